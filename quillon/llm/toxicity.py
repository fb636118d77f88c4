"""Toxicity of texts whose words may be disguised: a noisy channel is undone, then the restored words are scored.

Someone who writes ``1d10t``, ``i d i o t`` or ``idiooot`` means a word and sends it through a channel that swaps letters
for signs that look like them, spaces letters out or repeats them.  A token that may have gone through it becomes a
lattice of the strings each of its signs may stand for, and the best path is found by the Viterbi algorithm: cost of
the channel plus cost under a language model of letters, states being the last two letters.  The model counts letter
triples of all documents, by task, merged by Spark; the table is bounded by its alphabet.

Restored words and their beginnings are features.  At most FIT_ROWS labelled documents that are not held out (those of the
least seeded hashes, where there are more) count for their features' log-odds; counts are summed by Spark, and the LEXICON
strongest toxic features are kept.  A document's score is a logistic function of its strongest word and of the sum of all,
fitted on at most CURVE_ROWS of these documents, each with its own label taken out of the counts that it is judged by.

Defined results: a null or empty text has no words and the score of such documents; a null id is held out, as the crc32
of nothing is 0; labels other than 0 and 1 are ignored, of several for one id the least counts; with labels of one kind
or none every score is the rate of toxic labels (one half without any), bounded to RATES; repeated rows are scored alike;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow
from quillon.llm.tokens import slices

#: Labelled documents that features are learnt from, those of them that the logistic function is fitted on, and features kept, at most.
FIT_ROWS, CURVE_ROWS, LEXICON = 100_000, 20_000, 65_536
#: Toxic documents that a feature needs, and its least log-odds.
LEAST_TOXIC, LEAST_ODDS = 3, 1.0
SEED, HELD_OUT = 1729, 5
RATES = (1e-3, 1 - 1e-3)
SLICE_BYTES = 4 << 20
#: Tokens whose restored form, and features whose counts, a task holds at most.
CACHE = 400_000

#: Letters of the model: none, a to z, and all others in OTHERS cells.
OTHERS = 37
SYMBOLS = 27 + OTHERS

# Signs that stand for letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "£": "l",
}
#: Costs of the channel, in nats: a run of signs for letters, a repeated letter, two of a repeated letter, a gap that is none, a gap between single letters, a sign without meaning, a sign that means itself, a masked letter.
SWAP, REPEAT, DOUBLE, LOST_GAP, GAP, NOISE, ITSELF, MASK = 1.0, 0.7, 1.0, 0.8, 2.5, 4.0, 8.0, 3.3
_GAPS = " .-_*·~,"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1*", re.S)
_DECORATION = re.compile(r"([^\w\s])\1{2,}")
_EDGES = ".,;:?()\"'[]{}<>«»“”¿¡"
_SPACED = re.compile(r"(?:\S[.\-_*·~,]){2,}\S")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SIGN = re.compile("[" + re.escape("".join(LOOKS) + "*") + "]")


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x3000, np.int64)
    for p in range(len(table)):
        if chr(p).isalpha():
            table[p] = p - 96 if 97 <= p < 123 else 27 + p % OTHERS
    table[-1] = 27  # all beyond
    return table


_TABLE = _symbol_table()


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each triple of symbols comes in the lowered texts of all *docs*."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                lowered = pc.utf8_lower(pc.fill_null(batch.column(0).slice(a, b - a).cast(pa.large_string()), ""))
                s = _symbols("  ".join(["", *lowered.to_pylist(), ""]))
                # Two symbols before a word are none; so a letter after a gap has no memory of the word before.
                before = np.where(s[1:-1] == 0, 0, s[:-2])
                found += np.bincount((before * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["triple", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).transform(map_arrow, count, "triple long, n long")
    out = np.zeros(SYMBOLS**3)
    for r in parts.groupBy("triple").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS ** 3 rows
        out[r["triple"]] = r["n"]
    return out


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first two), from triples, pairs and single symbols in fixed shares."""
    triples = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs, single = triples.sum(0), triples.sum((0, 1))
    one = (single + 1) / (single.sum() + SYMBOLS)
    two = (pairs + 5 * one) / (pairs.sum(1, keepdims=True) + 5)
    three = (triples + 5 * two[None]) / (triples.sum(2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of equal signs of a lowered token may stand for: (letters or a gap, cost of the channel)."""
    out = []
    for m in _RUN.finditer(token):
        sign, n = m[1], len(m[0])
        if sign.isalpha():
            out.append([(sign, 0.0)] if n == 1 else [(sign * 2, 0.0 if n == 2 else DOUBLE), (sign, REPEAT)])
            continue
        options = {" ": ITSELF if sign in LOOKS else NOISE}
        for letter in LOOKS.get(sign, ""):
            options[letter * n] = SWAP + (0.0 if n < 3 else DOUBLE)
            if n > 1:
                options[letter] = SWAP + REPEAT
            if n > 2:
                options[letter * 2] = SWAP + DOUBLE
        if sign in _GAPS:
            options[" "] = GAP
            options[""] = LOST_GAP
        elif sign in LOOKS and not sign.isdigit():
            options[""] = NOISE
        if sign == "*" and n == 1:
            options |= dict.fromkeys(_LETTERS, MASK)
        out.append(list(options.items()))
    return out


def decode(token: str, costs: np.ndarray) -> str:
    """The letters of the cheapest path through the lattice of *token*; of equally cheap ones the first by its letters."""
    states = {(0, 0): (0.0, "")}
    for options in [*lattice(token), [(" ", 0.0)]]:
        new: dict = {}
        for (p, q), (so_far, letters) in states.items():
            for emitted, cost in options:
                a, b, total = p, q, so_far + cost
                for c in emitted:
                    s = int(_symbols(c)[0])
                    if s or b:  # a gap after a gap says nothing
                        total += float(costs[a, b, s])
                    a, b = (b, s) if s else (0, 0)
                best = new.get((a, b))
                found = (total, letters + emitted)
                if best is None or found < best:
                    new[a, b] = found
        states = new
    return " ".join(min(states.values())[1].split())


def suspicious(token: str) -> str | None:
    """The part of a lowered token that may be disguised, or None."""
    token = _DECORATION.sub(" ", token).strip().strip(_EDGES)
    if len(token) < 3 or not _WORD.search(token):
        return None
    inner = token.rstrip("!")
    if _SIGN.search(inner) or _TRIPLE.search(inner) or _SPACED.fullmatch(inner):
        return inner
    return None


@dataclass
class Restorer:
    """Restored forms of tokens, each found once."""

    costs: np.ndarray
    known: dict[str, str] = field(default_factory=dict)

    def token(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            hidden = suspicious(token)
            found = token if hidden is None else decode(hidden, self.costs)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = found
        return found

    def span(self, signs: str) -> str:
        """Single signs with gaps between."""
        return decode(signs, self.costs) if _WORD.search(signs) else signs


def _tokens(texts: pa.Array, restore: Restorer) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, place in the third) of the distinct restored tokens of each of *texts*."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(lowered)
    starts = lists.offsets.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    coded = lists.flatten().dictionary_encode()
    code, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    names = kinds.to_pylist()
    alone = (pc.utf8_length(kinds).to_numpy(zero_copy_only=False) == 1)[code] if len(code) else np.zeros(0, bool)
    # Runs of three and more single signs in one text.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alone, [0]]).astype(np.int8) != 0)) if len(alone) else np.zeros(0, np.int64)
    spans_doc, spans = [], []
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a < 3:
            continue
        for d in np.unique(doc[a:b]):
            inside = code[a:b][doc[a:b] == d]
            if len(inside) > 2:
                spans_doc.append(d)
                spans.append(restore.span(" ".join(names[k] for k in inside)))
    words = [restore.token(t) for t in names]
    used = np.unique(doc * max(1, len(names)) + code)
    return np.concatenate([used // max(1, len(names)), np.array(spans_doc, np.int64)]), np.concatenate([used % max(1, len(names)), len(names) + np.arange(len(spans))]), words + spans


def features(restored: str) -> list[str]:
    """A restored token's words and the beginnings of longer ones; a very long word by its head and length."""
    out = []
    for w in _WORD.findall(restored):
        n = len(w)
        if n > 2:
            out.append(w if n <= 32 else f"{w[:32]}:{n}")
            out += [w[:k] + "*" for k in (4, 5, 6) if n > k]
    return out


def restore_texts(docs: DataFrame, costs: np.ndarray, text: str = "text", out: str = "restored") -> DataFrame:
    """*docs*, all columns, with the lowered text whose disguised tokens are restored, single spaces between."""
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(costs)
        for batch in batches:
            found = []
            for t in batch.column(names.index(text)).to_pylist():
                tokens, kept, k = (t or "").lower().split(), [], 0
                while k < len(tokens):
                    end = k
                    while end < len(tokens) and len(tokens[end]) == 1:
                        end += 1
                    if end - k > 2:
                        kept.append(restore.span(" ".join(tokens[k:end])))
                        k = end
                    else:
                        kept.append(restore.token(tokens[k]))
                        k += 1
                found.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, out])

    return docs.transform(map_arrow, rows, docs.withColumn(out, F.lit("")).schema)


def feature_counts(labelled: DataFrame, costs: np.ndarray) -> DataFrame:
    """*labelled* (text, y) -> feature, toxic, clean: documents of either kind that hold the feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, found = Restorer(costs), [Counter(), Counter()]

        def flushed():
            keys = list(found[0].keys() | found[1].keys())
            columns = [pa.array(keys, pa.string()), *[pa.array([found[y][k] for k in keys], pa.int64()) for y in (1, 0)]]
            for c in found:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

        for batch in batches:
            texts, y = batch.column("text"), batch.column("y").to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE_BYTES):
                doc, at, words = _tokens(texts.slice(a, b - a), restore)
                of = [features(w) for w in words]
                order = np.argsort(doc, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                    if len(part):
                        found[int(y[a + doc[part[0]]])].update({f for k in at[part] for f in of[k]})
                if len(found[0]) + len(found[1]) > CACHE:
                    yield flushed()
        yield flushed()

    parts = labelled.select("text", "y").transform(map_arrow, count, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Model:
    costs: np.ndarray
    counts: dict[str, tuple[int, int]]  # documents of either kind that hold a feature
    n_toxic: int
    n_clean: int
    weights: tuple[float, float, float]  # of the strongest word, of all words, and the bias

    def odds(self, feature: str, toxic: int, clean: int) -> float:
        """Log-odds of a feature, less one document of the given kind."""
        t, c = self.counts.get(feature, (0, 0))
        t, c = t - toxic, max(0, c - clean)
        if t < 1:
            return 0.0
        return max(0.0, math.log((t + 0.5) / (self.n_toxic - toxic + 1)) - math.log((c + 0.5) / (self.n_clean - clean + 1)))

    def evidence(self, texts: pa.Array, restore: Restorer, y: np.ndarray | None = None, cache: dict | None = None) -> np.ndarray:
        """A row per text: its strongest word's log-odds, and the root of the sum over its distinct words."""
        doc, at, words = _tokens(texts, restore)
        cache = {} if cache is None else cache
        out = np.zeros((len(texts), 2))
        kinds = (None,) if y is None else (0, 1)
        for kind in kinds:
            odds = np.zeros(len(words))
            for k, w in enumerate(words):
                key = (w, kind)
                found = cache.get(key)
                if found is None:
                    found = max((self.odds(f, int(kind == 1), int(kind == 0)) for f in features(w) if f in self.counts), default=0.0)
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[key] = found
                odds[k] = found
            mine = slice(None) if y is None else y[doc] == kind
            if len(doc):
                np.maximum.at(out[:, 0], doc[mine], odds[at[mine]])
                np.add.at(out[:, 1], doc[mine], odds[at[mine]])
        out[:, 1] = np.sqrt(out[:, 1])
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array(self.weights[:2]) + self.weights[2], -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Weights and bias by Newton's method; columns of *x* are positive and never speak for a clean text."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(3), np.array([ridge, ridge, 1e-6]) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad, curve = z.T @ (p - y) + penalty * w, (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(curve, grad)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def held_out(id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def _at_most(known: DataFrame, rows: int) -> DataFrame:
    """*known*, or about *rows* of it and never more: those whose seeded hash is below a share of all hashes."""
    n = known.count()
    if n <= rows:
        return known
    share = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return known.where(share < 0.98 * rows / n).limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The letter model of all *docs*, the features of all labelled rows that are not held out, and the logistic function."""
    costs = letter_costs(letter_counts(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = _at_most(known.groupBy("doc_id").agg(F.min("y").alias("y")).where(~held_out()), fit_rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = slim.join(F.broadcast(known), "doc_id")  # at most fit_rows ids
    sums = labelled.groupBy("y").count().collect()
    n = defaultdict(int, {r["y"]: r["count"] for r in sums})
    total = n[0] + n[1]
    if not n[0] or not n[1]:
        rate = min(max(n[1] / total if total else 0.5, RATES[0]), RATES[1])
        return Model(costs, {}, n[1], n[0], (0.0, 0.0, math.log(rate / (1 - rate))))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    strong = feature_counts(labelled, costs).withColumn("odds", odds).where((F.col("toxic") >= LEAST_TOXIC) & (F.col("odds") >= LEAST_ODDS))
    kept = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(LEXICON).collect()
    model = Model(costs, {r["feature"]: (r["toxic"], r["clean"]) for r in kept}, n[1], n[0], (1.0, 0.0, 0.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, cache = Restorer(model.costs), {}
        for batch in batches:
            texts, y = batch.column("text"), batch.column("y")
            for a, b in slices(texts, SLICE_BYTES):
                x = model.evidence(texts.slice(a, b - a), restore, y.slice(a, b - a).to_numpy(zero_copy_only=False), cache)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), y.slice(a, b - a), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "y", "strongest", "all"])

    few = slim.join(F.broadcast(_at_most(known, CURVE_ROWS)), "doc_id").transform(map_arrow, rows, "doc_id long, y int, strongest double, all double")
    got = few.limit(4 * CURVE_ROWS).toPandas().sort_values(["doc_id", "strongest", "all"])  # documents may share an id
    model.weights = logistic(got[["strongest", "all"]].to_numpy(), got["y"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    model = model or train(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, cache = Restorer(model.costs), {}
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE_BYTES):
                found = model.score(model.evidence(texts.slice(a, b - a), restore, cache=cache))
                columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return slim.transform(map_arrow, rows, "doc_id long, held_out boolean, score double, predicted int")
