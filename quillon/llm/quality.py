"""Quality classifier with hierarchical empirical Bayes.

Document evidence is a logistic regression on shares of byte-class pairs, word statistics and signed hashes of the
words and word pairs, fitted on at most ``FIT_ROWS`` labelled documents (those with the smallest seeded hash).  Sites form a hierarchy: all documents, host
(``source``), path below the host (``lang``).  Grouped aggregation sums the evidence of every document of a host and of
a path.  Host rates have a beta prior around the global rate and path rates one around their host's posterior, each
with a strength estimated by moments from the spread of the level's rates, so that sparse sites shrink towards what
is known above them.  A document's posterior odds are its own evidence times the prior odds of its path.

The evidence is the classifier's log-odds less those of the fitting sample, so the site's rate enters once.

Defined results: a null or empty text has the evidence of an empty document; null hosts and paths are sites of their
own; documents without a usable label take part in everything but the fit; without labels of both kinds the evidence
is 0 and every posterior the global rate; repeated rows count as often as they come; an empty table gives an empty
result; other columns are kept by :func:`score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, null_safe_join, quoted, staged
from quillon.llm.hashing import mix, word_hashes
from quillon.llm.tokens import joined, slices

#: Labelled documents the classifier is fitted on, at most.
FIT_ROWS = 20_000
SEED = 1729
#: A document is kept from this posterior on.
KEEP_FROM = 0.5
#: Up to so many paths the table of site posteriors is sent to all tasks; beyond, it is joined by shuffling, with the same rows.
BROADCAST_SITES = 50_000
STRENGTHS = (1.0, 1000.0)

_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)  # white space and control 0, lower 1, upper 2, digit 3, marks 4-8, beyond ASCII 9
_CLASS[:33] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _marks, _kind in ((b".,;:'\"-()", 4), (b"!?", 5), (b"#$%&*@^~", 6), (b"|<>{}[]/\\=+_`", 7)):
    _CLASS[list(_marks)] = _kind
_CLASS[10] = 8
#: Cells that words and word pairs are hashed to, and their ridge a row, which lets them speak only where labels are many.
GRAMS, GRAM_RIDGE = 64, 0.3
N_SHAPES = _CLASSES * _CLASSES + 7
N_FEATURES = N_SHAPES + GRAMS


def features(texts: pa.Array) -> np.ndarray:
    """A row per text: shares of byte-class pairs, statistics of words and lines, and hashed words and word pairs."""
    raw, offsets = joined(texts)
    return np.hstack([_shapes(raw, offsets), _grams(raw, offsets)])


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed counts of words and word pairs in GRAMS cells, over the root of the number of words."""
    n = len(offsets) - 1
    word, _, _, text = word_hashes(raw, offsets)
    both = text[1:] == text[:-1]
    h = mix(np.concatenate([word, (word[:-1] * np.uint64(3) + word[1:])[both]]))
    text = np.concatenate([text, text[1:][both]])
    sign = (h >> np.uint64(63)).astype(float) * 2 - 1
    counts = np.bincount(text * GRAMS + (h % np.uint64(GRAMS)).astype(np.int64), sign, n * GRAMS).reshape(n, GRAMS)
    return counts / np.sqrt(np.maximum(1, np.bincount(text, minlength=n)))[:, None]


def _shapes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, N_SHAPES))
    out[:, -1] = np.log1p(1)  # a text without line ends is one line
    size = np.diff(offsets).astype(float)
    if len(raw):
        kind = _CLASS[raw].astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))
        pair = kind[:-1] * _CLASSES + kind[1:]
        same = row[1:] == row[:-1]
        count = np.bincount(row[1:][same] * _CLASSES**2 + pair[same], minlength=n * _CLASSES**2).reshape(n, -1)
        out[:, : _CLASSES**2] = np.sqrt(count / np.maximum(1.0, size - 1)[:, None])
        gap = (kind == 0) | (kind == 8)
        first = ~gap & np.concatenate([[True], gap[:-1] | ~same])
        words = np.bincount(row[first], minlength=n)
        lines = np.bincount(row[kind == 8], minlength=n) + 1
        at = np.flatnonzero(first)
        capital = np.bincount(row[at[_CLASS[raw[at]] == 2]], minlength=n)
        # Repeated words: those that begin with the same four bytes as another, or as the one before.
        quad = np.append(raw, np.zeros(3, np.uint8))
        end = offsets[row[at] + 1]
        head = sum(np.where(at + k < end, quad[at + k], 0).astype(np.int64) << (8 * k) for k in range(4))
        order = np.lexsort((head, row[at]))
        again = (head[order][1:] == head[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
        repeats = np.bincount(row[at][order][1:][again], minlength=n)
        some = np.maximum(1, words)
        runs = np.bincount(row[at][1:][(head[1:] == head[:-1]) & (row[at][1:] == row[at][:-1])], minlength=n)
        out[:, -7:] = np.stack([runs / some, np.log1p(words), size / some / 10, capital / some, repeats / some, np.log1p(words / lines), np.log1p(lines)], 1)
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    base: float  # log-odds of the fitting sample

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias - self.base, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> Classifier:
    """Ridge logistic regression by Newton's method; no evidence at all where only one kind is labelled."""
    good = y.mean() if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    if not 0 < good < 1:
        return Classifier(mean, scale, np.zeros(N_FEATURES), 0.0, 0.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.concatenate([np.full(N_SHAPES, ridge * len(x) + 1e-2), np.full(GRAMS, GRAM_RIDGE * len(x) + 1e-2), [1e-3]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        curve, h = np.diag(penalty), p * (1 - p) + 1e-6
        for at in range(0, len(z), 2000):  # the driver holds one copy of the rows, not two
            part = z[at : at + 2000]
            curve += (part * h[at : at + 2000, None]).T @ part
        move = np.linalg.solve(curve, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]), float(np.log(good / (1 - good))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on the labelled documents with the smallest hash of their id, at most *fit_rows*; rates ignore the bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(fit_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                x = features(texts.slice(a, b - a)).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    got = chosen.select("doc_id", "y", "text").transform(map_arrow, rows, "doc_id long, y int, x binary").orderBy("doc_id", "x").limit(fit_rows).collect()
    x = np.frombuffer(b"".join(r["x"] for r in got), "<f4").reshape(len(got), N_FEATURES).astype(float)
    return fit(x, np.array([r["y"] for r in got], float))


def with_evidence(docs: DataFrame, model: Classifier, text: str = "text", out: str = "evidence") -> DataFrame:
    """*docs*, all columns, with the log-odds that each document's own text gives."""
    names = docs.columns
    plain = [f"_{k}" for k in range(len(names) + 1)]  # mapInArrow takes no names with dots

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.evidence(features(texts.slice(a, b - a))))], names=plain)

    renamed = docs.toDF(*plain[:-1])
    return renamed.transform(map_arrow, rows, renamed.withColumn(plain[-1], F.lit(0.0)).schema).toDF(*names, out)


def _strength(groups: DataFrame, rate, n) -> float:
    """How many documents the prior of this level weighs: by moments, from the spread of the rates of its groups."""
    mid = F.sum(rate * n) / F.sum(n)
    m, total, k, squares = groups.agg(mid, F.sum(n), F.count(F.lit(1)), F.sum(n * n)).first()
    if not total or k < 2 or not 0 < m < 1:
        return STRENGTHS[1]
    spread = groups.agg(F.sum(n * (rate - m) * (rate - m))).first()[0]
    between = (spread - (k - 1) * m * (1 - m)) / (total - squares / total)
    return float(np.clip(m * (1 - m) / between - 1 if between > 0 else STRENGTHS[1], *STRENGTHS))


def site_posteriors(evidence: DataFrame, rate: float) -> DataFrame:
    """*evidence* (host, path, evidence of each document) -> host, path, documents, host_rate, path_rate.

    A document counts towards its site by the probability that its evidence gives at the global *rate*.
    """
    odds = float(np.log(rate / (1 - rate)))
    p = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
    paths = staged(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("good")), "site-paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "site-hosts")
    mean = hosts.agg(F.sum("host_good") / F.sum("host_n")).first()[0]
    mean = float(np.clip(rate if mean is None else mean, 1e-3, 1 - 1e-3))
    a = _strength(hosts, F.col("host_good") / F.col("host_n"), F.col("host_n"))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + a * mean) / (F.col("host_n") + a))
    b = _strength(paths, F.col("good") / F.col("n"), F.col("n"))
    sites = null_safe_join(paths, hosts.select("host", "host_rate"), ["host"])
    return sites.select("host", "path", F.col("n").cast("long").alias("documents"), "host_rate", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_from: float = KEEP_FROM, without_text: bool = False) -> DataFrame:
    """*docs*, all columns, with evidence, host_rate, path_rate, quality and kept, each named ``_quillon_...``.

    Without the text, the evidence of each document is found once and written beside its columns; with it, whole texts
    are not written again for that: evidence is found for the sites and once more for the documents.
    """
    model = train(docs, labels)
    rate = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    rate = float(np.clip(0.5 if rate is None else rate, 1e-3, 1 - 1e-3))
    keys = ["_quillon_host", "_quillon_path"]
    named = docs.withColumns({"_quillon_text": F.col("text").cast("string"), keys[0]: F.col(host).cast("string"), keys[1]: F.col(path).cast("string")})
    if without_text:
        named = named.drop("text")
    seen = with_evidence(named, model, "_quillon_text", "_quillon_evidence").drop("_quillon_text")
    if without_text:
        seen = staged(seen, "evidence")
    light = seen if without_text else with_evidence(named.select(*keys, "_quillon_text"), model, "_quillon_text", "_quillon_evidence")
    evidence = light.select(*[F.col(k).alias(c) for k, c in zip((*keys, "_quillon_evidence"), ("host", "path", "evidence"))])
    sites = site_posteriors(evidence, rate).select(F.col("host").alias(keys[0]), F.col("path").alias(keys[1]), F.col("host_rate").alias("_quillon_host_rate"), F.col("path_rate").alias("_quillon_path_rate"))
    sites = staged(sites, "sites")
    few = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    judged = null_safe_join(seen, F.broadcast(sites) if few else sites, keys).drop(*keys)
    odds = F.col("_quillon_evidence") + F.log(F.col("_quillon_path_rate") / (1 - F.col("_quillon_path_rate")))
    return judged.withColumn("_quillon_quality", 1 / (1 + F.exp(-odds))).withColumn("_quillon_kept", F.col("_quillon_quality") >= keep_from)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, evidence, host_rate, path_rate, quality, kept."""
    slim = docs.select("doc_id", "text", "source", "lang")
    return score(slim, labels, without_text=True, **options).select(
        "doc_id", F.col("_quillon_evidence").alias("evidence"), F.col("_quillon_host_rate").alias("host_rate"), F.col("_quillon_path_rate").alias("path_rate"), F.col("_quillon_quality").alias("quality"), F.col("_quillon_kept").alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    return score(docs, labels, **options).where("_quillon_kept").select(*quoted(docs.columns))
