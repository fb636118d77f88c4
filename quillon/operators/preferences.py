"""Preference pairs from chat messages: rendering, splitting, filtering, unpairing, reversing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import let

# The chat markup and the length limits.
START, END = "<|im_start|>", "<|im_end|>"
HEADER = START + "assistant"
MAX_PROMPT_TOKENS = 2048
MAX_SEQ_LENGTH = 2048
TOKEN = r"[^\s]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_messages(messages: str | Column) -> Column:
    """Role and content alone; missing content is empty."""
    return F.transform(col(messages), lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def render(messages: str | Column) -> Column:
    """The messages as one chat string."""
    return F.array_join(F.transform(plain_messages(messages), lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")


def completion(chat: str | Column) -> Column:
    """What follows the last assistant header; null without one."""
    chat = col(chat)
    return F.when(F.contains(chat, F.lit(HEADER)), F.substring_index(chat, HEADER, -1))


def prompt(chat: str | Column) -> Column:
    """Everything up to the last assistant header and the header itself; null without one."""
    chat = col(chat)
    return F.substring(chat, F.lit(1), F.length(chat) - F.length(completion(chat)))


def required(split: Column, chat: Column) -> Column:
    """*split*, or an error that names the fault: for callers that must not lose rows silently."""
    return F.when(split.isNull() & chat.isNotNull(), F.raise_error(F.lit("chat without an assistant header"))).otherwise(split)


def format_pairs(pairs: DataFrame, reverse: bool = False, strict: bool = False) -> DataFrame:
    """idx, prompt (of the chosen side), chosen, rejected from two message lists; P5 with *reverse*.

    Pairs without a header on either side have a null there; with *strict* they raise.
    """
    sides = ("rejected", "chosen") if reverse else ("chosen", "rejected")
    chats = pairs.select("idx", render(sides[0]).alias("_c"), render(sides[1]).alias("_r"))
    ends = [completion("_c"), completion("_r")]
    if strict:
        ends = [required(e, F.col(c)) for e, c in zip(ends, ("_c", "_r"))]
    return chats.select("idx", prompt("_c").alias("prompt"), ends[0].alias("chosen"), ends[1].alias("rejected"))


def unpair(pairs: DataFrame) -> DataFrame:
    """Each pair as two rows, the chosen completion labelled true, the other false."""
    sides = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    return pairs.select("idx", "prompt", F.explode(sides).alias("_s")).select("idx", "prompt", "_s.completion", "_s.label")


def n_tokens(text: str | Column) -> Column:
    """Tokens by the surrogate tokenizer, runs without white space."""
    return F.regexp_count(col(text), F.lit(TOKEN))


def skip_reason(pairs: str = "") -> Column:
    """Why a pair is unusable, or null (F1, F2)."""
    return (
        F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), F.lit("no_header"))
        .when(n_tokens("chosen") == 0, F.lit("empty_chosen"))
        .when(n_tokens("rejected") == 0, F.lit("empty_rejected"))
        .when(n_tokens("prompt") >= MAX_PROMPT_TOKENS, F.lit("long_prompt"))
    )


def filter_degenerate(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable pairs, and the others with their reason."""
    judged = pairs.withColumn("reason", skip_reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def last_message(messages: str | Column, role: str | None = None) -> Column:
    """The content of the last message (of a role); null if there is none."""
    found = plain_messages(messages)
    if role:
        found = F.filter(found, lambda m: m["role"] == role)
    return F.try_element_at(found, F.lit(-1))["content"]


def last_match(ids: str | Column, header: list[int]) -> Column:
    """Where the last match of *header* in *ids* ends, null without one: one pass over the ids.

    The state is how much of the header the ids so far end with.  Its next value for each id of the header is a table of the
    plan, made from the header's own prefixes; any other id leads back to nothing.
    """
    if not header:
        raise ValueError("an empty header")
    known, m = list(dict.fromkeys(header)), len(header)
    ends = lambda seen: max(k for k in range(m + 1) if k <= len(seen) and seen[len(seen) - k :] == header[:k])
    table = F.array(*[F.array(*[F.lit(ends(header[:k] + [x])) for x in known]) for k in range(m + 1)])
    tokens = F.array(*[F.lit(x) for x in known])

    def step(s: Column, x: Column) -> Column:
        place = F.coalesce(F.array_position(tokens, x), F.lit(0))
        k = F.when(place == 0, F.lit(0)).otherwise(F.get(F.get(table, s["k"]), (place - 1).cast("int")))
        return F.struct((s["i"] + 1).alias("i"), k.alias("k"), F.when(k == m, s["i"] + 1).otherwise(s["last"]).alias("last"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(col(ids), start, step)["last"]


def split_ids(ids: str | Column, header: list[int], max_len: int) -> Column:
    """(comp_start, completion_ids) at the last match of *header*; null without a match, or where it leaves no room.

    A chat that ends with the header has an empty completion, not a null one.
    """
    ids = col(ids)

    def split(start: Column) -> Column:
        room = F.least(F.size(ids) - start, F.lit(max_len) - start)
        fits = (F.size(ids) <= max_len) | (room > 0)
        return F.when(start.isNotNull() & fits, F.struct(start.alias("comp_start"), F.slice(ids, start + 1, F.greatest(room, F.lit(0))).alias("completion_ids")))

    return let(last_match(ids, header), split)


def label_mask(ids: str | Column, comp_start: str | Column, ignore: int = -100) -> Column:
    """*ignore* over the prompt, the ids after it."""
    ids, start = col(ids), col(comp_start)
    return F.concat(F.array_repeat(F.lit(ignore), start), F.slice(ids, start + 1, F.size(ids)))


def pad_left(ids: str | Column, to: str | Column, pad: int = 0) -> Column:
    """*pad* in front, up to the length *to* of the batch."""
    ids = col(ids)
    return F.concat(F.array_repeat(F.lit(pad), col(to) - F.size(ids)), ids)


def available(base: DataFrame, products: DataFrame, required_directions: list[str]) -> DataFrame:
    """Examples that have every required direction."""
    have = products.where(F.col("direction").isin(required_directions)).groupBy("idx").agg(F.count_distinct("direction").alias("_n"))
    return base.join(have.where(F.col("_n") == len(set(required_directions))), "idx", "left_semi")


def coverage(base: DataFrame, done: DataFrame, key: str = "idx", first: int = 5) -> DataFrame:
    """How many of *base* are done, and the first gaps."""
    joined = base.select(key).join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    counts = joined.agg(F.count(F.lit(1)).alias("n_base"), F.count("_done").alias("n_done"))
    gaps = joined.where("_done is null").orderBy(key).limit(first).agg(F.array_sort(F.collect_list(key)).alias("first_gaps"))
    return counts.crossJoin(gaps).withColumn("n_missing", F.col("n_base") - F.col("n_done"))


def shifted(values: str | Column, by: int = 1) -> Column:
    """The values without the first *by*, as labels, masks and weights stand beside the logits that predict them."""
    return F.slice(col(values), 1 + by, F.greatest(F.lit(0), F.size(col(values)) - by))


def last_true(mask: str | Column) -> Column:
    """The last index whose mask holds; the last index of all where none does."""
    m = col(mask)
    return F.coalesce(F.array_max(F.filter(F.transform(m, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())), F.size(m) - 1)


def upstream_filter(docs: DataFrame, language: str = "en", most: int = 8000) -> DataFrame:
    """single texts of one language of at most *most* characters."""
    return docs.where((F.col("lang") == language) & (F.length("text") <= most))


def frozen(df: DataFrame, indices: DataFrame, key: str = "idx") -> DataFrame:
    """The rows that a stored list of ids names."""
    return df.join(indices.select(key).distinct(), key, "left_semi")


def zipped(df: DataFrame, *names: str) -> DataFrame:
    """Arrays that are aligned by position, a row (i, values) for each place; uneven lengths raise."""
    sizes = F.array(*[F.size(n) for n in names])
    even = F.when(F.array_min(sizes) != F.array_max(sizes), F.raise_error(F.lit("arrays of uneven length"))).otherwise(F.arrays_zip(*names))
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.posexplode(even).alias("i", "_z")).select(*rest, "i", *[F.col(f"_z.{n}").alias(n) for n in names])
