"""Queries of scans, sinks, incremental runs and audits: each writes tables in the shared folder and reads them back."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from quillon.functions.hashing import hash32
from quillon.functions.vectors import at_least, cosine, dot, norm
from quillon.operators import directions, identity, inspection, preferences
from quillon.plans.registry import query, round_columns as _round, union as _union
from quillon.plans.surrogates import DIM, centroids, chat_pairs, mean_direction, own_directions, sketches, table
from quillon.sources import tables
from quillon.streaming import incremental


@query
def q60_scan_dataset(spark, sf):
    """Message pairs written as JSON, scanned with the engine's schema, the first rows by key."""
    path = tables.workspace(spark, "pairs")
    chat_pairs(spark, sf).write.json(path)
    return tables.first_rows(tables.scan(spark, path, "pairs_raw", "json"), 25).select("idx", F.size("chosen").alias("n_chosen"), F.size("rejected").alias("n_rejected"), F.get("chosen", F.lit(0))["role"].alias("first_role"))


@query
def q61_scan_shards(spark, sf):
    """Shards of two weightings with repeated rows; one weighting is scanned, repeats are told."""
    path = tables.workspace(spark, "emb")
    s = sketches(spark, sf).select(F.col("vec_id").alias("idx"), F.col("raw").alias("emb"), "gnorm")
    rows = s.unionByName(s.where("idx < 5")).withColumn("weighting", F.lit("w1")).unionByName(s.withColumn("weighting", F.lit("uw")))
    tables.write(rows, path, ["weighting"], max_rows=100)
    found, repeated = tables.scan_shards(spark, path, "w1")
    once = found.dropDuplicates(["idx"]).join(F.broadcast(repeated.withColumnRenamed("count", "n")), "idx", "left")
    return _round(once.select("idx", "gnorm", F.get("emb", F.lit(0)).alias("head"), F.coalesce("n", F.lit(1)).alias("n")), "gnorm", "head")


@query
def q62_cluster_runs(spark, sf):
    """The runs there are for a weighting, each scanned with its checks."""
    path = tables.workspace(spark, "assignments")
    s = sketches(spark, sf).select(F.col("vec_id").alias("idx"), "label")
    runs = [s.select("idx", (F.col("label") % k).alias("cluster")).withColumns({"weighting": F.lit(w), "n_clusters": F.lit(k)}) for k, w in ((10, "w1"), (5, "w1"), (2, "uw"))]
    tables.write(_union(runs), path, ["weighting", "n_clusters"])
    found = spark.read.parquet(path)
    each = [tables.scan_assignments(found, "w1", k) for k in tables.cluster_runs(found, "w1")]
    return _union(each).groupBy("n_clusters", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query
def q63_exact_norms(spark, sf):
    """The norm of every wanted id, none missing, all positive and finite."""
    path = tables.workspace(spark, "norms")
    s = sketches(spark, sf).select(F.col("vec_id").alias("idx"), "gnorm")
    tables.write(s, path)
    return _round(tables.exact_norms(spark.read.parquet(path), s), "gnorm")


@query
def q64_centroid_scan(spark, sf):
    """Centroids of two kinds, complete and of one dimension."""
    path = tables.workspace(spark, "centroids")
    s = sketches(spark, sf)
    rows = _union([centroids(s, kind).withColumns({"weighting": F.lit("w1"), "n_clusters": F.lit(10), "kind": F.lit(kind), "norm": norm("center")}) for kind in directions.KINDS])
    tables.write(rows, path, ["weighting", "n_clusters", "kind"])
    found = spark.read.parquet(path)
    each = [tables.scan_centroids(found, "w1", 10, kind, DIM) for kind in directions.KINDS]
    return _round(_union(each).select("kind", "k", "n_averaged", "norm", F.get("center", F.lit(0)).alias("head")), "norm", "head")


@query
def q65_token_products(spark, sf):
    """Every token against every direction, written by direction, scanned with the norms."""
    products, norms = tables.workspace(spark, "products"), tables.workspace(spark, "token-norms")
    s = sketches(spark, sf).withColumn("g_norm", norm("raw"))
    every = centroids(s).select(F.format_string("k%02d", F.col("k")).alias("direction"), "center").unionByName(mean_direction(s).select(F.lit("aggregated").alias("direction"), "center"))
    tables.write(directions.all_scores(s, every, "raw", "g_norm").select("idx", F.col("t").cast("int").alias("t"), "direction", "dot"), products, ["direction"])
    tables.write(s.select("idx", F.col("t").cast("int").alias("t"), "g_norm"), norms)
    own = every.select("direction", norm("center").alias("own"))
    met = tables.scan(spark, products, "token_products").join(tables.scan(spark, norms, "token_norms"), ["idx", "t"]).join(F.broadcast(own), "direction")
    return _round(met.select("idx", "t", "direction", "dot", cosine("dot", "g_norm", "own").alias("cos")), "dot", "cos")


@query
def q66_scalar_norms(spark, sf):
    """A sidecar of scalars, of which the numbers are kept."""
    path = tables.workspace(spark, "norms-json")
    s = sketches(spark, sf)
    own = s.agg(F.avg(norm("raw")).alias("single"), F.max(norm("raw")).alias("largest"))
    tables.write_json(mean_direction(s).select(norm("center").alias("aggregated"), F.lit("of unit vectors").alias("note")).crossJoin(own), path)
    text = "".join(r[0] for r in spark.read.text(path).collect())  # one line
    return _round(tables.scalar_norms(spark, text), "norm")


@query
def q67_complete_examples(spark, sf):
    """The first examples in the order of their names whose metadata parses and that have all artefacts."""
    s = sketches(spark, sf).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    broken = F.when(F.col("idx") % 7 == 3, F.lit('{"n": ')).otherwise(F.to_json(F.struct("n")))
    rows = s.select(F.format_string("example_%05d", F.col("idx")).alias("name"), broken.alias("metadata"), F.when(F.col("idx") % 5 != 0, F.col("n")).alias("products"), F.col("n").alias("norms"))
    return tables.first_complete(rows, ["products", "norms"], 20, "name").select("name", "products")


@query
def q68_length_mismatch(spark, sf):
    """examples whose number of tokens agrees with the saved norms, and the others."""
    s = sketches(spark, sf).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    same, other = tables.same_length(s.withColumn("saved", F.col("n") - (F.col("idx") % 4 == 0).cast("int")), "n", "saved")
    return same.select("idx", F.lit(True).alias("kept")).unionByName(other.select("idx", F.lit(False).alias("kept")))


@query
def q69_frozen_subset(spark, sf):
    """A stored list of ids and the rows that it names."""
    path = tables.workspace(spark, "indices")
    s = sketches(spark, sf).select(F.col("vec_id").alias("idx"), "label")
    tables.write_json(s.where(hash32("idx", "frozen") % 3 == 0).agg(F.array_sort(F.collect_list("idx")).alias("indices")), path)
    return preferences.frozen(s, spark.read.schema("indices array<bigint>").json(path).select(F.explode("indices").alias("idx")))


@query
def q70_versions(spark, sf):
    """Two versions of a table side by side, and an appended log of metrics."""
    path, log = tables.workspace(spark, "versions"), tables.workspace(spark, "metrics")
    s = sketches(spark, sf).select(F.col("vec_id").alias("idx"), "gnorm")
    tables.append_version(s, path)
    tables.append_version(s.where("idx >= 100"), path)
    for step, mode in ((1, "train"), (2, "eval")):
        tables.append_metrics(s.agg(F.avg("gnorm").alias("value")).select(F.lit(step).alias("step"), F.lit(mode).alias("mode"), F.lit("norm").alias("key"), (F.col("value") * step).alias("value")), log)
    versions = spark.read.parquet(path).groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("gnorm").alias("total"))
    logged = tables.scan(spark, log, "metrics").groupBy("step", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return _round(versions.select(F.concat(F.lit("version "), F.col("version").cast("string")).alias("what"), "n", "total").unionByName(logged.select(F.concat_ws(" ", "mode", "step").alias("what"), "n", "total")), "total")


@query
def q71_html_report(spark, sf):
    """The page of a clustering; its rows read back from the page, which holds no open markup of the data."""
    s = sketches(spark, sf)
    rows = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile("gnorm", 0.5).alias("median_norm")).withColumn("name", F.concat(F.lit("</script><b>"), F.col("label").cast("string")))
    page = inspection.html_report(rows, "Clusters <of> A & B")
    data = json.loads(re.search(r"const rows=(\[.*?\]);const cells", page, re.S)[1])
    escaped = "<of>" not in page and "</script><b>" not in page and "Clusters &lt;of> A &amp; B" in page
    found = spark.createDataFrame([(r["name"], r["n"], float(r["median_norm"]), escaped) for r in data], "name string, n bigint, median_norm double, escaped boolean")
    return _round(found, "median_norm")


@query
def q72_display_texts(spark, sf):
    """Prompt and last messages, cut for display."""
    last = preferences.last_message
    cut = lambda c: F.left(c, F.lit(inspection.DISPLAY_CHARS))
    return chat_pairs(spark, sf).select("idx", cut(last("chosen", "user")).alias("prompt"), cut(last("chosen")).alias("chosen"), cut(last("rejected")).alias("rejected"))


@query
def q73_key_difference(spark, sf):
    """Names that one side lacks, and the verdict on each name."""
    s = sketches(spark, sf).withColumn("name", F.col("label").cast("string"))
    saved = identity.fingerprint(s.where("label <> 7"), "name", "raw")
    now = identity.fingerprint(s.where("label <> 3").withColumn("raw", F.when(F.col("label") == 5, F.slice("raw", 1, 8)).otherwise(F.col("raw"))), "name", "raw")
    only = identity.key_difference(saved, now, "name").select("name", "only_in")
    return identity.verify(saved, now, "name").join(only, "name", "left").select("name", "status", "only_in")


@query
def q74_establish(spark, sf):
    """The first run saves its fingerprint, an equal one passes, a drifted one is told as advice; S15: same names."""
    path = tables.workspace(spark, "fingerprint")
    s = sketches(spark, sf).withColumn("name", F.col("label").cast("string"))
    drifted = s.withColumn("raw", F.when(F.col("label").isin(2, 4), F.transform("raw", lambda x: x * -1.01)).otherwise(F.col("raw")))
    out = []
    for run, df, policy in (("first", s, "fatal"), ("again", s, "fatal"), ("drifted", drifted, "advisory")):
        now = identity.fingerprint(df, "name", "raw")
        faults = identity.establish(now, path, "name", policy)
        identity.pinned(spark.read.parquet(path), now, "name")
        out.append(faults.select(F.lit(run).alias("run"), "name", "status"))
    return _union(out)


@query
def q75_sources(spark, sf):
    """The runs that artefacts come from; more than one is refused elsewhere."""
    s = sketches(spark, sf)
    parts = [s.select((F.col("label") % n).cast("string").alias("source_id")) for n in (1, 2, 3)]
    return identity.sources(parts)


@query
def q76_stream_resume(spark, sf):
    """Files that come in two lots, each processed once, the sink rewritten and verified."""
    source, sink, checkpoint = (tables.workspace(spark, x) for x in ("in", "out", "progress"))
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    runs = []
    for lot in (0, 1, None):
        if lot is not None:
            e.where(F.col("event_id") % 2 == lot).repartition(3, "event_id").write.mode("append").parquet(source)
        runs.append(incremental.run_incrementally(spark, source, e.schema, lambda df: df.withColumn("value", F.col("value") * 2), sink, checkpoint, files_per_batch=2))
    if runs != [2, 2, 0]:
        raise ValueError(f"batches of the runs: {runs}")
    whole = tables.workspace(spark, "whole")
    tables.rechunk(spark.read.parquet(sink).drop("batch"), whole, 1000, 2, key="event_id")
    return _round(spark.read.parquet(whole).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query
def q77_accumulate(spark, sf):
    """T3, T4, A4, N-8: sums by cluster kept as states of batches, merged to means."""
    source, sink, checkpoint = (tables.workspace(spark, x) for x in ("in", "states", "progress"))
    s = sketches(spark, sf).select("vec_id", "label", "u")
    for lot in (0, 1):
        s.where(F.col("vec_id") % 2 == lot).repartition(3, "vec_id").write.mode("append").parquet(source)
        state = incremental.accumulate(spark, source, s.schema, "label", "u", DIM, sink, checkpoint, files_per_batch=2)
    means = state.select(F.col("label").alias("k"), "n", F.transform("sum", lambda x: x / F.col("n")).alias("mean"))
    return _round(means.select("k", "n", F.posexplode("mean").alias("i", "value")), "value")


@query
def q118_state_accumulator(spark, sf):
    """Means under three weightings whose sums live in the state store; a run that goes on, and one whose layout has changed."""
    from quillon.plans.method_queries import WEIGHTINGS, token_weights

    source, sink, checkpoint = (tables.workspace(spark, x) for x in ("in", "sums", "progress"))
    s = token_weights(sketches(spark, sf)).select("vec_id", "label", "u", *WEIGHTINGS)
    weights, layout = {w: F.col(w) for w in WEIGHTINGS}, [("a", 40), ("b", DIM - 40)]
    run = lambda source, layout: incremental.accumulate_state(spark, source, s.schema, "label", "u", weights, layout, sink, checkpoint, files_per_batch=2)
    for lot in (0, 1):
        s.where(F.col("vec_id") % 2 == lot).repartition(3, "vec_id").write.mode("append").parquet(source)
        sums = run(source, layout)
    went_on = tables.staged(sums.select(F.lit("went on").alias("run"), *sums.columns), "went-on")  # the next run replaces what this reads
    half = tables.workspace(spark, "in")
    s.where("vec_id % 2 = 0").repartition(2, "vec_id").write.parquet(half)
    over = run(half, [("a", DIM)])
    both = went_on.unionByName(over.withColumn("run", F.lit("started over")))
    each = F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("v")) for w in WEIGHTINGS])
    long = both.select("run", "label", "n", "offset", F.explode(each).alias("w")).select("run", "label", "n", "w.weighting", F.posexplode("w.v").alias("i", "value"))
    return _round(long.withColumn("value", F.col("value") / F.col("n")), "value")


@query
def q119_bucketed_lookups(spark, sf):
    """Tokens, their examples' directions and norms, written by id once and looked up by id without a shuffle."""
    s = sketches(spark, sf)
    tokens = tables.write_bucketed(s.select("idx", "t", "raw"), "idx", 16, "tokens")
    own = tables.write_bucketed(own_directions(s).select("idx", "center"), "idx", 16, "own")
    norms = tables.write_bucketed(s.groupBy("idx").agg(F.max("gnorm").alias("top")), "idx", 16, "norms")
    both = tables.lookup(spark, tokens, own, "idx")
    met = both.join(spark.table(norms).hint("merge"), "idx")
    return _round(met.select("idx", "t", dot("raw", "center").alias("dot"), (dot("raw", "center") / at_least("top")).alias("scaled")), "dot", "scaled")


@query
def q78_run_names(spark, sf):
    """What a run was told, as the tags of its name."""
    configs = [tables.RunConfig(), tables.RunConfig(direction="maxclu_mean_K8"), tables.RunConfig(method="altcos", seed=7), tables.RunConfig(beta=0.05, dot_scale="unit", sum_mode="ignore")]
    return spark.createDataFrame([(k, c.name("dpo"), json.loads(c.to_json())["method"]) for k, c in enumerate(configs)], "i bigint, name string, method string")
