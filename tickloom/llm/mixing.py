"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words, stopped at ``most`` times its own size. Every document
first gets the whole copies that are certain, floor(target / size). What is missing is drawn without
replacement: documents are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)), and the
lowest are taken until the words are there. Inclusion odds are the source's missing share's odds
times the square root of the document's size over its source's mean, so longer texts, which fill
the target with fewer draws, are more likely.

What is known per source is stored before documents meet it: Spark then sees its size, and either broadcasts
it under its own limit or splits a hot source's rows, instead of dealing all documents by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, positions, store

BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); weights repeat in code point order, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = positions(sources, [F.col("source").asc_nulls_last()], "sources")
    weighed = store(placed.select("source", "source_size", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int")).alias("weight")),
        "weights")
    total, heavy = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    rate = float(total or 0) / heavy if heavy else 0.0
    while True:  # each round stops at least one more source, and the rate only grows
        full = F.col("weight") * rate > most * F.col("source_size")
        capped, free = weighed.agg(F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        after = (total - (capped or 0)) / free if free else rate
        if after <= rate * (1 + 1e-15):
            break
        rate = after
    return weighed.withColumn("target", F.least(F.col("weight") * rate, (most * F.col("source_size")).cast("double")))


def _fill(docs: DataFrame) -> DataFrame:
    """``docs`` (source, size, missing, y, taken) with further rows taken in order of y while they fit in ``missing``."""
    open_ = (~F.col("taken")) & (F.col("size") > 0) & (F.col("size") <= F.col("missing"))
    bucketed = docs.withColumn("_bucket", F.when(open_, F.floor(F.col("y") / (1 + F.col("y")) * BUCKETS)))
    sums = bucketed.filter("_bucket is not null").groupBy("source", "_bucket").agg(
        F.sum("size").alias("words"), F.first("missing").alias("missing"))
    run = Window.partitionBy("source").orderBy("_bucket")
    edge = store(sums.withColumn("upto", F.sum("words").over(run)).filter("upto > missing").groupBy("source").agg(
        F.min("_bucket").alias("edge"), F.min(F.col("upto") - F.col("words")).alias("before")), "edges")
    marked = bucketed.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")), "left") \
        .select("d.*", "e.edge", "e.before")
    whole = marked.filter("edge is null or _bucket is null or _bucket <> edge").withColumn(
        "taken", F.expr("taken or (_bucket is not null and (edge is null or _bucket < edge))"))
    order = Window.partitionBy("source").orderBy("y", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    part = marked.filter("_bucket = edge").withColumn(
        "taken", F.sum("size").over(order) + F.col("before") <= F.col("missing"))
    filled = whole.unionByName(part).drop("edge", "before", "_bucket")
    return filled


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = (1, 2, 3), most: int = 3, seed: int = 17, passes: int = 3, key: Column | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row; ``taken`` = size * copies, the words the mix takes.

    The draw fills the missing words in rank order and then, for ``passes`` - 1 times, what is still
    missing with the next documents short enough. Random numbers come from a hash of id and text, so
    reruns agree; rows equal in both are exchangeable. A null text has size 0 and is never copied; a null
    source is a source. Documents without words take nothing; an empty table gives an empty result.
    ``key`` is carried as ``key`` where rows must be told apart by more than their id.
    """
    tie = F.xxhash64(F.lit(seed), F.col(id), F.col(text))
    sized = store(docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), (key if key is not None else F.lit(None).cast("long")).alias("key"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), tie.alias("tie")), "sizes")
    shares = targets(sized.select("source", "size"), weights, most)
    counted = sized.groupBy("source").count().withColumnRenamed("source", "s")
    plan = store(shares.join(counted, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("s"), "source_size", "target", (F.col("source_size") / F.col("count")).alias("mean"),
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
        .otherwise(0).cast("long").alias("sure")), "plan")
    u = (F.shiftrightunsigned("tie", 11).cast("double") + 0.5) / float(1 << 53)
    drawn = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn(
        "y", u / (1 - u) / F.sqrt(F.greatest(F.col("size"), F.lit(1)) / F.greatest("mean", F.lit(1.0)))) \
        .withColumn("missing", F.col("target") - F.col("sure") * F.col("source_size")) \
        .withColumn("taken", F.lit(False))
    for n in range(passes):
        drawn = store(_fill(drawn), f"draw{n}")
        if n + 1 < passes:
            got = store(drawn.filter("taken").groupBy("source").agg(F.sum("size").alias("got")).withColumnRenamed("source", "s"), "got")
            drawn = drawn.join(got, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn(
                "missing", F.col("target") - F.col("sure") * F.col("source_size") - F.coalesce("got", F.lit(0))).drop("got")
    copies = F.col("sure") + F.col("taken").cast("long")
    return drawn.select(F.col("id").alias(id), "key", "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))
