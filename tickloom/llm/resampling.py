"""Quality classifier by importance resampling over hashed n-gram models.

Two generative models over hashed word unigrams and bigrams are counted: one of the target, texts labelled
good, one of all raw text. A document's log importance weight is the sum of the log ratios of its
n-grams, less a margin per n-gram that separates the labelled sample best, losing a good text counting as
much as keeping ``GOOD`` bad ones. Weights are divided by a temperature, Gumbel noise is added, and the
k highest are kept, where k is the number of documents the weights themselves call target-like (weight at
least 0), so the draw's size follows the data. A low temperature leaves chance only to texts at the margin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tickloom.llm.common import store

SLOTS = 1 << 16
GOOD = 4
PSEUDO = 2.0


def slots(text: str | None) -> np.ndarray:
    """Hash slots of the lower-cased words and of their neighbouring pairs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)  # noqa: E731  15 bits
    return np.concatenate([mix(one), mix(one[:-1] * np.uint64(31) + one[1:] + np.uint64(7)) + SLOTS // 2])


def labelled(labels: DataFrame, label_rows: int) -> DataFrame:
    """(id, quality, held): at most ``label_rows`` labelled ids, chosen and split in two by hash."""
    known = labels.groupBy("id").agg(F.min("quality").alias("quality")).filter("id is not null and quality is not null")
    return known.orderBy(F.xxhash64("id"), "id").limit(label_rows).withColumn("held", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)) == 1)


def model(docs: DataFrame, sample: DataFrame, *, id: str, text: str) -> np.ndarray:
    """Log ratio per slot: counts over all documents, target counts over the sampled good ones not held out."""
    tagged = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(sample.filter("not held")), "id", "left")  # its bound is label_rows

    def count(batches):
        raw, target, kept = np.zeros(SLOTS), np.zeros(SLOTS), 0
        for batch in batches:
            for t, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(slots(t), minlength=SLOTS) if t else 0
                raw += n
                if q == 1:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["slot", "raw", "target"])

    # One row per slot: SLOTS rows at most reach the driver.
    rows = tagged.select("text", "quality").mapInArrow(count, "slot int, raw double, target double") \
        .groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(SLOTS), np.zeros(SLOTS)
    raw[rows["slot"]], target[rows["slot"]] = rows["raw"], rows["target"]
    ratio = np.zeros(SLOTS)
    for half in (slice(0, SLOTS // 2), slice(SLOTS // 2, SLOTS)):
        if not target[half].sum():
            continue
        # Counts the target would have if it were raw text; a pseudo count on both sides, so that
        # slots too rare to have been met say nothing.
        expected = raw[half] * (target[half].sum() / raw[half].sum())
        ratio[half] = np.log((target[half] + PSEUDO) / (expected + PSEUDO))
    return ratio


def _scores(docs: DataFrame, ratio) -> DataFrame:
    """``docs`` (text and others) with ratio and grams in the place of text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            found = [slots(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(f.name) for f in kept], pa.array([float(ratio.value[s].sum()) for s in found], pa.float64()),
                pa.array([len(s) for s in found], pa.int64())], [f.name for f in kept] + ["ratio", "grams"])
    return docs.mapInArrow(run, StructType([*kept, StructField("ratio", DoubleType()), StructField("grams", LongType())]))


def resample(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label_rows: int = 20_000,
             temperature: float = 0.1, seed: int = 29,
             carry: tuple | list = ()) -> DataFrame:
    """(id, log_ratio, n_grams, log_weight, gumbel_key, kept) per row of ``docs``.

    ``labels`` has the id and ``quality`` 0/1; null labels are ignored, of contradicting ones the lower
    counts. ``label_rows`` bounds the labelled sample, chosen by hash of the id; one half of it makes the target
    model, the other the margin. Without labels every ratio is 0 and all rows are kept. Null and empty texts have no n-grams and
    weight 0. Noise comes from a hash of id and text: reruns agree, repeated rows are kept or dropped
    together, and rows tied with the last kept one are kept too. ``carry`` names further columns to return; none may
    be called like the results. They are stored with the scores, so that no join of texts is needed.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id).alias("id"), "quality")
    sample = labelled(marks, label_rows)
    ratio = spark.sparkContext.broadcast(model(docs, sample, id=id, text=text))
    along = [F.col(c).alias(f"c{n}") for n, c in enumerate(carry)]
    scored = store(_scores(docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), F.col(id), F.col(text)).alias("noise"),
                                       *along), ratio), "ratios")
    fit = scored.filter("grams > 0").join(F.broadcast(sample.filter("held")), "id").groupBy("id").agg(  # label_rows rows at most
        F.min(F.col("ratio") / F.col("grams")).alias("mean"), F.min("quality").alias("quality")).toPandas()
    margin = best_margin(fit["mean"].to_numpy(float), fit["quality"].to_numpy(int))
    u = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.col("ratio") - F.lit(margin) * F.col("grams")
    keyed = scored.withColumn("weight", weight).withColumn("key", F.col("weight") / temperature - F.log(-F.log(u)))
    k = keyed.filter("weight >= 0").count()
    edge = kth_largest(keyed, "key", k)
    return keyed.select(F.col("id").alias(id), *[F.col(f"c{n}").alias(c) for n, c in enumerate(carry)], F.col("ratio").alias("log_ratio"), F.col("grams").alias("n_grams"),
                        F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"),
                        (F.col("key") >= F.lit(edge)).alias("kept"))


def best_margin(mean: np.ndarray, quality: np.ndarray) -> float:
    """Midpoint of the gap between means that separates the labels best; 0 without both labels."""
    good, bad = np.sort(mean[quality == 1]), np.sort(mean[quality != 1])
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(mean)
    right = np.searchsorted(bad, cuts, "left") / len(bad) - GOOD * np.searchsorted(good, cuts, "left") / len(good)
    top = int(np.argmax(right))
    return float((cuts[top] + cuts[top - 1]) / 2) if top else float(cuts[0])


def kth_largest(df: DataFrame, column: str, k: int, buckets: int = 4096) -> float:
    """The kth largest value, by counting buckets of an interval that shrinks to one value."""
    if k <= 0:
        return float("inf")
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / buckets
        if low + width == low:
            break
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(buckets - 1)).alias("b")
        rows = df.filter(F.col(column).between(F.lit(low), F.lit(high))).groupBy(place).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # buckets rows at most
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low
