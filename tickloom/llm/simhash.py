"""SimHash near-duplicates: a grid join on segment bit counts, then exact bit distances.

A 64-bit fingerprint becomes the vector of bit counts of its 16 segments. Differing bits are never fewer
than the Manhattan distance of two such vectors, so fingerprints that link lie within ``distance`` of each
other there. Every differing bit moves one coordinate; with the coordinates in distance + 4 groups,
at least four groups agree, and each choice of four gives the grid cells of one projection. Pairs of
a cell pass the Manhattan bound, then the exact distance.

Cells beyond ``cell_rows`` fingerprints are not paired. Their fingerprints each name all fingerprints one
bit away and themselves; two lie within two bits exactly if they name a common one, which at most 65
can, so small groups replace the pairs and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickloom.llm.common import store
from tickloom.llm.components import components

SEGMENTS, BITS = 16, 4
KEPT = 4
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(flat[s:e], 42) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """(id, fp), stored."""
    kind = docs.schema[id].dataType

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.int64())], ["id", "fp"])

    return store(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, StructType([StructField("id", kind), StructField("fp", LongType())])), "fingerprints")


def _counts() -> F.Column:
    """Bit counts of the segments, three bits each, in one long."""
    fields = [F.shiftleft(F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))).cast("long"), 3 * i)
              for i in range(SEGMENTS)]
    out = fields[0]
    for f in fields[1:]:
        out = out.bitwiseOR(f)
    return out


def links(fps: DataFrame, distance: int, cell_rows: int = 1000) -> DataFrame:
    """(a, b) pairs of the distinct fingerprints ``fps`` (fp) that connect all within ``distance`` bits."""
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts = np.array_split(np.arange(SEGMENTS), distance + KEPT)
    masks = [sum(7 << (3 * int(i)) for g in keep for i in parts[g]) for keep in combinations(range(distance + KEPT), KEPT)]
    counted = fps.withColumn("counts", _counts())
    cells = store(counted.select("fp", "counts", F.explode(F.array(*[
        F.col("counts").bitwiseAND(F.lit(m)).bitwiseOR(F.lit(n << 48)) for n, m in enumerate(masks)])).alias("cell")), "cells")
    star = distance <= 2
    crowded = cells.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell")
    paired = cells.join(crowded, "cell", "left_anti") if star else cells
    left = paired.select(F.col("cell").alias("cell_a"), F.col("fp").alias("a"), F.col("counts").alias("ca"))
    right = paired.select(F.col("cell").alias("cell_b"), F.col("fp").alias("b"), F.col("counts").alias("cb"))
    apart = sum(F.abs(F.shiftright("ca", 3 * i).bitwiseAND(F.lit(7)) - F.shiftright("cb", 3 * i).bitwiseAND(F.lit(7))) for i in range(SEGMENTS))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, (F.col("cell_a") == F.col("cell_b")) & (F.col("a") < F.col("b")) & (apart <= distance) & close).select("a", "b")
    if not star:
        return pairs.distinct()
    dense = cells.join(crowded, "cell", "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    named = dense.select("fp", F.explode(flips).alias("name"))
    if distance == 1:
        return pairs.unionByName(named.join(dense.withColumnRenamed("fp", "b"), F.col("name") == F.col("b")).select(F.col("fp").alias("a"), "b")).distinct()
    groups = named.groupBy("name").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)  # 65 at most
    return pairs.unionByName(groups.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) per row; component_id is the smallest id that links reach.

    Null and empty texts, and texts of white space, have fingerprint 0 and link like others. Equal texts share
    a fingerprint. Null ids stay and are never the smallest unless a component has no other; repeated rows
    give repeated rows. An empty table gives an empty result.
    """
    marked = fingerprints(docs, id, text, shingle)
    first = store(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(first.select("fp"), distance))
    grouped = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
