"""Exact top-k by inner product with a dual-tree search over cover trees.

Queries and data are dealt in blocks; each pair of blocks is one task group. In it both sides get a
cover tree. A pair of nodes bounds every inner product below it by <q,p> + Rp|q| + Rq|p| + RqRp with the
covering radii R; the pair is dropped when that is below the worst kth score of the node's queries.
The k best of each block are merged per query. Scores are whole numbers, exact in doubles below 2**53
and computed with Python's integers beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store

LEAF = 64
EXACT = float(1 << 53)


class Node:
    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, rows, centre, radius, children):
        self.rows, self.centre, self.radius, self.children = rows, centre, radius, children
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(points: np.ndarray, rows: np.ndarray, centre: int | None = None) -> Node:
    """Node over ``rows``: greedy centres at half the covering radius, each row under its nearest.

    A node stops at ``LEAF`` rows, at radius 0 (equal points), or where its rows lie so evenly apart that
    a smaller radius would need more than one centre per two leaves; then it is a leaf of any size.
    """
    centre = rows[0] if centre is None else centre
    gap = np.sqrt(np.maximum(((points[rows] - points[centre]) ** 2).sum(1), 0))
    radius = float(gap.max(initial=0.0))
    if len(rows) <= LEAF or radius == 0:
        return Node(rows, points[centre], radius, [])
    near, owner = gap.copy(), np.zeros(len(rows), int)
    centres, most = [centre], max(2, len(rows) // (LEAF // 2))
    while near.max() > radius / 2 and len(centres) < most:
        far = int(near.argmax())
        away = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(1))
        closer = away < near
        owner[closer], near = len(centres), np.minimum(near, away)
        centres.append(rows[far])
    children = [rows[owner == i] for i in range(len(centres))]
    if max(map(len, children)) == len(rows):
        return Node(rows, points[centre], radius, [])
    return Node(rows, points[centre], radius, [cover_tree(points, r, c) for r, c in zip(children, centres) if len(r)])


def _merge(best, which, scores, ids, k):
    """Put ``scores`` (queries x candidates) into the lists of the queries ``which``, ties to smaller ids."""
    s0, i0 = best
    s = np.concatenate([s0[which], scores], 1)
    i = np.concatenate([i0[which], np.broadcast_to(ids, scores.shape)], 1)
    if s.shape[1] > 4 * k and s.dtype != object:  # keep all that tie with the kth
        edge = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
        width = int((s >= edge[:, None]).sum(1).max())
        pick = np.argpartition(-s, width - 1, 1)[:, :width] if width < s.shape[1] else None
        if pick is not None:
            s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    for row, q in enumerate(which):
        order = np.lexsort((i[row], -s[row]))[:k]
        s0[q], i0[q] = s[row][order], i[row][order]


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
    """(scores, ids) of the k best rows of ``data`` per query; -inf where there are fewer."""
    wide = max(np.abs(queries).max(initial=0), 1) * max(np.abs(data).max(initial=0), 1) * queries.shape[1] >= EXACT
    exact_q, exact_d = ((queries.astype(object), data.astype(object)) if wide else (queries, data))
    if wide:  # Python's integers; no bound in doubles would hold
        exact_q = np.vectorize(int, otypes=[object])(queries)
        exact_d = np.vectorize(int, otypes=[object])(data)
    scores = np.full((len(queries), k), -np.inf, dtype=object if wide else float)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def base(q, d):
        found = exact_q[q] @ exact_d[d].T
        own = query_ids[q][:, None] == data_ids[d][None, :]
        if own.any():
            found = found.copy()
            found[own] = -np.inf
        _merge((scores, ids), q, found, data_ids[d], k)

    if wide:
        for part in np.array_split(np.arange(len(data)), max(1, len(data) // 1024)):
            base(np.arange(len(queries)), part)
        return scores, ids
    todo = [(cover_tree(queries, np.arange(len(queries))), cover_tree(data, np.arange(len(data))))]
    while todo:
        a, b = todo.pop()
        bound = a.centre @ b.centre + b.radius * a.norm + a.radius * b.norm + a.radius * b.radius
        if bound * (1 + 1e-9) + 1e-6 < scores[a.rows, k - 1].min():
            continue
        if not a.children and not b.children:
            base(a.rows, b.rows)
        elif not b.children or (a.children and len(a.rows) >= len(b.rows)):
            todo += [(c, b) for c in a.children]
        else:  # the most promising last, so that it is searched first
            todo += [(a, c) for c in sorted(b.children, key=lambda c: a.centre @ c.centre + c.radius * a.norm)]
    return scores, ids


def top_k(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100,
          scale: int = 1024, query_rows: int = 2048, data_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest inner products of each query row.

    Queries are rows whose id is divisible by ``every``; candidates are all rows but those with the query's
    id. Components become floor(scale * x). Vectors that are null or hold null, NaN or infinite components, and
    rows with a null id, take no part; vectors of unequal length are never compared; a repeated query id
    asks with the smallest of its vectors; repeated candidates each count. Scores beyond a long
    stop at its ends. Fewer than ``k`` candidates give fewer rows, an empty table none.
    """
    clean = store(vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
                  .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
                  .filter("forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('Infinity'))")
                  .select("id", F.size("v").alias("n"), F.transform("v", lambda x: F.floor(
                      x.cast("double") * scale).cast("double")).alias("v")), "vectors")
    asked = clean.filter(F.col("id") % every == 0).groupBy("id", "n").agg(F.min("v").alias("v")) \
        .groupBy("id").agg(F.min(F.struct("n", "v")).alias("s")).select("id", "s.n", "s.v")
    rows, query_count = clean.count(), asked.count()
    parts, sets = max(1, -(-rows // data_rows)), max(1, -(-query_count // query_rows))
    # Queries are a stated set; each block of them meets each block of the data once.
    q = asked.withColumn("set", F.pmod(F.xxhash64("id"), F.lit(sets))) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("ask", F.lit(True))
    d = clean.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts))) \
        .withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).withColumn("ask", F.lit(False))
    cols = ["set", "part", "n", "ask", "id", "v"]
    both = q.select(*[F.col(c).cast("long") if c in cols[:3] else F.col(c) for c in cols]).unionByName(
        d.select(*[F.col(c).cast("long") if c in cols[:3] else F.col(c) for c in cols]))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec": [], "score": []}).astype("int64")
        width = int(pdf["n"].iloc[0])
        mat = lambda x: np.array(x["v"].tolist(), float).reshape(len(x), width)
        s, i = search(mat(a), a["id"].to_numpy(), mat(b), b["id"].to_numpy(), k)
        keep = s != -np.inf
        low, high = -(1 << 63), (1 << 63) - 1
        return pd.DataFrame({"query_id": np.repeat(a["id"].to_numpy(), k)[keep.ravel()], "vec": i[keep],
                             "score": np.array([min(max(int(x), low), high) for x in s[keep]], "int64")})

    found = both.groupBy("set", "part", "n").applyInPandas(group, "query_id long, vec long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("vec").alias(id), "score")
