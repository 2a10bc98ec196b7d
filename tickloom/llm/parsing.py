"""Document fingerprints by locally consistent parsing.

A level turns a sequence of names into phrases. Runs of one name become one name. Deterministic coin tossing
then labels each place by the lowest bit in which its name differs from the one before and that bit's
value; three tosses leave fewer than ten labels, with neighbours unequal. A phrase starts at each
local maximum of the labels, and its name is a hash of the names in it. Where a phrase starts depends on a
few neighbours only, so equal substrings get equal phrases inside, wherever they stand; the next level
parses the phrase names in the same way.

A fingerprint is the digest of the whole text and, for the phrase names of levels ``FIRST_LEVEL`` and
above, a sketch of ``BINS`` bins with the least hash in each. Likeness is 2j/(1+j) for the share j of bins that
agree among those that either text fills.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tickloom.llm.common import partitions, store

BINS, FIRST_LEVEL, LEVELS = 64, 2, 6
CHARS = 1 << 18
EMPTY = 0xFFFF
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_LOW = np.array([[(lambda d: 2 * ((d & -d).bit_length() - 1) + ((b >> ((d & -d).bit_length() - 1)) & 1))(a ^ b) if a != b else 0
                  for b in range(128)] for a in range(128)], np.uint8).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _phrases(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names, and where a text's first phrase is; ``head`` marks the first name of each text."""
    fresh = np.empty(len(names), bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh |= head
    at = np.flatnonzero(fresh)
    if len(at) < len(names):
        runs = np.diff(at, append=len(names)).astype(np.uint64)
        names, head = names[at], head[at]
        long = np.flatnonzero(runs > 1)
        names = names.copy()
        names[long] = _mix(names[long] * np.uint64(31) + runs[long])
    before = np.empty_like(names)
    before[1:], before[0] = names[:-1], 0
    first = np.flatnonzero(head)
    before[first] = ~names[first]
    low = before ^ names
    low &= -low
    label = (np.bitwise_count(low - np.uint64(1)) << 1) + ((names & low) != 0)
    for _ in range(2):
        pair = label.astype(np.uint16)
        pair[1:] += label[:-1].astype(np.uint16) << 7
        toss = _LOW[pair]
        toss[first] = label[first] & 1
        # A text's first label stands alone; where it meets its neighbour's, the neighbour still differs from it by its own toss.
        label = toss
    peak = np.empty(len(label), bool)
    peak[0] = True
    np.greater(label[1:], label[:-1], out=peak[1:])
    peak[:-1] &= (label[:-1] >= label[1:]) | head[1:]  # a text's last name has none after it
    peak |= head
    start = np.flatnonzero(peak)
    size = np.diff(start, append=len(names))
    place = np.arange(len(names)) - np.repeat(start, size)
    power = _POWERS[place & 63]
    far = place > 63
    if far.any():
        power = power + (place >> 6).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return _mix(np.add.reduceat(names * power, start)), head[start]


def sketches(texts: list[str]) -> np.ndarray:
    """(texts, BINS) array of the least 16-bit hash per bin; EMPTY where no name falls in it."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    sizes = np.array([len(t) for t in texts])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    head = np.zeros(len(names), bool)
    head[np.r_[0, np.cumsum(sizes[full])[:-1]]] = True
    found_text, found_name = [], []
    for level in range(1, LEVELS + 1):
        names, head = _phrases(names, head)
        owner = full[np.cumsum(head) - 1]
        alone = np.bincount(owner, minlength=len(texts))[owner] == 1
        keep = slice(None) if level >= FIRST_LEVEL else np.flatnonzero(alone)
        found_text.append(owner[keep])
        found_name.append(names[keep] + np.uint64(level))
        # A text that is one phrase has no higher level, whatever texts are parsed beside it.
        if alone.all():
            break
        if alone.any():
            full = np.unique(owner[~alone])
            names, head = names[~alone], head[~alone]
    name, owner = _mix(np.concatenate(found_name)), np.concatenate(found_text)
    cell = owner * BINS + (name >> np.uint64(58)).astype(np.int64)
    value = ((name >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)
    np.minimum.at(out.ravel(), cell, np.minimum(value, EMPTY - 1))
    return out


def fingerprints(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Fingerprint strings and their sketches; texts are parsed together up to ``CHARS`` code points."""
    parts, part, chars = [], [], 0
    for t in texts:
        if part and chars + len(t) > CHARS:
            parts.append(sketches(part))
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    parts.append(sketches(part))
    sketch = np.concatenate(parts) if texts else np.zeros((0, BINS), np.uint16)
    digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for t in texts]
    body = sketch.astype(">u2").tobytes().hex()
    return [d + body[i * 4 * BINS:(i + 1) * 4 * BINS] for i, d in enumerate(digests)], sketch


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Likeness of rows of sketches; ``same`` marks equal fingerprints, which are alike by 1."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    agree = ((a == b) & (a != EMPTY)).sum(1)
    share = agree / np.maximum(used, 1)
    return np.where(same, 1.0, 2 * share / (1 + share))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(texts: list[str], following: list[str], own, after):
    """Columns n_chars ... near_next from texts, the texts after them, and the fingerprints of both."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    names, sketch = fingerprints(changed)
    digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    (own_names, own_sketch), (next_names, next_sketch) = own, after
    equal = lambda x, y: np.array([a == b for a, b in zip(x, y)], bool)
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array(digest, pa.string()), pa.array(own_names, pa.string()), pa.array(names, pa.string()),
            pa.array(likeness(own_sketch, sketch, equal(own_names, names)), pa.float64()),
            pa.array(likeness(own_sketch, next_sketch, equal(own_names, next_names)), pa.float64())]


RESULTS = [StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()),
           StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]


def document_fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The next document is the one after in descending id, null ids last, rows of one id in order of a hash of
    their text; the first comes after the last, so a single document is its own next. Null texts are empty;
    empty texts are alike by 1 to empty ones and by 0 to others. Texts are shuffled once, by ranges of
    the id; the rows at the ends of a range, two per partition, meet the next range's first row in a second step.
    """
    kind = docs.schema[id].dataType
    fields = [StructField("id", kind), *RESULTS, StructField("role", IntegerType()), StructField("pid", IntegerType()), StructField("text", StringType())]
    names = [f.name for f in fields]
    ordered = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .repartitionByRange(partitions(docs.sparkSession), F.col("id").desc_nulls_last()) \
        .sortWithinPartitions(F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")

    def edge(ids, text, role, pid):
        return pa.RecordBatch.from_arrays([ids, *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())],
                                           pa.array([role], pa.int32()), pa.array([pid], pa.int32()), pa.array([text], pa.string())], names)

    def run(batches):
        pid, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            own = fingerprints(texts)
            if last is None:
                yield edge(ids.slice(0, 1), texts[0], 1, pid)
            else:
                ids, texts = pa.concat_arrays([last[0], ids]), [last[1], *texts]
                own = ([last[2], *own[0]], np.concatenate([last[3], own[1]]))
            n = len(texts) - 1
            if n:
                found = _compare(texts[:-1], texts[1:], (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:]))
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *found, pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.string())], names)
            last = (ids.slice(n, 1), texts[-1], own[0][-1], own[1][-1:])
        if last is not None:
            yield edge(last[0], last[1], 2, pid)

    done = store(ordered.mapInArrow(run, StructType(fields)), "parsed")
    pids = sorted(r[0] for r in done.filter("role = 1").select("pid").collect())  # one per partition
    after = {p: pids[(i + 1) % len(pids)] for i, p in enumerate(pids)}
    spark = docs.sparkSession
    order = spark.createDataFrame(list(after.items()) or [(-1, -1)], "pid int, next int")
    ends = done.filter("role = 2").select("id", "text", "pid").join(order, "pid").join(
        done.filter("role = 1").select(F.col("pid").alias("next"), F.col("text").alias("following")), "next").select("id", "text", "following")

    def finish(batches):
        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *_compare(texts, following, fingerprints(texts), fingerprints(following))], names[:7])

    rest = ends.mapInArrow(finish, StructType(fields[:7]))
    return done.filter("role = 0").select(*names[:7]).unionByName(rest).withColumnRenamed("id", id)
