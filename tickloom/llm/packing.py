"""Best-fit packing of tokenized documents into sequences with a grouping genetic algorithm on islands.

Documents longer than a sequence are cut; their full pieces fill sequences by themselves. The other
pieces are dealt evenly over islands. Pieces of equal length are interchangeable, so a chromosome is a
list of bins, each a tuple of lengths. Crossover injects whole well-filled bins of one parent into the
other, removes the receiver's bins that hold lengths now used twice, and best-fits the displaced pieces,
together with those of the worst-filled bins. Between rounds every island sends its fullest bin patterns,
its elite, to the next island, which injects those it has the pieces for.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

END = 2
SPECIAL = "<|endoftext|>"


def tokenizer(path: str | None = None):
    """Function from a text to its uint32 ids of the vocabulary file (default: the public byte-level BPE of 50k ids).

    The same vocabulary as ranks gives the same ids several times faster; texts that contain the special
    token's string, which the file's own tokenizer reads as that token, go through that tokenizer.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    if path != public_tokenizers.path("byte_bpe_50k.json"):
        return lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as ranks:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text)
    return ids


def pieces(docs: DataFrame, *, id: str, text: str, size: int, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32), stored: the first piece takes what does not fill a sequence."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        ids = tokenizer(path)
        for batch in batches:
            at, number, start, length, crc = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(ids(t or ""), END).astype("<u4")
                cuts = [0, *range(len(tokens) % size or size, len(tokens), size), len(tokens)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at.append(row)
                    number.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    cut = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return store(cut.withColumn("_place", F.monotonically_increasing_id()), "pieces")


class Bins:
    """Bins by what is left in them, with the best fit found from a bit set of the rests in use."""

    def __init__(self, size: int, bins=()):
        self.size, self.by, self.used = size, {}, 0
        for b in bins:
            self.put(b, size - sum(b))

    def put(self, items: tuple, left: int) -> None:
        self.by.setdefault(left, []).append(items)
        self.used |= 1 << left

    def fit(self, length: int) -> None:
        fits = self.used >> length
        if not fits:
            self.put((length,), self.size - length)
            return
        left = length + (fits & -fits).bit_length() - 1
        stack = self.by[left]
        items = stack.pop()
        if not stack:
            self.used &= ~(1 << left)
        self.put((*items, length), left - length)

    def bins(self) -> list[tuple]:
        return [b for stack in self.by.values() for b in stack]


def best_fit(lengths, size: int, bins=()) -> list[tuple]:
    out = Bins(size, bins)
    for length in lengths:
        out.fit(length)
    return out.bins()


def _fitness(bins: list[tuple], size: int) -> tuple:
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins)


def crossover(receiver: list[tuple], injected: list[tuple], pool: Counter, size: int, rng: random.Random, shake: float = 0.02) -> list[tuple]:
    """Child of ``receiver`` with the ``injected`` bins, whose lengths must be within ``pool``."""
    twice = Counter(x for b in injected for x in b)
    kept, loose = [], []
    order = sorted(receiver, key=sum)
    cut = int(len(order) * shake)
    rest = order[cut:]
    rng.shuffle(rest)
    for b in order[:cut] + rest:  # the emptiest give way first
        if any(twice[x] for x in b):
            for x in b:
                if twice[x]:
                    twice[x] -= 1
                else:
                    loose.append(x)
        else:
            kept.append(b)
    worst = sorted(kept, key=sum)[:cut]
    gone = Counter(worst)
    for b in worst:
        loose.extend(b)
    kept = [b for b in kept if not (gone[b] and not gone.subtract((b,)))]
    loose.sort(reverse=True)
    if rng.random() < 0.5:  # near-decreasing order, for variety
        loose = sorted(loose, key=lambda x: -x * rng.uniform(0.9, 1.1))
    return best_fit(loose, size, injected + kept)


def within(bins: list[tuple], pool: Counter) -> list[tuple]:
    """The bins that can all be filled from ``pool`` at once."""
    left, out = Counter(pool), []
    for b in bins:
        need = Counter(b)
        if all(left[x] >= n for x, n in need.items()):
            left.subtract(need)
            out.append(b)
    return out


def evolve(pool: Counter, size: int, start: list[tuple] | None, elites: list[tuple], seed: int, generations: int, population: int) -> list[tuple]:
    """The best packing found; stops at the least number of bins the total allows."""
    rng = random.Random(seed)
    lengths = sorted(pool.elements(), reverse=True)
    least = -(-sum(lengths) // size)
    people = [start] if start else []
    while len(people) < population:
        people.append(best_fit(lengths if not people else sorted(lengths, key=lambda x: -x * rng.uniform(0.8, 1.2)), size))
        if len(people[-1]) <= least:
            return people[-1]
    if elites:
        people.append(crossover(people[0], within(elites, pool), pool, size, rng))
    people.sort(key=lambda b: _fitness(b, size), reverse=True)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        a, b = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
        good = [x for x in b if sum(x) >= size - 1]
        injected = within(rng.sample(good, min(len(good), max(1, len(b) // 10))), pool)
        child = crossover(a, injected, pool, size, rng)
        if _fitness(child, size) > _fitness(people[-1], size):
            people[-1] = child
            people.sort(key=lambda x: _fitness(x, size), reverse=True)
    return people[0]


def _patterns(island: int, bins: list[tuple], size: int, elite: int) -> pd.DataFrame:
    counts = Counter(tuple(sorted(b, reverse=True)) for b in bins)
    best = sorted(counts, key=lambda b: (-sum(b), len(b), b))[:elite]
    top = set(b for b in best if sum(b) >= size - 1)
    return pd.DataFrame({"island": island, "bin": [list(b) for b in counts], "n": list(counts.values()), "elite": [b in top for b in counts]})


def pack(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 1024, island_pieces: int = 32_768,
         migrations: int = 2, generations: int = 12, population: int = 4, elite: int = 256, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Sequence ids of islands are not negative, those of full pieces negative. Null and empty texts are one piece
    holding the end id. Null ids and repeated rows are packed like others, each row by itself; an empty table
    gives an empty result.
    """
    cut = pieces(docs, id=id, text=text, size=size, path=path)
    loose = cut.filter(F.col("length") < size).count()
    islands = max(1, -(-loose // island_pieces))
    items = cut.filter(F.col("length") < size).withColumn("island", F.pmod(F.xxhash64("_place"), F.lit(islands)).cast("long"))
    sizes = store(items.groupBy("island", "length").agg(F.count("*").alias("n")), "lengths")
    shape = "island long, bin array<int>, n long, elite boolean"
    best = None
    for turn in range(migrations + 1):  # each turn is written before the next is planned
        rows = sizes.select("island", F.array(F.col("length").cast("int")).alias("bin"), "n", F.lit(0).alias("role"))
        if best is not None:
            sent = best.filter("elite").select(((F.col("island") + 1) % islands).alias("island"), "bin", "n", F.lit(2).alias("role"))
            rows = rows.unionByName(best.select("island", "bin", "n", F.lit(1).alias("role"))).unionByName(sent)

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            island, part = int(pdf["island"].iloc[0]), {r: g for r, g in pdf.groupby("role")}
            pool = Counter({int(b[0]): int(n) for b, n in zip(part[0]["bin"], part[0]["n"])})
            listed = lambda r: [tuple(int(x) for x in b) for b, n in zip(part[r]["bin"], part[r]["n"]) for _ in range(n)] if r in part else []
            elites = sorted(listed(2)) if islands > 1 else []
            found = evolve(pool, size, sorted(listed(1)) or None, elites, island * 1000 + len(part), generations, population)
            return _patterns(island, found, size, elite)

        best = store(rows.repartition(islands, "island").groupBy("island").applyInPandas(step, shape), f"bins{turn}")

    kind = docs.schema[id].dataType.simpleString()

    def place(mine: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.assign(key=[tuple(b) for b in bins["bin"]]).sort_values("key")
        length, sequence, offset, number = [], [], [], int(mine["island"].iloc[0]) << 32
        for b, n in zip(bins["key"], bins["n"]):
            ends = np.cumsum(b)
            length.append(np.tile(np.array(b, np.int64), n))
            offset.append(np.tile(ends - np.array(b), n))
            sequence.append(np.repeat(np.arange(number, number + n), len(b)))
            number += n
        slot = np.argsort(np.concatenate(length), kind="stable")
        mine = mine.sort_values(["length", "_place"], kind="stable")
        return pd.DataFrame({"_place": mine["_place"].to_numpy(), "sequence_id": np.concatenate(sequence)[slot], "offset": np.concatenate(offset)[slot]})

    placed = items.select("island", "length", "_place").groupBy("island").cogroup(best.groupBy("island")).applyInPandas(
        place, "_place long, sequence_id long, offset long")
    full = cut.filter(F.col("length") == size).withColumn("sequence_id", -F.col("_place") - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < size).join(placed, "_place")
    columns = [F.col("id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*columns).unionByName(rest.select(*columns))
