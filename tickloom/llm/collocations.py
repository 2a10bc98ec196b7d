"""Collocation mining with Rabin-Karp fingerprints.

Texts are cut into chunks of one language, stored as word numbers plus the chunk's own dictionary. In a chunk a
prefix polynomial over the words' hashes, modulo 2^64, gives the fingerprint of every n-gram by one subtraction and one
product. N-grams of a chunk with equal fingerprints are compared word by word, so a chunk's counts are those
of real phrases; each count travels as (fingerprint, second hash, count, pointer to one occurrence). A window over the
fingerprint adds them up, and only rows whose fingerprint reaches the least frequency stay. Where all second hashes of a
fingerprint agree its first pointer stands for them; where they differ every pointer stays, with its own count.

What stayed of a chunk's words and pairs is handed back to that chunk, so no list of frequent phrases is ever held
whole: there the pointers are resolved to text, and longer phrases counted where all word pairs inside are frequent. Those
that stay in their turn are resolved the same way. Counts are added by the phrase's text, which parts
phrases that shared a fingerprint, and exact frequencies decide. Two phrases are taken for one only if 61 bits of
the fingerprint and 32 of an independent hash agree in different chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store

BREAK = b"\n"
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 10
_FOLD[9] = 32
_FOLD = bytes(_FOLD)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PAIR = 2
SHARES = 32


def split_words(text: bytes) -> list[bytes]:
    """Words in order; ``BREAK`` parts the pieces."""
    return [w for w in text.translate(_FOLD).replace(BREAK, b" \n ").split(b" ") if w]


def _chunks(docs: DataFrame, lang: str, text: str, chunk_words: int) -> DataFrame:
    """(chunk, lang, n, words, ids), stored: texts of one language, ``chunk_words`` words or one text more.

    ``ids`` number the words by falling frequency, -1 between pieces; they are compressed.
    """
    def packed(chunk, name, tokens):
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        at, vocabulary = np.asarray(coded.indices), coded.dictionary.to_pylist()
        count = np.bincount(at, minlength=len(vocabulary))
        if BREAK in vocabulary:
            count[vocabulary.index(BREAK)] = -1
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        if BREAK in vocabulary:
            number[vocabulary.index(BREAK)] = -1
            order = order[:-1]
        ids = number[at]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([name]), pa.array([int((ids >= 0).sum())], pa.int64()),
             pa.array([_shut(ids.tobytes())], pa.binary()),
             pa.array([_shut(BREAK.join([vocabulary[i] for i in order]))], pa.binary())],
            ["chunk", "lang", "n", "ids", "words"])

    def run(batches):
        first, held, total, made = TaskContext.get().partitionId() << 32, {}, 0, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = split_words(value or b"")
                if not tokens:
                    continue
                held.setdefault(name, []).extend([*tokens, BREAK])
                total += len(tokens) + 1
                while total >= chunk_words:
                    longest = max(held, key=lambda k: len(held[k]))
                    total -= len(held[longest])
                    yield packed(first + made, longest, held.pop(longest))
                    made += 1
        for name, tokens in held.items():
            yield packed(first + made, name, tokens)
            made += 1

    return store(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "chunk long, lang string, n long, ids binary, words binary"), "chunks")


class Chunk:
    """One chunk's words and the prefix polynomial over their hashes."""

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray):
        self.words, self.ids, size = words, ids, len(ids)
        seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
        other = xxhash.xxh3_64_intdigest
        self.second = np.fromiter((other(w, seed) for w in words), np.uint64, len(words))
        self.there = self.ids >= 0
        value = np.where(self.there, hashes[np.maximum(self.ids, 0)] if len(words) else np.uint64(0), np.uint64(0))
        powers = np.full(size + 1, BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        back = np.full(size + 1, INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, out=back)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[:-1], dtype=np.uint64)])

    def starts(self, length: int) -> np.ndarray:
        """Places where ``length`` words of one piece begin."""
        n = max(len(self.ids) - length + 1, 0)
        ok = self.there[:n].copy()
        for k in range(1, length):
            ok &= self.there[k:k + n]
        return np.flatnonzero(ok)

    def prints(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the ``length`` words from each place of ``at``; the low three bits hold the length."""
        h = (self.prefix[at + length] - self.prefix[at]) * self.back[at]
        h ^= h >> np.uint64(29)
        return ((h & ~np.uint64(7)) | np.uint64(length)).view(np.int64)

    def checks(self, at: np.ndarray, length: int) -> np.ndarray:
        """A second hash of the same words, independent of the fingerprint."""
        h = np.zeros(len(at), np.uint64)
        for k in range(length):
            h = (h ^ self.second[self.ids[at + k]]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h.astype(np.uint32).view(np.int32)

    def counted(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, count, first place) per phrase among the places ``at``.

        Equal fingerprints are held against the words of their first place; others start rows of their own.
        """
        found = []
        while len(at):
            prints = self.prints(at, length)
            keys, first, group = np.unique(prints, return_index=True, return_inverse=True)
            model = at[first][group]
            same = np.ones(len(at), bool)
            for k in range(length):
                same &= self.ids[model + k] == self.ids[at + k]
            found.append((keys, np.bincount(group[same], minlength=len(keys)), at[first]))
            at = at[~same]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def phrase(self, at: int, length: int) -> bytes:
        return b" ".join(self.words[i] for i in self.ids[at:at + length])


def _shut(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _opened(row) -> Chunk:
    return Chunk(row["lang"], zstandard.decompress(bytes(row["words"])).split(BREAK), np.frombuffer(zstandard.decompress(bytes(row["ids"])), np.int32))


def _counts(chunk: Chunk, number: int, at: np.ndarray, length: int) -> pd.DataFrame:
    fp, n, place = chunk.counted(at, length)
    return pd.DataFrame({"fp": fp, "second": chunk.checks(place, length), "n": n.astype(np.int32), "chunk": np.int64(number), "place": place.astype(np.int32)})


COUNTS = "fp long, second int, n int, chunk long, place int"


def _short(chunks: DataFrame) -> DataFrame:
    """The single words and word pairs of each chunk."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _opened(row)
                for length in (1, PAIR):
                    yield pa.RecordBatch.from_pandas(_counts(chunk, row["chunk"], chunk.starts(length), length), preserve_index=False)
    return chunks.select("chunk", "lang", "words", "ids").mapInArrow(run, COUNTS)


def _frequent(counts: DataFrame, least: int, name: str) -> DataFrame:
    """Stored (fp, chunk, place, n): pointers to resolve, and the word pairs of each chunk (n is null), of fingerprints that occur ``least`` times.

    A fingerprint has one row per chunk and phrase at most.
    """
    same = Window.partitionBy("fp").orderBy("chunk", "place")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = counts.select("fp", "chunk", "place", "n", F.sum(F.col("n").cast("long")).over(whole).alias("total"), F.row_number().over(same).alias("at"),
                           (F.min("second").over(whole) == F.max("second").over(whole)).alias("one")).filter(F.col("total") >= least)
    n = F.when(~F.col("one"), F.col("n").cast("long")).when(F.col("at") == 1, F.col("total"))
    pair = F.col("fp").bitwiseAND(F.lit(7)) == PAIR
    return store(summed.select("fp", "chunk", "place", n.alias("n")).filter(F.col("n").isNotNull() | pair), name)


def _texts(chunk: Chunk, lang: str, rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, phrase, length, n): the words behind the pointers of ``rows``."""
    lengths = (rows["fp"].to_numpy() & 7).astype(np.int32)
    return pd.DataFrame({"lang": lang, "phrase": [chunk.phrase(p, k) for p, k in zip(rows["place"].tolist(), lengths.tolist())],
                         "length": lengths, "n": rows["n"].to_numpy(np.int64)})


def _known(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[rows["n"].notna()]
    return _texts(_opened(mine.iloc[0]), mine["lang"].iat[0], rows) if len(mine) and len(rows) else pd.DataFrame(
        {"lang": pd.Series([], dtype=str), "phrase": pd.Series([], dtype=object), "length": pd.Series([], dtype=np.int32), "n": pd.Series([], dtype=np.int64)})


def _longer(mine: pd.DataFrame, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The texts behind the chunk's pointers, and the counts of its phrases of 3 to ``most`` words made of frequent pairs."""
    texts = _known(mine, rows)
    texts = texts.assign(**{c: np.zeros(len(texts), kind) for c, kind in (("fp", np.int64), ("second", np.int32), ("chunk", np.int64), ("place", np.int32))})
    if not len(mine) or not len(rows):
        return texts
    chunk = _opened(mine.iloc[0])
    at = chunk.starts(PAIR)
    good = np.zeros(len(chunk.ids) + 1, bool)
    prints = rows["fp"].to_numpy()
    good[at] = np.isin(chunk.prints(at, PAIR), prints[(prints & 7) == PAIR])
    out = [texts]
    for length in range(3, most + 1):
        at = chunk.starts(length)
        for k in range(length - 1):
            at = at[good[at + k]]
        out.append(_counts(chunk, mine["chunk"].iat[0], at, length).assign(lang=None, phrase=None, length=np.int32(length)).astype({"n": np.int64}))
    return pd.concat([part for part in out if len(part)] or [texts], ignore_index=True)


def _by_chunk(chunks: DataFrame, rows: DataFrame, run, fields: str) -> DataFrame:
    """``run`` on every chunk and its rows of ``rows``."""
    return chunks.select("chunk", "lang", "words", "ids").groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInPandas(run, fields)


def phrase_counts(docs: DataFrame, *, lang: str = "lang", text: str = "text", most: int = 4, least: int = 30,
                  chunk_words: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, length, f)): words per language, and the phrases of 1 to ``most`` words that occur ``least`` times, stored."""
    chunks = _chunks(docs, lang, text, chunk_words)
    short = _frequent(_short(chunks), least, "short")
    fields = "lang string, phrase binary, length int, n long"
    if most > PAIR:
        both = store(_by_chunk(chunks, short, lambda mine, rows: _longer(mine, rows, most), f"{fields}, fp long, second int, chunk long, place int"), "longer")
        long = _frequent(both.filter("phrase is null").select("fp", "second", "n", "chunk", "place"), least, "long")
        known = both.filter("phrase is not null").select("lang", "phrase", "length", "n").unionByName(_by_chunk(chunks, long, _known, fields))
    else:
        known = _by_chunk(chunks, short, _known, fields)
    counted = known.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "length").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return chunks.groupBy("lang").agg(F.sum("n").alias("n")), store(counted, "phrases")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", most: int = 4, least: int = 30, top: int = 2000,
                 chunk_words: int = 4_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most`` (at most 7) words.

    Null and empty texts hold no words; a null language is ``und``, together with rows that say so. Repeated rows count
    each. Phrases tied in score and frequency are ranked by their bytes, so reruns agree; languages without a phrase that
    occurs ``least`` times give no rows, nor does an empty table. Arithmetic is exact.
    """
    sizes, phrases = phrase_counts(docs, lang=lang, text=text, most=most, least=least, chunk_words=chunk_words)
    word = F.split("phrase", " ")
    part = lambda start, size: F.concat_ws(" ", F.slice(F.col("w"), start, size))
    wide = phrases.filter("length >= 2").withColumn("w", word)
    # A phrase goes if one word more on either side keeps 80 of 100 occurrences; so do longer ones around it.
    inside = wide.filter("length > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, length - 1), k -> transform(sequence(1, length - k + 1), i -> concat_ws(' ', slice(w, i, k)))))")).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = wide.join(around, ["lang", "phrase"], "left").filter("longer is null or cast(longer as decimal(38,0)) * 100 < cast(f as decimal(38,0)) * 80")
    cuts = wide.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, length - 1)")).alias("k")) \
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    f = phrases.select("lang", "phrase", "f")
    both = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]) \
        .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    scored = both.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within shares of a language, so that one task meets only the first rows of each share.
    salted = least_cut.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    kept = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
