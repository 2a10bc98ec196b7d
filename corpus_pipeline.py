"""Corpus pipeline: quality classifier, near-dedup, personal data, source mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Scratch tables of a stage are deleted when the next one begins, since its result is
written by then; other queries' tables stay.

Decisions on documents travel with the place of their row in its file, and meet the texts in one hash join on it. Its
build side are the places a partition keeps, so texts are shuffled once, and neither sorted nor stored again,
by the same plan at every size.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import keyed, prepare, recorded, sweep, table
from tickloom.llm.mixing import mix
from tickloom.llm.packing import pack
from tickloom.llm.personal_data import redact
from tickloom.llm.resampling import resample
from tickloom.llm.simhash import near_duplicates
from tickloom.sources.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_left: list[str] = []  # scratch tables of the stage before


def stage(fn):
    @wraps(fn)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _left)
        prepare(spark)
        with recorded(_left):
            return fn(spark, docs, sf_dir)
    return begun


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the importance weights keep. Repeated rows stay or go together; a null id has no label."""
    return resample(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


@stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id, null ids last.

    Of repeated rows one stays; texts without words have fingerprint 0 and count as copies of each other.
    """
    rows = keyed(docs, COLUMNS, "dedup")
    marked = near_duplicates(rows.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")),
                             id="_key", text="text", shingle=3, distance=2)
    first = marked.filter(F.col("_key") == F.col("component_id")).select(F.col("_key._row").alias("_row"))
    return rows.join(first.hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; n_chars follows where a text changes."""
    plain = docs.select(*COLUMNS).withColumn("_before", F.length("text"))
    done = redact(plain, text="text")
    return done.withColumn("n_chars", F.when(F.length("text") != F.col("_before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it takes no time, and texts without words, go."""
    rows = keyed(docs, COLUMNS, "mix")
    copies = mix(rows, id="_row").filter("copies > 0 and size > 0").select("_row", F.col("copies").cast("int").alias("_copies"))
    return rows.join(copies.hint("shuffle_hash"), "_row").select(
        *COLUMNS, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select(*COLUMNS)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences."""
    return pack(docs)


STAGES = [("quality classifier", quality_classifier), ("simhash near-dedup", simhash_dedup), ("personal data", personal_data),
          ("mixing sources", mix_sources), ("best-fit packing", best_fit_packing)]

#: The classifier, the fingerprints and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), name.replace(" ", "-"))
    sweep(spark, _left)
    return docs
