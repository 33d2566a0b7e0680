"""A corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.llm import exact_dedup, language_id, minhash, packing, secret_scan
from attrilake.llm.common import ROW, Scratch, chosen, lend, numbered, owned, reclaim, ship, small_batches


def stage(function):
    """The stage, with this package sent to the executors before it begins.

    Its tables go at the beginning of a later stage, if no DataFrame can read them any more by then.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        reclaim(spark)
        with owned() as made:
            out = function(spark, docs, sf_dir)
        return lend(out, made)

    return run_stage


def rows_found(scratch: Scratch, find) -> DataFrame:
    """What ``find()`` gives, a few columns a row, written; what its operators wrote on the way goes."""
    with owned() as made, small_batches(scratch.spark):
        found = scratch.keep(find(), "found")
    for table in made:
        table.end()
    scratch.spark.sparkContext._jvm.System.gc()  # and the shuffle files with them
    return found


@stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the evidence agrees on; ``lang`` becomes that language.

    The declared language is ``lang``, the host is ``source``. Texts without letters, with no
    likely language or unlike any known one go.
    """
    scratch = Scratch(spark, "stage-language")
    rows = numbered(docs, scratch)

    def accepted() -> DataFrame:
        found = language_id.identify(language_id.as_rows(rows, "doc_id", rows["text"], rows["lang"], rows["source"]), language_id.train(rows))
        found = found.filter("accepted").select(F.col("row_id").alias(ROW), F.col("language").alias("__language__"))
        return found.join(rows.select(ROW, F.col("lang").alias("__declared__")), ROW).select(ROW, "__language__", F.expr("__language__ <=> __declared__").alias("__same__"))

    found = rows_found(scratch, accepted)
    same, other = found.filter("__same__"), found.filter("NOT __same__")
    # only rows that get another language than the declared one meet it in a shuffle, which deals them to few files
    renamed = chosen(rows, other).join(other.hint("merge"), ROW).withColumn("lang", F.col("__language__"))
    return chosen(rows, same).select(*docs.columns).unionByName(renamed.select(*docs.columns))


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays."""
    scratch = Scratch(spark, "stage-exact")
    rows = numbered(docs, scratch)
    kept = rows_found(scratch, lambda: exact_dedup.exact_dedup(rows).filter("kept").select(F.col("row_id").alias(ROW)))
    return chosen(rows, kept).select(*docs.columns)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more) the first document stays."""
    scratch = Scratch(spark, "stage-near")
    rows = numbered(docs, scratch)
    kept = rows_found(scratch, lambda: minhash.near_duplicates(rows, percent=80).filter("row_id = keep_row").select(F.col("row_id").alias(ROW)))
    return chosen(rows, kept).select(*docs.columns)


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark."""
    return secret_scan.redacted(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the language model nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder.

    A stage's own tables go as soon as its result is written; those of other runs are never touched.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, function in STAGES[:-1]:
        with owned() as made:
            docs = scratch.keep(function(spark, docs, sf_dir), name)
        for table in made:
            table.end()
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
