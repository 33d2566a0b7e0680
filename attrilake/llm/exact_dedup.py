"""Exact deduplication by a log-structured merge index, in DataFrame operations alone.

Every scan task is a memtable: it flushes its rows as one run, sorted by digest, and each batch of
runs gets a filter of its digests' hash bits. Compaction merges the runs that came since the last
one into the level before, and writes the next level, sorted by digest: a row a digest, with its
number of rows and the smallest by the order in which rows stay; older runs aren't read again. A
digest with two rows or more is a hit; hits are verified byte by byte against the row that stays.
Lookups probe the filters first: only rows that a filter lets through reach the level, and only
those that meet a digest there have their bytes compared.

Defined results: null text counts as empty; texts that are empty after normalisation equal each
other; with equal lengths the smallest doc_id stays, null ids last, and of repeated rows with one
id the first in scan order stays (exactly one row of a group has ``kept``); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.llm.common import BLANKS, PART_BYTES, Scratch, join_keyed, key_filter, likely, passing, row_number, sha256_hex


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


#: Runs: a row a text. Levels: a row a digest, its rows, the bytes of one of them, and the one that stays.
RUN = "row_id long, doc_id long, n_points int, digest string, body string"
LEVEL = "digest string, group_size long, octets long, first struct<len: int, no_id: boolean, doc_id: bigint, row_id: bigint>"


class LsmIndex:
    """Sorted digest runs in a shared folder, their filters, and the level they are compacted to."""

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None):
        self.spark, self.scratch = spark, scratch or Scratch(spark, "lsm")
        self.batches, self.merged = 0, 0  # batches that came, and those of them that the level holds

    def insert(self, docs: DataFrame) -> None:
        """Flush a batch: one sorted run a task, with row ids that never repeat across batches."""
        text = F.coalesce(docs["text"], F.lit(""))
        rows = docs.select(row_number(docs).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.char_length(text).cast("int").alias("n_points"), normalised(docs["text"]).alias("body"))
        rows = rows.select((F.col("row") + F.lit(self.batches << 56)).alias("row_id"), "doc_id", "n_points", sha256_hex(F.col("body")).alias("digest"), "body")
        self.scratch.keep(rows.sortWithinPartitions("digest"), f"run-{self.batches}")
        self.batches += 1

    def runs(self, since: int = 0) -> DataFrame:
        """The rows of all batches from ``since`` on."""
        none = self.spark.createDataFrame([], RUN)
        return reduce(DataFrame.unionByName, (self.spark.read.schema(RUN).parquet(self.scratch.path(f"run-{b}")) for b in range(since, self.batches)), none)

    def compact(self) -> DataFrame:
        """Merge the runs that the level doesn't hold yet into it: the next level."""
        if self.merged < self.batches:
            order = F.struct((-F.col("n_points")).alias("len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
            new = self.runs(self.merged).select("digest", F.lit(1).cast("long").alias("group_size"), F.octet_length("body").cast("long").alias("octets"), order.alias("first"))
            every = new if not self.merged else self.level().unionByName(new)
            level = every.groupBy("digest").agg(F.sum("group_size").alias("group_size"), F.max("octets").alias("octets"), F.min("first").alias("first"))
            old, self.merged = self.merged, self.batches
            self.scratch.keep(level.sortWithinPartitions("digest"), f"level-{self.merged}")
            if old:
                self.scratch.drop(f"level-{old}")
        return self.level()

    def level(self) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(self.scratch.path(f"level-{self.merged}")) if self.merged else self.spark.createDataFrame([], LEVEL)

    def filters(self) -> DataFrame:
        """The filters of all batches as one, each built when it's first asked for; 4 MB at most."""
        for b in range(self.batches):
            if f"filter-{b}" not in self.scratch.names:
                self.scratch.keep(key_filter(self.spark.read.schema(RUN).parquet(self.scratch.path(f"run-{b}")), "digest"), f"filter-{b}")
        every = [self.spark.read.parquet(self.scratch.path(f"filter-{b}")) for b in range(self.batches)]
        return reduce(DataFrame.unionByName, every).groupBy("_slot").agg(F.bitmap_or_agg("_bits").alias("_bits"))

    def lookup(self, docs: DataFrame) -> DataFrame:
        """Rows of a new batch whose bytes the index already holds: doc_id, keep_id of the row that stays there.

        Where texts of one digest differ, which verification finds, the row that stays of the equal ones.
        """
        if not self.batches:
            return docs.sparkSession.createDataFrame([], "doc_id long, keep_id long")
        level = self.compact()
        new = docs.select(row_number(docs).alias("new_row"), docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("body")).withColumn("digest", sha256_hex(F.col("body")))
        met = self.scratch.keep(passing(new, self.filters(), "digest"), "met")
        asked = met.groupBy("digest").agg((F.count("*") * (F.max(F.octet_length("body")) + 64)).alias("bytes")).join(level.select("digest", "first"), "digest")
        # the row that stays brings its bytes, once for each part of those that ask
        held = likely(self.runs().select("row_id", "digest", "body"), asked, "digest").join(asked.select("digest", "bytes", F.col("first.row_id").alias("row_id"), F.col("first.doc_id").alias("keep_id")), ["digest", "row_id"])
        total = met.agg(F.coalesce(F.sum(F.octet_length("body") + 64), F.lit(0))).first()[0]
        found = join_keyed(met, held.select("digest", "bytes", "keep_id", F.col("body").alias("held")), "digest", "bytes", total, "new_row", part=PART_BYTES)
        same = found.filter(F.col("body") == F.col("held")).select("new_row", "doc_id", "keep_id")
        other = found.filter(F.col("body") != F.col("held")).select("new_row", "doc_id", "digest", "body")
        # equal digests of unequal bytes: compare with every row of the digest
        others = other.join(self.runs().select("digest", "body", "n_points", F.col("doc_id").alias("held_id"), "row_id"), ["digest", "body"])
        order = F.struct((-F.col("n_points")).alias("len"), F.col("held_id").isNull().alias("no_id"), "held_id", "row_id")
        return same.unionByName(others.groupBy("new_row", "doc_id").agg(F.min(order).alias("first")).select("new_row", "doc_id", F.col("first.held_id").alias("keep_id"))).drop("new_row")

    def resolve(self) -> DataFrame:
        """Each row with the one that stays of its group, every hit verified byte by byte."""
        level = self.compact()
        rows, distinct = level.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count("*")).first()
        entries = self.runs().drop("body")
        if rows == distinct:
            return entries.select("row_id", "doc_id", "digest", F.lit(1).cast("long").alias("group_size"), F.col("row_id").alias("keep_row"), F.col("doc_id").alias("keep_id"), F.lit(True).alias("kept"))
        hits = level.filter("group_size > 1").select("digest", "group_size", "octets", F.col("first.row_id").alias("keep_row"), F.col("first.doc_id").alias("keep_id"))
        wrong = self._unequal(hits)
        out = join_keyed(entries, hits.drop("octets"), "digest", "group_size", rows, how="left").select(
            "row_id", "doc_id", "digest", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce("keep_row", "row_id").alias("keep_row"), F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        )
        if not wrong.isEmpty():
            out = self._split_groups(out, wrong)
        return out.withColumn("kept", F.col("row_id") == F.col("keep_row"))

    def _unequal(self, hits: DataFrame) -> DataFrame:
        """Digests under which not all rows have the bytes of the row that stays.

        Only rows that the filter lets through carry their bytes into the shuffle. A group is cut
        into parts by bytes, and the row that stays is copied once for each part.
        """
        hits = hits.select("digest", "keep_row", (F.col("group_size") * (F.col("octets") + 64)).alias("bytes"))
        total = hits.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        bodies = likely(self.runs().select("row_id", "digest", "body"), hits, "digest")
        keepers = bodies.select(F.col("row_id").alias("keep_row"), F.col("body").alias("kept_body")).join(hits, "keep_row")
        rest = join_keyed(bodies, keepers, "digest", "bytes", total, part=PART_BYTES).filter("row_id <> keep_row AND body <> kept_body")
        return self.scratch.keep(rest.select("digest").distinct(), "wrong")

    def _split_groups(self, out: DataFrame, wrong: DataFrame) -> DataFrame:
        """Digests that stand for several texts: their rows are grouped anew by the bytes themselves."""
        rows = likely(self.runs(), wrong, "digest").join(wrong, "digest", "left_semi")
        order = F.struct((-F.col("n_points")).alias("len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
        best = rows.groupBy("digest", "body").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
        again = rows.join(best, ["digest", "body"]).select(
            "row_id", "doc_id", "digest", "group_size", F.col("first.row_id").alias("keep_row"), F.col("first.doc_id").alias("keep_id")
        )
        return out.join(wrong, "digest", "left_anti").unionByName(again)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with digest, group_size, keep_id and kept, through a fresh index."""
    index = LsmIndex(docs.sparkSession)
    index.insert(docs)
    return index.resolve()


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY n_points DESC, doc_id)
"""
