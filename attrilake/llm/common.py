"""What the operators share: scratch tables, joins that survive hot keys, UTF-8 helpers."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.sources.shared import drop_path, shared_dir

#: The white space that the contracts name: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors.

    ``drop`` deletes a table that no later step reads; what a returned, still lazy DataFrame reads
    goes when the session ends, or when whoever called within ``owned`` has written the result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/attrilake/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        self.ended = False
        owner = _OWNER.get()
        if owner is not None:
            owner.append(self)
        atexit.register(self.end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        writer = df.write.mode("overwrite")
        for k, v in options.items():
            writer = writer.option(k, v)
        writer.parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table; the shuffle files of finished steps go with it, as Spark's cleaner follows the driver's collector."""
        drop_path(self.spark, self.path(name))
        self.names.discard(name)
        self.spark.sparkContext._jvm.System.gc()

    def drop_but(self, *needed: str) -> None:
        """Delete all tables but these."""
        for name in self.names - set(needed):
            self.drop(name)

    def end(self) -> None:
        """Delete all of it."""
        if not self.ended:
            self.ended = True
            atexit.unregister(self.end)
            with contextlib.suppress(Exception):  # the session may be gone already
                drop_path(self.spark, self.root)


#: Where the caller collects the scratch folders that are made on its behalf.
_OWNER: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("owner", default=None)


@contextlib.contextmanager
def owned():
    """Within it, the scratch folders that operators make belong to the caller, who ends them once their results are written."""
    made: list[Scratch] = []
    outer = _OWNER.get()
    token = _OWNER.set(made)
    try:
        yield made
    finally:
        _OWNER.reset(token)
        if outer is not None:
            outer.extend(made)


def readers(df: DataFrame) -> list:
    """JVM weak references to what lists the files that ``df`` reads; every plan made from ``df`` holds the same objects."""
    jvm, leaves = df.sparkSession.sparkContext._jvm, df._jdf.queryExecution().analyzed().collectLeaves()
    relations = [leaf.relation() for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation"]
    return [jvm.java.lang.ref.WeakReference(r.location()) for r in relations if r.getClass().getSimpleName() == "HadoopFsRelation"]


#: Scratch folders with the references by which a returned DataFrame, or one made from it, can still be read.
_LENT: list[tuple[list[Scratch], list]] = []


def lend(out: DataFrame, made: list[Scratch]) -> DataFrame:
    """``out``; ``made`` ends at a later ``reclaim`` by which neither it nor any DataFrame made from it is left.

    An RDD made from it doesn't count.
    """
    refs = readers(out)
    if refs and made:
        _LENT.append((made, refs))
    return out


def reclaim(spark: SparkSession) -> None:
    """End lent scratch folders that no DataFrame can read any more."""
    if _LENT:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    for entry in list(_LENT):
        made, refs = entry
        if all(s.ended for s in made) or all(r.get() is None for r in refs):
            for s in made:
                s.end()
            _LENT.remove(entry)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What is run within it hands ``rows`` rows at a time to Python at most: wide rows then take less memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Column that names a row where doc_ids may repeat or be null.
ROW = "__attrilake_row__"


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ROW, a number for each row that stays the same whenever the rows are read again."""
    return scratch.keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def row_number(docs: DataFrame) -> Column:
    """ROW where there is one, else numbers in scan order."""
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()


#: A key is hot when it has more rows than this, and more than one in HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 512, 20_000


def hot_rows(total: int) -> int:
    """Rows from which a key counts as hot, so that there are at most HOT_KEYS hot keys."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


#: Bytes of a hot key's rows that one part holds, where rows are wide.
PART_BYTES = 32 << 20


def join_keyed(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: str = "row_id", how: str = "inner", part: int | None = None) -> DataFrame:
    """rows join groups on ``key`` where ``groups`` has one row a key and its row count ``size``.

    A key with over hot_rows(total) rows is cut into parts of about that many, dealt by the hash of
    ``spread``, and its group is copied once for each part. Only the hot keys and their numbers of
    parts are broadcast: there are fewer than total / hot_rows(total) of them, HOT_KEYS at most.
    Where rows are wide, ``size`` and ``total`` count bytes and ``part`` is the bytes of a part.
    Rows without a key meet nobody and are dealt evenly.
    """
    least = hot_rows(total) if part is None else max(part, -(-total // HOT_KEYS))
    parts = F.when(F.col(size) > least, F.ceil(F.col(size) / (part or least))).otherwise(1).cast("long")
    hot = groups.filter(F.col(size) > least).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    mixed = F.xxhash64(spread)
    salt = F.when(F.col(key).isNull(), mixed).otherwise(F.pmod(mixed, F.coalesce("_parts", F.lit(1).cast("long"))))
    dealt = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_parts")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def join_salted(rows: DataFrame, groups: DataFrame, key: str, spread: str, part: int = HOT_ROWS) -> DataFrame:
    """rows join groups on ``key``, where a row of ``groups`` may be large and a key have many rows.

    The rows of a key are dealt by ``spread`` to parts of about ``part`` rows, and its group is
    copied once for each part. Only keys and counts are broadcast, of hot keys alone.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size"))
    total = rows.count()
    parts = F.ceil(F.col("_size") / part).cast("long")
    dealt = join_keyed(rows, sizes, key, "_size", total, spread).withColumn("_salt", F.pmod(F.xxhash64(spread), parts)).drop("_size")
    copies = groups.join(sizes, key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_size")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


#: Bits of a filter that says which rows may have one of many keys: 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """The keys' hash bits as a bitmap in slots of 4 KB: FILTER_BITS / 32768 rows at most, 4 MB."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return keys.groupBy(F.shiftright(bit, 15).alias("_slot")).agg(F.bitmap_construct_agg(bit % 32768).alias("_bits"))


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be one of ``keys``; none that is one is missing.

    It keeps wide rows out of a shuffle in which they'd find no partner.
    """
    return passing(rows, key_filter(keys, key), key)


def passing(rows: DataFrame, bitmap: DataFrame, key: str) -> DataFrame:
    """The rows that a ``key_filter`` lets through; it is broadcast."""
    return marked(rows, bitmap, F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)))


def marked(rows: DataFrame, bitmap: DataFrame, bit: Column) -> DataFrame:
    """The rows whose ``bit`` is set in ``bitmap``, which has a row for each slot of 32,768 bits and is broadcast."""
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(bit % 32768, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    found = rows.join(F.broadcast(bitmap), F.col("_slot") == F.shiftright(bit, 15))
    return found.filter(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1).drop("_slot", "_bits")


#: Bytes of the bitmaps of row numbers that ``chosen`` broadcasts at most; past that it joins.
MARK_BYTES = 64 << 20


def chosen(rows: DataFrame, found: DataFrame, most: int = MARK_BYTES) -> DataFrame:
    """The ``rows`` whose ROW is one of ``found``'s, without a shuffle of ``rows``.

    A scan numbers its rows one after the other, so a slot of 4 KB marks up to 32,768 rows of a
    partition. The marks are exact; if there are more bytes of them than ``most``, rows are joined.
    """
    marks = found.groupBy(F.shiftright(ROW, 15).alias("_slot")).agg(F.bitmap_construct_agg(F.col(ROW) % 32768).alias("_bits"))
    if marks.count() * 4096 > most:
        return rows.join(found.select(ROW), ROW, "left_semi")
    return marked(rows, marks, F.col(ROW))


#: Edges that one task of a round of ``components`` handles at least.
EDGES_A_TASK = 1_000_000


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root of the connected components of ``edges`` (a, b); the root is the least node.

    In every round each root hooks to the least root next to it, hooks are followed to their ends by
    doubling, and edges inside a tree drop out. The number of rounds grows with the logarithm of the
    longest path. All of it stays distributed; a round's tables are written, so lineage stays short.
    """
    live = scratch.keep(edges.select("a", "b"), f"{name}-edges-0")
    tasks = 1 + live.count() // EDGES_A_TASK
    keep = lambda df, what: scratch.keep(df.coalesce(tasks), f"{name}-{what}")
    roots = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    step = 0
    while not live.isEmpty():
        step += 1
        # the least root next to each root: a minimum by key, combined before the shuffle
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = keep(both.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"), f"hook-{step}")
        while True:
            longer = parent.join(parent.select(F.col("a").alias("to"), F.col("to").alias("top")), "to", "left")
            if longer.filter("top IS NOT NULL").isEmpty():
                break
            step += 1
            parent = keep(longer.select("a", F.coalesce("top", "to").alias("to")), f"hook-{step}")
        ends = parent.select(F.col("a").alias("root"), "to")
        roots = keep(roots.join(ends, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"roots-{step}")
        for side in ("a", "b"):
            live = live.join(ends.withColumnRenamed("root", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        live = keep(live.filter("a <> b").select("a", "b").distinct(), f"edges-{step}")
    return roots


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark application."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="attrilake-")) / "attrilake.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, Path(top.name) / f.relative_to(top))
    context.addPyFile(str(at))
    _SHIPPED.add(context.applicationId)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
