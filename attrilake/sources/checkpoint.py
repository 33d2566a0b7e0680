"""Index checkpoints as text files, read and written in a distributed way.

A file starts with a magic line that ends in ``_INDEX_V1``. In the served layout a line with the
server's number and its suffix mode follows; in the plain layout, lists of keys and of suffixes,
each after a line with its length. Then come the number of objects and, for each, a line with its
id and its number of pairs and two lines, key and value, a pair.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.operators.store import ID, KEY, VALUE, suffixes

MAGIC = re.compile(r"[A-Z][A-Z0-9]*_INDEX_V1\Z")
OWN_MAGIC = "ATTRILAKE_INDEX_V1"
SCHEMA = "path string, server int, seq long, object_id long, key string, value string"


def parse(text: str, path: str = "", server: int | None = None):
    """(server, seq, object_id, key, value) of a file's pairs; server is None in the plain layout."""
    lines = text.split("\n")
    if not MAGIC.match(lines[0].strip()):
        raise ValueError(f"{path}: not an index checkpoint")
    head, at, owner = lines[1].split(), 2, None
    if len(head) == 2:
        owner = int(head[0])
        if server is not None and owner != server:
            raise ValueError(f"{path}: of server {owner}, not {server}")
    else:
        at = 2 + int(head[0])
        at += 1 + int(lines[at])
    objects, at, seq = int(lines[at]), at + 1, 0
    for _ in range(objects):
        object_id, pairs = map(int, lines[at].split())
        at += 1
        for k in range(pairs):
            yield owner, seq, object_id, lines[at + 2 * k], lines[at + 2 * k + 1]
            seq += 1
        at += 2 * pairs


def read_checkpoint(spark: SparkSession, path: str, server: int | None = None) -> DataFrame:
    """Triples of all files under ``path``, with the file, server and place that each came from.

    A file with another magic raises an error; so does one of another server if one is named.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def read(batches):
        for batch in batches:
            for name, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                rows = list(parse(text, name, server))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["path", "server", "seq", ID, KEY, VALUE])

    return files.mapInArrow(read, SCHEMA)


def write_servers(triples: DataFrame, path: str, server: Column, suffix_mode: bool = True, magic: str = OWN_MAGIC, plain: bool = False) -> None:
    """A folder ``server=n`` with one text file for each server, in the served or the plain layout.

    ``server`` gives each pair's server. A server's file is one task's work, as the layout has the
    number of objects before them; servers are written side by side. Keys and values with line
    breaks have no place in this format and raise an error; Parquet (``save``) holds them.
    """
    rows = triples.select(server.cast("int").alias("server"), ID, KEY, VALUE)
    if not rows.filter(F.col(KEY).rlike("[\r\n]") | F.col(VALUE).rlike("[\r\n]")).isEmpty():
        raise ValueError("the text layout can't hold line breaks")
    lines = F.flatten(F.transform("pairs", lambda p: F.array(p[KEY], p[VALUE])))
    objects = rows.groupBy("server", ID).agg(F.array_sort(F.collect_list(F.struct(KEY, VALUE))).alias("pairs"))
    objects = objects.select("server", ID, F.concat_ws("\n", F.concat_ws(" ", F.col(ID), F.size("pairs")), F.array_join(lines, "\n")).alias("value"))
    count = rows.groupBy("server").agg(F.count_distinct(ID).alias("n"), F.array_sort(F.collect_set(KEY)).alias("keys"))
    if plain:
        listed = lambda c: F.concat(F.array(F.size(c).cast("string")), c)
        count = count.withColumn("ends", F.array_sort(F.array_distinct(F.flatten(F.transform("keys", suffixes)))))
        top = F.array_join(F.concat(F.array(F.lit(magic)), listed(F.col("keys")), listed(F.col("ends")), F.array(F.col("n").cast("string"))), "\n")
    else:
        top = F.concat_ws("\n", F.lit(magic), F.concat_ws(" ", "server", F.lit(int(suffix_mode))), "n")
    every = count.select("server", F.lit(None).cast("long").alias(ID), top.alias("value")).unionByName(objects)
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    every.repartition(tasks, "server").sortWithinPartitions("server", F.asc_nulls_first(ID)).select("server", "value").write.mode("overwrite").partitionBy("server").text(path)


def write_checkpoint(triples: DataFrame, path: str, server: int = 0, suffix_mode: bool = True, magic: str = OWN_MAGIC) -> None:
    """One server's file in the served layout."""
    write_servers(triples, path, F.lit(server), suffix_mode, magic)
    if triples.isEmpty():
        triples.sparkSession.createDataFrame([(server, f"{magic}\n{server} {int(suffix_mode)}\n0")], "server int, value string").write.mode("overwrite").partitionBy("server").text(path)


def save(triples: DataFrame, path: str, by_key: bool = True) -> None:
    """The native checkpoint: Parquet, a folder a key, so that key patterns prune folders.

    ``by_key`` suits up to some thousand keys; beyond that rows are sorted by key within files, whose
    statistics prune instead. A Bloom filter on values serves exact searches.
    """
    writer = triples.repartition(KEY) if by_key else triples.repartitionByRange(KEY).sortWithinPartitions(KEY, VALUE)
    out = writer.write.mode("overwrite").option("parquet.bloom.filter.enabled#value", "true")
    (out.partitionBy(KEY) if by_key else out).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema(f"{ID} long, {VALUE} string, {KEY} string").parquet(path).select(ID, KEY, VALUE)
