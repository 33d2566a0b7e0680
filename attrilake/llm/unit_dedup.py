"""Substring deduplication by hashing units: lines, and windows of words for passages inside lines.

Units are normalised (A-Z as a-z, runs of white space as one) and hashed to 128 bits; digests are
grouped over all documents, the earliest occurrence by (doc_id, row, place) stays and all others are
removed. There are three sizes of unit, the larger ones first:

* whole texts: equal ones leave one, so that groups of copies never meet again line by line;
* lines: each later occurrence is marked, whatever its length;
* windows of PASSAGE words at every place, so that a passage set into the middle of a line goes as
  well. A window's least GRAM-word gram is the same wherever it stands, so only windows whose gram
  is repeated are written and grouped. In one row the earlier window must end before the later begins.

Marked units that overlap or touch become one run; runs of ``least_words`` words or more are removed.
A run keeps its offsets (code points, ends exclusive) in the original text.

Defined results: null and blank texts have no units; null doc_ids rank last; repeated rows lose
everything but their first occurrence; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrilake.llm.common import ROW, Scratch, join_keyed, likely, numbered
from attrilake.llm.shingles import mix, powers, slices, words_of

#: Words of a window that goes when it stands earlier, and of the grams that find it.
PASSAGE, GRAM = 51, 20
#: Line breaks: U+000A to U+000D.
_BREAK = np.zeros(256, bool)
_BREAK[10:14] = True
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class Units:
    """The words of a column's rows, and digests of any run of them from running sums."""

    def __init__(self, column: pa.Array):
        self.hashes, self.first, self.starts, self.ends, self.raw, self.offsets = words_of(column)
        n = len(self.hashes)
        self.up, self.down = powers(n + 1)
        self.sums = []
        for h in (self.hashes, mix(self.hashes ^ _SECOND)):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(h * self.up[:n], dtype=np.uint64, out=total[1:])
            self.sums.append(total)

    def hash(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """64 bits for the words from a to b (exclusive); an array of each."""
        total = self.sums[which]
        return mix((total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64) * _SECOND)

    def digests(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """128 bits for each run of words."""
        both = np.stack([self.hash(a, b), self.hash(a, b, 1)], 1)
        return pa.Array.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())

    def points(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Offsets in code points, within their rows, of these bytes."""
        inside = self.raw >= 0x80
        if not inside.any():
            return at - self.offsets[row]
        before = np.zeros(len(self.raw) + 1, np.int32 if len(self.raw) < 1 << 31 else np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, dtype=before.dtype, out=before[1:])
        return before[at].astype(np.int64) - before[self.offsets[row]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and end (exclusive) of every line that has words."""
        n = len(self.hashes)
        if not n:
            return (np.empty(0, np.int64),) * 3
        breaks = np.searchsorted(np.flatnonzero(_BREAK[self.raw]), self.starts)
        new = np.r_[True, breaks[1:] != breaks[:-1]]
        row_starts = self.first[:-1]
        new[row_starts[row_starts < n]] = True
        a = np.flatnonzero(new)
        return np.searchsorted(self.first, a, "right") - 1, a, np.r_[a[1:], n]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, gram, first window and end (exclusive) of all windows of PASSAGE words, by the least gram in them.

        Neighbouring windows with one least gram (the first of equal ones) are one segment; which
        gram a window has depends on its own words alone.
        """
        n, width = len(self.hashes), PASSAGE - GRAM + 1
        if n < PASSAGE:
            return (np.empty(0, np.int64),) * 4
        place = np.arange(n - GRAM + 1)
        gram = self.hash(place, place + GRAM)
        best, size = place, 1  # the place of the least of ``size`` grams from each place on
        while size < width:
            step = min(size, width - size)
            a, b = best[:-step], best[step:]
            best, size = np.where(gram[b] < gram[a], b, a), size + step
        lengths = np.diff(self.first)
        windows = np.flatnonzero(np.arange(len(best)) + PASSAGE <= np.repeat(self.first[1:], lengths)[: len(best)])  # within one row
        if not len(windows):
            return (np.empty(0, np.int64),) * 4
        of = best[windows]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (windows[1:] != windows[:-1] + 1)])
        a, b = windows[new], windows[np.r_[new[1:], len(windows)] - 1] + 1
        return np.searchsorted(self.first, a, "right") - 1, gram[of[new]].view(np.int64), a, b


CUT = (
    "row_id long, doc_id long, digest binary, n_words int, start int, end int, lines array<binary>, line_at array<int>, line_to array<int>, line_starts array<int>, line_ends array<int>, "
    "grams array<long>, segments array<binary>, segment_at array<int>, segment_to array<int>, segment_starts array<int>, segment_ends array<int>"
)


def cut(docs: DataFrame) -> DataFrame:
    """A row a text that has words: its digest, its lines and its segments of windows."""
    names = [c.split()[0] for c in CUT.split(", ")]
    ints = lambda x: pa.array(x.astype(np.int32))

    def map_cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                units = Units(batch.column("text"))
                a, b = units.first[:-1], units.first[1:]
                rows = np.flatnonzero(b > a)
                if not len(rows):
                    continue
                a, b, taken = a[rows], b[rows], pa.array(rows)

                def spans(of, c, d, *others):
                    """Lists by row: digests, places of the first word and of the end, offsets of both."""
                    at = ints(np.r_[np.searchsorted(of, rows), len(of)])  # noqa: B023
                    values = [*others, units.digests(c, d), ints(c - units.first[of]), ints(d - units.first[of]), ints(units.points(units.starts[c], of)), ints(units.points(units.ends[d - 1], of))]  # noqa: B023
                    return [pa.ListArray.from_arrays(at, v) for v in values]

                of, gram, c, d = units.segments()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id").take(taken), batch.column("doc_id").take(taken), units.digests(a, b), ints(b - a),
                        ints(units.points(units.starts[a], rows)), ints(units.points(units.ends[b - 1], rows)),
                        *spans(*units.lines()), *spans(of, c, d + PASSAGE - 1, pa.array(gram)),
                    ], names,
                )

    return docs.filter("text IS NOT NULL").select("row_id", "doc_id", "text").mapInArrow(map_cut, CUT)


#: What earlier units cover: places of words (``to`` exclusive), offsets, whole units, and who keeps them.
COVER = ("row_id", "doc_id", "word", "to", "start", "end", "n_units", "first_doc_id")


def rank(*place: str):
    """Order of occurrences: doc_id, nulls last, then row, then place."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", *place)


def with_first(units: DataFrame, total: int, scratch: Scratch, name: str) -> DataFrame:
    """The units whose digest stands more than once, with ``first``, where it stands first (doc_id, row_id, word)."""
    counted = scratch.keep(units.groupBy("digest").agg(F.count("*").alias("times")).filter("times > 1"), f"repeated-{name}")
    met = scratch.keep(join_keyed(likely(units, counted, "digest"), counted, "digest", "times", total), f"met-{name}")
    scratch.drop(f"repeated-{name}")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "word")
    first = met.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("times"))
    return join_keyed(met.drop("times"), first, "digest", "times", total).drop("times")


def repeated_texts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """COVER of texts that an earlier one equals."""
    units = texts.select("row_id", "doc_id", "digest", F.lit(0).alias("word"), F.col("n_words").alias("to"), "start", "end")
    found = with_first(units, texts.count(), scratch, "texts").filter(F.col("row_id") != F.col("first.row_id"))
    return found.select("row_id", "doc_id", "word", "to", "start", "end", F.lit(1).alias("n_units"), F.col("first.doc_id").alias("first_doc_id"))


def listed(texts: DataFrame, **columns: str) -> DataFrame:
    """A row an element of these list columns, under new names."""
    each = texts.select("row_id", "doc_id", F.explode(F.arrays_zip(*columns.values())).alias("u"))
    return each.select("row_id", "doc_id", *(F.col("u")[old].alias(new) for new, old in columns.items()))


def elements(texts: DataFrame, column: str) -> int:
    return texts.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]


def repeated_lines(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """COVER of every later occurrence of a line."""
    lines = listed(texts, digest="lines", word="line_at", to="line_to", start="line_starts", end="line_ends")
    found = with_first(lines, elements(texts, "lines"), scratch, "lines").filter(~((F.col("row_id") == F.col("first.row_id")) & (F.col("word") == F.col("first.word"))))
    return found.select("row_id", "doc_id", "word", "to", "start", "end", F.lit(1).alias("n_units"), F.col("first.doc_id").alias("first_doc_id"))


def repeated_windows(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """COVER of windows of PASSAGE words that stand earlier.

    Only segments whose gram is repeated take part. Of equal segments in several texts the first
    text's are opened, window by window; the others are covered whole, so that the windows of a
    passage that many texts share are compared once.
    """
    total = elements(texts, "grams")
    repeated = scratch.keep(texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1"), "repeated-grams")
    every = listed(texts, gram="grams", digest="segments", word="segment_at", to="segment_to", start="segment_starts", end="segment_ends")
    known = scratch.keep(join_keyed(likely(every, repeated, "gram"), repeated, "gram", "times", total).drop("gram", "times"), "segments")
    scratch.drop("repeated-grams")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    first = known.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("times")).filter("times > 1")
    known = scratch.keep(join_keyed(known, first, "digest", "times", total, how="left").drop("digest", "times"), "ranked-segments")
    scratch.drop("segments")
    later = known.filter("first.row_id <> row_id").select("row_id", "doc_id", "word", "to", "start", "end", F.col("first.doc_id").alias("first_doc_id"))
    ranges = known.filter("first IS NULL OR first.row_id = row_id").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("word", "to"))).alias("ranges"))
    ranges = scratch.keep(ranges, "ranges")
    found = likely(rows, ranges, "row_id").join(ranges, "row_id").select("row_id", "doc_id", "text", "ranges")
    windows = scratch.keep(found.mapInArrow(opened, "row_id long, doc_id long, word int, start int, end int, own boolean, digest binary"), "windows")
    scratch.drop("ranges")
    found = with_first(windows, windows.count(), scratch, "windows").filter("own OR first.row_id <> row_id")
    scratch.drop("windows")
    found = found.withColumn("run", F.col("word") - F.row_number().over(Window.partitionBy("row_id").orderBy("word")))
    found = found.groupBy("row_id", "doc_id", "run").agg(F.min("word").alias("word"), (F.max("word") + PASSAGE).alias("to"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first.doc_id", "word").alias("first_doc_id"))
    return found.drop("run").unionByName(later).withColumn("n_units", F.lit(0))


def opened(batches):
    """A row a window of the ranges (first word, end) of each text; ``own`` where the text itself has it before."""
    for whole in batches:
        for batch in slices(whole, "text"):
            units = Units(batch.column("text"))
            ranges = batch.column("ranges").combine_chunks() if isinstance(batch.column("ranges"), pa.ChunkedArray) else batch.column("ranges")
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ranges).to_numpy())
            at, to = (ranges.flatten().field(i).to_numpy() for i in (0, 1))
            count = to - at - (PASSAGE - 1)
            row = np.repeat(rows, count)
            word = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
            place = units.first[row] + word
            key = units.hash(place, place + PASSAGE)
            order = np.lexsort((word, key, row))
            new = np.r_[True, (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])]
            own = np.empty(len(row), bool)
            own[order] = word[order] >= word[order][np.flatnonzero(new)][np.cumsum(new) - 1] + PASSAGE
            taken, ints = pa.array(row), lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(taken), batch.column("doc_id").take(taken), ints(word), ints(units.points(units.starts[place], row)),
                    ints(units.points(units.ends[place + PASSAGE - 1], row)), pa.array(own), units.digests(place, place + PASSAGE),
                ], ["row_id", "doc_id", "word", "start", "end", "own", "digest"],
            )


def repeated_runs(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """A row a run to remove: row_id, doc_id, start, end, n_words, n_units, first_doc_id.

    n_units counts the run's whole lines (1 where the whole text goes as one); first_doc_id is the
    document that keeps the longest unit or passage of the run.
    """
    scratch = Scratch(docs.sparkSession, "units")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *([ROW] if ROW in docs.columns else []))
    rows = (rows if ROW in docs.columns else numbered(rows, scratch)).withColumnRenamed(ROW, "row_id")
    texts = scratch.keep(cut(rows), "cut")
    copies = scratch.keep(repeated_texts(texts, scratch).select(*COVER), "copies")
    scratch.drop("met-texts")
    texts = scratch.keep(texts.join(copies.select("row_id"), "row_id", "left_anti"), "texts") if not copies.isEmpty() else texts
    if "texts" in scratch.names:
        scratch.drop("cut")
    lines = scratch.keep(repeated_lines(texts, scratch).select(*COVER), "lines")
    scratch.drop("met-lines")
    windows = scratch.keep(repeated_windows(rows, texts, scratch).select(*COVER), "passages")
    scratch.drop_but("copies", "lines", "passages")
    every = copies.unionByName(lines).unionByName(windows)
    # what overlaps or touches becomes one
    by_word = Window.partitionBy("row_id").orderBy("word", "to")
    every = every.withColumn("new", F.coalesce(F.col("word") > F.max("to").over(by_word.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    every = every.withColumn("run", F.sum("new").over(by_word.rowsBetween(Window.unboundedPreceding, 0)))
    every = every.groupBy("row_id", "doc_id", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("to") - F.min("word")).cast("long").alias("n_words"), F.sum("n_units").alias("n_units"),
        F.max(F.struct((F.col("to") - F.col("word")).alias("words"), F.col("first_doc_id").alias("of"))).alias("longest"),
    )
    return every.filter(F.col("n_words") >= least_words).select("row_id", "doc_id", "start", "end", "n_words", "n_units", F.col("longest.of").alias("first_doc_id"))


def without_runs(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """``docs`` without its repeated runs, and ``segments``: where each piece that stays was (start, end)."""
    rows = numbered(docs, Scratch(docs.sparkSession, "without"))
    spans = repeated_runs(rows, least_words).groupBy(F.col("row_id").alias(ROW)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__gone__"))
    size = F.char_length(F.coalesce("text", F.lit("")))
    joined = rows.join(spans, ROW, "left").withColumn("__gone__", F.coalesce("__gone__", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("__gone__", lambda g: g["end"]))
    starts = F.concat(F.transform("__gone__", lambda g: g["start"]), F.array(size.cast("long")))
    joined = joined.withColumn("segments", F.filter(F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s["end"] > s["start"]))
    text = F.when(F.size("__gone__") == 0, F.col("text")).otherwise(F.expr("array_join(transform(segments, s -> substring(text, cast(s.start as int) + 1, cast(s.end - s.start as int))), '')"))
    return joined.withColumn("text", text).drop(ROW, "__gone__")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand earlier; shorter repeats, as any two texts share, stay."""
    return repeated_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), PASSAGE).select("doc_id", "start", "end", "n_words")


#: Every window and line of every text, grouped; for small tables.
OP7_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, regexp_split_to_array(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS g FROM documents),
low AS (SELECT doc_id, w, g, string_split(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS l FROM texts WHERE len(w) > 0),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(l) AS l, unnest(w) AS w, unnest(g[1 : len(w)]) AS g FROM low),
placed AS (SELECT doc_id, i, l, sum(length(g) + length(w)) OVER t AS stop, length(w) AS n, sum(CASE WHEN i = 1 OR regexp_matches(g, '[\x0A-\x0D]') THEN 1 ELSE 0 END) OVER t AS line
  FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
lines AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b, string_agg(l, ' ' ORDER BY i) AS unit FROM placed GROUP BY doc_id, line),
windows AS (SELECT doc_id, a, a + 51 AS b, md5(array_to_string(l[a : a + 50], ' ')) AS unit FROM (SELECT doc_id, l, unnest(range(1, len(l) - 49)) AS a FROM low)),
marked AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, a) AS k FROM lines) WHERE k > 1
  UNION ALL SELECT doc_id, a, b FROM (SELECT *, first_value(doc_id) OVER u AS d, first_value(a) OVER u AS f FROM windows WINDOW u AS (PARTITION BY unit ORDER BY doc_id, a)) WHERE doc_id <> d OR a >= f + 51),
begun AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM marked),
runs AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM begun) GROUP BY doc_id, run)
SELECT runs.doc_id, CAST(p.stop - p.n AS BIGINT) AS start, CAST(q.stop AS BIGINT) AS "end", CAST(b - a AS BIGINT) AS n_words
FROM runs JOIN placed p ON p.doc_id = runs.doc_id AND p.i = a JOIN placed q ON q.doc_id = runs.doc_id AND q.i = b - 1 WHERE b - a >= 51
"""
