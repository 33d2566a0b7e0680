"""Near-duplicate groups by MinHash, banding and sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles, a signature of minima and a key for
   each band of the signature. Texts of equal sets collapse to one node.
2. Nodes that share a band key are candidates. First each node meets the first node of each of its
   buckets; what links collapses to components. Then only buckets that still hold several
   components are compared in full, in blocks, inside kernels that hand out no more than they read.
3. A candidate's signatures are compared batch by batch. After n minima of which m agree, the
   posterior of the similarity (uniform prior) is Beta(m + 1, n - m + 1); a pair goes as soon as the
   probability that it reaches the threshold falls under ``miss``.
4. Survivors are verified on their full shingle sets; verified links make the components.

The rows of a band follow from the threshold, so that a pair at it misses every bucket with
probability ``miss`` at most: 24 bands of 5 at 0.85 (8e-7), 30 bands of 4 at 0.8 (1.4e-7).

Defined results: null or blank text has no shingles and is linked with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; rows of equal sets are linked whatever
their ids; a component's id is its smallest doc_id, nulls last; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.llm.common import Scratch, components, join_keyed, join_salted, likely, row_number
from attrilake.llm.shingles import mix, shingle_sets, slices

WORDS, PERCENT = 5, 85
BANDS, ROWS = 24, 5
#: Minima that are compared before the posterior is looked at again, and the chance to miss a link there.
BATCH, MISS = 24, 1e-6
#: Members of a bucket that meet in one block, and array elements that a MinHash pass handles at once.
BLOCK, ELEMENTS = 1024, 1 << 16

_RANDOM = np.random.Generator(np.random.PCG64(1729))
_FLIP = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BANDS * ROWS) minima; every set must have an element."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= ELEMENTS):
            total += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(BANDS * ROWS):
            y = (x ^ _FLIP[k]) * _TIMES[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[at:end, k] = np.minimum.reduceat(y, first)
        at = end
    return out


def band_rows(percent: int, miss: float) -> int:
    """The most rows of a band, ROWS at most, with which a pair at the threshold misses all bands with probability ``miss`` at most."""
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (BANDS * ROWS // rows) <= miss:
            return rows
    raise ValueError(f"{BANDS * ROWS} minima miss links at {percent} percent")


def band_keys(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, different for equal values of different bands."""
    bands = BANDS * ROWS // rows
    parts = minima.reshape(len(minima), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def least_matches(percent: int, miss: float) -> dict[int, int]:
    """For each number n of minima looked at, the fewest matches m with P(J >= t | m, n) >= miss.

    P(J >= t) under Beta(m + 1, n - m + 1) is the chance of m successes at most in n + 1 trials at t.
    """
    t, need = percent / 100, {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        need[n] = m
    return need


def plausible(sign: np.ndarray, a: np.ndarray, b: np.ndarray, need: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (a, b) of the signatures the posterior doesn't rule out, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in need.items():
        batch = slice(n - BATCH, n)
        matches[alive] += (sign[a[alive], batch] == sign[b[alive], batch]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def as_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


SIGNED = "row_id long, doc_id long, text_key string, n_shingles long, digest string, keys array<long>, signature binary"


def signed(docs: DataFrame, band: int = ROWS) -> DataFrame:
    """Every row with its set's size and digest, band keys and signature (null for empty sets)."""
    rows = docs.select(row_number(docs).alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"), F.md5(docs["text"].cast("binary")).alias("text_key"), docs["text"].cast("string").alias("text"))

    def sign(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), WORDS)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys, minima = [None] * len(sets), [None] * len(sets)
                if some:
                    found = signatures([sets[i] for i in some])
                    for i, k, m in zip(some, band_keys(found, band), found, strict=True):
                        keys[i], minima[i] = k, m.tobytes()
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())],
                    ["row_id", "doc_id", "text_key", "n_shingles", "digest", "keys", "signature"],
                )

    return rows.mapInArrow(sign, SIGNED)


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the nodes in ``wanted`` (node, text_key); a text that many rows have comes once."""
    texts = docs.select(F.md5(docs["text"].cast("binary")).alias("text_key"), docs["text"].cast("string").alias("text"))
    texts = likely(texts, wanted, "text_key").groupBy("text_key").agg(F.any_value("text").alias("text"))
    return wanted.join(texts, "text_key").select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are as similar as that."""
    pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_key"), "node")
    texts = scratch.keep(texts_of(wanted, docs), f"{name}-texts")
    right = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = join_salted(right, texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a", "b", 256)

    def check(batches):
        known: dict[int, np.ndarray] = {}  # sets of recent a's
        for batch in (part for whole in batches for part in slices(whole, "text_b")):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            if len(known) > 256:
                known.clear()
            fresh = list({x: i for i, x in enumerate(a) if x not in known}.values())
            for one in slices(batch.take(pa.array(fresh, pa.int64())), "text_a"):
                known.update(zip(one.column("a").to_pylist(), shingle_sets(one.column("text_a"), WORDS), strict=True))
            keep = []
            for i, s in enumerate(shingle_sets(batch.column("text_b"), WORDS)):
                r = known[a[i]]
                shared = len(np.intersect1d(r, s, assume_unique=True))
                keep.append(100 * shared >= percent * (len(r) + len(s) - shared))
            at = pa.array([i for i, k in enumerate(keep) if k], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).take(at), pa.array(b, pa.int64()).take(at)], ["a", "b"])

    out = scratch.keep(both.mapInArrow(check, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return out


def first_candidates(members: DataFrame, nodes: DataFrame, need: dict[int, int]) -> DataFrame:
    """Each node with the first node of each of its buckets, if the signatures leave a chance."""
    pairs = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    minima = nodes.select("node", "signature")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    left = sizes.join(minima.withColumnsRenamed({"node": "a", "signature": "sign_a"}), "a")
    total = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    both = join_keyed(pairs.join(minima.withColumnsRenamed({"node": "b", "signature": "sign_b"}), "b"), left, "a", "pairs", total, "b")

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                both = np.concatenate([as_matrix(batch.column("sign_a")), as_matrix(batch.column("sign_b"))])
                n = batch.num_rows
                at = pa.array(plausible(both, np.arange(n), np.arange(n, 2 * n), need)[0])
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return both.select("a", "b", "sign_a", "sign_b").mapInArrow(prune, "a long, b long")


@dataclass
class Block:
    """Rows of one block, or of two that meet: ``right`` tells the second block's rows."""

    node: np.ndarray
    root: np.ndarray
    right: np.ndarray
    keys: np.ndarray
    sign: np.ndarray
    text: list | None
    head: tuple

    def pairs(self, need: dict[int, int]):
        """(a, b, matches) of pairs of rows of different roots that the signatures leave a chance.

        A pair meets in every bucket that it shares; it counts in that of the first band alone.
        """
        bucket, i, j = self.head
        found, a, b = [], [], []
        left = np.arange(len(self.node)) if i == j else np.flatnonzero(~self.right)
        second = np.flatnonzero(self.right)

        def flush():
            x, y = np.concatenate(a), np.concatenate(b)
            same = self.keys[x] == self.keys[y]
            x, y = (z[self.keys[x, same.argmax(1)] == bucket] for z in (x, y))
            alive, matches = plausible(self.sign, x, y, need)
            found.append((x[alive], y[alive], matches))
            a.clear(), b.clear()

        for k in left:
            others = np.arange(k + 1, len(self.node)) if i == j else second
            others = others[self.root[others] != self.root[k]]
            if len(others):
                a.append(np.full(len(others), k))
                b.append(others)
                if sum(map(len, a)) > 1 << 15:
                    flush()
        if a:
            flush()
        return [np.concatenate(z) for z in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3

    def links(self, need: dict[int, int], percent: int):
        """Verified links, likeliest pairs first; a pair whose rows are joined already is passed over."""
        x, y, matches = self.pairs(need)
        order = np.argsort(-matches, kind="stable")
        sets: dict[int, np.ndarray] = {}
        parent = {r: r for r in self.root.tolist()}

        def top(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        def shingles(k):
            if k not in sets:
                sets[k] = shingle_sets(pa.array([self.text[k]], pa.large_string()), WORDS)[0]
            return sets[k]

        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            r, s = top(int(self.root[a])), top(int(self.root[b]))
            if r != s:
                p, q = shingles(a), shingles(b)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * shared >= percent * (len(p) + len(q) - shared):
                        parent[max(r, s)] = min(r, s)
                        yield int(self.node[a]), int(self.node[b])


def in_blocks(batches, with_text: bool):
    """Blocks of rows that come sorted by (bucket, i, j)."""
    names = ["bucket", "i", "j", "right", "node", "root", "keys", "signature"] + ["text"] * with_text
    held: list[tuple] = []

    def block(rows):
        column = dict(zip(names, zip(*rows, strict=True), strict=True))
        return Block(np.array(column["node"]), np.array(column["root"]), np.array(column["right"]), np.array(column["keys"]), np.frombuffer(b"".join(column["signature"]), np.uint32).reshape(len(rows), -1), column.get("text"), rows[0][:3])

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if held and held[0][:3] != row[:3]:
                yield block(held)
                held = []
            held.append(row)
    if held:
        yield block(held)


def rest_links(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, need: dict[int, int], percent: int) -> DataFrame:
    """Links (a, b) between nodes of one bucket but of different components, as many as join them.

    A bucket of over BLOCK members is cut into blocks, each pair of which meets in a kernel. The
    first kernel tells which rows have a partner left after the signatures were compared; only
    these get their texts, and the second kernel verifies, likeliest pairs first, and hands out a
    link only where it joins components. So no kernel gives more rows than it reads.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    rows = join_keyed(placed.select("bucket", "node", "root"), mixed, "bucket", "size", members.count(), "node").withColumn("mine", F.pmod(F.xxhash64("node"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("right"), "node", "root")
    signs = nodes.select("node", "keys", "signature")
    met = rows.join(signs, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def partnered(batches):
        for b in in_blocks(batches, False):
            x, y, _ = b.pairs(need)
            at = np.union1d(x, y).astype(np.int64)
            if len(at):
                bucket, i, j = b.head
                columns = [pa.array(np.full(len(at), v), pa.int64()) for v in (bucket, i, j)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(b.right[at]), pa.array(b.node[at]), pa.array(b.root[at])], ["bucket", "i", "j", "right", "node", "root"])

    left = scratch.keep(met.mapInArrow(partnered, "bucket long, i long, j long, right boolean, node long, root long"), "partnered")
    wanted = left.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    texts = texts_of(wanted, docs)
    again = left.join(signs, "node").join(texts, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def verify(batches):
        for b in in_blocks(batches, True):
            found = list(b.links(need, percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    columns = ["bucket", "i", "j", "right", "node", "root", "keys", "signature", "text"]
    return scratch.keep(again.select(*columns).mapInArrow(verify, "a long, b long").distinct(), "rest-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id (smallest doc_id reachable) and keep_row of every row of ``docs``.

    keep_row is the row of its component that stays: the first by doc_id, then row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    need = least_matches(percent, miss)
    band = band_rows(percent, miss)
    rows = scratch.keep(signed(docs, band), "signed")
    classes = scratch.keep(rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("row_id").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("least"), F.count("*").alias("copies")), "classes")
    nodes = scratch.keep(rows.join(classes.select(F.col("node").alias("row_id")), "row_id").select(F.col("row_id").alias("node"), "text_key", "keys", "signature"), "nodes")
    members = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = scratch.keep(join_keyed(members, shared, "bucket", "size", nodes.count() * (BANDS * ROWS // band), "node").select("bucket", "node", "first"), "members")
    links = verified(first_candidates(members, nodes, need), nodes, docs, scratch, "first", percent)
    roots = components(links, scratch, "first")
    more = rest_links(members, roots, nodes, docs, scratch, need, percent)
    if not more.isEmpty():
        # the new links join components: label them by roots, and follow what joins them
        for side in ("a", "b"):
            known = roots.select(F.col("node").alias(side), F.col("root").alias("known"))
            more = more.join(known, side, "left").withColumn(side, F.coalesce("known", side)).drop("known")
        tops = components(more.select("a", "b").distinct(), scratch, "rest").select(F.col("node").alias("under"), F.col("root").alias("above"))
        every = roots.unionByName(tops.select(F.col("under").alias("node"), F.col("under").alias("root")).join(roots.select("node"), "node", "left_anti"))
        roots = every.join(tops, F.col("root") == F.col("under"), "left").select("node", F.coalesce("above", "root").alias("root"))
    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("stays"), F.count("*").alias("members"))
    count = classes.count()
    known = join_keyed(grouped, least, "root", "members", count, "node").filter("members > 1 OR copies > 1")
    known = scratch.keep(known.select("digest", "copies", F.col("stays.doc_id").alias("component_id"), F.col("stays.row_id").alias("keep_row")), "known")
    scratch.drop_but("signed", "known")
    out = join_keyed(rows.select("row_id", "doc_id", "n_shingles", "digest"), known, "digest", "copies", rows.count(), how="left")
    return out.select("row_id", "doc_id", "n_shingles", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keep_row", "row_id").alias("keep_row"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs that share a shingle; for small tables, as its joins grow with the square of a group.
OP1_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM texts),
sizes AS (SELECT doc_id, count(s) AS n FROM texts LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN (SELECT x, y FROM links UNION SELECT y, x FROM links) ON x = doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
