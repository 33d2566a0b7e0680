"""Packing of documents into training sequences by lexical retrieval.

Documents are tokenised once. Document frequencies and lengths are counted over all of them, and
so are BM25's weights. Documents are then sorted by lexical content: by the minima of MINIMA hashes
over their terms, each hash weighted by the terms' rarity, so that documents which share rare terms
tend to stand side by side (two with a weighted overlap of J start with the same minimum with
probability J). Consecutive documents make a shard of SHARD_IDS ids or one document. Within a shard,
an inverted index over token ids holds the weights; each seed document opens a window and the index
returns its best unused neighbours by all of its terms, which fill the window greedily. The document
that overruns a window is cut there and its rest seeds the next window, so windows are full. What is
left at a shard's end is cut into sequences whose lengths are powers of two, which need no padding.

A row that comes back is a piece: its document's id, the place of the piece in it, its ids (packed
little-endian uint32), and its sequence and offset. Defined results: null text counts as empty; an
empty document is one piece that holds the end id; null or repeated doc_ids are packed like any
other row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.llm.common import Scratch, small_batches
from attrilake.llm.shingles import slices

#: Ids of a shard, shards that a task handles on average, and BM25's parameters.
SHARD_IDS, SHARDS_A_TASK, K1, B = 1 << 19, 16, 1.2, 0.75
#: Token ids fit 16 bits; minima that a document is sorted by.
VOCABULARY, MINIMA = 1 << 16, 4
WINDOW, END_ID = 4096, 2
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def terms_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of every distinct term of some documents, in this order."""
    kind = np.uint32 if len(ids) <= 1 << 16 else np.uint64  # half the bytes to sort
    keys = np.sort(np.repeat(np.arange(len(ids), dtype=kind), [len(x) for x in ids]) << kind(16) | np.concatenate([np.empty(0, "<u2"), *ids]).astype(kind))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return (keys[first] >> kind(16)).astype(np.int64), (keys[first] & kind(0xFFFF)).astype(np.int64), np.diff(np.r_[first, len(keys)])


class Bm25Shard:
    """The terms of a shard's documents and their weights, by corpus-wide rarity and mean length."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        doc, self.term, tf = terms_of(ids)
        lengths = np.array([len(x) for x in ids], np.int64)
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))).astype(np.float32)
        self.by_doc = np.searchsorted(doc, np.arange(len(ids)))  # every document holds the end id
        # the inverted index: each term's documents and weights
        order = np.argsort(self.term, kind="stable")
        self.by_term = np.searchsorted(self.term[order], np.arange(VOCABULARY + 1))
        self.post_doc, self.post_weight, self.n = doc[order].astype(np.int32), self.weight[order], len(ids)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for all terms of the seed."""
        end = self.by_doc[seed + 1] if seed + 1 < self.n else len(self.term)
        terms = self.term[self.by_doc[seed] : end]
        size = self.by_term[terms + 1] - self.by_term[terms]
        if size.sum() * 2 > len(self.term):  # most of the index: one pass over the documents instead
            asked = np.zeros(VOCABULARY, np.float32)
            asked[terms] = 1
            return np.add.reduceat(self.weight * asked[self.term], self.by_doc)
        at = np.arange(size.sum()) + np.repeat(self.by_term[terms] - np.cumsum(size) + size, size)
        return np.bincount(self.post_doc[at], self.post_weight[at], self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, the best first, ties by place."""
        score = np.where(unused, self.scores(seed), 0)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def fill(lengths: np.ndarray, neighbours, window: int = WINDOW):
    """Yield (document, start, length, sequence, offset) that place every id of every document once."""
    n = len(lengths)
    unused, total, cursor, sequence = np.ones(n, bool), int(lengths.sum()), 0, 0
    doc, start, queue = -1, 0, iter(())

    def following() -> int:
        nonlocal cursor
        for d in queue:
            if unused[d]:
                return d
        while not unused[cursor]:
            cursor += 1
        return cursor

    while total:
        # the last ids go to sequences of lengths that are powers of two
        room = size = min(window, 1 << (total.bit_length() - 1))
        seed = True
        while room:
            if doc < 0:
                doc, start = int(following()), 0
                unused[doc] = False
            if seed:
                queue, seed = iter(neighbours(doc, unused)) if room > lengths[doc] - start else iter(()), False
            take = min(room, int(lengths[doc]) - start)
            yield doc, start, take, sequence, size - room
            room, start, total = room - take, start + take, total - take
            if start == lengths[doc]:
                doc = -1
        sequence += 1


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row and ids (little-endian uint16, the end id last) of every document."""

    def encode(batches):
        bpe, end = encoder(tokenizer), np.array([end_id], "<u2").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [bpe.encode(t) + end for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.binary())], ["doc_id", "row", "ids"])

    text = F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text).mapInArrow(encode, "doc_id long, row long, ids binary")


def ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def frequencies(rows: DataFrame) -> np.ndarray:
    """How many documents hold each token id."""

    def counted(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                total += np.bincount(terms_of(ids_of(batch))[1], minlength=VOCABULARY)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    table = rows.select("ids").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # VOCABULARY rows at most
    df = np.zeros(VOCABULARY)
    df[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return df


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's inverse document frequency of every token id."""
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def orders(df: np.ndarray, n: int) -> np.ndarray:
    """For each of MINIMA hashes the rank of every token id: rarer ones tend to come first, those of one document last."""
    drawn = np.random.Generator(np.random.PCG64(97)).exponential(size=(MINIMA, VOCABULARY)) / np.where(df > 1, np.maximum(rarity(df, n), 1e-6) ** 2, 1e-12)
    return np.argsort(np.argsort(drawn, axis=1), axis=1).astype(np.int64)


def placed(rows: DataFrame, ranked: np.ndarray) -> DataFrame:
    """``rows`` with ``place``: their minima under the hashes, 16 bits each."""
    shared = rows.sparkSession.sparkContext.broadcast(ranked)

    def mark(batches):
        ranks = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                doc, term, _ = terms_of(ids_of(batch))
                first = np.searchsorted(doc, np.arange(batch.num_rows))
                place = np.zeros(batch.num_rows, np.uint64)
                for rank in ranks:
                    place = place << np.uint64(16) | np.minimum.reduceat(rank[term], first).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.view(np.int64))], [*batch.schema.names, "place"])

    return rows.mapInArrow(mark, "doc_id long, row long, ids binary, place long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents; ``tokenizer`` is the path of a word-end BPE file."""
    scratch = Scratch(docs.sparkSession, "packing")
    with small_batches(docs.sparkSession):
        rows = scratch.keep(tokenised(docs, tokenizer, end_id), "ids")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 2).first()
    if not n:
        return docs.sparkSession.createDataFrame([], PIECE)
    df, mean = frequencies(rows), float(total) / n
    weights = docs.sparkSession.sparkContext.broadcast(rarity(df, n))
    tasks = max(1, -(-int(total) // (shard_ids * SHARDS_A_TASK)))

    def packed(batches):
        held, size, sequences = [], 0, TaskContext.get().partitionId() << 40

        def settle():
            nonlocal held, size, sequences
            ids = [x for _, x in held]
            lengths = np.array([len(x) for x in ids], np.int64)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*fill(lengths, Bm25Shard(ids, weights.value, mean).neighbours, window), strict=True))
            for a in range(0, len(doc), 4096):
                b = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[d][0] for d in doc[b].tolist()], pa.int64()), pa.array(start[b]), pa.array(length[b]),
                        pa.array([ids[d][s : s + k].astype("<u4").tobytes() for d, s, k in zip(doc[b].tolist(), start[b].tolist(), length[b].tolist(), strict=True)], pa.binary()),
                        pa.array(lengths[doc[b]]), pa.array(sequence[b] + sequences), pa.array(offset[b]),
                    ], [c.split()[0] for c in PIECE.split(", ")],
                )
            held, size, sequences = [], 0, sequences + int(sequence[-1]) + 1

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch), strict=True):
                if held and size + len(ids) > shard_ids:
                    yield from settle()
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield from settle()

    # equal places may be many: the row's hash splits them among tasks
    dealt = placed(rows, orders(df, n)).withColumn("tie", F.xxhash64("row")).repartitionByRange(tasks, "place", "tie").sortWithinPartitions("place", "tie")
    return dealt.select("doc_id", "ids").mapInArrow(packed, PIECE)


_ENCODERS: dict = {}


def encoder(path: str):
    """One encoder a worker process."""
    from attrilake.llm.wordbpe import WordBpe

    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
