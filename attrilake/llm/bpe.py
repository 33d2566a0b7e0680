"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of its bytes' tokens. Every adjacent pair that has a merge rank lies
in the bucket of that rank; three levels of 64-bit words mark the buckets in use, so find-first-set
on each level gives the least rank in three steps whatever the pre-token's length. A bucket gives
its leftmost position first; an entry whose pair has changed since is stale and skipped. A merge
costs O(log) at worst, so a pre-token of a million letters is as cheap a byte as a short one.

Defined results: null text counts as empty and gives no ids; lone surrogates cannot occur in
Spark's UTF-8 strings; repeated rows give equal rows; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Pre-tokens that a worker remembers: two generations of so many; longer ones are never remembered.
REMEMBERED, REMEMBERED_CHARS = 900_000, 48
#: Bytes of a pre-token whose positions fit in one word, and tables of such words and links.
SHORT = 64
BITS = [1 << i for i in range(64)]
AFTER, BEFORE = list(range(1, SHORT + 1)), list(range(-1, SHORT - 1))
#: Rows that a worker encodes before it hands them on.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a line is a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank under three levels of bitmap words of 64 bits."""

    __slots__ = ("low", "mid", "top", "buckets")

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0  # one bit for each word of mid: a word of 64 bits covers 2^18 ranks, Python's grow beyond
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heappush(bucket, position)

    def least(self) -> int:
        """The least rank with a bucket; -1 if there is none."""
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        i = i << 6 | (word & -word).bit_length() - 1
        word = self.low[i]
        return i << 6 | (word & -word).bit_length() - 1

    def drop(self, rank: int) -> None:
        """The bucket of ``rank`` is empty: clear its bits upwards as far as words run empty."""
        del self.buckets[rank]
        i = rank >> 6
        self.low[i] &= ~(1 << (rank & 63))
        if not self.low[i]:
            j = i >> 6
            self.mid[j] &= ~(1 << (i & 63))
            if not self.mid[j]:
                self.top &= ~(1 << j)


class ByteBpe:
    """Encoder and decoder for one file of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(size)
        # rank of every pair of tokens that is a token itself
        self.pairs = {ranks[t[:i]] * size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.size = size
        self.limit, self.new, self.old = remembered, {}, {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: always the least rank first, of equal ranks the leftmost pair."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        single, rank_of, size, queue = self.single, self.pairs.get, self.size, self.queue
        tokens = [single[b] for b in raw]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the pair that starts at a position, -1 if none or no longer a token
        pending = [rank_of(a * size + b, -1) for a, b in zip(tokens, tokens[1:])]
        pending.append(-1)
        buckets, low, mid, push = queue.buckets, queue.low, queue.mid, queue.push
        for i, rank in enumerate(pending):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    push(rank, i)
        while top := queue.top:
            i = (top & -top).bit_length() - 1
            word = mid[i]
            i = i << 6 | (word & -word).bit_length() - 1
            word = low[i]
            rank = i << 6 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                queue.drop(rank)
            else:
                i = heappop(bucket)
            if pending[i] != rank:
                continue
            j = after[i]
            tokens[i], pending[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pending[i] = rank_of(rank * size + tokens[k], -1)
                if new >= 0:
                    push(new, i)
            else:
                pending[i] = -1
            h = before[i]
            if h >= 0:
                new = pending[h] = rank_of(tokens[h] * size + rank, -1)
                if new >= 0:
                    push(new, h)
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = after[i]
        return tuple(out)

    def merge_short(self, raw: bytes) -> tuple[int, ...]:
        """``merge`` for up to SHORT bytes: a bucket is one word whose bits are positions.

        The same queue with its steps in line; a bucket's leftmost position is its first set bit.
        """
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        single, rank_of, size, bit = self.single, self.pairs.get, self.size, BITS
        low, mid = self.queue.low, self.queue.mid
        tokens = [single[b] for b in raw]
        n = len(tokens)
        after, before = AFTER[:n], BEFORE[:n]
        pending = [rank_of(a * size + b, -1) for a, b in zip(tokens, tokens[1:])]
        pending.append(-1)
        buckets: dict[int, int] = {}
        top = 0
        for i, rank in enumerate(pending):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank] |= bit[i]
                else:
                    buckets[rank] = bit[i]
                    low[rank >> 6] |= bit[rank & 63]
                    mid[rank >> 12] |= bit[rank >> 6 & 63]
                    top |= bit[rank >> 12]
        while top:
            # find-first-set on each level: the least rank with a bucket
            w = (top & -top).bit_length() - 1
            word = mid[w]
            v = w << 6 | (word & -word).bit_length() - 1
            word = low[v]
            one = word & -word
            rank = v << 6 | one.bit_length() - 1
            bucket = buckets[rank]
            first = bucket & -bucket
            if bucket == first:
                del buckets[rank]
                word ^= one
                low[v] = word
                if not word:
                    mid[w] ^= bit[v & 63]
                    if not mid[w]:
                        top ^= bit[w]
            else:
                buckets[rank] = bucket ^ first
            i = first.bit_length() - 1
            if pending[i] != rank:
                continue  # stale
            j = after[i]
            tokens[i] = rank
            pending[j] = -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                new = pending[i] = rank_of(rank * size + tokens[k], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new] |= bit[i]
                    else:
                        buckets[new] = bit[i]
                        low[new >> 6] |= bit[new & 63]
                        mid[new >> 12] |= bit[new >> 6 & 63]
                        top |= bit[new >> 12]
            else:
                pending[i] = -1
            if h >= 0:
                new = pending[h] = rank_of(tokens[h] * size + rank, -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new] |= bit[h]
                    else:
                        buckets[new] = bit[h]
                        low[new >> 6] |= bit[new & 63]
                        mid[new >> 12] |= bit[new >> 6 & 63]
                        top |= bit[new >> 12]
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = after[i]
        return tuple(out)

    def _missing(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = self.merge_short(raw) if len(raw) <= SHORT and self.size <= 1 << 18 else self.merge(raw)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, missing = self.new.get, self._missing
        found = []
        for piece in self.split(text):
            ids = get(piece)
            if ids is None:
                ids = missing(piece)
                get = self.new.get
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec a worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: array<int> for every text."""

    def encoded(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_column(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw: the bytes that each row's ids stand for."""

    def decoded(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            raw = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return tokens.mapInArrow(decoded, "doc_id long, raw binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text and decode its ids, in one worker: their digests, and how many there are."""

    def digests(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                rows = []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text or "")
                    raw, decimal = bpe.decode(ids), " ".join(map(bpe.decimal.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in DIGESTS.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(digests, DIGESTS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)
