"""Media columns of baseline JPEG images, written and read in numpy.

A payload's bytes become the quantised coefficients of 8 x 8 blocks, which baseline JPEG keeps
without loss: byte 0 of a block is its DC coefficient, the others follow in zigzag order. Each
block is a restart interval of its own, so all blocks of many images are coded and decoded in
lockstep: step k handles coefficient k of every block, and a damaged block spoils no other.

The reader is a baseline decoder: it parses the markers, Huffman-decodes the scan (any tables, any
restart interval, one component or more with sampling factors), and rebuilds the luminance
thumbnail from DC coefficients alone. What it stores of an image are its dimensions and an average
hash of that thumbnail.

Defined results: null text counts as empty, and an empty payload is one block of zero bytes; equal
texts give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Coefficient of byte b is the signed 8-bit value of b - SHIFT: small for the commonest letters.
SHIFT = 108
#: Blocks that are coded in lockstep, and payload bytes of the images that share a call.
LANES, CALL_BYTES = 16_384, 4 << 20
#: Blocks a row or column of an image may have: 65535 samples at most.
MOST_BLOCKS = 8191


# Huffman tables, by rule: common sizes without a run of zeros before them get the short codes.
def ac_lengths() -> dict[int, int]:
    lengths = {size: 3 if size in (3, 4, 7) else 4 for size in range(1, 9)} | {0x00: 5}
    lengths |= {0x10 | size: 7 for size in range(1, 9)}
    return lengths | {run << 4 | size: 10 for run in range(2, 16) for size in range(1, 9)} | {0xF0: 10}


def dc_lengths() -> dict[int, int]:
    return dict.fromkeys(range(12), 4)


def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """BITS and HUFFVAL of a table with these code lengths."""
    values = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(values)


def codes(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) by the standard's canonical order."""
    out, code, at = [], 0, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            out.append((values[at], code, n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decoding_table(bits: bytes, values: bytes) -> np.ndarray:
    """For each 16 next bits: symbol << 8 | code length; length 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, n in codes(bits, values):
        table[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 8 | n
    return table


def encoding_table(bits: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for symbol, c, n in codes(bits, values):
        code[symbol], length[symbol] = c, n
    return code, length


DC, AC = canonical(dc_lengths()), canonical(ac_lengths())
DC_CODE, DC_LENGTH = encoding_table(*DC)
AC_CODE, AC_LENGTH = encoding_table(*AC)
SIZE_OF = np.array([int(abs(v)).bit_length() for v in range(-2048, 2048)], np.int64)


class BitLanes:
    """A bit buffer for each lane, flushed in words of 32 bits."""

    def __init__(self, lanes: int, words: int):
        self.acc, self.bits = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
        self.out, self.at = np.zeros((lanes, words), ">u4"), np.zeros(lanes, np.int64)

    def put(self, value: np.ndarray, length: np.ndarray) -> None:
        """Append ``length`` (up to 27) low bits of ``value`` to every lane."""
        self.acc = self.acc << length | value
        self.bits += length
        full = np.flatnonzero(self.bits >= 32)
        if len(full):
            left = self.bits[full] - np.uint64(32)
            self.out[full, self.at[full]] = (self.acc[full] >> left).astype(np.uint32)
            self.bits[full] = left
            self.at[full] += 1

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """All lanes' bytes in a row, each lane padded with ones to whole bytes, and their counts."""
        pad = (np.uint64(8) - self.bits % np.uint64(8)) % np.uint64(8)
        self.put((np.uint64(1) << pad) - np.uint64(1), pad)
        size = self.at * 4 + (self.bits >> np.uint64(3)).astype(np.int64)
        rest = np.uint64(32) - self.bits
        lanes = np.arange(len(size))
        self.out[lanes, self.at] = (self.acc << rest).astype(np.uint32)
        flat = self.out.view(np.uint8).reshape(len(size), -1)
        return flat[np.arange(flat.shape[1]) < size[:, None]], size


def encode_blocks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of (n, 64) zigzag coefficients, a restart interval a block."""
    n = len(blocks)
    lanes = BitLanes(n, 56)  # 64 coefficients of 27 bits at most

    def magnitude(c: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(c < 0, c + (1 << size) - 1, c).astype(np.uint64)

    dc = blocks[:, 0].astype(np.int64)
    size = SIZE_OF[dc + 2048]
    lanes.put(DC_CODE[size] << size.astype(np.uint64) | magnitude(dc, size), DC_LENGTH[size] + size.astype(np.uint64))
    run = np.zeros(n, np.int64)
    none = np.uint64(0)
    for k in range(1, 64):
        c = blocks[:, k].astype(np.int64)
        zero = c == 0
        some = zero.any()
        while len(long := np.flatnonzero(~zero & (run > 15))):
            value, length = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            value[long], length[long] = AC_CODE[0xF0], AC_LENGTH[0xF0]
            lanes.put(value, length)
            run[long] -= 16
        size = SIZE_OF[c + 2048]
        symbol = np.minimum(run, 15) << 4 | size
        wide = size.astype(np.uint64)
        value, length = AC_CODE[symbol] << wide | magnitude(c, size), AC_LENGTH[symbol] + wide
        if some:
            value, length = np.where(zero, none, value), np.where(zero, none, length)
            run = np.where(zero, run + 1, 0)
        else:
            run[:] = 0
        lanes.put(value, length)
    ended = run > 0
    lanes.put(np.where(ended, AC_CODE[0], none), np.where(ended, AC_LENGTH[0], none))
    return lanes.close()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, columns: int, payload: int) -> bytes:
    """Everything up to the scan's data: one component, quantisation by one, a restart interval of one."""
    return b"".join([
        b"\xff\xd8", segment(0xEC, b"bytes" + struct.pack(">Q", payload)),
        segment(0xDB, b"\0" + b"\1" * 64),
        segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\1\x11\0"),
        segment(0xC4, b"\x00" + DC[0] + DC[1]), segment(0xC4, b"\x10" + AC[0] + AC[1]),
        segment(0xDD, b"\0\1"), segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of the squarest image that has room for so many blocks."""
    columns = max(int(np.ceil(np.sqrt(blocks))), -(-blocks // MOST_BLOCKS))
    return -(-blocks // columns), columns


def write_images(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (unpadded bytes)."""
    shapes = [grid(max(1, -(-len(p) // 64))) for p in payloads]
    counts = np.array([r * c for r, c in shapes], np.int64)
    padded = [np.frombuffer(p, np.uint8) for p in payloads]
    blocks = np.zeros((int(counts.sum()), 64), np.int8)
    at = 0
    for p, n in zip(padded, counts, strict=True):
        used = max(1, -(-len(p) // 64))
        flat = np.zeros(used * 64, np.uint8)
        flat[: len(p)] = p
        blocks[at : at + used] = (flat - np.uint8(SHIFT)).view(np.int8).reshape(used, 64)
        at += n
    last = np.cumsum(counts) - 1
    first = np.r_[0, last[:-1] + 1]
    marker = (0xD0 + (np.arange(len(blocks)) - np.repeat(first, counts)) % 8).astype(np.uint8)
    marker[last] = 0xD9
    # a zero after each 0xFF, and a marker of two bytes after each interval: a restart, or the image's end
    chunks, ends, total = [], [], 0
    for i in range(0, len(blocks), LANES):
        data, size = encode_blocks(blocks[i : i + LANES])
        full = data == 0xFF
        lane_end = np.cumsum(size)
        place = np.arange(len(data)) + np.cumsum(full) - full + 2 * np.repeat(np.arange(len(size)), size)
        end = lane_end + np.r_[0, np.cumsum(full)][lane_end] + 2 * np.arange(len(size))
        chunk = np.zeros(int(end[-1]) + 2, np.uint8)
        chunk[place] = data
        chunk[end], chunk[end + 1] = 0xFF, marker[i : i + LANES]
        chunks.append(chunk), ends.append(end + total)
        total += len(chunk)
    out, ends = np.concatenate(chunks), np.concatenate(ends)
    begin = np.r_[0, ends[last][:-1] + 2]
    return [header(*shape, len(p)) + out[a : b + 2].tobytes() for shape, p, a, b in zip(shapes, payloads, begin, ends[last], strict=True)]


@dataclass
class Image:
    """What the markers of a baseline image say, and its intervals' bytes without stuffing."""

    width: int = 0
    height: int = 0
    payload: int = -1
    interval: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantisation table, DC table, AC table)
    quantisation: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    scan: np.ndarray | None = None

    def layout(self):
        return tuple(self.tables.items()), tuple(self.components), self.interval


def parse(raw: bytes) -> Image:
    """Read the markers; the scan stays as it is. Raises ValueError where it is not baseline JPEG."""
    try:
        return _parse(raw)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("a segment is cut short") from e


def _parse(raw: bytes) -> Image:
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    image, at = Image(), 2
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisation[body[0] & 15] = struct.unpack_from(">64H" if wide else "64B", body, 1)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif marker == 0xEC and body[:5] == b"bytes":
            image.payload = struct.unpack_from(">Q", body, 5)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            image.components = [(*c, chosen[c[0]] >> 4, 0x10 | chosen[c[0]] & 15) for c in image.components]
            image.scan = np.frombuffer(raw, np.uint8, offset=at)
            return image


#: Bytes of a scan whose windows are held at once.
SLICE = 1 << 22


def decode_blocks(images: list[Image]) -> list[list[np.ndarray]]:
    """Zigzag coefficients of images of one layout: for each image, an (n, 64) array a component.

    A lane is a restart interval. All lanes decode their first block together, then their second.
    """
    like = images[0]
    scan = np.concatenate([x.scan for x in images])
    owner = np.repeat(np.arange(len(images)), [len(x.scan) for x in images])
    full = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] >= 0xD0) & (scan[1:] <= 0xD9))
    full = full[(scan[full + 1] <= 0xD7) | (scan[full + 1] == 0xD9)]
    stuffed = np.zeros(len(scan), bool)
    stuffed[1:] = (scan[:-1] == 0xFF) & (scan[1:] == 0)
    shifted = np.cumsum(stuffed, dtype=np.int32 if len(scan) < 1 << 31 else np.int64)
    lane_owner = owner[full]
    starts = np.r_[0, full[:-1] + 2]
    new = np.r_[True, lane_owner[1:] != lane_owner[:-1]]
    image_start = np.r_[0, np.cumsum([len(x.scan) for x in images])[:-1]]
    starts[new] = image_start[lane_owner[new]]
    data = np.concatenate([scan[~stuffed], np.full(16, 0xFF, np.uint8)])
    bit = 8 * (starts - np.where(starts > 0, shifted[starts - 1], 0).astype(np.int64))
    del stuffed, shifted

    wide, high = max(c[1] for c in like.components), max(c[2] for c in like.components)
    one = len(like.components) == 1
    per_mcu = [(i, 1 if one else c[1] * c[2], decoding_table(*like.tables[c[4]]), decoding_table(*like.tables[c[5]])) for i, c in enumerate(like.components)]
    mcus = np.array([(-(-x.width // 8) * -(-x.height // 8)) if one else -(-x.width // (8 * wide)) * -(-x.height // (8 * high)) for x in images], np.int64)
    lanes = len(bit)
    first = np.flatnonzero(new)
    rank = np.arange(lanes) - np.repeat(first, np.diff(np.r_[first, lanes]))
    each = like.interval or int(mcus.max())
    left = np.minimum(each, mcus[lane_owner] - rank * each)
    begin = np.r_[0, np.cumsum(mcus)[:-1]][lane_owner] + rank * each
    out = [np.zeros((int(mcus.sum()) * n, 64), np.int16) for _, n, _, _ in per_mcu]
    before = np.zeros((len(per_mcu), lanes), np.int64)
    # lanes that begin within SLICE bytes go together: only their bytes are spread to windows
    edges = np.flatnonzero(np.r_[True, np.diff(bit // (8 * SLICE)) > 0, True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        low = int(bit[a]) >> 3
        piece = data[low : (int(bit[b]) >> 3) + 16 if b < lanes else len(data)].astype(np.uint64)
        window = np.zeros(len(piece) - 7, np.uint64)  # the 64 bits from each byte on
        for i in range(8):
            window |= piece[i : len(piece) - 7 + i] << np.uint64(56 - 8 * i)
        here = bit[a:b] - 8 * low
        for step in range(int(left[a:b].max())):
            at = np.flatnonzero(left[a:b] > step)
            for i, n, dc, ac in per_mcu:
                for part in range(n):
                    row = (begin[a + at] + step) * n + part
                    here[at], difference = decode_lockstep(window, here[at], dc, ac, out[i], row)
                    before[i, a + at] += difference
                    out[i][row, 0] = before[i, a + at]
    cut = np.cumsum(mcus)[:-1]
    split = [np.split(out[i], cut * n) for i, n, _, _ in per_mcu]
    return [[s[k] for s in split] for k in range(len(images))]


def decode_lockstep(window, bit, dc, ac, out, row):
    """One block a lane: fills ``out[row, 1:]``; gives the lanes' new positions and DC differences."""

    def read(bit, table):
        """Symbols that start at ``bit``, the bits' positions after them, and their values."""
        word = window[bit >> 3] << (bit & 7).astype(np.uint64)
        entry = table[(word >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry & 255, entry >> 8
        if not length.all():
            raise ValueError("a code that no table has")
        size = symbol & 15
        # the value's bits, read as the top ones of what follows the code
        raw = ((word << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)
        return symbol, bit + length + size, value

    _, bit, difference = read(bit, dc)
    k = np.ones(len(bit), np.int64)
    alive = None  # all lanes
    while True:
        now = bit if alive is None else bit[alive]
        symbol, moved, value = read(now, ac)
        run, size = symbol >> 4, symbol & 15
        place = (k if alive is None else k[alive]) + run
        coded = size > 0
        if coded.all():
            if place.max() > 63:
                raise ValueError("a coefficient beyond its block")
            out[row if alive is None else row[alive], place] = value
            after = place + 1
        else:
            at = np.flatnonzero(coded)
            if len(at) and place[at].max() > 63:
                raise ValueError("a coefficient beyond its block")
            out[(row if alive is None else row[alive])[at], place[at]] = value[at]
            after = np.where(coded | (run == 15), place + 1, 64)
        if alive is None:
            bit, k = moved, after
        else:
            bit[alive], k[alive] = moved, after
        done = after > 63
        if done.any():
            alive = (np.arange(len(k)) if alive is None else alive)[~done]
            if not len(alive):
                return bit, difference


def luminance(image: Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """The thumbnail of one sample a block of the first component, from its DC coefficients."""
    c = image.components[0]
    dc = np.clip(np.round(coefficients[0][:, 0].astype(np.float64) * image.quantisation[c[3]][0] / 8 + 128), 0, 255)
    if len(image.components) == 1:
        return dc.reshape(-(-image.height // 8), -1)
    wide, high = max(x[1] for x in image.components), max(x[2] for x in image.components)
    rows, columns = -(-image.height // (8 * high)), -(-image.width // (8 * wide))
    return dc.reshape(rows, columns, c[2], c[1]).transpose(0, 2, 1, 3).reshape(rows * c[2], columns * c[1])


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which cells of the thumbnail, shrunk or stretched to 8 x 8, are brighter than their mean."""
    for axis in (0, 1):
        n = thumbnail.shape[axis]
        low = np.arange(8) * n // 8
        high = np.maximum((np.arange(8) + 1) * n // 8, low + 1)
        total = np.concatenate([np.zeros_like(thumbnail.take([0], axis)), thumbnail.cumsum(axis)], axis)
        spans = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
        thumbnail = (total.take(high, axis) - total.take(low, axis)) / spans
    bits = (thumbnail > thumbnail.mean() + 1e-9).ravel()
    return np.packbits(bits).tobytes().hex()


def read_images(raws: list[bytes]) -> list[tuple[bytes, int, int, int, str]]:
    """(payload with its padding, bytes without it, width, height, thumbnail hash) of images of ours."""
    images = [parse(r) for r in raws]
    groups: dict = {}
    for i, x in enumerate(images):
        groups.setdefault(x.layout(), []).append(i)
    found: list = [None] * len(raws)
    for at in groups.values():
        for i, coefficients in zip(at, decode_blocks([images[i] for i in at]), strict=True):
            x = images[i]
            blocks = max(1, -(-x.payload // 64))
            payload = (coefficients[0][:blocks].astype(np.uint8) + np.uint8(SHIFT)).tobytes()
            found[i] = payload, x.payload, x.width, x.height, average_hash(luminance(x, coefficients))
    return found


def in_calls(values: list, size) -> list[list[int]]:
    """Places of values in runs of about CALL_BYTES."""
    calls, total = [[]], 0
    for i, v in enumerate(values):
        if total > CALL_BYTES:
            calls.append([])
            total = 0
        calls[-1].append(i)
        total += size(v)
    return [c for c in calls if c]


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: the JPEG that holds the text's UTF-8 bytes."""

    def written(batches):
        for batch in batches:
            payloads = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column("text").cast(pa.binary())]
            for at in in_calls(payloads, len):
                media = write_images([payloads[i] for i in at])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at[0], len(at)), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(written, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, thumbnail_hash string"


def media_features(media: DataFrame) -> DataFrame:
    """Read the stored images back: what they hold, their dimensions and thumbnail hashes."""

    def read(batches):
        for batch in batches:
            raws = [v.as_buffer().to_pybytes() for v in batch.column("media")]
            for at in in_calls(raws, len):
                rows = []
                for i, (payload, n, width, height, mark) in zip(at, read_images([raws[i] for i in at]), strict=True):
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raws[i]), hashlib.sha256(raws[i]).hexdigest(), width, height, mark))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [c.split()[0] for c in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at[0], len(at)), *columns], names)

    return media.mapInArrow(read, FEATURES)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "concat(width, 'x', height, ':', thumbnail_hash) AS feature", "width", "height")
