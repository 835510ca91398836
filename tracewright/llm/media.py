"""Baseline JPEG as a media column.

A payload of bytes is stored losslessly in the format's own unit: one 8x8 block a byte, whose DC coefficient
is the byte less 128 under a DC quantiser of 8, and whose AC coefficients are 0. Blocks stand 64 to a row, with a restart
marker after each row. Reading parses the markers, Huffman-decodes the scan and rebuilds the luminance
thumbnail from DC coefficients alone; for a stored payload the thumbnail is the payload. Restart
segments are decoded side by side in numpy, one block of each at a step. The reader takes any baseline JPEG
with one interleaved scan, with chroma and AC coefficients, not only what the writer makes.

Defined cases: a null or empty text is a payload of 64 zero bytes; a payload too tall for one picture goes on
in further pictures of the same stream; repeated rows and null doc_ids come back as they came; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts_of

ROW = 64
#: Blocks of the tallest picture that a writer makes, of the 8191 rows that fit.
TALLEST = ROW * 8128
#: Payload bytes that are coded, and media bytes that are decoded, at once.
CHUNK = 2 << 20

# Fixed values of the format: code lengths and symbols of the writer's two Huffman tables, zero-run order of
# the quantiser being of no use to DC alone.
DC_BITS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_BITS, AC_VALUES = (0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0,)


def codes(bits, values):
    """(symbol, code, length) of a canonical Huffman table."""
    code, k = 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            yield values[k], code, length
            code, k = code + 1, k + 1
        code <<= 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63), _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES)), _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES)),
        _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference plus 255: a block's bits (category, value, end of block) and their number."""
    table = {s: (c, n) for s, c, n in codes(DC_BITS, DC_VALUES)}
    (_, end, end_n), *_ = codes(AC_BITS, AC_VALUES)
    bits, count = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        value = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = (((code << size) | value) << end_n) | end
        count[d + 255] = n + size + end_n
    return bits, count


BITS, COUNT = _block_codes()


def write(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload, whose length is a positive multiple of ROW; coded picture by picture, about CHUNK bytes at once."""
    pictures = [(k, x[at : at + TALLEST]) for k, x in enumerate(payloads) for at in range(0, len(x), TALLEST)]
    coded: list[list[bytes]] = [[] for _ in payloads]
    for a, b in chunks([x for _, x in pictures]):
        for (k, _), stream in zip(pictures[a:b], _written([x for _, x in pictures[a:b]]), strict=True):
            coded[k].append(stream)
    return [b"".join(x) for x in coded]


def _written(payloads: list[bytes]) -> list[bytes]:
    """A picture for each payload of at most TALLEST bytes."""
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = flat.copy()
    diff[:, 1:] -= flat[:, :-1]
    diff += 255
    bits, count = BITS[diff], COUNT[diff]
    # two blocks of at most 18 bits each are one item
    n2 = count[:, 1::2]
    item, size = (bits[:, 0::2] << n2.astype(np.uint64)) | bits[:, 1::2], count[:, 0::2] + n2
    total = size.sum(1)
    bytes_in_row = (total + 7) >> 3
    # each row ends in ones up to the whole byte
    pad = bytes_in_row * 8 - total
    item[:, -1] = (item[:, -1] << pad.astype(np.uint64)) | ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))
    size[:, -1] += pad
    words_in_row = (bytes_in_row + 7) >> 3
    word0 = np.concatenate(([0], np.cumsum(words_in_row)[:-1]))
    at = np.cumsum(size, 1) - size
    word = ((at >> 6) + word0[:, None]).ravel()
    room = 64 - (at & 63).ravel() - size.ravel()
    item = item.ravel()
    over = np.where(room < 0, -room, 0).astype(np.uint64)
    head = np.where(room >= 0, item << np.maximum(room, 0).astype(np.uint64), item >> over)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    packed = np.zeros(int(words_in_row.sum()) + 1, np.uint64)
    packed[word[first]] = np.add.reduceat(head, first)
    tail = np.flatnonzero(room < 0)
    packed[word[tail] + 1] += item[tail] << (np.uint64(64) - over[tail])
    raw = packed[:-1].astype(">u8").view(np.uint8)
    in_row = np.arange(len(raw)) - np.repeat(word0 * 8, words_in_row * 8)
    raw = raw[in_row < np.repeat(bytes_in_row, words_in_row * 8)]
    # a zero after each 0xFF, a restart marker after each row
    ends = np.cumsum(bytes_in_row)
    step = 1 + (raw == 0xFF).astype(np.int64)
    step[ends - 1] += 2
    place = np.cumsum(step)
    out = np.zeros(int(place[-1]), np.uint8)
    out[place - step] = raw
    row_end = place[ends - 1]
    out[row_end - 2] = 0xFF
    row_start = np.concatenate(([0], row_end[:-1]))
    streams, row = [], 0
    for payload in payloads:
        rows = len(payload) // ROW
        out[row_end[row : row + rows] - 1] = 0xD0 + np.arange(rows) % 8
        streams.append(_header(rows) + out[row_start[row] : row_end[row + rows - 1] - 2].tobytes() + b"\xff\xd9")
        row += rows
    return streams


MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


class Picture:
    """Markers of one baseline picture: size, quantisers, Huffman tables, components, the scan's place."""

    def __init__(self, data: bytes, at: int) -> None:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no picture at byte {at}")
        quant, huff, self.restart, at = {}, {}, 0, at + 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide = 64 * (1 + (body[0] >> 4)) + 1
                    quant[body[0] & 15] = body[1] if wide == 65 else int.from_bytes(body[1:3])
                    body = body[wide:]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body)
            elif marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
                parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError(f"not baseline: marker {marker:02x}")
            elif marker == 0xDA:
                if body[0] != len(parts):
                    raise ValueError("one interleaved scan is expected")
                chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
        single = len(parts) == 1
        #: (h, v, DC table, AC table) of each component, luminance first
        self.parts = tuple((1 if single else h, 1 if single else v, huff[chosen[c] >> 4], huff[16 + (chosen[c] & 15)]) for c, (h, v, _) in parts.items())
        h, v = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        self.quant = quant[next(iter(parts.values()))[2]]
        self.across, self.down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.start, self.end = at, MARKER.search(data, at).start()
        self.next = self.end + 2


def lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for s, code, n in codes(*table):
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def luminance_dc(scans: list[bytes], pictures: list[Picture]) -> list[np.ndarray]:
    """DC coefficients of luminance blocks in scan order, for pictures of one kind of tables and components."""
    data = np.frombuffer(b"".join(scans) + b"\xff\xd9", np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    drop = ff[after == 0] + 1
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[drop] = keep[marks] = keep[marks + 1] = False
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    begins = np.cumsum([0, *map(len, scans)])[:-1]
    starts = np.sort(np.concatenate((begins, marks + 2)))
    owner = np.searchsorted(begins, starts, "right") - 1
    rank = np.arange(len(starts)) - np.searchsorted(owner, owner)
    units = np.array([p.across * p.down for p in pictures])
    each = np.array([p.restart or p.across * p.down for p in pictures])
    left = np.minimum(each[owner], units[owner] - rank * each[owner])
    by = np.argsort(-left, kind="stable")
    left, pos = left[by], kept_before[starts[by]].astype(np.int64) * 8
    stream = np.concatenate((data[keep], np.zeros(16, np.uint8)))
    window = np.ndarray(len(stream) - 7, ">u8", stream.data, 0, (1,))
    parts = pictures[0].parts
    tables = [(lookup(p[2]), lookup(p[3])) for p in parts]
    lum = parts[0][0] * parts[0][1]
    out = np.zeros((len(left), int(left[0]) * lum), np.int32)
    pred = np.zeros((len(parts), len(left)), np.int64)
    u = np.uint64

    def peek(p, used):
        return (window[p >> 3].astype(u) << ((p & 7) + used).astype(u)) >> u(48)

    for unit in range(int(left[0])):
        n = int(np.searchsorted(-left, -unit, "left"))
        p = pos[:n]
        for c, (h, v, *_) in enumerate(parts):
            (dc_symbol, dc_length), (ac_symbol, ac_length) = tables[c]
            for block in range(h * v):
                word = window[p >> 3].astype(u) << (p & 7).astype(u)
                top = (word >> u(48)).astype(np.int64)
                size, used = dc_symbol[top], dc_length[top]
                low = u(64) - np.maximum(size, 1).astype(u)
                extra = ((word << used.astype(u)) >> low).astype(np.int64)
                extra = np.where(size == 0, 0, np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra))
                pred[c, :n] += extra
                if c == 0:
                    out[:n, unit * lum + block] = pred[0, :n]
                used = used + size
                top = ((word << used.astype(u)) >> u(48)).astype(np.int64)
                symbol = ac_symbol[top]
                p = p + used + ac_length[top]
                busy = np.flatnonzero(symbol)
                if len(busy):
                    k = np.ones(n, np.int64)
                    rs = symbol[busy]
                    while True:
                        size = rs & 15
                        p[busy] += size
                        k[busy] += (rs >> 4) + 1
                        busy = busy[k[busy] <= 63]
                        if not len(busy):
                            break
                        top = peek(p[busy], 0).astype(np.int64)
                        rs = ac_symbol[top]
                        p[busy] += ac_length[top]
                        busy, rs = busy[rs != 0], rs[rs != 0]
                        if not len(busy):
                            break
        pos[:n] = p
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    cuts = np.searchsorted(owner, np.arange(1, len(scans)))
    return [np.concatenate([out[i, : left[i] * lum] for i in rows]) if len(rows) > 1 else out[rows[0], : left[rows[0]] * lum] for rows in np.split(back, cuts)]


def read(streams: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Width, height (of a stream's pictures, one below the other) and DC-only thumbnail, rows x columns, of each stream."""
    pictures, kinds = [], {}
    for k, data in enumerate(streams):
        at = 0
        while at < len(data):
            p = Picture(data, at)
            kinds.setdefault(p.parts, []).append(len(pictures))
            pictures.append((k, p))
            at = p.next
    thumbs: list[list] = [[] for _ in streams]
    found = {}
    for all_own in kinds.values():
        scans = [streams[k][p.start : p.end] for k, p in map(pictures.__getitem__, all_own)]
        for a, b in chunks(scans):
            own = all_own[a:b]
            found.update(zip(own, luminance_dc(scans[a:b], [pictures[i][1] for i in own]), strict=True))
    for i, (k, p) in enumerate(pictures):
        h, v = p.parts[0][:2]
        grid = found.pop(i).reshape(p.down, p.across, v, h).swapaxes(1, 2).reshape(p.down * v, p.across * h)
        thumbs[k].append((p, np.clip(np.rint(grid * (p.quant / 8) + 128), 0, 255).astype(np.uint8)[: -(-p.height // 8), : -(-p.width // 8)]))
    return [(own[0][0].width, sum(p.height for p, _ in own), np.concatenate([t for _, t in own]) if len(own) > 1 else own[0][1]) for own in thumbs]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of the thumbnail, shrunk to 8 x 8, lie above their mean."""
    cells = thumb.astype(np.int64)
    for axis in (0, 1):
        n = cells.shape[axis]
        cells = np.take(cells, np.arange(8) * n // 8, axis) if n < 8 else np.add.reduceat(cells, np.arange(8) * n // 8, axis) * 840 // np.diff(np.append(np.arange(8) * n // 8, n)).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits((cells * 64 > cells.sum()).ravel()).tobytes().hex()


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % ROW if raw else ROW)


def chunks(items: list[bytes]):
    """Index ranges of about CHUNK bytes."""
    start, held = 0, 0
    for k, x in enumerate(items):
        held += len(x)
        if held >= CHUNK:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(items):
        yield start, len(items)


def _store(batches):
    for batch in batches:
        sizes, raw = zip(*map(payload, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
        yield {"doc_id": batch.column("doc_id"), "n_bytes": list(sizes), "media": write(list(raw))}


def _features(batches):
    for batch in batches:
        media = batch.column("media").to_pylist()
        rows = read(media)
        stored = [t.tobytes() for _, _, t in rows]
        yield {
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": [len(x) for x in stored], "payload_sha256": [hashlib.sha256(x).hexdigest() for x in stored],
            "tail_crc32": [zlib.crc32(x[-ROW:]) for x in stored], "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "feature": [f"{w}x{h}:{average_hash(t)}" for w, h, t in rows], "width": [w for w, _, _ in rows], "height": [h for _, h, _ in rows],
        }


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG stream of each text's payload; no shuffle."""
    return map_batches(texts_of(docs), _store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and digests of media, read from the stored bytes; no shuffle."""
    return map_batches(media, _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def op3_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))


QUERIES = {"op3_jpeg_thumbnails": op3_jpeg_thumbnails}
ORACLE_SQL: dict[str, str] = {}
