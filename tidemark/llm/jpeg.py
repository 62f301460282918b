"""Baseline JPEG: bytes as coefficients, marker parsing, Huffman decoding of scans, DC-only luminance thumbnails.

A payload is stored losslessly as the quantised coefficients of a grey image, 64 bytes to a block. Each block is its
own restart interval. The decoder reads baseline files whose components share one interleaved scan; it walks all restart
intervals of many files in lockstep, so that each numpy operation decodes one symbol of every interval at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import runs_of

#: Blocks in a row of a stored payload's image, side of a thumbnail, and bytes of media decoded at once.
ACROSS, SIDE, CHUNK = 64, 8, 1_000_000
#: Bytes by how often text has them (a fixed order); the n-th one is stored as the coefficient 1, -1, 2, -2 and so on.
COMMON = b" etaoinsrhldcumpfgyb,.wvk\nETAINSOCPHRLDMBWFGUVKYJXQZjxqz0123456789'\"-:;()/!?&%$*#\xc3\xa9\xa8\xa0\xb6\xbc\xa4\x9f\xb3\xad\xb1\x00"
_ORDER = np.array([*dict.fromkeys([*COMMON, *range(256)])], np.uint8)
_RANK = np.argsort(_ORDER)
COEFFICIENT = np.where(_RANK % 2 == 0, _RANK // 2 + 1, -(_RANK // 2 + 1)).astype(np.int16)
_BYTE = np.zeros(257, np.uint8)
_BYTE[COEFFICIENT + 128] = np.arange(256)
#: The Huffman table of stored payloads, for DC and AC alike: codes of each length, symbols (a size of 1 to 8; 0 ends a
#: block that only fills up the image).
HUFFMAN = (bytes([0, 3, 1, 1, 1, 1, 1, 1] + [0] * 8), bytes([3, 2, 1, 4, 5, 6, 7, 8, 0]))
NOTE = b"tidemark payload "


def _codes(table: tuple[bytes, bytes]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) of a Huffman table in its file form."""
    found, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for symbol in table[1][at : at + n]:
            found[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return found


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body


def _words() -> tuple[np.ndarray, np.ndarray]:
    """Code and extra bits of each payload byte, and of a zero coefficient as the 257th: the word and its length."""
    codes = _codes(HUFFMAN)
    word, bits = np.zeros(257, np.uint16), np.zeros(257, np.uint8)
    for byte, c in enumerate([*COEFFICIENT.tolist(), 0]):
        size = abs(c).bit_length()
        code, length = codes[size]
        word[byte], bits[byte] = code << size | (c if c > 0 else c + (1 << size) - 1), length + size
    return word, bits


WORD, BITS = _words()


def _scans(payloads: np.ndarray, grids: list[tuple[int, int, int, bool]]) -> list[bytes]:
    """The scan of each image or part of one, from 64 bytes a block; grids: blocks with bytes, blocks in all, the number of
    the first one in its image, and whether the image ends with them.

    Each block is an interval of its own: its words, ones up to a whole byte, zeros after bytes of 255, and a restart
    marker, but for an image's last block.
    """
    full, every, first, ending = (np.array(c) for c in zip(*grids))
    last = np.cumsum(every)
    total = int(last[-1])
    filled = np.ones(total, bool)
    for n, end, size in zip(full, last, every):
        filled[end - size + n : end] = False
    bits = np.zeros((total, 65), np.uint8)
    word = np.zeros((total, 65), np.uint16)
    bits[filled, :64], word[filled, :64] = BITS[payloads], WORD[payloads]
    bits[~filled, :2], word[~filled, :2] = BITS[256], WORD[256]
    used = bits.sum(axis=1, dtype=np.int64)
    spare = -used % 8
    bits[:, 64], word[:, 64] = spare, (1 << spare) - 1
    flat = bits.ravel()
    ends = np.cumsum(flat, dtype=np.int32)  # CHUNK bytes have fewer than 2**31 bits
    shift = np.repeat(ends, flat) - np.arange(1, int(ends[-1]) + 1, dtype=np.int32)
    stream = np.packbits((np.repeat(word.ravel(), flat) >> shift.astype(np.uint8)).astype(np.uint8) & 1)
    block_end = np.cumsum((used + 7) // 8)
    stuffed = np.concatenate([[0], np.cumsum(stream == 255)])
    marker = np.ones(total, np.int64)
    marker[last[ending] - 1] = 0
    shown = np.cumsum(marker)
    block = np.repeat(np.arange(total), (used + 7) // 8)
    place = np.arange(len(stream)) + stuffed[:-1] + 2 * (shown - marker)[block]
    out = np.zeros(len(stream) + int(stuffed[-1]) + 2 * int(shown[-1]), np.uint8)
    out[place] = stream
    after = block_end + stuffed[block_end] + 2 * (shown - marker)
    nth = np.arange(total) - np.repeat(last - every - first, every)
    has = marker == 1
    out[after[has]] = 0xFF
    out[after[has] + 1] = 0xD0 + nth[has] % 8
    raw, cuts = out.tobytes(), [0, *(after + 2 * marker)[last - 1].tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def store(payloads: list[bytes]) -> list[bytes]:
    """A grey baseline JPEG of each payload (a positive multiple of 64 bytes), made together in slices of CHUNK bytes."""
    grids = []
    for p in payloads:
        n = len(p) // 64
        across = min(n, max(ACROSS, -(-n // 8191)))  # sides are below 65,536 pixels
        grids.append((n, across, -(-n // across)))
    parts, scans = [], [[] for _ in payloads]
    for i, (n, across, down) in enumerate(grids):
        for at in range(0, across * down, CHUNK // 64):
            size = min(CHUNK // 64, across * down - at)
            parts.append((i, max(0, min(n - at, size)), size, at, at + size == across * down))
    for a, b in runs_of([64 * part[2] for part in parts], CHUNK):
        some = parts[a:b]
        held = b"".join(memoryview(payloads[i])[64 * at : 64 * (at + n)] for i, n, _, at, _ in some)
        for (i, *_), scan in zip(some, _scans(np.frombuffer(held, np.uint8).reshape(-1, 64), [part[1:] for part in some])):
            scans[i].append(scan)
    files = []
    for p, (_, across, down), scan in zip(payloads, grids, scans):
        head = b"\xff\xd8" + _segment(0xFE, NOTE + str(len(p)).encode()) + _segment(0xDB, b"\x00" + b"\x01" * 64)
        head += _segment(0xC0, bytes([8]) + (down * 8).to_bytes(2) + (across * 8).to_bytes(2) + bytes([1, 1, 0x11, 0]))
        head += _segment(0xC4, b"\x00" + b"".join(HUFFMAN)) + _segment(0xC4, b"\x10" + b"".join(HUFFMAN))
        head += _segment(0xDD, (1).to_bytes(2)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
        files.append(b"".join([head, *scan, b"\xff\xd9"]))
    return files


@dataclass
class Image:
    """What the markers of a baseline file say; scan: its bytes without stuffing and markers; sizes: of its intervals."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, across and down sampling, quantisation table
    quant: dict[int, np.ndarray]
    tables: tuple[tuple[tuple[bytes, bytes], tuple[bytes, bytes]], ...]  # DC and AC of each component
    every: int
    scan: np.ndarray
    sizes: np.ndarray
    note: bytes


class JpegError(ValueError):
    """A file that is broken, or no baseline JPEG with one interleaved scan."""


def parse(data: bytes) -> Image:
    """Reads the markers of a baseline JPEG with one interleaved scan; JpegError where it is none."""
    try:
        return _parse(data)
    except (ValueError, IndexError, KeyError) as error:
        raise error if isinstance(error, JpegError) else JpegError(str(error)) from error


def _parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, quant, huffman, every, frame, note = 2, {}, {}, 0, None, b""
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise JpegError(f"segment {marker:x} is cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                if wide > 1 or len(body) < n:
                    raise JpegError("bad quantisation table")
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if len(body) < n:
                    raise JpegError("bad Huffman table")
                huffman[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17:n]))
                body = body[n:]
        elif marker == 0xC0:
            if body[0] != 8:
                raise JpegError("samples aren't of 8 bits")
            frame = (int.from_bytes(body[3:5]), int.from_bytes(body[1:3]), [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)])
        elif marker == 0xDD:
            every = int.from_bytes(body)
        elif marker == 0xFE:
            note = note or body
        elif marker == 0xDA:
            break
        elif marker in range(0xC1, 0xD0):
            raise JpegError("not baseline")
    if frame is None or not frame[0] or not frame[1] or body[0] != len(frame[2]):
        raise JpegError("no frame, or a scan of some components only")
    chosen = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
    tables = tuple((huffman[0, chosen[c[0]] >> 4], huffman[1, chosen[c[0]] & 15]) for c in frame[2])
    rest = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(rest[:-1] == 255)
    after = rest[ff + 1]
    ends = ff[(after != 0) & (after != 255)]
    restart = (rest[ends + 1] & 0xF8) == 0xD0
    stop = int(np.argmin(restart)) if not restart.all() else -1
    if stop < 0 or rest[ends[stop] + 1] != 0xD9:
        raise JpegError("no end of image")
    if ((rest[ends[:stop] + 1] & 7) != np.arange(stop) % 8).any():
        raise JpegError("restart markers are out of order")
    kept = np.ones(int(ends[stop]), bool)
    kept[ff[(after == 0) & (ff < ends[stop])] + 1] = False
    kept[ends[:stop]] = kept[ends[:stop] + 1] = False
    gone = np.flatnonzero(~kept)
    sizes = np.diff(ends[: stop + 1] - np.searchsorted(gone, ends[: stop + 1]), prepend=0)
    return Image(*frame, quant, tables, every, rest[: len(kept)][kept], sizes, note)


#: In a look-up: the end of a block, and a code word that the 16 bits ahead don't hold whole.
_END, _LONG = 128, 255


def _lookup(table: tuple[bytes, bytes], dc: bool) -> tuple[np.ndarray, ...]:
    """For each 16 bits ahead: zeros to skip, the coefficient, and bits used (0 where no code begins so).

    Where a word is longer than 16 bits, skip is _LONG, the coefficient its symbol, and bits those of the code alone.
    """
    skip, value, bits = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in _codes(table).items():
        size, begin, end = symbol & 15, code << (16 - length), (code + 1) << (16 - length)
        if length + size > 16:
            skip[begin:end], value[begin:end], bits[begin:end] = _LONG, symbol, length
            continue
        raw = (np.arange(begin, end) >> (16 - length - size)) & ((1 << size) - 1)
        value[begin:end] = np.where(raw < (1 << size) // 2, raw - (1 << size) + 1, raw) if size else 0
        skip[begin:end] = 0 if dc else symbol >> 4 if size or symbol == 0xF0 else _END
        bits[begin:end] = length + size
    return skip, value, bits


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """The quantised coefficients (blocks x 64, zigzag order) of each component of each image.

    Images with equal tables and sampling are decoded together, some CHUNK bytes of scans at a time, also of one image
    with restart markers; an interval is never split.
    """
    out: list[list[list[np.ndarray]]] = [[[] for _ in image.components] for image in images]
    alike: dict[tuple, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
    for i, m in enumerate(images):
        single = len(m.components) == 1
        wide, high = (1, 1) if single else (max(c[1] for c in m.components), max(c[2] for c in m.components))
        total = -(-m.width // (8 * wide)) * -(-m.height // (8 * high))
        each = m.every or total
        if len(m.sizes) != -(-total // each):
            raise JpegError("restart markers are missing")
        units = np.full(len(m.sizes), each)
        units[-1] = total - each * (len(m.sizes) - 1)
        upto = np.cumsum(m.sizes)
        begin = 0
        while begin < len(units):
            at = int(upto[begin] - m.sizes[begin])
            end = max(begin + 1, int(np.searchsorted(upto, at + CHUNK, "right")))
            alike[m.tables, tuple(c[1:3] for c in m.components)].append((i, units[begin:end], m.sizes[begin:end], m.scan[at : int(upto[end - 1])]))
            begin = end
    for (tables, sampling), pieces in alike.items():
        for a, b in runs_of([len(scan) for *_, scan in pieces], CHUNK):
            for (i, *_), found in zip(pieces[a:b], _decoded(tables, sampling, [piece[1:] for piece in pieces[a:b]])):
                for held, blocks in zip(out[i], found):
                    held.append(blocks)
    return [[held[0] if len(held) == 1 else np.concatenate(held) for held in image] for image in out]


def _decoded(tables: tuple, sampling: tuple, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[list[np.ndarray]]:
    """The coefficients of each component of pieces of scans: blocks of each interval, their bytes, and the scan itself.

    Every restart interval is a lane with its own bit position, and all lanes read their next symbol in the same numpy
    steps.
    """
    order = [0] if len(sampling) == 1 else [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    units = np.concatenate([u for u, _, _ in pieces])
    size = np.concatenate([n for _, n, _ in pieces])
    stop = np.cumsum(size) * 8
    bit = stop - size * 8
    data = np.concatenate([*(scan for *_, scan in pieces), np.full(8, 255, np.uint8)]).astype(np.uint32)
    ahead = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]  # 24 bits from each byte
    first = np.cumsum(units) - units
    found = [np.zeros((int(units.sum()) * order.count(c), 64), np.int16) for c in range(len(sampling))]
    looked = [tuple(_lookup(t, k == 0) for k, t in enumerate(pair)) for pair in tables]
    predicted = np.zeros((len(sampling), len(size)), np.int64)

    def read(lane: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each lane: zeros to skip and the coefficient."""
        at = bit[lane]
        got = (ahead[np.minimum(at >> 3, len(ahead) - 1)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        skip, value, used = (t[got] for t in table)
        bit[lane] = at + used
        if not used.all():
            raise JpegError("no such Huffman code")
        for k in np.flatnonzero(skip == _LONG):  # rare: large coefficients under long codes
            n, raw, b = int(value[k]) & 15, 0, int(at[k] + used[k])
            for j in range(b, b + n):
                raw = raw << 1 | int(data[min(j >> 3, len(data) - 1)]) >> (7 - (j & 7)) & 1
            skip[k], value[k] = int(value[k]) >> 4, raw if raw >> (n - 1) else raw - (1 << n) + 1
            bit[lane[k]] = b + n
        return skip, value

    for unit in range(int(units.max(initial=0))):
        live = np.flatnonzero(units > unit)
        for k, c in enumerate(order):
            row = (first[live] + unit) * order.count(c) + k - order.index(c)
            predicted[c, live] += read(live, looked[c][0])[1]
            found[c][row, 0] = predicted[c, live]
            lane, place = live, np.ones(len(live), np.int64)
            while len(lane):
                skip, value = read(lane, looked[c][1])
                place += skip
                most = place.max()
                if most < 63:
                    found[c][row, place] = value
                    place += 1
                    continue
                if ((place > 63) & (place < _END)).any():
                    raise JpegError("a run passes the end of its block")
                on = place < 64
                found[c][row[on], place[on]] = value[on]
                on = place < 63
                lane, row, place = lane[on], row[on], place[on] + 1
    if (bit > stop).any():
        raise JpegError("a scan is cut off")
    out, at = [], 0
    for own, *_ in pieces:
        begin, count = int(first[at]), int(own.sum())
        out.append([f[begin * order.count(c) : (begin + count) * order.count(c)] for c, f in enumerate(found)])
        at += len(own)
    return out


def payload(image: Image, blocks: list[np.ndarray]) -> bytes:
    """The payload of a file that store() made."""
    if not image.note.startswith(NOTE):
        raise JpegError("no stored payload")
    n = int(image.note[len(NOTE) :])
    return _BYTE[blocks[0].ravel()[:n] + 128].tobytes()


def thumbnail(image: Image, blocks: list[np.ndarray], side: int = SIDE) -> np.ndarray:
    """Luminance at an eighth of the size from DC coefficients alone, averaged down to side x side bytes."""
    _, h, v, q = image.components[0]
    single = len(image.components) == 1
    h, v = (1, 1) if single else (h, v)
    wide = 1 if single else max(c[1] for c in image.components)
    high = 1 if single else max(c[2] for c in image.components)
    across = -(-image.width // (8 * wide))
    down = -(-image.height // (8 * high))
    dc = blocks[0][:, 0].astype(np.float64) * image.quant[q][0] / 8 + 128
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h).clip(0, 255)
    for axis in (0, 1):
        n = grid.shape[axis]
        edges = np.arange(side) * n // side
        width = np.maximum(np.append(edges[1:], n) - edges, 1)
        sums = np.add.reduceat(grid, edges, axis=axis)
        grid = sums / (width[:, None] if axis == 0 else width[None])
    return np.rint(grid).astype(np.uint8)


def thumbnail_hash(small: np.ndarray) -> str:
    """64 bits, one for each place that is brighter than the mean, as 16 hex digits."""
    return np.packbits(small > small.mean()).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes (of the text in UTF-8) and media: a JPEG that holds the text and 0 to 64 zero bytes.

    A null text counts as empty; an empty one is stored as 64 zero bytes. Repeated rows stay repeated, other columns
    are ignored, no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in runs_of([len(t) for t in raw], CHUNK):
                some = raw[a:b]
                files = store([t + bytes(-len(t) % 64 if t else 64) for t in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in some], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each stored payload: digests of payload and file, dimensions, thumbnail (bytes) and its hash in `feature`."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            for a, b in runs_of([len(f) for f in files], CHUNK):
                images = [parse(f) for f in files[a:b]]
                rows = []
                for f, image, blocks in zip(files[a:b], images, coefficients(images)):
                    p, small = payload(image, blocks), thumbnail(image, blocks)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), f"{image.width}x{image.height}:{thumbnail_hash(small)}", image.width, image.height, small.tobytes()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in (0, 1)] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail binary")
