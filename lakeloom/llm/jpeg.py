"""Baseline JPEG media columns.

``encode`` stores a payload as a grey baseline JPEG: each byte is the DC coefficient of one flat
8x8 block (quantiser 8, so block mean = byte), 64 blocks a row, a restart interval each row.
``luminance`` reads any baseline JPEG: it parses the markers, Huffman-decodes the scans and rebuilds
the DC-only luminance thumbnail, one value for each 8x8 block.  Restart intervals of all images of a
batch are decoded side by side in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_rows

WIDTH = 64
#: Blocks of one image: 64 columns, and as many rows as 16-bit heights allow.
IMAGE_BYTES = WIDTH * 8191
#: Bytes of payload or scan that are worked on together.
WORK_BYTES = 1 << 20

# Order of the 64 coefficients in a DQT segment is irrelevant here: only the DC quantiser is used.
_DC_CODES = bytes([1] * 9 + [0] * 7), bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
_AC_CODES = bytes([1] + [0] * 15), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63)
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + _DC_CODES[0] + _DC_CODES[1])
        + _segment(0xC4, b"\x10" + _AC_CODES[0] + _AC_CODES[1])
        + _segment(0xDD, struct.pack(">H", WIDTH))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _block_codes() -> np.ndarray:
    """For DC differences -255..255: code, extra bits and end of block, ten bits in all."""
    out = np.zeros(511, dtype=np.uint16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix = (1 << (9 - size)) - 2
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        out[diff + 255] = (prefix << size | extra) << 1
    return out


_BLOCK_CODES = _block_codes()


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 or (64 if not data else 0))


def groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive items whose sizes add up to ``most`` at most, or one item."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One media value for each payload (a positive multiple of 64 bytes): concatenated JPEG images.

    Images are made a few at a time, so a long payload takes no more working memory than short ones.
    """
    parts = [(i, p[at : at + IMAGE_BYTES]) for i, p in enumerate(payloads) for at in range(0, len(p), IMAGE_BYTES)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for lo, hi in groups_of([len(p) for _, p in parts], WORK_BYTES):
        for (i, _), made in zip(parts[lo:hi], _encode([p for _, p in parts[lo:hi]])):
            out[i].append(made)
    return [b"".join(x) for x in out]


def _encode(payloads: list[bytes]) -> list[bytes]:
    """One image for each payload of ``IMAGE_BYTES`` at most."""
    rows = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDTH).astype(np.int16)
    if not len(rows):
        return []
    code = _BLOCK_CODES[np.diff(rows, axis=1, prepend=np.int16(128)) + 255].reshape(len(rows), 16, 4)
    c0, c1, c2, c3 = (code[:, :, i] for i in range(4))
    scan = np.empty((len(rows), 82), dtype=np.uint8)
    scan[:, :80] = np.stack([c0 >> 2, (c0 & 3) << 6 | c1 >> 4, (c1 & 15) << 4 | c2 >> 6, (c2 & 63) << 2 | c3 >> 8, c3 & 255], axis=2).reshape(len(rows), 80)
    scan[:, 80] = 0xFF
    images: list[tuple[int, int]] = []  # first row, rows
    at = 0
    for p in payloads:
        n = len(p) // WIDTH
        scan[at : at + n, 81] = 0xD0 + np.arange(n) % 8
        scan[at + n - 1, 81] = 0xD9
        images.append((at, n))
        at += n
    full = scan[:, :80] == 0xFF
    ends = np.cumsum(82 + full.sum(axis=1))
    times = np.ones(scan.shape, dtype=np.int8)
    times[:, :80] += full
    flat = np.repeat(scan.ravel(), times.ravel())
    stuffed = np.cumsum(times.ravel(), dtype=np.int64)[np.flatnonzero(times.ravel() == 2)] - 1
    flat[stuffed] = 0
    data = flat.tobytes()
    return [_head(n) + data[(ends[first - 1] if first else 0) : ends[first + n - 1]] for first, n in images]


class Huffman:
    """Symbol and length for each 16-bit window; length 0 where no code matches."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol = np.zeros(1 << 16, dtype=np.uint8)
        self.length = np.zeros(1 << 16, dtype=np.uint8)
        code = at = 0
        for size, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                lo, hi = code << (16 - size), (code + 1) << (16 - size)
                self.symbol[lo:hi], self.length[lo:hi] = s, size
                code += 1
            at += n
            code <<= 1


_tables: dict[bytes, Huffman] = {}
_fused: dict[bytes, np.ndarray] = {}


def _huffman(key: bytes) -> Huffman:
    if key not in _tables:
        if len(_tables) > 256:
            _tables.clear()
        _tables[key] = Huffman(key[:16], key[16:])
    return _tables[key]


def _whole_block(dc: bytes, ac: bytes) -> np.ndarray:
    """For each 16-bit window that holds a DC code, its extra bits and an end of block: (difference + 2048) << 8 | bits; else 0."""
    key = dc + b"|" + ac
    if key not in _fused:
        if len(_fused) > 64:
            _fused.clear()
        d, a = _huffman(dc), _huffman(ac)
        w = np.arange(1 << 16, dtype=np.int64)
        size, length = d.symbol.astype(np.int64), d.length.astype(np.int64)
        fits = (length > 0) & (size <= 11) & (length + size <= 16)
        extra = np.where(fits, (w >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1), 0)
        diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        rest = (w << np.minimum(length + size, 16)) & 0xFFFF
        total = length + size + a.length[rest]
        fits &= (a.length[rest] > 0) & (a.symbol[rest] == 0) & (total <= 16)
        _fused[key] = np.where(fits, (diff + 2048) << 8 | total, 0).astype(np.int32)
    return _fused[key]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: (horizontal, vertical sampling, DC table, AC table, DC quantiser) of each component of the scan
    parts: tuple = ()
    interval: int = 0
    scan: tuple[int, int] = (0, 0)
    sizes: dict = field(default_factory=dict)


def parse(data: bytes) -> list[Image]:
    """Images of concatenated baseline JPEG streams, one at least.  Raises ValueError for anything else."""
    try:
        images = _parse(data)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"cut or broken segment: {e}") from e
    if not images:
        raise ValueError("no image")
    for image in images:
        blocks = -(-image.height // (8 * max(x[1] for x in image.parts))) * -(-image.width // (8 * max(x[0] for x in image.parts)))
        if not blocks or 2 * blocks > 8 * (image.scan[1] - image.scan[0]):  # a block takes two bits at least
            raise ValueError("the scan is too short for its dimensions")
    return images


def _parse(data: bytes) -> list[Image]:
    images, at = [], 0
    quant: dict[int, int] = {}
    codes: dict[int, bytes] = {}
    frame: list = []
    image = Image()
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker in (0xD8, 0xD9, 0x01) or 0xD0 <= marker <= 0xD7:
            if marker == 0xD8:
                image, quant, codes, frame = Image(), {}, {}, []
            continue
        size = int.from_bytes(data[at : at + 2])
        body = data[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("cut segment")
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1:3]) if wide else body[1]
                body = body[1 + 64 * (2 if wide else 1) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2])
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline JPEG")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if len(chosen) != len(frame):
                raise ValueError("only one interleaved scan")
            image.parts = tuple((h, v, codes[chosen[c] >> 4], codes[16 | chosen[c] & 15], quant[q]) for c, h, v, q in frame)
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("cut scan")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            image.scan = (at, end)
            at = end
            images.append(image)
            image = Image(interval=image.interval)
    return images


def _lanes(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Restart intervals of all scans without stuffing: bytes, first bit of each, scan of each."""
    raw = np.frombuffer(b"".join(s + b"\xff\xd9" for s in scans), dtype=np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    marks, stuffed = full[(after >= 0xD0) & (after <= 0xD9)], full[after == 0] + 1
    keep = np.ones(len(raw), dtype=bool)
    keep[marks] = keep[marks + 1] = keep[stuffed] = False
    starts = np.concatenate([[0], marks[:-1] + 2])
    ends = np.cumsum([len(s) + 2 for s in scans])
    scan = np.searchsorted(ends, starts, side="right")
    new = np.concatenate([[0], np.cumsum(keep)])
    return np.concatenate([raw[keep], np.zeros(16, dtype=np.uint8)]), new[starts] * 8, scan


def luminance(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each media value the DC-only luminance thumbnails (rows x columns of block means) of its images.

    Raises ValueError if a value is no baseline JPEG.
    """
    parsed = [parse(m) for m in media]
    out: list[list[np.ndarray]] = [[None] * len(p) for p in parsed]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, p in enumerate(parsed):
        for j, image in enumerate(p):
            groups.setdefault((image.parts, image.interval), []).append((i, j))
    work = [(key, members[lo:hi]) for key, members in groups.items() for lo, hi in groups_of([parsed[i][j].scan[1] - parsed[i][j].scan[0] for i, j in members], WORK_BYTES)]
    for (parts, interval), members in work:
        images = [parsed[i][j] for i, j in members]
        hmax, vmax = max(x[0] for x in parts), max(x[1] for x in parts)
        if len(parts) == 1:
            parts, hmax, vmax = ((1, 1, *parts[0][2:]),), 1, 1
        shape = [(-(-x.height // (8 * vmax)), -(-x.width // (8 * hmax))) for x in images]
        total = np.array([a * b for a, b in shape])
        data, start, scan = _lanes([media[i][images[k].scan[0] : images[k].scan[1]] for k, (i, _) in enumerate(members)])
        number = np.arange(len(scan)) - np.searchsorted(scan, scan)
        count = np.clip(total[scan] - number * interval, 0, interval) if interval else total[scan]
        if np.any(np.bincount(scan, weights=count, minlength=len(images)) != total):
            raise ValueError("intervals are missing")
        values = _decode(data, start, np.append(start[1:], (len(data) - 16) * 8), count, parts)
        h, v, _, _, q = parts[0]
        first = np.concatenate([[0], np.cumsum(np.bincount(scan, minlength=len(images)))])
        for k, (i, j) in enumerate(members):
            lanes = slice(first[k], first[k + 1])
            block = values[lanes].reshape(-1, h * v)[: total[k]]  # only an image's last interval is shorter
            rows, cols = shape[k]
            grid = block.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
            grid = grid[: -(-images[k].height * v // (8 * vmax)), : -(-images[k].width * h // (8 * hmax))]
            out[i][j] = np.clip((grid.astype(np.int64) * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def _decode(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, parts: tuple) -> np.ndarray:
    """DC coefficients of component 0: lanes x MCUs x blocks."""
    four = data[:-3].astype(np.uint32) << 24
    for k in (1, 2, 3):
        four |= data[k : len(data) - 3 + k].astype(np.uint32) << (24 - 8 * k)

    def window(bits: np.ndarray) -> np.ndarray:
        at = bits >> 3
        if at.max(initial=0) >= len(four):
            raise ValueError("a scan ends early")
        return (four[at] << (bits & 7).astype(np.uint32)) >> np.uint32(16)

    pos = start.astype(np.int64).copy()
    most = int(count.max(initial=0))
    h, v = parts[0][:2]
    out = np.zeros((len(start), most, h * v), dtype=np.int16)
    last = np.zeros((len(parts), len(start)), dtype=np.int32)
    even = bool(len(count)) and bool((count == most).all())
    for step in range(most):
        lanes = None if even else np.flatnonzero(count > step)
        for c, (ch, cv, dc, ac, _) in enumerate(parts):
            table = _whole_block(dc, ac)
            for b in range(ch * cv):
                p = pos if lanes is None else pos[lanes]
                got = table[window(p)]
                move, diff = got & 255, (got >> 8) - 2048
                slow = np.flatnonzero(got == 0)
                if len(slow):
                    move[slow], diff[slow] = _one_block(window, p[slow], _huffman(dc), _huffman(ac))
                if lanes is None:
                    pos += move
                    last[c] += diff
                    if c == 0:
                        out[:, step, b] = last[c]
                else:
                    pos[lanes] += move
                    last[c, lanes] += diff
                    if c == 0:
                        out[lanes, step, b] = last[c, lanes]
    if np.any(pos > end):
        raise ValueError("a scan ends early")
    return out


def _one_block(window, pos: np.ndarray, dc: Huffman, ac: Huffman) -> tuple[np.ndarray, np.ndarray]:
    """Bits used and DC difference of one block in each lane, symbol by symbol."""
    at = pos.copy()
    w = window(at)
    size = dc.symbol[w].astype(np.int64)
    if np.any(dc.length[w] == 0) or np.any(size > 11):
        raise ValueError("no such DC code")
    at += dc.length[w]
    extra = window(at).astype(np.int64) >> (16 - size)
    diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
    at += size
    k = np.ones(len(at), dtype=np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        w = window(at[open_])
        if np.any(ac.length[w] == 0):
            raise ValueError("no such AC code")
        symbol = ac.symbol[w].astype(np.int64)
        at[open_] += ac.length[w] + (symbol & 15)
        k[open_] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
        open_ = open_[k[open_] < 64]
    return at - pos, diff


def thumbnail_hash(grid: np.ndarray) -> int:
    """Average hash: 8x8 cell means of the thumbnail, bit set where a cell is over the mean of all."""
    rows = np.arange(8) * grid.shape[0] // 8
    cols = np.arange(8) * grid.shape[1] // 8
    sums = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), rows, axis=0), cols, axis=1)
    high = np.maximum(np.diff(np.append(rows, grid.shape[0])), 1)
    wide = np.maximum(np.diff(np.append(cols, grid.shape[1])), 1)
    mean = sums / (high[:, None] * wide[None, :])
    return int.from_bytes(np.packbits(mean.ravel() > mean.mean()).tobytes())


def store_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, n_bytes, media)``: each whole text as a lossless baseline JPEG column.

    Null texts count as empty; empty texts become one row of 64 zero blocks; texts over 524,224
    bytes become several concatenated images; repeated rows stay; other columns are ignored.
    """

    def rows(keys, texts):
        raw = [t or b"" for t in texts]
        yield {"doc_id": keys, "n_bytes": [len(t) for t in raw], "media": encode([pad(t) for t in raw])}

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw"))
    return arrow_rows(source, rows, "doc_id long, n_bytes long, media binary", slice_bytes=2 << 20)


def readable(values: list[bytes]) -> tuple[list[list[np.ndarray] | None], list[str | None]]:
    """Thumbnails of each media value, or None and what is wrong with it."""
    try:
        return luminance(values), [None] * len(values)
    except (ValueError, IndexError):
        pass
    grids: list = []
    errors: list[str | None] = []
    for v in values:  # one of them is broken
        try:
            (grid,) = luminance([v])
            error = None
        except (ValueError, IndexError) as e:
            grid, error = None, str(e) or "broken scan"
        grids.append(grid)
        errors.append(error)
    return grids, errors


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, images int, error string"


def media_features(media: DataFrame) -> DataFrame:
    """Read stored media back: dimensions, thumbnail hash, payload and digests.

    A null media value gives nulls.  Bytes that are no baseline JPEG, empty ones too, give their own
    size and digest, nulls for what would be read, and ``error``, which is null for all others.
    Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """

    def rows(keys, sizes, values):
        there = [i for i, v in enumerate(values) if v is not None]
        grids, errors = (dict(zip(there, x)) for x in readable([values[i] for i in there]))
        out: dict[str, list] = {x.split()[0]: [] for x in FEATURES.split(", ")[2:]}
        for i, v in enumerate(values):
            found: dict = dict.fromkeys(out)
            if v is not None:
                found |= {"media_bytes": len(v), "media_sha256": hashlib.sha256(v).hexdigest(), "error": errors[i]}
            if grids.get(i) is not None:
                sha, tail = hashlib.sha256(), b""
                for g in grids[i]:
                    part = g.tobytes()
                    sha.update(part)
                    tail = (tail + part[-64:])[-64:]
                high = sum(g.shape[0] for g in grids[i]) * 8
                wide = grids[i][0].shape[1] * 8
                mark = "-".join(f"{thumbnail_hash(g):016x}" for g in grids[i])
                found |= {"payload_bytes": sum(g.size for g in grids[i]), "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "feature": f"jpeg {wide}x{high} {mark}", "width": wide, "height": high, "images": len(grids[i])}
            for k, x in out.items():
                x.append(found[k])
        yield {"doc_id": keys, "n_bytes": sizes} | out

    return arrow_rows(media.select("doc_id", "n_bytes", "media"), rows, FEATURES, slice_bytes=3 << 20)
