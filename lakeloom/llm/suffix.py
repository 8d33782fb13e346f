"""Suffix-array dedup: removal of bytes covered by long repeated strings.

Any string of ``length`` bytes contains a window of ``ANCHOR`` bytes whose hash is smallest; equal
strings have it at the same place.  So only suffixes at such anchors need sorting: neighbouring starts
with one anchor make a *stretch*, keyed by the anchor's hash, the bytes from the anchor on and then the
bytes before it.  Each task sorts the keys of its slices to front-coded runs, the runs are exchanged by key
range, and a loser tree merges them; it keeps the common prefix of every contender with the last
winner, so bytes known to agree are never compared again.  As keys begin with a hash, ranges of equal
width are even, no key is sampled, and an anchor lies in one range.

Equal stretches are repeated as a whole; those that a run holds many times are settled there, and one of
them goes on.  Different stretches of one anchor are compared start by start, but only at starts that the
neighbours' common prefixes leave possible.  Of an anchor with very many stretches these starts are
compared by digest in a second exchange, so that no task holds them together.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_rows, cut_lineage

LENGTH = 200
ANCHOR = 24
#: Text that one sorted run covers (about 100 bytes a stretch), and bytes of text for each key range.
RUN_BYTES, RANGE_BYTES = 16 << 20, 8 << 20
#: Distinct stretches of one anchor that a task compares; those of a more frequent anchor meet by digest.
HOT_KEYS = 5_000
#: Tasks of the merge at most; beyond, a task merges several ranges, one after the other.
MAX_TASKS = 100_000
#: A longer text is cut into chunks of so many starts.
CHUNK = 1 << 22
_POS = np.uint64((1 << 24) - 1)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MOD = 0x9E3779B97F4A7C15 | 1, 1 << 64
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, _MOD)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def anchor_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` bytes: equal windows, equal hashes, wherever they stand."""
    n = len(data) - width + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * down[1 : len(data) + 1], out=sums[1:])
    h = (sums[width:] - sums[:n]) * up[width : width + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def stretches(data: bytes, length: int = LENGTH, width: int = ANCHOR) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, first start, last start, 32 bits of the anchor's hash) of each stretch; every start of a ``length``-byte string is in exactly one."""
    starts = len(data) - length + 1
    for base in range(0, starts, CHUNK):
        part = np.frombuffer(data, dtype=np.uint8)[base : min(base + CHUNK, starts) + length - 1]
        h = anchor_hashes(part, width)
        low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
        window, size = low, 1
        want = length - width + 1
        while size * 2 <= want:
            window = np.minimum(window[:-size], window[size:])
            size *= 2
        if size < want:
            window = np.minimum(window[: len(window) - (want - size)], window[want - size :])
        at = (window & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        # the smallest hashes are small; mixed once more their upper bits are even
        mixed = (h[at[first]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        yield from zip((at[first] + base).tolist(), (first + base).tolist(), (last + base).tolist(), mixed.tolist())


#: Bytes of the hash at the head of a key.
HASH = 4


def key_of(data: bytes, anchor: int, first: int, last: int, mixed: int, length: int = LENGTH) -> bytes:
    """Hash of the anchor, bytes from the anchor on, then the bytes before it, then both lengths."""
    before, after = anchor - first, last + length - anchor
    return mixed.to_bytes(HASH) + data[anchor : last + length] + data[first:anchor] + before.to_bytes(2) + after.to_bytes(2)


def parts_of(key: bytes) -> tuple[bytes, bytes]:
    """The bytes before and from the anchor on."""
    before, after = int.from_bytes(key[-4:-2]), int.from_bytes(key[-2:])
    return key[HASH + after : HASH + after + before], key[HASH : HASH + after]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    n = min(len(a), len(b))
    lo, step = known, 16
    while lo < n:
        hi = min(lo + step, n)
        x, y = a[lo:hi], b[lo:hi]
        if x != y:
            diff = int.from_bytes(x) ^ int.from_bytes(y)
            return hi - (diff.bit_length() + 7) // 8
        lo, step = hi, step * 4
    return n


# -- front-coded runs ---------------------------------------------------------------------------


def write_run(entries: list[tuple[bytes, int, int, int, int]]) -> bytes:
    """A sorted run of (key, text number, first start, last start, 1 if it stands for several), each key without the prefix that it shares with the one before."""
    keys = [e[0] for e in entries]
    shared = [0, *map(common_prefix, keys, keys[1:])]
    tails = [k[n:] for k, n in zip(keys, shared)]
    numbers = np.array([shared, list(map(len, tails)), *([e[i] for e in entries] for i in (1, 2, 3, 4))], dtype="<i8")
    pack = zstandard.ZstdCompressor(level=5).compress
    head = pack(numbers.view(np.uint8).reshape(6, -1, 8).transpose(0, 2, 1).tobytes())  # equal bytes of a column side by side
    return len(entries).to_bytes(4) + len(head).to_bytes(4) + head + pack(b"".join(tails))


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """(prefix shared with the entry before, rest of the key, text number, first start, last start, several) in key order."""
    n, size = int.from_bytes(blob[:4]), int.from_bytes(blob[4:8])
    unpack = zstandard.ZstdDecompressor().decompress
    head = np.frombuffer(unpack(blob[8 : 8 + size]), dtype=np.uint8).reshape(6, 8, n).transpose(0, 2, 1)
    tails, at = unpack(blob[8 + size :]), 0
    for s, k, d, f, l, m in zip(*np.ascontiguousarray(head).view("<i8").reshape(6, n).tolist()):
        yield s, tails[at : at + k], d, f, l, m
        at += k


class LoserTree:
    """Merge of front-coded runs: yields (common prefix with the entry before, key, document, first start, last start, several).

    A contender is [prefix shared with the last winner, key, source, payload].  Of two contenders the
    one with the longer shared prefix is smaller; only at equal prefixes are bytes compared, from there on.
    """

    def __init__(self, runs: list[bytes]):
        self.sources = [read_run(r) for r in runs]
        self.current = [b""] * len(runs)
        self.width = max(1, len(runs))
        self.nodes: list[list | None] = [None] * self.width

    def _next(self, source: int, shared: int | None = None) -> list | None:
        entry = next(self.sources[source], None)
        if entry is None:
            return None
        s, tail, *payload = entry
        self.current[source] = key = self.current[source][:s] + tail
        return [s if shared is None else shared, key, source, payload]

    @staticmethod
    def _duel(a: list | None, b: list | None) -> tuple[list | None, list | None]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        if a is None:
            return b, a
        if b is None:
            return a, b
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        n = common_prefix(a[1], b[1], a[0])
        first = a[1][n:] <= b[1][n:]
        win, lose = (a, b) if first else (b, a)
        lose[0] = n
        return win, lose

    def _play(self, node: int) -> list | None:
        """Winner of the subtree of a node; losers stay in the nodes."""
        if node >= self.width:
            return self._next(node - self.width, 0)
        winner, self.nodes[node] = self._duel(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self):
        champion = self._play(1) if self.sources else None
        while champion is not None:
            shared, key, source, payload = champion
            yield (shared, key, *payload)
            champion, node = self._next(source), (source + self.width) // 2
            while node:
                champion, self.nodes[node] = self._duel(champion, self.nodes[node])
                node //= 2


# -- comparison of the stretches of one anchor ----------------------------------------------------


def possible(reach: int, before: int, after: int, length: int) -> tuple[int, int]:
    """Distances before the anchor at which a start may be repeated, if another key shares at most ``reach`` bytes from the anchor."""
    return length - min(reach, after), before


def repeated_starts(keys: list[bytes], reach: list[int], length: int) -> list[list[int]]:
    """For each key the distances d before the anchor whose string is also one of another key (keys differ).

    One distance at a time, so memory follows the number of keys, not of starts.
    """
    halves = [parts_of(k) for k in keys]
    found: list[list[int]] = [[] for _ in keys]
    events: dict[int, list[int]] = {}
    for i, (r, (b, a)) in enumerate(zip(reach, halves)):
        lo, hi = possible(r, len(b), len(a), length)
        for d in range(lo, hi + 1):
            events.setdefault(d, []).append(i)
    for d, members in events.items():
        if len(members) < 2:
            continue
        seen: dict[bytes, int] = {}
        for i in members:
            before, after = halves[i]
            text = before[len(before) - d :] + after[: length - d]
            other = seen.setdefault(text, i)
            if other != i:
                found[i].append(d)
                if not found[other] or found[other][-1] != d:
                    found[other].append(d)
    return found


SPANS = "doc long, lo long, hi long, digest binary"


def merge_range(runs: list[bytes], length: int = LENGTH, width: int = ANCHOR, hot_keys: int = HOT_KEYS) -> Iterator[tuple]:
    """Rows of ``SPANS`` from the runs of one key range.

    Covered bytes [lo, hi) of a text have a null digest; rows with a digest are starts of anchors with
    over ``hot_keys`` distinct stretches, to be compared with each other.  Besides these stretches, of
    which it holds ``hot_keys`` at most, a merge holds one entry of each run.
    """
    group: list[list] = []  # [key, bytes shared with the key before, number of places, text, first, last]
    hot = False  # this anchor's starts go by digest

    def begins(key, first, distances):
        return sorted(first + int.from_bytes(key[-4:-2]) - d for d in distances)

    def reaches(next_shared: int) -> list[int]:
        """Bytes from the anchor on that each key shares with a neighbour."""
        near = [*[g[1] for g in group], next_shared]
        return [max(near[i], near[i + 1]) - HASH for i in range(len(group))]

    def by_digest(keys: list[list], reach: list[int]):
        for (key, _, _, doc, first, _), r in zip(keys, reach):
            before, after = parts_of(key)
            lo, hi = possible(r, len(before), len(after), length)
            for d in range(lo, hi + 1):
                text = before[len(before) - d :] + after[: length - d]
                start = first + len(before) - d
                yield doc, start, start + length, hashlib.blake2b(text, digest_size=16).digest()

    def close():
        if hot:
            yield from by_digest(group, reaches(0))
            return
        if len(group) < 2 or all(g[2] > 1 for g in group):
            return
        for (key, _, places, doc, first, _), hits in zip(group, repeated_starts([g[0] for g in group], reaches(0), length)):
            if places == 1 and hits:
                starts = begins(key, first, hits)
                start = stop = starts[0]
                for b in starts[1:]:
                    if b > stop + length:
                        yield doc, start, stop + length, None
                        start = b
                    stop = b
                yield doc, start, stop + length, None

    for shared, key, doc, first, last, several in LoserTree(runs):
        if group and shared >= HASH + width:
            own = group[-1]
            if shared == len(key) == len(own[0]):
                if own[2] == 1:
                    yield own[3], own[4], own[5] + length, None
                own[2] += 1
                yield doc, first, last + length, None
                continue
            if len(group) >= hot_keys:
                hot = True
                yield from by_digest(group[:-1], reaches(shared)[:-1])
                del group[:-1]
        elif group:
            yield from close()
            group, hot, shared = [], False, 0
        group.append([key, shared, 1 + several, doc, first, last])
    if group:
        yield from close()


# -- Spark --------------------------------------------------------------------------------------


#: Heads of rows that are not runs: the texts of a task, and bytes that are known to be covered.
_NAMES, _SPANS = b"\xff\xff\xff\xff", b"\xff\xff\xff\xfe"


def _bounds(ranges: int) -> list[bytes]:
    """Heads of keys that cut the hashes in ranges of equal width."""
    return [(-(-(i << 8 * HASH) // ranges)).to_bytes(HASH) for i in range(1, ranges)]


def _settled(entries: list[tuple[bytes, int, int, int]], length: int) -> tuple[list[tuple], np.ndarray]:
    """One entry of each key of a sorted run, with 1 if it stands for several, and the bytes that several cover: (text, lo, hi)."""
    kept, covered, i = [], [], 0
    while i < len(entries):
        j = i + 1
        while j < len(entries) and entries[j][0] == entries[i][0]:
            j += 1
        kept.append((*entries[i], int(j > i + 1)))
        if j > i + 1:
            covered += [(doc, first, last + length) for _, doc, first, last in entries[i:j]]
        i = j
    return kept, np.array(covered, dtype="<i8").reshape(-1, 3)


def _runs(source: DataFrame, ranges: int, length: int, width: int, run_bytes: int) -> DataFrame:
    """Rows ``(range, run)``: the sorted, front-coded stretches of each slice of texts, by key range.

    Texts are numbered by task and place; each task also sends the digests of its texts, and what its
    own repeated stretches cover, to some range.
    """
    schema = pa.schema([("range", pa.int32()), ("run", pa.binary())])

    def row(number, blob):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

    def flush(entries, names, first_name, heads):
        entries.sort()
        kept, covered = _settled(entries, length)
        entries.clear()
        lo = 0
        for number, hi in enumerate([*[bisect_left(kept, (c,)) for c in heads], len(kept)]):
            if hi > lo:
                yield row(number, write_run(kept[lo:hi]))
            lo = hi
        some = zlib.crc32(first_name.to_bytes(8)) % ranges
        yield row(some, _NAMES + first_name.to_bytes(8) + b"".join(names))
        if len(covered):
            yield row(some, _SPANS + zstandard.ZstdCompressor(level=3).compress(covered.tobytes()))

    def run(batches):
        entries, names, heads = [], [], _bounds(ranges)
        number = first_name = TaskContext.get().partitionId() << 40
        for batch in batches:
            for text in batch.column(0).to_pylist():
                names.append(hashlib.md5(text).digest())
                for at, first, last, mixed in stretches(text, length, width):
                    entries.append((key_of(text, at, first, last, mixed, length), number, first, last))
                number += 1
                if len(entries) * 100 >= run_bytes:
                    yield from flush(entries, names, first_name, heads)
                    names, first_name = [], number
        if names:
            yield from flush(entries, names, first_name, heads)

    return source.select("text").mapInArrow(run, "range int, run binary")


def repeated_spans(source: DataFrame, length: int = LENGTH, width: int = ANCHOR, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Rows ``(doc, spans)`` for the texts of ``source(text binary)`` that hold repeated strings: spans cover them, possibly overlapping.

    ``doc`` is the MD5 digest of a text; equal texts have equal spans.
    """
    long_ = source.where(F.octet_length("text") >= length)
    total = long_.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    arrow = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        columns: tuple[list, ...] = ([], [], [], [])
        blobs = table.column("run").to_pylist()
        for blob in blobs:
            if blob[:4] == _NAMES:
                first, names = int.from_bytes(blob[4:12]), blob[12:]
                for i in range(len(names) // 16):
                    for c, x in zip(columns, (first + i, -1, -1, names[16 * i : 16 * i + 16])):
                        c.append(x)
            elif blob[:4] == _SPANS:
                found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), dtype="<i8").reshape(-1, 3)
                for c, x in zip(columns, (*found.T.tolist(), [None] * len(found))):
                    c.extend(x)
        for row in merge_range([b for b in blobs if b[:4] not in (_NAMES, _SPANS)], length, width, hot_keys):
            for c, x in zip(columns, row):
                c.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # about one range a task, however many there are
    runs = _runs(long_, ranges, length, width, run_bytes).repartition(min(ranges, MAX_TASKS), "range")
    rows = cut_lineage(runs.groupBy("range").applyInArrow(merge, SPANS))
    # of equal texts one number is enough: their spans are equal
    names = rows.where("lo < 0").groupBy(F.col("digest").alias("name")).agg(F.min("doc").alias("doc"))
    edges = rows.where("lo >= 0 AND digest IS NOT NULL")  # starts of frequent anchors
    again = edges.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    covered = rows.where("lo >= 0 AND digest IS NULL").select("doc", "lo", "hi").union(edges.join(again, "digest", "left_semi").select("doc", "lo", "hi"))
    spans = covered.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return spans.join(names, "doc").select(F.col("name").alias("doc"), "spans")


def _packed(source: DataFrame) -> DataFrame:
    """Rows ``(doc_id, doc, text)`` with the text's MD5 digest and the compressed text, for the exchange."""

    def rows(keys, texts):
        pack = zstandard.ZstdCompressor(level=3).compress
        yield {"doc_id": keys, "doc": [hashlib.md5(t).digest() for t in texts], "text": [pack(t) for t in texts]}

    return arrow_rows(source.select("doc_id", "text"), rows, "doc_id long, doc binary, text binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", keep_text: bool = True, **sizes) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every document.

    Null texts count as empty.  Each byte covered by a ``length``-byte string that also starts anywhere
    else goes; ``kept`` is what is left (broken characters replaced).  Repeated rows are copies of each
    other; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(source.select("text"), length, **sizes)
    joined = _packed(source).join(spans, "doc", "left").select("doc_id", "text", "spans")
    names = [x.split()[0] for x in RESULT.split(", ")]
    if not keep_text:
        names = names[:-1]
    schema = ", ".join(x for x in RESULT.split(", ") if x.split()[0] in names)

    def rows(keys, texts, spans):
        out: dict[str, list] = {n: [] for n in names}
        unpack = zstandard.ZstdDecompressor().decompress
        for k, t, found in zip(keys, texts, spans):
            t = unpack(t)
            kept, at, removed, runs = [], 0, 0, 0
            for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
                if lo > at or not runs:
                    kept.append(t[at:lo])
                    runs += 1
                    removed += hi - lo
                    at = hi
                elif hi > at:
                    removed += hi - at
                    at = hi
            kept = b"".join([*kept, t[at:]])
            for n, x in zip(names, (k, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None)):
                out[n].append(x)
        yield out

    return arrow_rows(joined, rows, schema)
