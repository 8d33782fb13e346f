"""Sum-of-squares online packing of tokenised documents.

Each task packs the documents of its own input partition, so no text is shuffled.  Whole sequences
are cut off a long document; what remains goes to the fill level that minimises the sum of squared
counts of partially filled sequences, tracked in a level array.  A level holds at most
``level_limit`` sequences: where every level that could take a document whole is full, the document
is cut to close the fullest sequence.  So a task holds a bounded number of open sequences, whatever
its documents; a sequence leaves memory as it fills.  At the end of the partition the few that are
still open are cut and joined to full ones; the last tokens fill sequences of powers of two, which
need no padding.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Open sequences of one fill level; with 4 KB a sequence, a task holds 32 MB of ids at the very most.
LEVEL_LIMIT = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = tuple(x.split()[0] for x in SCHEMA.split(", "))

# Pre-token pattern of the byte-level BPE vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Other characters than these send a text down the slow way; single blanks and line ends between
#: them are the only white space.
OTHERS = re.compile("[^\n -~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2013\u2014\u2018-\u201e\u2026\u20ac]").search
RUNS = ("  ", " \n", "\n ", "\n\n")
CACHE = 300_000


class Tokenizer(dict):
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    No pre-token of the pattern spans a single blank or line end, so a word encodes alike wherever it
    stands; words are encoded once and kept (at most ``CACHE``, then the cache starts anew).  Texts
    with runs of white space, special tokens or rare characters are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer as Fast
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.fast = Fast.from_file(path)
        self.special = [t.content for t in self.fast.get_added_tokens_decoder().values()]
        # The file's byte alphabet: printable bytes stand for themselves, the others for U+0100 and on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        if set(byte) != set(ByteLevel.alphabet()):
            raise ValueError("another byte alphabet")
        ranks = {bytes(byte[c] for c in token): i for token, i in self.fast.get_vocab().items() if token not in self.special}
        self.short = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.short(word if word[:1] == "\n" else " " + word)
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.fast.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or OTHERS(text) or any(r in text for r in RUNS) or any(x in text for x in self.special):
            return self.whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return np.array(self.short(first), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, words))


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, given by a path or a name known to ``public_tokenizers``."""
    if name not in _tokenizers:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _tokenizers[name] = Tokenizer(path)
    return _tokenizers[name]


class SumOfSquares:
    """Online packing into sequences of ``capacity``; a piece is ``(owner, start, length)``.

    ``add`` and ``finish`` give the sequences that they fill.
    """

    def __init__(self, capacity: int = CAPACITY, level_limit: int = LEVEL_LIMIT):
        self.capacity, self.level_limit = capacity, level_limit
        self.count = np.zeros(capacity + 1, dtype=np.float64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def add(self, owner, tokens: int) -> Iterator[list]:
        start = 0
        while tokens - start >= self.capacity:
            yield [(owner, start, self.capacity)]
            start += self.capacity
        while start < tokens:
            level = self.choose(tokens - start)
            size = tokens - start
            if level is None:  # no room for it whole: it closes the fullest sequence, which is too full for it
                level = int(np.flatnonzero(self.count)[-1])
                size = self.capacity - level
            bin_ = self.open[level].pop() if level else []
            if level:
                self.count[level] -= 1
            bin_.append((owner, start, size))
            start += size
            if level + size == self.capacity:
                yield bin_
            else:
                self.open[level + size].append(bin_)
                self.count[level + size] += 1

    def choose(self, size: int) -> int | None:
        """Fill level whose use makes the sum of squared counts smallest; the fullest of equals; 0 opens a sequence.

        None where each level that it would lead to is at its limit.
        """
        top = self.capacity - size
        count = self.count
        after = count[size : self.capacity + 1].copy()  # counts at level + size, for levels 0..top
        full = after >= self.level_limit
        after[top], full[top] = -0.5, False  # a full sequence is not counted: the square only loses
        change = after - count[: top + 1] + 1
        change[0] = (count[size] if top else -0.5) + 0.5
        change[1:][count[1 : top + 1] == 0] = np.inf
        change[full] = np.inf
        best = top - int(np.argmin(change[::-1]))
        return best if change[best] < np.inf else None

    def finish(self) -> Iterator[list]:
        """Those still open are cut and joined, the rest fills powers of two."""
        left = [piece for level in range(self.capacity, 0, -1) for bin_ in self.open[level] for piece in bin_]
        room, bin_ = self._target(sum(p[2] for p in left)), []
        total = sum(p[2] for p in left)
        for owner, start, size in left:
            while size:
                cut = min(size, room)
                bin_.append((owner, start, cut))
                start, size, room, total = start + cut, size - cut, room - cut, total - cut
                if not room:
                    yield bin_
                    room, bin_ = self._target(total), []

    def _target(self, total: int) -> int:
        return self.capacity if total >= self.capacity else (1 << total.bit_length() - 1 if total else 0)


def pack(docs: DataFrame, tokenizer_path: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0, text: str = "text", key: str = "doc_id", level_limit: int = LEVEL_LIMIT) -> DataFrame:
    """One row for each piece: ``SCHEMA``; ``sequence_id`` and ``offset`` say where it lies.

    A document is its ids and then ``end_id``.  Null and empty texts are the end id alone; repeated
    rows are packed each; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    if level_limit < 1:
        raise ValueError("a level holds at least one sequence")

    def run(batches):
        encode = tokenizer(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 40
        packer = SumOfSquares(capacity, level_limit)
        out: dict[str, list] = {n: [] for n in COLUMNS}

        def place(bin_, sequence):
            offset = 0
            for (k, n, whole, tail, ids), start, length in bin_:
                if start < whole:  # a whole sequence of its own, filled while the ids are at hand
                    crc = zlib.crc32(ids[0][4 * start : 4 * (start + length)])
                else:
                    crc = zlib.crc32(tail[4 * (start - whole) : 4 * (start - whole + length)])
                for values, x in zip(out.values(), (k, start, length, crc, n, sequence, offset)):
                    values.append(x)
                offset += length

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [encode(t or "") + end]
                n = len(ids[0]) // 4
                whole = n - n % capacity
                for bin_ in packer.add((k, n, whole, ids[0][4 * whole :], ids), n):
                    place(bin_, number)
                    number += 1
                    if len(out["doc_id"]) >= 10_000:
                        yield _batch(out)
                        out.update({n: [] for n in COLUMNS})
                ids.clear()  # only the tails of open sequences stay
        for bin_ in packer.finish():
            place(bin_, number)
            number += 1
        if out["doc_id"]:
            yield _batch(out)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))
