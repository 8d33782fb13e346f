"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces; any passage within the budget
holds one piece unchanged.  One Aho-Corasick automaton finds all pieces in a text, and Myers'
bit-parallel distance verifies each candidate place.  Items too short for an edit must stand as whole
words.  Items go to the tasks in blocks of bounded size, one block after the other.
"""

from __future__ import annotations

import re

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_rows, cut_lineage, unused

BUDGET = 0.05
#: Characters of test items that one automaton holds; more items make more passes over the documents.
BLOCK_CHARS = 8_000_000
#: Normalised characters of an item from which on finding it makes a document contaminated: a word or two
#: are found, but stand in clean documents too.
MIN_CHARS = 20

_gap = re.compile(r"[\W_]+").sub


def normalise(text: str | None) -> str:
    """Lower-case letters and digits, runs of anything else as one blank."""
    return _gap(" ", (text or "").lower()).strip()


def pieces(item: str, budget: float) -> tuple[int, list[tuple[int, str]]]:
    """The number of edits allowed, and one more pieces than that with their offsets."""
    k = min(int(len(item) * budget), len(item) - 1)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to a substring of ``text`` and where that ends; None if over ``k``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = None
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = score, i + 1
    return best


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """All items of one block: pieces in an automaton, bit masks for the distances."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = normalise(text)
            if not item:
                continue
            k, parts = pieces(item, budget)
            at = len(self.items)
            self.items.append((key, item, k, bits(item), bits(item[::-1])))
            for offset, piece in parts:
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """For each item found: (edits, start, end, places), of the best place, in normalised characters."""
        if not self.items:
            return {}
        best: dict[int, tuple[int, int, int, int]] = {}
        tried: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for at, offset in places:
                _, item, k, mask, back = self.items[at]
                start = end + 1 - size - offset
                if not k:
                    if start and text[start - 1] != " " or end + 1 < len(text) and text[end + 1] != " ":
                        continue
                    old = best.get(at)
                    best[at] = (0, start, end + 1, 1) if old is None else (*old[:3], old[3] + 1)
                    continue
                near = tried.get(at)
                # a window reaches 3k beyond the item on both sides: what a start within k could find is inside
                if near is not None and any(abs(start - x) <= k for x in near[-4:]):
                    continue
                tried.setdefault(at, []).append(start)
                lo = max(0, start - 3 * k)
                got = myers(mask, len(item), text[lo : start + len(item) + 3 * k], k)
                if got is None:
                    continue
                stop = lo + got[1]
                first = myers(back, len(item), text[max(0, stop - len(item) - k) : stop][::-1], got[0])
                begin = stop - (first[1] if first else len(item))
                old = best.get(at)
                count = old[3] + (begin >= old[2] or stop <= old[1]) if old else 1
                best[at] = (got[0], begin, stop, count) if old is None or got[0] < old[0] else (*old[:3], count)
        return best


MATCHES = "doc_id long, item_id long, edits int, item_chars int, match_start int, match_end int, places int"


def contamination(docs: DataFrame, items: DataFrame, budget: float = BUDGET, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and test item found in it within ``budget`` x its length edits.

    ``places`` counts places of an item that do not overlap the best one.  Null and empty texts or items
    match nothing; items of one text match each; repeated rows give repeated matches; null ids stay null;
    an empty table on either side gives no rows; other columns are ignored.  Items of over
    ``block_chars`` characters in all are dealt to blocks by hash; each block's matches are written
    to the shared folder before the next block is read, so one block is in memory at a time.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    named = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    total = named.agg(F.sum(F.length("t").cast("long"))).first()[0]
    if not total:
        return source.sparkSession.createDataFrame([], MATCHES)
    blocks = -(-total // block_chars)
    if blocks == 1:
        return _pass(source, [(r.k, r.t) for r in named.collect()], budget)[0]
    out = None
    for block in range(2 * blocks):  # half full on the average: by hash they are not even
        held = [(r.k, r.t) for r in named.where(F.pmod(F.xxhash64("k", "t"), F.lit(2 * blocks)) == block).collect()]
        if held:
            found, sent = _pass(source, held, budget)
            found = cut_lineage(found)
            sent.destroy()
            out = found if out is None else out.union(found)
    return out


def _pass(source: DataFrame, block: list[tuple[int, str]], budget: float) -> tuple[DataFrame, Broadcast]:
    """Matches of the items of one block, and the broadcast that holds these."""
    sent = source.sparkSession.sparkContext.broadcast(block)
    built: list[Matcher] = []

    def rows(keys, texts):
        if not built:
            built.append(Matcher(sent.value, budget))
        matcher = built[0]
        out: dict[str, list] = {n.split()[0]: [] for n in MATCHES.split(", ")}
        for key, text in zip(keys, texts):
            for at, (edits, begin, stop, count) in matcher.matches(normalise(text)).items():
                for name, value in zip(out, (key, matcher.items[at][0], edits, len(matcher.items[at][1]), begin, stop, count)):
                    out[name].append(value)
        yield out

    return arrow_rows(source, rows, MATCHES), sent


def clean(docs: DataFrame, items: DataFrame, budget: float = BUDGET, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a test item of ``min_chars`` normalised characters or more.

    A document with a null id or text stays; rows that share an id go together; an empty table on
    either side leaves ``docs`` as they are, and so does every column.
    """
    leaked = cut_lineage(contamination(docs, items, budget).where(F.col("item_chars") >= min_chars).select("doc_id").where("doc_id IS NOT NULL").distinct())
    name = unused(docs, "__leaked")
    return docs.join(leaked.toDF(name), F.col("doc_id") == F.col(name), "left_anti")
