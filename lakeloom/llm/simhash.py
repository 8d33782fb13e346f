"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four blocks of 16 bits.  Three differing bits leave two blocks
untouched, or one, and then each of the others has one differing bit.  Six tables take the first case:
their keys are two whole blocks.  Eight tables take the second: an untouched block, the untouched byte
of another, and a third block, which with seven bits of that byte is decoded to nearby Golay codewords.
So keys have 32 and 36 bits, and a fingerprint has 14 keys of its own and about 40 nearby ones.  Own keys
join nearby keys, and the join itself verifies the distance.  Each link comes out of exactly one table.

Groups are found in rounds: each fingerprint keeps its smallest neighbour, then each group its smallest
neighbouring group, so a dense cluster gives as many rows as it has members, not pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import golay
from lakeloom.llm.common import arrow_rows, connected_components, cut_lineage

SEED = 42
MASK64 = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at bytes 0x09-0x0D and 0x20."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], n: int):
    """n-word shingles joined by spaces, repeats included; fewer words: the whole sequence."""
    if len(tokens) < n:
        return [b" ".join(tokens)] if tokens else []
    return map(b" ".join, zip(*[tokens[i:] for i in range(n)]))


def hashes(tokens: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles(tokens, n), repeat(SEED)), dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; zero without hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, fp)``; the fingerprint as a signed long.  A null text counts as empty (fingerprint 0)."""

    def rows(keys, texts):
        yield {"doc_id": keys, "fp": [signed(fingerprint(hashes(words(t), shingle))) for t in texts]}

    return arrow_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", "text"), rows, "doc_id long, fp long")


#: Pairs of whole blocks, and for each block the two others that give the byte and the Golay vector.
PAIRS = tuple((i, j) for i in range(4) for j in range(i + 1, 4))
OTHERS = tuple(tuple(j for j in range(4) if j != i)[:2] for i in range(4))


def _parts(fp: np.ndarray):
    """The tables of one block and one byte: table, whole block, byte, and the 23-bit vector."""
    blocks = [((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    for i, (j, k) in enumerate(OTHERS):
        for u in range(2):
            byte = blocks[j] >> 8 * u & 0xFF
            yield len(PAIRS) + 2 * i + u, blocks[i], byte, blocks[k] | (byte & 0x7F) << 16


def _keys(groups: DataFrame, near: bool) -> DataFrame:
    """Rows ``(key, fp, rep, component)``: own keys, or all nearby keys, of each distinct fingerprint."""

    def rows(fps, reps, components):
        fp = np.array([x & MASK64 for x in fps], dtype=np.uint64)
        every = np.arange(len(fp))
        at, keys = [], []
        for t, (i, j) in enumerate(PAIRS):
            pair = ((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)) << np.uint64(16) | (fp >> np.uint64(16 * j)) & np.uint64(0xFFFF)
            at.append(every)
            keys.append(t << 48 | pair.astype(np.int64))
        for t, block, byte, vector in _parts(fp):
            head = t << 48 | block << 20 | byte << 12
            if near:
                codes, fresh = golay.nearby(vector, 16)
                i, j = np.nonzero(fresh)
                at.append(i)
                keys.append(head[i] | codes[i, j])
            else:
                at.append(every)
                keys.append(head | golay.decode_table()[vector])
        at = np.concatenate(at)
        yield {"key": np.concatenate(keys)} | {n: np.array(x, dtype=np.int64)[at] for n, x in (("fp", fps), ("rep", reps), ("component", components))}

    return arrow_rows(groups.select("fp", "rep", "component"), rows, "key long, fp long, rep long, component long", slice_bytes=40_000)


def _table(x: str) -> str:
    """SQL for the one table that gives a pair of XOR ``x`` (at most 3 bits)."""
    block = [f"(shiftrightunsigned({x}, {16 * i}) & 65535L)" for i in range(4)]
    pairs = " ".join(f"WHEN {block[i]} = 0 AND {block[j]} = 0 THEN {t}" for t, (i, j) in enumerate(PAIRS))
    single = " ".join(f"WHEN {block[i]} = 0 THEN CASE WHEN {block[j]} & 255L = 0 THEN {len(PAIRS) + 2 * i} ELSE {len(PAIRS) + 2 * i + 1} END" for i, (j, _) in enumerate(OTHERS))
    return f"CASE {pairs} {single} END"


def _met(groups: DataFrame, max_bits: int) -> DataFrame:
    """Own keys joined with nearby keys, distance verified: ``(key, fp_a, a, group_a, fp_b, b, group_b)``."""
    if not 1 <= max_bits <= 3:
        raise ValueError("the pigeonhole holds for 1 to 3 bits")
    own = _keys(groups, near=False).toDF("key", "fp_a", "a", "group_a")
    near = _keys(groups, near=True).toDF("key", "fp_b", "b", "group_b")
    return own.join(near, "key").where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_bits)


def links(groups: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of ``rep`` whose fingerprints differ in ``max_bits`` (at most 3) bits or fewer, each once.

    ``groups(fp, rep)`` has distinct representatives; those of one fingerprint are paired too.
    """
    met = _met(groups.withColumn("component", F.col("rep")), max_bits)
    return met.where(((F.col("fp_a") < F.col("fp_b")) | ((F.col("fp_a") == F.col("fp_b")) & (F.col("a") < F.col("b")))) & F.expr(f"shiftright(key, 48) = ({_table('(fp_a ^ fp_b)')})")).select("a", "b")


def nearest_links(groups: DataFrame, max_bits: int = 3) -> DataFrame:
    """For each group the smallest that has a link to it, if smaller: pairs ``(a, b)`` of ``component``, a < b, b once.

    ``groups(fp, rep, component)``: the representatives of distinct fingerprints and their groups.
    """
    met = _met(groups, max_bits).where("group_a < group_b")
    return met.groupBy(F.col("group_b").alias("b")).agg(F.min("group_a").alias("a")).select("a", "b")


def components(groups: DataFrame, max_bits: int = 3) -> DataFrame:
    """Rows ``(fp, rep, component)``: the smallest ``rep`` reachable over links, for ``groups(fp, rep)`` of distinct fingerprints.

    Rounds of ``nearest_links`` join groups until no two have a link; each halves at least the groups that have one.
    """
    found = cut_lineage(groups.select("fp", "rep", F.col("rep").alias("component")))
    while True:
        merged = connected_components(cut_lineage(nearest_links(found, max_bits)))
        if merged.isEmpty():
            return found
        merged = merged.select(F.col("v").alias("component"), F.col("component").alias("top"))
        found = cut_lineage(found.join(merged, "component", "left").select("fp", "rep", F.coalesce("top", "component").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)`` for every document.

    ``fingerprint``: 16 lowercase hex digits; ``component_id``: smallest document id reachable over
    links of at most ``max_bits`` differing bits, itself included.  Null and empty texts have
    fingerprint zero and link like others; repeated rows stay repeated; a null id keeps a null
    component unless its fingerprint is shared; an empty table gives no rows; other columns are ignored.
    """
    fps = cut_lineage(fingerprints(docs, shingle, text, key))
    groups = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(groups.where("rep IS NOT NULL"), max_bits).select("fp", F.col("component").alias("component_id"))
    return fps.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
