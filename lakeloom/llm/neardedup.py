"""Near-duplicate stage: SimHash links, and an exact set-similarity join for what they miss, over five-word shingles.

Documents with the same set of five-word shingles are one class.  Fingerprints of the sets, linked by
their Golay keys (``simhash``), give the first candidates.  A similarity of 0.8 moves about ten of 64
bits, which no three-bit search finds, so a prefix filter completes them: all sets are read in one
global order of shingles; two sets of Jaccard similarity t or more share one of the first
``size - ceil(t * size) + 1`` shingles of each, so every such pair meets at a shingle, whatever the
order.  Rare shingles come first, as a sample of documents tells them, which keeps the meetings few;
the exact sets decide on every candidate.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm import simhash
from lakeloom.llm.common import among, arrow_rows, connected_components, cut_lineage, remainder, unused

WORDS, SIMILARITY = 5, 0.8
#: Bytes of text whose shingles are worked on together (a longer text is alone).
SLICE = 1 << 20
#: One document of so many, by its id, tells which shingles are common, from ``OFTEN`` of those documents on; at most
#: ``COMMON`` shingles are sent to the tasks.  They bear on the order of shingles only: pairs are found under any order.
SAMPLE, OFTEN, COMMON = 16, 4, 500_000


def shingle_set(tokens: list[bytes], n: int) -> np.ndarray:
    return np.unique(simhash.hashes(tokens, n))


def common_shingles(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many documents of the sample hold, and in how many each is."""

    def rows(keys, texts):
        sets = [shingle_set(simhash.words(t), words) for t in texts]
        values, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), return_counts=True)
        yield {"shingle": values.view(np.int64), "n": n}

    counted = arrow_rows(source.where(remainder("doc_id", SAMPLE) == 0), rows, "shingle long, n long", give_back=True).groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    shingles = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["n"].to_numpy(np.int64)[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the global order: common ones last, by their number, then by hash."""
    size = len(shingles)
    if not size:
        return shingles
    keep = size - int(np.ceil(similarity * size - 1e-9)) + 1
    values, n = common
    often = np.zeros(size, dtype=np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        often = np.where(values[at] == shingles, n[at], 0)
    return shingles[np.lexsort((shingles, often))[:keep]]


def _can_link(size_a: Column, at_a: Column, size_b: Column, at_b: Column, similarity: float) -> Column:
    """Whether sets whose first common shingle has these places can be similar: only what follows is shared.

    A pair of enough similarity holds this at its first common shingle, so it may be asked of each.
    """
    return F.least(size_a - at_a, size_b - at_b) >= F.lit(similarity / (1 + similarity) - 1e-9) * (size_a + size_b)


def histogram(shingles: np.ndarray) -> np.ndarray | None:
    """Shingles of a set by their first byte; None where a number is over 127, which says nothing of a pair."""
    n = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256)
    return n.astype(np.int8) if n.max() < 128 else None


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows ``(doc_id, component_id)`` for every document with an id; a component's id is its smallest.

    Null and empty texts are copies of each other; rows that share an id share a component; documents
    without an id are left out; an empty table gives no rows; other columns are ignored.  Of the
    documents that meet at a shingle all are first held against the smallest; then all pairs that no
    component joins yet, so large groups cost few pairs.
    """
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = source.sparkSession.sparkContext.broadcast(common_shingles(source, words))

    def features(keys, texts):
        out: dict[str, list] = {"doc_id": keys, "k1": [], "k2": [], "size": [], "fp": [], "prefix": [], "parts": []}
        for t in texts:
            found = shingle_set(simhash.words(t), words)
            mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            out["k1"].append(int.from_bytes(mark[:8], signed=True))
            out["k2"].append(int.from_bytes(mark[8:], signed=True))
            out["size"].append(len(found))
            out["fp"].append(simhash.signed(simhash.fingerprint(found)))
            out["parts"].append(histogram(found))
            out["prefix"].append(prefix(found, sent.value, similarity).view(np.int64))
        yield out

    def sets(keys, texts):
        yield {"doc_id": keys, "shingles": [shingle_set(simhash.words(t), words).view(np.int64) for t in texts]}

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        # histograms bound the overlap, so few sets are built for pairs that are not similar
        held = among(marked.select("doc_id", "size", "parts"), "doc_id", ends(pairs))
        one, two = held.toDF("a", "size_a", "pa"), held.toDF("b", "size_b", "pb")
        overlap = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda n, x: n + x)
        enough = overlap >= F.lit(similarity / (1 + similarity) - 1e-9) * (F.col("size_a") + F.col("size_b"))
        pairs = cut_lineage(pairs.join(one, "a").join(two, "b").where(F.coalesce(enough, F.lit(True))).select("a", "b").distinct())
        ids = ends(pairs)
        texts = among(source, "doc_id", ids).join(ids, "doc_id").dropDuplicates(["doc_id"])  # a semi join would go before the filter
        held = cut_lineage(arrow_rows(texts, sets, "doc_id long, shingles array<long>", SLICE, give_back=True))
        left, right = held.toDF("a", "sa"), held.toDF("b", "sb")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("all"))
        return cut_lineage(both.where(F.col("both") >= F.lit(similarity) * (F.col("all") - F.col("both"))).select("a", "b"))

    marked = cut_lineage(arrow_rows(source, features, "doc_id long, k1 long, k2 long, size int, fp long, prefix array<long>, parts array<byte>", SLICE, give_back=True))
    exact = cut_lineage(marked.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")))
    # fingerprints: the classes of one, and of each the nearest smaller one
    prints = cut_lineage(exact.groupBy("fp").agg(F.min("rep").alias("rep")))
    same = exact.select("fp", F.col("rep").alias("b")).join(prints, "fp").where("rep <> b").select(F.col("rep").alias("a"), "b")
    marks = same.union(simhash.nearest_links(prints.withColumn("component", F.col("rep"))))
    met = Window.partitionBy("shingle")
    posts = exact.select("rep", "size", F.posexplode("prefix").alias("at", "shingle"))
    posts = posts.withColumn("n", F.count("*").over(met)).withColumn("first", F.min(F.struct("rep", "size", "at")).over(met)).where("n > 1")
    posts = cut_lineage(posts.drop("n"))
    stars = posts.where((F.col("rep") != F.col("first.rep")) & _can_link(F.col("size"), F.col("at"), F.col("first.size"), F.col("first.at"), similarity))
    links = verified(cut_lineage(stars.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).union(marks).distinct()))
    component = connected_components(links).withColumnRenamed("v", "rep")
    # one row for each shingle and component tells whether any pair is left to compare there
    grouped = posts.select("shingle", "rep", "size", "at").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = grouped.withColumn("lo", F.min("component").over(met)).withColumn("hi", F.max("component").over(met)).where("lo < hi")
    open_ = cut_lineage(open_.select("shingle", "rep", "size", "at", "component"))
    x, y = open_.alias("x"), open_.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y, apart & _can_link(F.col("x.size"), F.col("x.at"), F.col("y.size"), F.col("y.at"), similarity))
    rest = cut_lineage(rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    if not rest.isEmpty():
        more = verified(rest)
        if not more.isEmpty():
            component = connected_components(links.union(more)).withColumnRenamed("v", "rep")
    top = exact.join(component, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    return marked.select("doc_id", "k1", "k2").join(top, ["k1", "k2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; documents with a null id stay.

    Repeated rows of one id stay or go together; an empty table stays empty; every column is as it was.
    """
    gone = cut_lineage(classes(docs, words, similarity).where("component_id <> doc_id").select("doc_id").distinct())
    name = unused(docs, "__gone")
    return docs.join(gone.toDF(name), F.col("doc_id") == F.col(name), "left_anti")
