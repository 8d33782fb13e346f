"""Language identification with interpolated Kneser-Ney character models.

Character 4-grams of all training rows are counted in numpy and summed by Spark.  The summed counts
give one table for each order, stored as arrays sorted by a 64-bit hash, with the probabilities of
all languages side by side.  A text gets the language of lowest length-normalised cross-entropy.

Rejection is calibrated on a fold of the training documents that a first model does not count: how far
their entropies lie over the middle of their language, and how far they would lie if their own
language had not been learned, give the limit of each language.

Up to ``broadcast_rows`` rows of counts the tables are arrays that go to every task.  Beyond that the
same numbers are tables of Spark, and the grams of the texts are joined to them; both ways give the
same entropies.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut_lineage, giving_back, remainder, slices

ORDER = 4
#: One training document of so many calibrates the rejection.
CALIBRATION = 8
#: Share of a language's own documents that are kept, and of those of a language not learned that are rejected.
KEPT, REJECTED = 0.999, 0.99
#: Rows ``(language, 4-gram)`` that may come to the driver and be sent to the tasks, about 100 bytes each.
BROADCAST_ROWS = 4_000_000
#: Sharpness of ``score``: softmax of the negative entropies (nats a character) times this.
SHARPNESS = 8.0
UNKNOWN = "und"
#: Characters of text that are worked on together (a longer text is alone).
SLICE = 1 << 18

_fold: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Code point -> 16-bit class: letters lower-cased, anything else a blank (32)."""
    if not _fold:
        table = np.full(0x110000, 32, dtype=np.uint16)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low if low < 0x10000 else 0xE000 + low % 0x1800
        _fold.append(table)
    return _fold[0]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of all texts, the text of each key, and the number of letters of each text.

    A text reads as a blank and its letters, runs of anything else being one blank; a key
    belongs to each character after the first blank.
    """
    raw = np.frombuffer("\n".join(["", *[t or "" for t in texts], ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t or "") for t in texts])
    kind = _classes()[raw]
    ends = np.cumsum(sizes + 1)  # position of the line end after each text
    doc = np.concatenate([np.repeat(np.arange(len(texts)), sizes + 1), [len(texts)]])
    letters = np.bincount(doc[:-1], weights=(kind != 32)[:-1], minlength=len(texts)).astype(np.int64)
    keep = kind != 32
    keep[1:] |= kind[:-1] != 32  # the first blank after a letter
    keep[0] = True
    keep[ends] = True
    # a text's opening blank stays, so blanks at its start add nothing and one at its end merges
    kind, doc = kind[keep].astype(np.uint64), doc[keep]
    gram = kind.copy()
    for back in range(1, ORDER):
        before = np.full(len(kind), 32, dtype=np.uint64)
        before[back:] = np.where(doc[back:] == doc[:-back], kind[:-back], 32)
        gram |= before << np.uint64(16 * back)
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    use = ~first & (doc < len(texts))
    return gram[use], doc[use], letters


#: Distinct grams of one language that a task holds before it passes them on.
HELD_GRAMS = 200_000


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows ``(lang, calibrates, gram, n)`` over all rows with a language, apart for the calibrating fold.

    Slices of bounded size are counted and added up in their task, so long texts and hot languages
    send no more rows than there are grams.
    """
    schema = pa.schema([("lang", pa.string()), ("calibrates", pa.bool_()), ("gram", pa.int64()), ("n", pa.int64())])

    def batch(name, counted):
        values, n = counted
        return pa.RecordBatch.from_arrays([pa.array([name[0]] * len(values), pa.string()), pa.array([name[1]] * len(values), pa.bool_()), pa.array(values.view(np.int64)), pa.array(n)], schema=schema)

    def run(batches):
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            names, texts = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), b.column(2).to_pylist()
            for lo, hi in slices([texts], len(texts), SLICE):
                for name in set(names[lo:hi]):
                    gram, _, _ = encode([t for t, x in zip(texts[lo:hi], names[lo:hi]) if x == name])
                    new = np.unique(gram, return_counts=True)
                    held[name] = _added([held[name], new]) if name in held else new
                    if len(held[name][0]) > HELD_GRAMS:
                        yield batch(name, held.pop(name))
        for name, counted in held.items():
            yield batch(name, counted)

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _calibrates(text).alias("calibrates"), F.col(text).cast("string").alias("text"))
    part = rows.mapInArrow(giving_back(run), "lang string, calibrates boolean, gram long, n long")
    return part.groupBy("lang", "calibrates", "gram").agg(F.sum("n").alias("n"))


def _calibrates(text: str):
    """Whether a text calibrates; copies of a text do together."""
    return F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(CALIBRATION)) == 0


def _mix(key: np.ndarray) -> np.ndarray:
    x = key ^ key >> np.uint64(31)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class HashTable:
    """Hashes in sorted order with a row of values for each; an index of their leading bits finds the place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = _mix(keys)
        order = np.argsort(h, kind="stable")
        self.hash, self.values = h[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(4, int(2 * len(h)).bit_length()))
        starts = np.arange((1 << int(64 - int(self.shift))), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(self.hash, starts).astype(np.int32)
        self.hash = np.concatenate([self.hash, np.full(1, 2**64 - 1, dtype=np.uint64)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        h = _mix(keys)
        at = self.start[(h >> self.shift).astype(np.int64)].astype(np.int64)
        seen = self.hash[at]
        row = np.where(seen == h, at, -1)
        todo = np.flatnonzero(seen < h)
        while len(todo):
            at[todo] += 1
            seen = self.hash[at[todo]]
            hit = seen == h[todo]
            row[todo[hit]] = at[todo[hit]]
            todo = todo[seen < h[todo]]
        row[row == len(self.values)] = -1
        return row


class Model:
    """Interpolated Kneser-Ney over ``ORDER`` characters, for all languages at once."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        width = len(langs)
        keys, at = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(keys), width))
        np.add.at(counts, (at, lang), n)
        tables = [(keys, counts)]
        for _ in range(ORDER - 1):  # continuation counts: distinct characters before each shorter gram
            longer, c = tables[-1]
            short = longer & np.uint64((1 << 16 * (ORDER - len(tables))) - 1)
            keys, at = np.unique(short, return_inverse=True)
            cont = np.zeros((len(keys), width))
            np.add.at(cont, at, (c > 0).astype(float))
            tables.append((keys, cont))
        self.tables: list[HashTable] = []  # orders 1..ORDER, log probabilities
        self.weights: list[HashTable] = []  # of contexts of 1..ORDER-1 characters, log weight of the shorter order
        alphabet = len(tables[-1][0]) + 1
        self.floor = -np.log(alphabet)
        for order in range(1, ORDER + 1):
            keys, c = tables[ORDER - order]
            ones, twos = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
            discount = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
            context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
            np.add.at(total, at, c)
            np.add.at(kinds, at, (c > 0).astype(float))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if order == 1:
                lower = np.full((len(keys), width), 1 / alphabet)
                self.root = np.log(np.maximum(back[0], 1e-12))
            else:
                lower = np.exp(self.logp(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1).astype(float))
            p = np.where(total[at] > 0, np.maximum(c - discount, 0) / np.maximum(total[at], 1), 0) + back[at] * lower
            if order > 1:
                self.weights.append(HashTable(context, np.log(back)))
            self.tables.append(HashTable(keys, np.log(p)))
        grams, c = tables[0]
        logp = self.logp(grams, ORDER).astype(float)
        mass = np.maximum(c.sum(axis=0), 1)
        mean = -(c * logp).sum(axis=0) / mass
        self.limits = Limits.loose(mean, np.sqrt(np.maximum((c * logp**2).sum(axis=0) / mass - mean**2, 0)))

    def logp(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probability in each language of the last character of each gram."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), self.floor, dtype=np.float32)
        row = self.tables[order - 1].find(keys)
        out = self.tables[order - 1].values[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            rest = keys[miss]
            lower = self.logp(rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            if order > 1:
                context = self.weights[order - 2].find(rest >> np.uint64(16))
                lower = lower + np.where((context >= 0)[:, None], self.weights[order - 2].values[context], 0)
            else:
                lower = lower + self.root.astype(np.float32)
            out[miss] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character in each language, characters and letters of each text."""
        gram, doc, letters = encode(texts)
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, (1 << 19) // max(1, len(self.langs)))
        for lo in range(0, len(gram), step):
            part = doc[lo : lo + step]
            logp = self.logp(gram[lo : lo + step], ORDER)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total[part[starts]] += np.add.reduceat(logp, starts, axis=0, dtype=np.float64)
        n = np.bincount(doc, minlength=len(texts))
        return -total / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, its cross-entropy and rejection of each text."""
        return decide(self.langs, self.limits, *self.entropies(texts))


@dataclass
class Limits:
    """What a language's entropies are like: their middle, the spread of documents and of characters, and the largest score that is accepted."""

    centre: np.ndarray
    document: np.ndarray
    character: np.ndarray
    most: np.ndarray

    @staticmethod
    def loose(mean: np.ndarray, spread: np.ndarray) -> "Limits":
        """Without documents to calibrate on: nothing with a letter is rejected."""
        return Limits(mean, np.full(len(mean), 0.1), spread, np.full(len(mean), np.inf))

    def score(self, lang, entropy, n):
        """Standard deviations that an entropy over ``n`` characters lies over the middle."""
        return (entropy - self.centre[lang]) / np.sqrt(self.document[lang] ** 2 + self.character[lang] ** 2 / np.maximum(n, 1))


def decide(langs: list[str], limits: Limits, h: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, its cross-entropy and rejection of texts of entropies ``h`` over ``n`` characters."""
    best = h.argmin(axis=1)
    entropy = h.min(axis=1)
    odds = np.exp(-SHARPNESS * (h - entropy[:, None]))
    unknown = letters == 0
    names = [UNKNOWN if u else langs[b] for u, b in zip(unknown, best)]
    return names, np.where(unknown, 0.0, 1 / odds.sum(axis=1)), entropy, unknown | (limits.score(best, entropy, n) > limits.most[best])


#: Nats of one bin of the calibrating entropies.
BIN = 0.01


def _quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(sums, share * sums[-1] - 1e-9), len(values) - 1)])


def calibrate(langs: list[str], loose: Limits, rows: list) -> Limits:
    """Limits from rows ``(lang, own, size, bin, n)``: how many calibrating texts of about 2^(size / 2) characters have which entropy.

    ``own`` rows are of the texts of a language; the others are of texts whose nearest language it is
    once their own is left out.  A language's limit keeps ``KEPT`` of its own, and is as wide as
    ``REJECTED`` of the others allow.  A language without calibrating texts gets the widest limit of any.
    """
    out = Limits(loose.centre.copy(), loose.document.copy(), loose.character, loose.most.copy())
    table = np.array([[r.lang, r.own, 2 ** ((r.size + 0.5) / 2), (r.bin + 0.5) * BIN, r.n] for r in rows]).reshape(-1, 5)
    alone = []
    for lang in range(len(langs)):
        own, other = (table[(table[:, 0] == lang) & (table[:, 1] == x)] for x in (1, 0))
        if not len(own):
            alone.append(lang)
            continue
        long_ = own[own[:, 2] >= 256] if (own[:, 2] >= 256).any() else own
        out.centre[lang] = _quantile(long_[:, 3], long_[:, 4], 0.5)
        out.document[lang] = max(0.02, 1.4826 * _quantile(np.abs(long_[:, 3] - out.centre[lang]), long_[:, 4], 0.5))
        inside = _quantile(out.score(lang, own[:, 3], own[:, 2]), own[:, 4], KEPT)
        outside = _quantile(out.score(lang, other[:, 3], other[:, 2]), other[:, 4], 1 - REJECTED) if len(other) else 2 * inside
        out.most[lang] = max(inside, outside, 3.0)
    if len(alone) < len(langs):
        known = [x for x in range(len(langs)) if x not in alone]
        out.document[alone], out.most[alone] = out.document[known].max(), out.most[known].max()
    return out


def _binned(lang: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows ``(lang, own, size, bin)`` of texts of entropies ``h`` over ``n`` characters: in their own language, and in the nearest other one."""
    size = np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.int32)
    at = np.arange(len(lang))
    left = h.copy()
    left[at, lang] = np.inf
    near = left.argmin(axis=1)
    parts = [(lang, 1, h[at, lang]), *([(near, 0, left[at, near])] if h.shape[1] > 1 else [])]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.asarray(x, dtype=np.int32) for x, _, _ in parts])), pa.array(np.repeat([o for _, o, _ in parts], len(lang)).astype(np.int32)), pa.array(np.tile(size, len(parts))), pa.array(np.floor(np.concatenate([e for _, _, e in parts]) / BIN).astype(np.int32))],
        names=["lang", "own", "size", "bin"],
    )


BINNED = "lang int, own int, size int, bin int"


def _calibration(binned: DataFrame) -> list:
    """Rows for ``calibrate`` from those of ``_binned``; a few thousand for each language at most."""
    return binned.groupBy("lang", "own", "size", "bin").agg(F.count("*").alias("n")).collect()


class StoredModel:
    """The same model as tables of Spark, for more grams than may be sent to the tasks.

    ``probabilities[k]`` and ``weights[k]`` hold for each k-gram, or context of one, a map from
    languages to logarithms.  Absent grams take the weight of their context and the shorter gram, as in ``Model``.
    """

    def __init__(self, langs: list[str], counted: DataFrame):
        self.langs = langs
        per_order = {ORDER: counted.groupBy("lang", "gram").agg(F.sum("n").alias("c"))}
        for order in range(ORDER, 1, -1):
            per_order[order - 1] = per_order[order].groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1).alias("gram")).agg(F.count("*").alias("c"))
        per_order = {order: cut_lineage(c) for order, c in per_order.items()}
        alphabet = per_order[1].select("gram").distinct().count() + 1
        self.floor = -np.log(alphabet)
        self.probabilities: dict[int, DataFrame] = {}
        self.weights: dict[int, DataFrame] = {}
        lower = None
        for order in range(1, ORDER + 1):
            c = per_order[order].withColumn("context", F.shiftrightunsigned("gram", 16))
            kinds = c.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos"))
            share = F.when(F.col("ones") + F.col("twos") > 0, F.col("ones") / F.greatest(F.col("ones") + 2 * F.col("twos"), F.lit(1))).otherwise(0.5)
            # one row for each language
            discount = F.broadcast(kinds.select("lang", F.least(F.greatest(share, F.lit(0.1)), F.lit(0.95)).alias("discount")))
            contexts = c.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(discount, "lang")
            contexts = cut_lineage(contexts.select("lang", "context", "total", "discount", (F.col("discount") * F.col("kinds") / F.col("total")).alias("back")))
            p = c.join(contexts, ["lang", "context"])
            if order == 1:
                root = {r.lang: r.back for r in contexts.select("lang", "back").collect()}
                self.root = np.array([np.log(max(root.get(x, 1.0), 1e-12)) for x in range(len(langs))])
                p = p.withColumn("lower", F.lit(1 / alphabet))
            else:
                p = p.withColumn("suffix", F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
                self.weights[order] = cut_lineage(contexts.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.log("back")))).alias(f"w{order}")))
            lower = cut_lineage(p.select("lang", "gram", (F.greatest(F.col("c") - F.col("discount"), F.lit(0)) / F.col("total") + F.col("back") * F.col("lower")).alias("p")))
            self.probabilities[order] = cut_lineage(lower.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.log("p")))).alias(f"p{order}")))
        self.limits = Limits.loose(*self._moments(per_order[ORDER]))

    def logps(self, grams: DataFrame) -> DataFrame:
        """Rows ``(gram, logp)`` of distinct ``grams(gram)``: log probability in each language."""
        out = grams
        for order in range(ORDER, 0, -1):
            out = out.withColumn("k", F.col("gram").bitwiseAND((1 << 16 * order) - 1) if order < 4 else F.col("gram"))
            out = out.join(self.probabilities[order].withColumnRenamed("gram", "k"), "k", "left")
            if order > 1:
                out = out.withColumn("context", F.shiftrightunsigned("k", 16)).join(self.weights[order], "context", "left").drop("context")
        root = F.array(*[F.lit(float(x + self.floor)) for x in self.root])

        def value(lang):
            got = F.coalesce(F.try_element_at("p1", lang), F.element_at(root, lang + 1))
            for order in range(2, ORDER + 1):
                got = F.coalesce(F.try_element_at(f"p{order}", lang), F.coalesce(F.try_element_at(f"w{order}", lang), F.lit(0.0)) + got)
            return got

        return out.select("gram", F.transform(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)), value).alias("logp"))

    def _moments(self, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = counts.join(self.logps(counts.select("gram").distinct()), "gram").withColumn("x", F.element_at("logp", F.col("lang") + 1))
        found = {r.lang: r for r in rows.groupBy("lang").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("s"), F.sum(F.col("c") * F.col("x") ** 2).alias("q")).collect()}
        mean = np.array([-found[x].s / found[x].n if x in found else 0.0 for x in range(len(self.langs))])
        square = np.array([found[x].q / found[x].n if x in found else 0.0 for x in range(len(self.langs))])
        return mean, np.sqrt(np.maximum(square - mean**2, 0))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """Rows ``(name, h)`` of the distinct texts of ``texts(text)``; ``name`` is the MD5 digest, null for texts without grams."""

        def run(batches):
            for b in batches:
                values = b.column(0).to_pylist()
                for lo, hi in slices([values], len(values), SLICE):
                    gram, doc, _ = encode(values[lo:hi])
                    order = np.lexsort((gram, doc))
                    gram, doc = gram[order], doc[order]
                    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]))
                    n = np.diff(np.append(first, len(gram)))
                    names = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in values[lo:hi]]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in doc[first]], pa.binary()), pa.array(gram[first].view(np.int64)), pa.array(n)], names=["name", "gram", "n"])

        found = cut_lineage(texts.select(F.col("text").cast("string")).distinct().mapInArrow(run, "name binary, gram long, n long"))
        # a frequent gram is one key of many rows; the other side has one row of it, so a skewed join splits it
        each = found.join(self.logps(found.select("gram").distinct()), "gram")
        sums = [F.sum(F.col("n") * F.get("logp", F.lit(i))) for i in range(len(self.langs))]
        return each.groupBy("name").agg(F.sum("n").alias("size"), F.array(*sums).alias("sums")).select("name", "size", F.transform("sums", lambda x: -x / F.col("size")).alias("h"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", broadcast_rows: int = BROADCAST_ROWS) -> Model | StoredModel | None:
    """Model of all rows with a language, its rejection calibrated; None where there are none.

    Counts of more than ``broadcast_rows`` rows stay in Spark, and the model is a ``StoredModel``.  Null
    texts count as empty; every row counts, repeated ones each time.
    """
    named = cut_lineage(count_grams(docs, text, lang))
    langs = sorted(r.lang for r in named.select("lang").distinct().collect())
    if not langs:
        return None
    # short codes instead of names
    place = F.element_at(F.create_map(*[F.lit(v) for i, x in enumerate(langs) for v in (x, i)]), F.col("lang")).cast("int")
    counted = named.select(place.alias("lang"), "calibrates", "gram", "n")
    rest = docs.where(F.col(lang).isNotNull() & _calibrates(text)).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).select(place.alias("lang"), "text")
    sent = None
    if named.count() > broadcast_rows:
        first = StoredModel(langs, part if not (part := counted.where("NOT calibrates")).isEmpty() else counted)
        name = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
        scored = rest.withColumn("name", name).join(first.entropies(rest), "name").select("lang", "h", F.col("size").alias("n"))

        def run(batches):
            for b in batches:
                h = np.array(b.column(1).to_pylist(), dtype=float).reshape(b.num_rows, len(langs))
                yield _binned(b.column(0).to_numpy(zero_copy_only=False), h, b.column(2).to_numpy(zero_copy_only=False))

        binned = scored.mapInArrow(run, BINNED)
        model = StoredModel(langs, counted)
    else:
        grams = counted.toArrow()
        code, held, gram, n = (grams.column(i).to_numpy() for i in range(4))
        gram = gram.view(np.uint64)
        kept = ~held if not held.all() else held  # with calibrating documents alone they are both
        first = Model(langs, code[kept], gram[kept], n[kept])
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            for b in batches:
                codes, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
                for lo, hi in slices([texts], len(texts), SLICE):
                    h, size, _ = sent.value.entropies(texts[lo:hi])
                    use = np.flatnonzero(size > 0)
                    yield _binned(codes[lo:hi][use], h[use], size[use])

        binned = rest.mapInArrow(giving_back(run), BINNED)  # one Python worker a task: a second one in a row would hold memory of its own
        model = Model(langs, code, gram, n)
    model.limits = calibrate(langs, model.limits, _calibration(binned))
    if sent is not None:
        sent.destroy()  # the tasks hold one model at a time
    return model


def identify(docs: DataFrame, model: Model | StoredModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score``, ``cross_entropy`` and ``rejected`` (replacing columns of these names).

    Null and letterless texts are ``und``, score 0, rejected.  Without a model every text is ``und``.
    Ties go to the first language by name; repeated rows stay; an empty table stays empty.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    new = ["lang_pred", "lang_score", "cross_entropy", "rejected"]
    kept = docs.drop(*new)
    fields = [*kept.schema.fields, StructField(new[0], StringType()), StructField(new[1], DoubleType()), StructField(new[2], DoubleType()), StructField(new[3], BooleanType())]
    place, width, stored = kept.columns.index(text), len(kept.columns), isinstance(model, StoredModel)
    rows = kept
    if stored:
        langs, limits = model.langs, model.limits
        name, h = (next(x for x in (c + "_" * i for i in range(99)) if x not in kept.columns) for c in ("__name", "__h"))
        found = model.entropies(kept.select(F.col(f"`{text}`").alias("text"))).select(F.col("name").alias(name), F.col("h").alias(h))
        rows = kept.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))).join(found, name, "left").drop(name)
        rows = rows.select(*[F.col(f"`{c}`") for c in kept.columns], h)
    else:
        sent = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            parts = [[], [], [], []]
            for lo, hi in slices([texts], len(texts), SLICE):
                if stored:
                    gram, doc, letters = encode(texts[lo:hi])
                    entropies = [x if x is not None else [0.0] * len(langs) for x in batch.column(width).slice(lo, hi - lo).to_pylist()]
                    got = decide(langs, limits, np.array(entropies, dtype=float), np.bincount(doc, minlength=hi - lo), letters)
                elif sent.value is None:
                    got = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo), np.ones(hi - lo, dtype=bool)
                else:
                    got = sent.value.predict(texts[lo:hi])
                for p, g in zip(parts, got):
                    p.extend(g)
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [*batch.columns[:width], *[pa.array(p, t) for p, t in zip(parts, types)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:width], *new])

    return rows.mapInArrow(giving_back(run), StructType(fields))


def language_id(docs: DataFrame, folds: int = 3, held: int = 1, text: str = "text", lang: str = "lang", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score, cross_entropy, rejected)`` for every document.

    Rows whose crc32 of the id is ``held`` modulo ``folds`` are held out of training.  A null or
    letterless text is ``und``; a null id counts as the empty text in the fold; a null language is not
    learned from; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    source = source.withColumn("held_out", remainder("doc_id", folds) == held)
    model = train(source.where(~F.col("held_out")), broadcast_rows=broadcast_rows)
    found = identify(source.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "cross_entropy", "rejected")
