"""Toxicity scores from Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled training rows: words, and stems of inflected words, whose
documents are toxic far more often than chance allows.  Lexicon trie and Levenshtein automaton are
intersected and made deterministic on the fly, so each distinct word is read once, letter by letter,
and dies early.  Around each hit a context window tells quotation from abuse.  A logistic model over
these counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_rows, cut_lineage, remainder
from lakeloom.llm.simhash import hashes, words

#: Bound of the labelled training sample (rows with the smallest hashes of their ids).
TRAIN_ROWS = 8_000
#: Nats over which a gram's toxic rows are beyond the best of many thousand grams by chance.
CHANCE = math.log(2e5) + 2
_SALTS = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
STEM = 4, 9  # shortest and longest stem
WINDOW = 6  # words on each side of a hit
FEATURES = ("plain", "fuzzy", "quoted", "aimed", "density", "direct")
#: Mean (intercept first) and precision of the Gaussian prior of the logistic weights.
PRIOR, PRECISION = np.array([-3.0, 3.0, 1.5, 0.5, 0.5, 0.2, 2.0]), 0.5

_word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_quotes = re.compile(r"[\"“”«»„]")
_report = frozenset("said says say wrote writes called calls quote quoted quotes reported word words term insult insults slur".split())
_aim = frozenset("you your you're youre u ur yourself are such these they them du dein tu vous eres".split())


def grams(text: str | None) -> set[str]:
    """Distinct words (ending in a dot) and their stems."""
    out: set[str] = set()
    for w in {w for w in _word.findall((text or "").lower()) if len(w) >= 3}:
        out.add(w + ".")
        out.update(w[:k] for k in range(STEM[0], min(STEM[1], len(w)) + 1))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, limit: int, folds: int, held: int) -> DataFrame:
    """A bounded sample of labelled documents outside the held-out fold: ``(doc_id, toxic)``, at most ``limit`` rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return known.where(remainder("doc_id", folds) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def unlike(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text, toxic)`` without near copies, which would count one finding many times.

    Of documents that share a smallest hash of their five-word shingles under one of four hash
    functions only those stay that have the smallest id for each of their four.
    """

    def rows(keys, texts, toxic):
        marks: list[list[int]] = [[] for _ in _SALTS]
        for t in texts:
            h = hashes(words(t), 5)
            for mark, salt in zip(marks, _SALTS):
                mark.append(int(((h ^ salt) * _MULTIPLIER).min().view(np.int64)) if len(h) else 0)
        yield {"doc_id": keys, "toxic": toxic, "text": texts} | {f"m{i}": m for i, m in enumerate(marks)}

    marked = cut_lineage(arrow_rows(docs.select("doc_id", "text", "toxic"), rows, "doc_id long, toxic int, text string, " + ", ".join(f"m{i} long" for i in range(len(_SALTS)))))
    out = marked
    for i in range(len(_SALTS)):
        first = marked.groupBy(f"m{i}").agg(F.min("doc_id").alias("doc_id"))  # no more rows than the bounded sample
        out = out.join(F.broadcast(first), [f"m{i}", "doc_id"], "left_semi")
    return cut_lineage(out.select("text", "toxic"))


def gain_of(bad: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """Nats by which toxic rows among those with a gram are beyond the share of all rows; 0 below four fifths."""
    share = np.divide(bad, bad + clean, out=np.zeros(len(bad)), where=bad > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (bad + clean) * (np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base))))
    return np.where(share < 0.8, 0, gain)


def learn_lexicon(texts: DataFrame) -> list[str]:
    """Words (ending in a dot) and stems of the bounded sample ``texts(text, toxic)`` that mark toxic rows.

    Greedy cover: the gram whose toxic rows are least likely by chance, then the same among the rows
    that are left, until chance explains the rest.  Grams beyond chance on all rows are added, and the
    words of the sample under a chosen stem that mark toxic rows.
    """

    def rows(values, toxic):
        bad, all_ = Counter(), Counter()
        for t, y in zip(values, toxic):
            g = grams(t)
            all_.update(g)
            if y:
                bad.update(g)
        yield {"gram": list(all_), "bad": [bad[g] for g in all_], "n": list(all_.values())}

    total = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not total.n or not total.bad or total.bad == total.n:
        return []
    base = total.bad / total.n
    counted = arrow_rows(texts.select("text", "toxic"), rows, "gram string, bad long, n long", slice_bytes=16 << 20)
    often = counted.groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.expr("bad >= 3 AND bad >= 0.8 * n") & (F.col("bad") * -math.log(base) >= CHANCE))
    # a gram gains less on fewer toxic rows, so one that is not beyond chance on all of them never will be
    terms = sorted(r.gram for r in often.collect() if gain_of(np.array([r.bad]), np.array([r.n - r.bad]), base)[0] >= CHANCE)
    if not terms:
        return []
    place = {g: i for i, g in enumerate(terms)}

    def hits(values, toxic):
        yield {"toxic": toxic, "at": [[place[g] for g in grams(t) if g in place] for t in values]}

    found = arrow_rows(texts.select("text", "toxic"), hits, "toxic int, at array<int>").where("size(at) > 0").collect()
    clean = np.zeros(len(terms))
    for r in found:
        if not r.toxic:
            clean[r.at] += 1

    def gains(rows: list[list[int]]) -> np.ndarray:
        bad = np.zeros(len(terms))
        for at in rows:
            bad[at] += 1
        return gain_of(bad, clean, base)

    left = [r.at for r in found if r.toxic]
    alone = dict(zip(terms, gains(left)))
    chosen: list[str] = []
    while left:
        gain = gains(left)
        best = max(range(len(terms)), key=lambda i: (round(gain[i], 6), terms[i].endswith("."), len(terms[i])))
        if gain[best] < CHANCE:
            break
        chosen.append(terms[best])
        left = [at for at in left if best not in at]
    # best first; nothing that a chosen stem covers, no stem that says no more than a chosen longer gram
    for g in sorted((g for g in terms if alone[g] >= CHANCE), key=lambda g: (-round(alone[g], 6), not g.endswith("."), -len(g))):
        covered = any(not c.endswith(".") and g.startswith(c) for c in chosen)
        if not covered and not any(c.startswith(g) and alone[c] >= alone[g] - 1e-6 for c in chosen):
            chosen.append(g)
    # the words under a stem that mark toxic rows stand beside it, so that they are found misspelled too
    under = [F.substring("gram", 1, k).isin(at) for k in range(STEM[0], STEM[1] + 1) if (at := [c for c in chosen if len(c) == k and not c.endswith(".")])]
    if under:
        words_ = counted.where(F.col("gram").endswith(".") & reduce(Column.__or__, under))
        often = words_.groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where("bad >= 1 AND bad >= 0.8 * n")
        chosen += [r.gram for r in often.collect()]
    return sorted(set(chosen))


def ordinary_words(texts: DataFrame, terms: list[str]) -> list[str]:
    """Words of the bounded sample ``texts(text, toxic)`` that look like misspelled terms but do not mark toxic rows."""
    built: list[LexiconAutomaton] = []

    def rows(values, toxic):
        if not built:
            built.append(LexiconAutomaton(terms))
        bad, all_ = Counter(), Counter()
        for t, y in zip(values, toxic):
            found = {w for w in set(_word.findall((t or "").lower())) if built[0].lookup(w) == 2}
            all_.update(found)
            if y:
                bad.update(found)
        yield {"word": list(all_), "bad": [bad[w] for w in all_], "n": list(all_.values())}

    counted = arrow_rows(texts.select("text", "toxic"), rows, "word string, bad long, n long", slice_bytes=16 << 20)
    return sorted(r.word for r in counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where("bad < 0.8 * n").collect())


def edits(size: int) -> int:
    """Misspellings allowed in a term of so many letters."""
    return 0 if size < 5 else 1 if size < 10 else 2


class LexiconAutomaton:
    """Trie of terms x Levenshtein automaton, determinised lazily.

    A state maps trie nodes to the fewest edits that reach them.  ``lookup`` gives 0 for no hit, 1 for
    an exact word or stem, 2 for a misspelled word.  ``ordinary`` words are no misspellings.
    """

    def __init__(self, terms: list[str], ordinary: Iterable[str] = ()):
        self.ordinary = frozenset(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.word = [-1]  # edits allowed at the end of a word, -1 elsewhere
        self.stem = [False]
        self.most = [0]
        for term in terms:
            whole = term.endswith(".")
            letters = term[:-1] if whole else term
            node, allowed = 0, edits(len(letters)) if whole else 0
            self.most[0] = max(self.most[0], allowed)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(False)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            if whole:
                self.word[node] = max(self.word[node], allowed)
            else:
                self.stem[node] = True
        self.number: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[int] = []
        self.start = self._state({0: 0})
        self.cache: dict[str, int] = {}

    def _state(self, nodes: dict[int, int]) -> int:
        queue = list(nodes.items())
        for node, e in queue:  # a letter of the term that is left out
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    queue.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            best = min((e for n, e in nodes.items() if e <= self.word[n]), default=9)
            stem = any(self.stem[n] and e == 0 for n, e in nodes.items())
            self.final.append((1 if best == 0 else 2 if best < 9 else 0) | 4 * stem)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.states[state].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < new.get(child, 99):
                    new[child] = cost
            if e + 1 <= self.most[node] and e + 1 < new.get(node, 99):  # a letter too many
                new[node] = e + 1
        to = self._state(new) if new else -1
        self.moves[state][c] = to
        return to

    def read(self, word: str) -> int:
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return 0
            if self.final[state] & 4:
                return 1
        return self.final[state] & 3

    def lookup(self, word: str) -> int:
        hit = self.cache.get(word)
        if hit is None:
            if len(self.states) > 100_000:  # the automaton is rebuilt as words need it
                self.number, self.states, self.moves, self.final = {}, [], [], []
                self.start = self._state({0: 0})
            if len(self.cache) > 300_000:
                self.cache.clear()
            hit = self.read(word)
            self.cache[word] = hit = 0 if hit == 2 and word in self.ordinary else hit
        return hit


def features(text: str | None, automaton: LexiconAutomaton) -> tuple[float, ...]:
    """Counts of hits by kind and context, logarithmic, and hits per hundred words: ``FEATURES`` but the last."""
    lower = (text or "").lower()
    found = _word.findall(lower)
    look = automaton.lookup
    if not any(map(look, set(found))):
        return (0.0,) * (len(FEATURES) - 1)
    plain = fuzzy = quoted = aimed = hits = 0
    places = [(m.start(), m.group()) for m in _word.finditer(lower)]
    for i, (at, w) in enumerate(places):
        kind = look(w)
        if not kind:
            continue
        hits += 1
        lo = lower.rfind("\n", 0, at) + 1
        before = len(_quotes.findall(lower, lo, at))
        window = [x for _, x in places[max(0, i - WINDOW) : i + WINDOW + 1]]
        if before % 2 and _quotes.search(lower, at) or any(x in _report for x in window):
            quoted += 1
        elif kind == 1:
            plain += 1
        else:
            fuzzy += 1
        aimed += any(x in _aim for x in window)
    return tuple(map(math.log1p, (plain, fuzzy, quoted, aimed))) + (min(100.0 * hits / len(found), 20.0) / 4,)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, intercept first, by Newton's method under the prior."""
    x = np.column_stack([np.ones(len(x)), x.reshape(len(x), len(FEATURES))])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + PRECISION * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted, plain, fuzzy, quoted, aimed, density, direct)`` for every document.

    Labels are learned only from rows outside the held-out fold.  Null and empty texts have no hits and
    get the score of a text without hits; without labels there is no lexicon and the prior decides;
    repeated rows stay; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = cut_lineage(training_rows(docs, labels, train_rows, folds, held))  # at most train_rows rows, so it may be broadcast
    learned = unlike(source.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]))
    terms = learn_lexicon(learned)
    ordinary = ordinary_words(learned, terms) if terms else []
    built: list[LexiconAutomaton] = []

    def rows(keys, texts):
        if not built:
            built.append(LexiconAutomaton(terms, ordinary))
        found = [(*f, float(f[0] > 0)) for f in (features(t, built[0]) for t in texts)]
        yield {"doc_id": keys} | {n: [f[i] for f in found] for i, n in enumerate(FEATURES)}

    scored = cut_lineage(arrow_rows(source, rows, "doc_id long, " + ", ".join(f"{n} double" for n in FEATURES)))
    known = scored.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("toxic", *FEATURES).toPandas()
    weights = fit(known[list(FEATURES)].to_numpy(float), known["toxic"].to_numpy(float))
    z = F.lit(float(weights[0]))
    for n, w in zip(FEATURES, weights[1:]):
        z = z + F.col(n) * float(w)
    score = F.round(1 / (1 + F.exp(-z)), 9)
    return scored.withColumn("score", score).select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)
