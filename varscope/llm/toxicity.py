"""Toxicity: a Levenshtein automaton over a trie of learned terms, and context windows that tell quoting from abuse."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varscope.llm.common import small_batches, written

#: Labelled rows that the lexicon and the weights are learned from, at most (expected number; chosen by a hash of the id).
FIT_ROWS = 40_000
#: Letters of the shortest and longest term learned as the beginning of words.
SHORTEST, LONGEST = 4, 10
#: Share of toxic rows that a term must occur in, the least number of them, and the least share of toxic rows among its rows,
#: both kinds of rows weighted alike. All are counted in rows: a row counts once, however many of its words begin with a term.
LEAST_SHARE, LEAST_ROWS, LEAST_PURITY = 0.015, 5, 0.97
#: Terms in the trie at most: the most frequent ones; with the share above there are far fewer.
MOST_TERMS = 2_000
#: A whole word of this many letters or more is also caught with one edit, a shorter one with one letter replaced.
FUZZY_LETTERS = 5
#: A whole word is a term of its own where it is in this share of the toxic rows of the term that it begins with.
WORD_SHARE = 0.05
#: Words on either side that are looked through for quotation.
WINDOW = 6
#: Hits of each kind count up to this number.
MOST_HITS = 3
#: Words that a task remembers before it starts over.
MEMORY = 500_000
#: Mark of a replaced letter in a short word.
SWAP = 2
# Marks and words of quotation and report.
OPENING, CLOSING = "\"'“”„«»‘’‹›", "\"'“”«»‘’‹›"
REPORTING = frozenset((
    "said says called calls quote quoted quotes wrote writes word words term terms "
    "dijo dice llamó palabra palabras término sagte sagt nannte wort wörter schrieb zitat dit disait appelé mot mots terme").split())

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class TermAutomaton:
    """Accepts words that begin with a term, or are one edit away from a whole-word term.

    A state is the set of (trie node, edits) that the letters so far can have led to: the Levenshtein automaton of one
    edit run over the trie instead of over one word. Sets are numbered and their steps kept as they come up. Whole
    words under ``FUZZY_LETTERS`` letters take a replaced letter only, which is marked as ``SWAP`` in place of 1.
    """

    def __init__(self, stems: list[str], wholes: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.stem_end: set[int] = set()
        self.word_end: set[int] = set()
        self.swap_end: set[int] = set()
        self.fuzzy: set[int] = {0}
        self.swap: set[int] = {0}
        for term in stems:
            self.stem_end.add(self._insert(term)[-1])
        for term in wholes:
            path = self._insert(term)
            ends, nodes = (self.word_end, self.fuzzy) if len(term) >= FUZZY_LETTERS else (self.swap_end, self.swap)
            ends.add(path[-1])
            nodes.update(path)
        self.start = self._closed({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def _insert(self, term: str) -> list[int]:
        node, path = 0, []
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
            node = self.children[node][letter]
            path.append(node)
        return path

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With a letter of the term left out: one edit without reading."""
        more = {(n, 1) for s, e in states if e == 0 for n in self.children[s].values() if n in self.fuzzy}
        return frozenset(states | more)

    def _step(self, states: frozenset, letter: str) -> frozenset:
        key = (states, letter)
        if key not in self.steps:
            new: set[tuple[int, int]] = set()
            for node, edits in states:
                child = self.children[node].get(letter)
                if child is not None and (edits == 0 or child in (self.swap if edits == SWAP else self.fuzzy)):
                    new.add((child, edits))
                if edits == 0 and node in self.swap:
                    new.update((n, SWAP) for n in self.children[node].values() if n in self.swap and n != child)
                if edits == 0 and node in self.fuzzy:
                    new.add((node, 1))
                    new.update((n, 1) for n in self.children[node].values() if n in self.fuzzy)
            self.steps[key] = self._closed(new)
        return self.steps[key]

    def match(self, word: str) -> int:
        """0: no term, 1: begins with a term or is one, 2: one edit from a whole-word term."""
        states = self.start
        for letter in word:
            states = self._step(states, letter)
            if not states:
                return 0
            if any(e == 0 and n in self.stem_end for n, e in states):
                return 1
        return 2 if any(e != SWAP and n in self.word_end or e != 1 and n in self.swap_end for n, e in states) else 0


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """Rows (text, label) of about ``fit_rows`` labelled rows at most, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), (F.col(label_col) == 1).cast("int").alias("__label"))
    share = min(1.0, fit_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    # The chosen labels are bounded by fit_rows, so every task may hold them.
    rows = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("__own") == F.col("__id")).select("text", F.col("__label").alias("label"))
    # Near copies would count one text's rare words many times: of those with the same sketch one stays.
    drawn = rows.where("text IS NOT NULL").mapInPandas(_sketch, "text string, label int, sketch bigint")
    return written(drawn.dropDuplicates(["label", "sketch"]), "toxic-sample")


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the smallest hash of two words that follow each other: near copies mostly share it, others rarely."""
    for pdf in batches:
        found = []
        for text in pdf["text"]:
            words = [w.encode() for w in words_of(text)]
            pairs = zip(words, words[1:]) if len(words) > 1 else [(w, b"") for w in words]
            found.append(min((zlib.crc32(b, zlib.crc32(a)) for a, b in pairs), default=-1))
        yield pdf.assign(sketch=found)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of rows by term, whole (a word) or not (a beginning), and label."""
    counts: dict[tuple[bool, int], Counter] = {(whole, label): Counter() for whole in (False, True) for label in (0, 1)}
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            words = {w for w in words_of(text) if len(w) >= SHORTEST}
            counts[True, int(label)].update(words)
            counts[False, int(label)].update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
    for (whole, label), terms in counts.items():
        items = iter(terms.items())
        while part := list(itertools.islice(items, 50_000)):
            yield pd.DataFrame({"term": [t for t, _ in part], "whole": whole, "label": label, "n": [n for _, n in part]})


def learn_terms(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Beginnings of words and whole words that mark toxic rows.

    A beginning is learned where nearly all rows with such words are toxic and its own beginning is not learned. Only
    terms that pass reach the driver, ``MOST_TERMS`` at most.
    """
    rows = sample
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return [], []
    terms = written(rows.mapInPandas(_count_words, "term string, whole boolean, label int, n bigint").groupBy("term", "whole").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")), "toxic-terms")
    stems = terms.where("not whole").withColumnRenamed("term", "stem")
    words = terms.where("whole").withColumnRenamed("term", "word")
    rate = F.col("toxic") / toxic
    purity = rate / (rate + F.col("clean") / clean)
    good = (F.col("toxic") >= max(LEAST_ROWS, LEAST_SHARE * toxic)) & (purity >= LEAST_PURITY)
    pure = stems.where(good).orderBy(F.desc("toxic"), "stem").limit(MOST_TERMS).collect()
    found = {r["stem"]: r["toxic"] for r in pure}
    roots = sorted(s for s in found if not any(s[:k] in found for k in range(SHORTEST, len(s))))
    if not roots:
        return [], []
    # Each word with the one root that it begins with; roots are MOST_TERMS at most.
    begins = sample.sparkSession.createDataFrame([(r, found[r]) for r in roots], "root string, root_rows bigint")
    upto = F.sequence(F.lit(SHORTEST), F.least(F.char_length("word"), F.lit(LONGEST)))
    forms = words.select("*", F.explode(upto).alias("k")).withColumn("root", F.expr("substring(word, 1, k)")).join(F.broadcast(begins), "root")
    frequent = (F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") >= WORD_SHARE * F.col("root_rows")) & (purity >= LEAST_PURITY)
    wholes = [r["word"] for r in forms.where(frequent).orderBy(F.desc("toxic"), "word").limit(MOST_TERMS).collect()]
    return roots, sorted(wholes)


def _hit_counts(text: str, match) -> list[int]:
    """Numbers of (plain, misspelled) hits by (abuse, quotation), each up to ``MOST_HITS``."""
    lower = text.lower()
    places = [(m.start(), m.end()) for m in _WORD.finditer(lower)]
    words = [lower[a:b] for a, b in places]
    counts = [0, 0, 0, 0]
    for n, word in enumerate(words):
        kind = match(word)
        if kind:
            first, last = max(0, n - WINDOW), min(len(words), n + WINDOW + 1)
            before = lower[places[first][0]:places[n][0]]
            after = lower[places[n][1]:places[last - 1][1] + 1]
            quoted = any(c in before for c in OPENING) and any(c in after for c in CLOSING) or not REPORTING.isdisjoint(words[first:n])
            counts[(kind - 1) + 2 * quoted] += 1
    return [min(c, MOST_HITS) for c in counts]


def hit_features(stems: list[str], wholes: list[str]):
    """Function from texts to an array of hit counts; words already seen are remembered."""
    automaton, seen = TermAutomaton(stems, wholes), {}

    def match(word: str) -> int:
        kind = seen.get(word)
        if kind is None:
            if len(seen) > MEMORY:
                seen.clear()
            kind = seen[word] = automaton.match(word)
        return kind

    def features(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 4), dtype=np.int64)
        if not stems and not wholes:
            return out
        for n, text in enumerate(texts):
            if text and any(map(match, set(words_of(text)))):
                out[n] = _hit_counts(text, match)
        return out
    return features


def _design(hits: np.ndarray) -> np.ndarray:
    """Columns of the logistic model: each kind present, and its further hits."""
    return np.hstack([np.ones((len(hits), 1)), hits > 0, np.maximum(hits - 1, 0)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> dict:
    """Terms and weights learned from labelled rows of ``docs``, about ``fit_rows`` of them at most."""
    small_batches(docs.sparkSession)
    sample = _sampled(docs, labels, id_col, text_col, label_col, fit_rows)
    stems, wholes = learn_terms(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = hit_features(stems, wholes)
        for pdf in batches:
            hits = features(pdf["text"].tolist())
            yield pd.DataFrame(hits, columns=list("abcd")).assign(label=pdf["label"].to_numpy())
    table = sample.mapInPandas(count, "a bigint, b bigint, c bigint, d bigint, label int").groupBy(
        "a", "b", "c", "d", "label").count().toPandas()  # at most (MOST_HITS + 1) ** 4 * 2 rows
    x, y = _design(table[list("abcd")].to_numpy(dtype=np.float64)), table["label"].to_numpy(dtype=np.float64)
    n = table["count"].to_numpy(dtype=np.float64)
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a logistic regression with a slight pull towards zero
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(weights)),
                               x.T @ (n * (y - p)) - 0.1 * weights) if len(n) else np.zeros(len(weights))
        weights += np.clip(step, -2, 2)
    return {"stems": stems, "wholes": wholes, "weights": weights}


def toxicity_column(text: str | Column, model: dict) -> Column:
    """Score between 0 and 1 of the whole text; null and empty texts score as texts without any term."""
    stems, wholes, weights = model["stems"], model["wholes"], model["weights"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = hit_features(stems, wholes)
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(_design(features(texts.tolist())) @ weights, -30, 30))))
    return score(F.col(text) if isinstance(text, str) else text)


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score between 0 and 1 as ``out_col``, which replaces a column of that name.

    Repeated rows score alike; without labelled rows of both kinds every text scores the same; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, toxicity_column(text_col, model))
