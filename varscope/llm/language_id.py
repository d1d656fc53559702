"""Language identification: proportions of languages by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varscope.llm.common import small_batches

#: Bins of hashed byte trigrams, documents counted at a time, and iterations of the mixture.
BINS, CHUNK, ROUNDS = 4_096, 256, 10
#: Log likelihood that a further language must win, as a multiple of the logarithm of the number of trigrams.
PENALTY = 6.0
#: Share of a language's trigrams that is spread evenly over all bins.
SMOOTHING = 0.02
NO_LANGUAGE = "und"

# ASCII that is no letter becomes a space; bytes of other letters stay as they are.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_BLANK = ((32 << 16 | 32 << 8 | 32) * 2_654_435_761 & 0xFFFFFFFF) >> 20


def trigram_bins(text: str) -> np.ndarray:
    """Bins of the byte trigrams of the whole text, in lower case, with a space at either end."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_LETTERS), dtype=np.uint8).astype(np.uint32)
    codes = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2_654_435_761) >> np.uint32(20)
    return codes


def trigram_counts(texts: list[str]) -> np.ndarray:
    counts = np.empty((len(texts), BINS), dtype=np.float64)
    for n, text in enumerate(texts):
        counts[n] = np.bincount(trigram_bins(text), minlength=BINS)
    counts[:, _BLANK] = 0
    return counts


def count_languages(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Rows (lang, bin, n): trigrams of each language, combined in each task before they are added up."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                own = sums.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                own += np.bincount(trigram_bins(text), minlength=BINS)
        for lang, own in sums.items():
            own[_BLANK] = 0
            used = np.nonzero(own)[0]
            yield pd.DataFrame({"lang": lang, "bin": used, "n": own[used]})
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Trigram probabilities of every language in ``docs``. The driver gets at most ``BINS`` counts per language."""
    counts = count_languages(docs, text_col, lang_col).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BINS, len(langs)))
    if langs:
        table[counts["bin"], counts["lang"].map({v: n for n, v in enumerate(langs)})] = counts["n"]
    shares = table / np.maximum(table.sum(0), 1)
    return {"langs": langs, "shares": (1 - SMOOTHING) * shares + SMOOTHING / BINS}


def mixture(counts: np.ndarray, shares: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents by languages, zero where not allowed) and log likelihoods after EM."""
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    parts = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        mixed = parts @ shares.T
        np.divide(counts, mixed, out=mixed)
        parts = parts * (mixed @ shares) / size
        parts /= np.maximum(parts.sum(1, keepdims=True), 1e-300)
    return parts, np.einsum("ij,ij->i", counts, np.log(parts @ shares.T))


def language_sets(counts: np.ndarray, shares: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages of each document, and the language set of best penalised likelihood as a mask.

    Sets grow in order of the languages' share in the mixture of all. A document whose full mixture cannot pay for a
    second language keeps its single best one; the others try every size of set.
    """
    kinds = shares.shape[1]
    full, most = mixture(counts, shares, np.ones((len(counts), kinds)))
    cost = penalty * np.log(np.maximum(counts.sum(1), 2))
    single = counts @ np.log(shares)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.eye(kinds)[single.argmax(1)]
    chosen = best > 0
    value = single.max(1)
    open_ = np.nonzero(most - value > cost)[0]
    for k in range(2, kinds + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), kinds))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        parts, likely = mixture(counts[open_], shares, allowed)
        likely = likely - (k - 1) * cost[open_]
        better = likely > value[open_]
        best[open_[better]], value[open_[better]], chosen[open_[better]] = parts[better], likely[better], allowed[better] > 0
    return best * 0.9 + full * 0.1, chosen


def language_column(text: str | Column, model: dict) -> Column:
    """Struct (lang, score, langs): the language with the largest share, that share, and the chosen set.

    The share counts the chosen set nine tenths and the mixture of all languages one tenth, so that a text without a
    clear language scores lower. A null text or one without a letter, and any text where no language was learned, is
    ``und`` with score 0 and an empty set.
    """
    langs, shares = model["langs"], model["shares"]

    @F.pandas_udf("lang string, score double, langs array<string>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for at in range(0, len(texts), CHUNK):
                part = texts.iloc[at:at + CHUNK].tolist()
                known = [n for n, t in enumerate(part) if t is not None] if langs else []
                rows = [(NO_LANGUAGE, 0.0, [])] * len(part)
                if known:
                    parts, chosen = language_sets(trigram_counts([part[n] for n in known]), shares)
                    for n, own, members in zip(known, parts, chosen):
                        top = int(own.argmax())
                        rows[n] = (langs[top], float(min(own[top], 1.0)), [langs[i] for i in np.nonzero(members)[0]])
                found += rows
            yield pd.DataFrame(found, columns=["lang", "score", "langs"])

    text = F.col(text) if isinstance(text, str) else text
    return predict(F.when(text.rlike(r"\p{L}"), text))


def identify_languages(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with the struct of ``language_column`` as ``out_col``, which replaces a column of that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, language_column(text_col, model))
