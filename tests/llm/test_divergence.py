import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varscope.llm import divergence
from varscope.llm.divergence import audit_divergence, index_runs, merge_runs, share, term_frequencies


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, least=3, top=200):
    """All sums term by term in whole numbers; rows are (text, lang, source)."""
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms_of(text))
        documents[lang].update(set(terms_of(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in own:
            total.update({t: counts[lang, s][t] for t in kept})

        def p(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (size + len(kept)) for t in kept}
        shares, q = {s: p(counts[lang, s]) for s in own}, p(total)
        for s in own:
            pairs = [(sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o) for o in own if o != s]
            words = [((shares[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", words)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(ranked, 1) if part == "pair" or n <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(seed, rows, sources, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = ["Alpha", "é", "Ä", "日本", "b_c", "d'e", "x1y"] + [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(words)]
    return [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))), str(rng.choice(["en", "de"])), f"s{int(rng.integers(0, sources))}")
            for _ in range(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def test_against_brute_force(spark):
    rows = corpus(1, 300, 6) + [(None, "en", "empty"), ("", "en", None), ("!!! 12", None, "s1"), ("only here", "xx", "s1"), (None, None, None)]
    assert got(audit_divergence(frame(spark, rows), top_terms=5, run_postings=50)) == brute(rows, top=5)


def test_sources_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "HELD_TILES", 3)
    rows = corpus(2, 250, 14, 12)
    assert got(audit_divergence(frame(spark, rows), run_postings=30)) == brute(rows)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge_docs.collect()]
    assert got(audit_divergence(edge_docs, least_documents=1)) == brute(rows, 1)
    assert audit_divergence(no_docs).count() == 0


def test_runs_are_sorted_and_bounded():
    rows = corpus(3, 100, 3)
    batch = pa.record_batch({"lang": [r[1] for r in rows], "source": [r[2] for r in rows],
                             "text": pa.array([r[0].encode() for r in rows], pa.binary())})
    runs = list(index_runs(iter([batch.slice(0, 50), batch.slice(50)]), 60))
    keys = [[(r["lang"], r["term"], r["source"]) for r in run.to_pylist()] for run in runs]
    assert len(runs) > 3 and all(k == sorted(set(k)) and len(k) < 100 for k in keys)
    # Merged, they are the counts of all rows.
    merged = sorted((r for run in runs for r in run.to_pylist()), key=lambda r: (r["lang"], r["term"], r["source"]))
    table = pa.Table.from_pylist(merged, schema=runs[0].schema)
    for size in (1, 7, 10_000):
        sums = {(r["lang"], r["source"], r["term"].decode()): (r["documents"], r["count"])
                for b in merge_runs(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()}
        count, documents = Counter(), Counter()
        for text, lang, source in rows:
            count.update((lang, source, t) for t in terms_of(text))
            documents.update({(lang, source, t) for t in terms_of(text)})
        assert sums == {k: (documents[k], count[k]) for k in count}


def test_frequencies_do_not_depend_on_memory(spark):
    docs = frame(spark, corpus(4, 200, 4)).repartition(5)
    few, many = (sorted(map(tuple, term_frequencies(docs, run_postings=n).collect())) for n in (10, 10 ** 6))
    assert few == many


def test_shares_of_very_large_counts(spark):
    big = 10 ** 15
    row = spark.range(1).select(share(F.lit(big), F.lit(3 * big)).alias("p"), share(F.lit(0), F.lit(1)).alias("one")).first()
    assert row["p"] == 1 + 10 ** 9 * (big + 1) // (3 * big) and row["one"] == 1 + 10 ** 9


def test_runs_are_merged_by_term_first(spark):
    """op12_term_runs fails the check (CPU): a sort tells rows of many terms and few languages apart by the term."""
    docs = spark.createDataFrame([("bb aa", "de", "s"), ("cc aa", "de", "t"), ("aa bb", "en", "s")], "text string, lang string, source string")
    found = term_frequencies(docs, run_postings=2)
    assert "Sort [term" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["lang"], r["source"], r["term"], r["documents"], r["count"]) for r in found.collect()) == [
        ("de", "s", "aa", 1, 1), ("de", "s", "bb", 1, 1), ("de", "t", "aa", 1, 1), ("de", "t", "cc", 1, 1), ("en", "s", "aa", 1, 1), ("en", "s", "bb", 1, 1)]


def test_folded_runs_merge_to_the_same_sums(monkeypatch):
    """op12_term_runs fails the check (CPU): a row is shuffled for each term of a run, not for each of its sources."""
    from varscope.llm.divergence import fold_runs, unfold_runs

    batch = pa.record_batch({"lang": ["de", "en", "de", ""] * 30, "source": [f"s{n % 9}" for n in range(120)],
                             "text": pa.array([b"aa Bb aa cc" if n % 2 else b"\xc3\xa9t\xc3\xa9 bb" if n % 5 else b"12 ;" for n in range(120)], pa.binary())})
    count, documents = Counter(), Counter()
    for row in batch.to_pylist():
        words = terms_of(row["text"].decode())
        count.update((row["lang"], row["source"], w) for w in words)
        documents.update({(row["lang"], row["source"], w) for w in words})
    want = {k: (documents[k], count[k]) for k in count}
    for postings, cells, longest, at_once in ((10 ** 6, 1, 256, 50_000), (20, 1, 2, 1), (20, 3, 256, 5), (20, 3, 2, 40)):
        monkeypatch.setattr(divergence, "LIST_POSTINGS", longest)
        monkeypatch.setattr(divergence, "FOLDED_POSTINGS", at_once)
        runs = list(index_runs(iter([batch.slice(0, 70), batch.slice(70)]), postings))
        folded = [r for b in fold_runs(iter(runs), cells) for r in b.to_pylist()]
        assert all(len(r["source"]) == len(r["count"]) == len(r["documents"]) <= longest for r in folded)
        if len(runs) == cells == 1:
            assert len(folded) == len({(lang, term) for lang, _, term in want}) < len(want)
        folded.sort(key=lambda r: (r["term"], r["lang"], r["cell"]))
        table = pa.Table.from_pylist(folded, schema=next(fold_runs(iter(runs), cells)).schema)
        for size in (1, 4, 1_000):
            found = [r for b in merge_runs(unfold_runs(iter(table.to_batches(max_chunksize=size)))) for r in b.to_pylist()]
            assert len(found) == len(want) and {(r["lang"], r["source"], r["term"].decode()): (r["documents"], r["count"]) for r in found} == want


def test_many_sources_are_dealt_by_cells(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELL_SOURCES", 2)
    rows = corpus(6, 150, 9)
    assert got(audit_divergence(frame(spark, rows), run_postings=50)) == brute(rows)


def test_shares_of_counts_beside_the_range_of_64_bits(spark):
    edge = ((1 << 63) - 1) // 10 ** 9
    counts = [0, 1, edge - 2, edge - 1, edge, edge + 1]
    rows = spark.createDataFrame([(c, c + 7) for c in counts], "c bigint, t bigint").select("c", share(F.col("c"), F.col("t")).alias("p")).collect()
    assert {r["c"]: r["p"] for r in rows} == {c: 1 + 10 ** 9 * (c + 1) // (c + 7) for c in counts}
