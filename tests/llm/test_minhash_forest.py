import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from varscope.llm import minhash_forest
from varscope.llm.common import components
from varscope.llm.minhash_forest import (GROUP, PATH_BITS, _scan, confirmed, drop_near_copies, near_copies, prefix_candidates, shingle_sets,
                                         sorted_neighbours, word_hashes)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)


def _brute(rows):
    """Components over all pairs with Jaccard similarity of 0.8 or more; equal sets by their first member."""
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    first = {}
    for i, own in enumerate(sets):
        if own:
            parent[find(i)] = find(first.setdefault(own, i))
    distinct = list(first.items())
    for k, (x, i) in enumerate(distinct):
        for y, j in distinct[:k]:
            if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    parent[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        least = min((k for k in groups[find(i)] if k is not None), default=None)
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é漢\t\n\x0b", max_size=25), min_size=1, max_size=6))
def test_hashed_sets_are_the_sets_of_words(texts):
    for text, own in zip(texts, shingle_sets(texts)):
        assert len(own) == len(_set(text))
        assert np.array_equal(own, shingle_sets([text])[0])


def test_equal_words_hash_alike_anywhere():
    hashes, _ = word_hashes(b"Alpha beta  alpha\nalphA x" + b" y" * 10_000 + b" beta")
    assert hashes[0] == hashes[2] == hashes[3] and hashes[1] == hashes[-1] and len(set(hashes.tolist())) == 4


@pytest.fixture(scope="module")
def copies():
    """Random texts, pairs near the threshold, a dense group with changed words, and many texts around one passage."""
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 3_000))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.integers(3, 120))]
        for _ in range(rng.integers(1, 4)):
            own = list(base)
            for _ in range(rng.integers(0, 1 + len(own) // 18)):
                own[rng.integers(0, len(own))] = word()
            rows.append(" ".join(own))
    dense = [word() for _ in range(200)]
    for _ in range(250):
        own = list(dense)
        for _ in range(rng.integers(0, 8)):
            own[rng.integers(0, len(own))] = word()
        rows.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rng.integers(5, 60))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(rng.permutation(rows).tolist())]


def test_components_match_brute_force(spark, copies):
    got = near_copies(spark.createDataFrame(copies, "doc_id bigint, text string").repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(copies)


def test_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted((tuple(r) for r in near_copies(edge_docs).collect()), key=str) == _brute(rows)
    kept = drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 11
    assert near_copies(no_docs).count() == 0


@pytest.mark.parametrize("local_edges", [0, 500_000])
def test_components_of_long_paths_and_stars(spark, local_edges):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1, i) for i in range(500, 700)] + [(9, 9), (7, 8), (8, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8), local_edges).collect()}
    assert got == {i: 100 for i in range(101, 401)} | {i: 1 for i in range(500, 700)} | {8: 7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_template_cluster_matches_brute_force(spark):
    """Thousands of texts round one template that are no copies of each other, and twins that are."""
    rng, size, shape = np.random.default_rng(11), 3_000, 200
    rows = []
    for n in range(size):
        places = 2 * rng.choice(shape // 2 - 1, 8, replace=False) + 1
        words = [f"t{k}" for k in range(shape)]
        for k in places:
            words[k] = f"o{n}x{k}"
        rows.append(" ".join(words))
        if n % 5 == 0:
            for k in 2 * rng.choice(shape // 2 - 1, 10, replace=False) + 1:
                words[k] = f"p{n}x{k}"
            rows.append(" ".join(words))
    vocabulary, hits = {}, []
    for text in rows:
        hits.append([vocabulary.setdefault(s, len(vocabulary)) for s in _set(text)])
    common = [c for c, k in zip(*np.unique(np.concatenate(hits), return_counts=True)) if k > 1]
    place = {c: k for k, c in enumerate(common)}
    ones = np.zeros((len(rows), len(common)), dtype=np.float32)
    for n, own in enumerate(hits):
        ones[n, [place[c] for c in own if c in place]] = 1
    both, sizes = ones @ ones.T, np.array([len(x) for x in hits])
    linked = 100 * both >= 80 * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(len(rows))
    while not np.array_equal(label, new := np.array([label[own].min() for own in linked])):
        label = new
    got = near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(6)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label.tolist()))
    assert len(set(label.tolist())) > 1_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 2), min_size=5, max_size=5)), max_size=120))
def test_neighbours_of_sorted_rows(rows):
    """All pairs of small groups; in large ones all pairs of the first part that is small, and no row without a neighbour."""
    rows = sorted((k, sum(v << PATH_BITS * (4 - n) for n, v in enumerate(path))) for k, path in rows)
    key, path = (np.array([r[n] for r in rows], dtype=np.int64) for n in (0, 1))
    first, second, large = sorted_neighbours(key, path)
    pairs = set(zip(first.tolist(), second.tolist()))
    assert all(a < b and key[a] == key[b] for a, b in pairs)
    groups = {}
    for i, (k, p) in enumerate(rows):
        for level in range(6):
            groups.setdefault((level, k, p >> PATH_BITS * (5 - level)), []).append(i)
    assert large.tolist() == [len(groups[0, k, p >> PATH_BITS * 5]) > GROUP for k, p in rows]
    for (level, k, prefix), own in groups.items():
        above = groups[level - 1, k, prefix >> PATH_BITS] if level else None
        if len(own) <= GROUP and (above is None or len(above) > GROUP):
            assert pairs >= {(a, b) for a in own for b in own if a < b}
    # Neighbours join every group to one component.
    part = list(range(len(rows)))
    for a, b in sorted(pairs):
        part = [part[a] if x == part[b] else x for x in part]
    assert all(len({part[i] for i in own}) == 1 for (level, _, _), own in groups.items() if level == 0)


def test_scan_of_ranges_finds_what_one_range_finds(spark):
    rng = np.random.default_rng(5)
    rows = sorted((int(k), int(p)) for k, p in zip(rng.integers(0, 30, 600) ** 2 // 25, rng.integers(0, 1 << 60, 600)))
    whole = pa.record_batch({"key": [r[0] for r in rows], "path": [r[1] for r in rows], "node": list(range(600))})
    want = [r for b in _scan(iter([whole]), False) for r in b.to_pylist()]
    cuts, parts = sorted(rng.choice(600, 12, replace=False).tolist()), []
    for a, b in zip([0, *cuts], [*cuts, 600]):
        parts += [r for batch in _scan(iter([whole.slice(a, b - a)]), True) for r in batch.to_pylist()]
    edges = pa.RecordBatch.from_pylist(sorted(({"key": r["key"], "path": r["path"], "node": r["a"]} for r in parts if r["kind"] == 2),
                                              key=lambda r: (r["key"], r["path"], r["node"])))
    parts += [r for batch in _scan(iter([edges]), False) for r in batch.to_pylist()]
    small = {k for k in {r[0] for r in rows} if sum(r[0] == k for r in rows) <= GROUP}
    pairs = lambda found: {(r["a"], r["b"]) for r in found if r["kind"] == 0 and rows[r["a"]][0] in small}
    assert pairs(parts) == pairs(want)
    # Rows of large groups are told in either scan.
    members = lambda found: {r["a"] for r in found if r["kind"] == 1}
    assert members(parts) == members(want) and len(members(want)) > 100


@pytest.mark.parametrize("cell_rows", [3, 1_000])
def test_prefix_filter_loses_no_pair(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(minhash_forest, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(8)
    base, sets = rng.choice(400, 40, replace=False), []
    for _ in range(120):
        own = set(base.tolist()) if rng.random() < 0.7 else set(rng.choice(400, rng.integers(1, 40), replace=False).tolist())
        for _ in range(rng.integers(0, 8)):
            own.discard(int(rng.choice(sorted(own)))) if len(own) > 1 else None
            own.add(int(rng.integers(0, 400)))
        sets.append(own)
    roots = rng.integers(0, 60, 120).tolist()
    frame = spark.createDataFrame([(n, [int(x) for x in sorted(own)]) for n, own in enumerate(sets)], "node bigint, shingles array<bigint>")
    nodes = spark.createDataFrame([(n, r) for n, r in enumerate(roots)], "node bigint, root bigint")
    candidates = prefix_candidates(nodes, frame)
    alike = {(a, b) for b in range(120) for a in range(b) if roots[a] != roots[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = {tuple(r) for r in candidates.collect()}
    assert alike and alike <= found and len(found) < 120 * 119 // 4
    assert {tuple(r) for r in confirmed(candidates, frame).collect()} == alike


def test_repeated_ids_with_other_texts(spark):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(1, text), (1, text + " end"), (1, "something else entirely"), (None, text), (None, "x y z"), (2, "x y z"), (2, "x y z")]
    got = near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)
