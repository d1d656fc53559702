import numpy as np
import pytest

from varscope.llm import embedding_dedup
from varscope.llm.embedding_dedup import link_embeddings, linked_pairs, possible_from, quantise, smallest_reached, unit_rows


def _brute(rows, threshold=0.95):
    vectors = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors[n] = np.array(v, dtype=np.float64) / max(map(abs, v))
    links = {n: set() for n in range(len(rows))}
    for a, x in vectors.items():
        for b, y in vectors.items():
            if a < b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a].add(b), links[b].add(a)
    out = []
    for n in links:
        seen, todo = {n}, [n]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[n][0], len(links[n]), least, rows[n][0] == least))
    return sorted(out, key=str)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, _ = unit_rows(list(rng.normal(size=(40, 16)) * rng.exponential(5, 16)))
        y, _ = unit_rows(list(rng.normal(size=(30, 16))))
        (qx, sx, nx, ex), (qy, sy, _, ey) = quantise(x), quantise(y)
        products = qx.astype(np.int64) @ qy.astype(np.int64).T
        for threshold in (-0.2, 0.3, 0.8):
            reached = x @ y.T >= threshold
            assert (products >= possible_from(threshold, nx, ex, sx, ey.max(), sy)[:, None])[reached].all()
            found = {(a, b) for i, j in linked_pairs(x, y, threshold, False) for a, b in zip(i.tolist(), j.tolist())}
            assert found == set(zip(*(z.tolist() for z in np.nonzero(reached))))


def test_labels_join():
    labels = np.arange(7)
    smallest_reached(labels, np.array([6, 5, 3, 2]), np.array([5, 4, 4, 1]))
    assert labels.tolist() == [0, 1, 1, 3, 3, 3, 3]


@pytest.mark.parametrize("tile_rows", [16, 1_000])
def test_links_match_brute_force(spark, tile_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    vectors = [centres[i % 12] + rng.normal(size=8) * (0.3 if i % 5 else 0.02) for i in range(150)]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] * 8),
             (205, [float("inf")] + [1.0] * 7), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, rows[0][1]), (None, [9.0, -9.0, 9.0]),
             (7, rows[7][1]), (7, rows[7][1]), (208, [1e300, 1e300]), (209, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS row", "'x' AS id", "2 AS tile", "3 AS dims")
    got = link_embeddings(df, tile_rows=tile_rows, pivot_count=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert link_embeddings(none).count() == 0
    assert link_embeddings(spark.createDataFrame([(1, None)], none.schema)).collect()[0]["component_id"] == 1


def test_pairs_of_tiles_carry_no_vectors(spark, monkeypatch):
    """what is written per pair of tiles does not hold their vectors; equal vectors keep their counts."""
    plans, keep = {}, embedding_dedup.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(embedding_dedup, "written", noted)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(90)]
    rows += [(1_000 + i, rows[i % 3][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = link_embeddings(df, tile_rows=32)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)
    assert "vectors" not in plans["vector-links"]
