import numpy as np

import corpus_pipeline as pipeline


def test_stages_keep_columns_and_take_effect(spark, edge_docs, tmp_path):
    docs, counts = edge_docs, []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, "unused")
        out.write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == edge_docs.columns
        docs = out
        counts.append(out.count())
    assert len(pipeline.STAGES) == 5 and counts[0] == 8 and counts[1] == 6 and counts[2] == 6
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(docs.columns)


def test_language_stage_keeps_every_text_with_letters_where_nothing_is_learned(spark, edge_docs):
    bare = edge_docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert sorted(r["doc_id"] or -1 for r in pipeline.language(spark, bare, "").collect()) == [-1, 1, 2, 6, 7, 8, 8, 10]


def test_every_stage_takes_no_rows(spark, edge_docs):
    none = edge_docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "unused").count() == 0


def test_run_writes_and_reads_between_stages(spark, edge_docs, tmp_path):
    edge_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["offset"] + r["length"] <= 2_048 for r in rows)


def test_near_duplicates_are_told_by_five_words(spark):
    """Two-word sets of texts with scattered changes are alike where their five-word sets are not."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 200)]
        for changes in (0, 1, 2, 8):
            own = list(base)
            for n in rng.choice(200, changes, replace=False):
                own[n] = f"v{rng.integers(0, 10 ** 9)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), "one two three"), (len(rows) + 1, "one two  three"), (len(rows) + 2, "one two three four")]

    def kept(size):
        sets = []
        for _, text in rows:
            words = text.split()
            sets.append({tuple(words[n:n + size]) for n in range(max(1, len(words) - size + 1))})
        part = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and part[i] != part[j]:
                    low, high = sorted((part[i], part[j]))
                    part = [low if p == high else p for p in part]
        return [i for i in range(len(rows)) if part[i] == i]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == kept(5) != kept(2)
