import numpy as np
import pytest
from pyspark.sql import functions as F

from varscope.llm.common import crc_fold
from varscope.llm.language_id import fit_languages, identify_languages, language_sets, trigram_counts

LINES = {
    "en": "the house stands near the river and the children were playing with their friends in the morning",
    "de": "das haus steht neben dem fluss und die kinder spielten am morgen mit ihren freunden im garten",
    "fr": "la maison se trouve près de la rivière et les enfants jouaient avec leurs amis dans le jardin",
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        lang = list(LINES)[i % 3]
        rows.append((i, " ".join(rng.choice(LINES[lang].split(), 40)), lang if i % 10 else None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy_and_sets(docs):
    marked = docs.withColumn("held_out", crc_fold("doc_id", 4) == 2)
    model = fit_languages(marked.where("not held_out"))
    assert model["langs"] == ["de", "en", "fr"]
    rows = identify_languages(marked, model).where("held_out and lang is not null").collect()
    assert len(rows) > 80 and all(r["language"]["lang"] == r["lang"] and r["language"]["score"] > 0.8 for r in rows)
    both = " ".join([LINES["en"]] * 6 + [LINES["fr"]] * 3)
    own, chosen = language_sets(trigram_counts([both, LINES["de"]]), model["shares"])
    assert chosen.tolist() == [[False, True, True], [True, False, False]]
    assert own[0].argmax() == 1 and 0.15 < own[0][2] < 0.45 and own[0][0] < 0.05
    assert own[1].argmax() == 0 and own[1][0] > 0.9 and np.allclose(own.sum(1), 1)


def test_edges(docs, edge_docs, no_docs):
    model = fit_languages(docs)
    found = {r["doc_id"]: r["language"] for r in identify_languages(edge_docs, model).collect()}
    assert [found[i]["lang"] for i in (3, 4, 5, 9)] == ["und"] * 4 and found[3]["score"] == 0
    assert found[1]["lang"] == "en" and found[8]["lang"] == "de" and 0 <= found[10]["score"] <= 1 and found[7]["lang"] != "und"
    assert identify_languages(no_docs, model).count() == 0
    nothing = fit_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["language"]["lang"] for r in identify_languages(edge_docs, nothing).collect()} == {"und"}
    assert fit_languages(no_docs)["langs"] == []


def test_every_chosen_language_is_listed(spark, docs):
    """A share of a few hundredths is listed too, where the penalised likelihood chose its language."""
    model = fit_languages(docs)
    text = " ".join([LINES["fr"]] * 50 + [LINES["en"]] * 2)
    rows = spark.createDataFrame([(1, text), (2, LINES["fr"])], "doc_id bigint, text string")
    found = {r["doc_id"]: r["language"] for r in identify_languages(rows, model).collect()}
    assert found[1]["lang"] == "fr" and sorted(found[1]["langs"]) == ["en", "fr"] and found[1]["score"] > 0.9
    assert found[2]["langs"] == ["fr"]
