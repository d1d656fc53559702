import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from varscope.llm.common import crc_fold
from varscope.llm.toxicity import TermAutomaton, fit_toxicity, hit_features, learn_terms, score_toxicity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9))
def test_automaton_matches_edit_distance(word):
    stems, wholes = ["abca"], ["bcabc", "cccccc", "abcbb"]
    expected = 1 if any(word.startswith(s) for s in stems) else 2 if any(_distance(word, w) <= 1 for w in wholes) else 0
    assert TermAutomaton(stems, wholes).match(word) == expected


def test_quotation_is_told_from_abuse():
    features = hit_features(["idio"], ["idiot", "pathetic"])
    hits = features(["you are an idiot", 'the word "idiot" is old', "an id1ot and a patetic one", None, "", "idiot " * 50])
    assert hits.tolist() == [[1, 0, 0, 0], [0, 0, 1, 0], [0, 2, 0, 0], [0] * 4, [0] * 4, [3, 0, 0, 0]]


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("ran", "tol", "mip", "ser", "gav") for b in ("en", "ot", "ul", "ira", "em")]
    docs, labels = [], []
    for i in range(900):
        words = rng.choice(plain, 30).tolist()
        toxic = i % 6 == 0
        if toxic:
            for n in rng.integers(0, 30, 3):
                words[n] = rng.choice(["gruntfool", "blorphead", "zwick" + str(rng.choice(["en", "ul", "aro"]))])
        docs.append((i, " ".join(words), 1))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id bigint, text string, label int"),
            spark.createDataFrame(labels + [(None, 1), (3, None), (5, 2)], "doc_id bigint, toxic int"))


def test_held_out_scores_and_misspellings(talk, spark):
    docs, labels = talk
    marked = docs.withColumn("held_out", crc_fold("doc_id", 3) == 1)
    model = fit_toxicity(marked.where("not held_out"), labels)
    assert any(s.startswith("grun") for s in model["stems"]) and "gruntfool" in model["wholes"]
    rows = score_toxicity(marked, model).where("held_out").collect()
    assert len(rows) > 250 and all((r["toxicity"] >= 0.7) == (r["doc_id"] % 6 == 0) for r in rows)
    odd = spark.createDataFrame([(1, "ranen grunfool tolot"), (2, "ranen tolot")], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["toxicity"] for r in score_toxicity(odd, model).collect()}
    assert scores[1] > scores[2]


def test_edges(talk, edge_docs, no_docs, spark):
    docs, labels = talk
    model = fit_toxicity(docs, labels)
    scores = [r["score"] for r in score_toxicity(edge_docs, model, out_col="score").collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    assert score_toxicity(no_docs, model).count() == 0
    flat = fit_toxicity(edge_docs, labels.where("false"))
    assert len({r["toxicity"] for r in score_toxicity(edge_docs, flat).collect()}) == 1


def _sample(spark, toxic, clean):
    return spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, label int")


def test_a_long_row_counts_once_for_a_beginning(spark):
    many = " ".join(f"plain{a}{b}" for a in "abcdefg" for b in "abcdefg")
    toxic = [f"gruntfool ordinary {i}" for i in range(20)] + [many]
    stems, wholes = learn_terms(_sample(spark, toxic, [f"ordinary talk {i}" for i in range(60)]))
    assert stems == ["grun"] and wholes == ["gruntfool"]


def test_purity_is_measured_on_rows(spark):
    many = " ".join(f"plain{a}{b}" for a in "abcdefg" for b in "abcdefg")
    toxic = [f"gruntfool {many}"] * 20
    clean = ["plainaa"] * 6 + ["ordinary talk"] * 14
    assert learn_terms(_sample(spark, toxic, clean))[0][:1] == ["grun"]
    assert "plai" not in learn_terms(_sample(spark, toxic, clean))[0]


def test_every_frequent_form_of_a_root_is_caught_misspelled(spark):
    toxic = [f"{w} ordinary" for w, n in (("gruntfool", 9), ("gruntfools", 6), ("gruntfoolish", 5), ("glip", 20)) for _ in range(n)]
    stems, wholes = learn_terms(_sample(spark, toxic, ["ordinary talk"] * 60))
    assert stems == ["glip", "grun"] and wholes == ["glip", "gruntfool", "gruntfoolish", "gruntfools"]
    match = TermAutomaton(stems, wholes).match
    assert [match(w) for w in ("gxuntfool", "gxuntfools", "guntfoolish", "glap", "xlip")] == [2] * 5
    assert [match(w) for w in ("gli", "gliip", "gip", "gxip", "gxap", "axlip", "lip")] == [0, 0, 0, 2, 0, 0, 0]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7))
def test_short_words_take_a_replaced_letter_only(word):
    wholes = ["abca", "ccab", "abcab"]
    near = any(len(word) == len(w) and sum(x != y for x, y in zip(word, w)) <= 1 for w in wholes[:2]) or _distance(word, wholes[2]) <= 1
    assert TermAutomaton([], wholes).match(word) == 2 * near
