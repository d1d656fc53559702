import random

import pytest

from varscope.functions.vocab import Catalogue
from varscope.operators import catalogues, quality
from varscope.operators.catalogues import catalogue_table, missing_from, nearest_entries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(value, entries):
    scored = min(((distance(value, e), i, e) for i, e in enumerate(entries)), default=None)
    return scored[2] if value and scored and scored[0] <= max(1, len(value) // 3) else None


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "norma string")


def changed(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        place = rng.randrange(len(letters) + 1)
        kind = rng.random()
        if kind < 0.3:
            letters.insert(place, rng.choice("abcde "))
        elif letters and kind < 0.6:
            del letters[min(place, len(letters) - 1)]
        elif letters:
            letters[min(place, len(letters) - 1)] = rng.choice("abcde ")
    return "".join(letters)


def test_nearest_entry_against_brute_force(spark):
    rng = random.Random(3)
    entries = sorted({"".join(rng.choice("abcde ") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21, 34]))) for _ in range(400)})
    rng.shuffle(entries)
    values = {changed(rng, rng.choice(entries), rng.randrange(9)) for _ in range(300)} | {
        "", "a", "zz", "zzzzzz", "x" * 90, *["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(100)]}
    got = {r["norma"]: r["sugerido"] for r in nearest_entries(texts(spark, values), catalogue_table(spark, entries)).collect()}
    assert got == {v: nearest(v, entries) for v in values}
    assert len([v for v in got.values() if v]) > 200


def test_ties_repeats_nulls_and_empty_tables(spark):
    table = spark.createDataFrame([("abcd", 2), ("abce", 1), ("abce", 5), (None, 0)], "entrada string, orden bigint")
    got = nearest_entries(texts(spark, ["abcf", "abcf", None]), table).collect()
    assert [(r["norma"], r["sugerido"]) for r in got if r["norma"]] == [("abcf", "abce")]
    assert [r["norma"] for r in missing_from(texts(spark, ["abcd", "new"]), table).collect()] == ["new"]
    assert nearest_entries(texts(spark, []), table).count() == 0
    assert [r["sugerido"] for r in nearest_entries(texts(spark, ["a"]), table.where("false")).collect()] == [None]


@pytest.mark.parametrize("limit", [0, 10_000])
def test_long_catalogues_give_the_findings_of_short_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "LITERAL_ENTRIES", limit)
    places = Catalogue("Lugares", "u", ("lugar",), ("san juan", "santa fe", "la paz", "lima"))
    df = spark.createDataFrame([("Lima",), ("Limma",), ("SAN JUÁN",), ("Sta Fe",), ("Tokio",), (None,), ("la paz",)], "`Lugar` string")
    found = [r for r in quality.findings(df, catalogues=[places]).collect() if r["codigo"] == "valor_fuera_de_catalogo"]
    assert [(r["filas_afectadas"], r["ejemplos"]) for r in found] == [(3, ["Limma → lima", "Sta Fe → santa fe", "Tokio"])]


def test_few_pairs_are_compared(spark, monkeypatch):
    """letters are compared before edits, and a pair is never shuffled."""
    rng = random.Random(11)
    entries = sorted({"".join(rng.choice(["the", "on", "tion", "an", "er", "ing"]) for _ in range(4)) for _ in range(600)})
    values = sorted({changed(rng, rng.choice(entries), rng.randrange(6)) for _ in range(60)})
    plans, keep = [], catalogues._within

    def noted(*args):
        plans.append(keep(*args))
        return plans[-1]

    monkeypatch.setattr(catalogues, "_within", noted)
    got = {r["norma"]: r["sugerido"] for r in nearest_entries(texts(spark, values), catalogue_table(spark, entries)).collect()}
    assert got == {v: nearest(v, entries) for v in values}
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "Aggregate" not in plan.split("Join", 1)[0]
