import unicodedata

import pytest
from pyspark.sql import functions as F

from varscope.functions.text import fold_marks, normalize, normalize_name


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def test_every_code_point_is_its_decomposition_without_marks(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Sixteen characters a row, so that neighbours are folded on their own too.
    rows = [("".join(map(chr, codes[n:n + 16])),) for n in range(0, len(codes), 16)]
    got = spark.createDataFrame(rows, "t string").select("t", fold_marks(F.col("t")).alias("f")).collect()
    assert len(got) == len(rows)
    wrong = [r["t"] for r in got if r["f"] != "".join(plain(c) for c in r["t"])]
    assert not wrong


@pytest.mark.parametrize("text", [
    "Ελλάδα ΆΈΉ", "йЙ ё Ї", "Việt Nam ệ Ữ", "한국어 값", "কো কো", "é é", "\U00011099 𑂚", "İstanbul", "ﬁ ½ Å", "", "plain_text - x", "தொ"])
def test_composed_and_decomposed_forms_are_one(spark, text):
    forms = {unicodedata.normalize(f, text) for f in ("NFC", "NFD")}
    got = {r["f"] for r in spark.createDataFrame([(f,) for f in forms], "t string").select(normalize(F.col("t")).alias("f")).collect()}
    assert got == {normalize_name(text)}
