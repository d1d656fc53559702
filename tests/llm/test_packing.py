import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from varscope.llm.packing import _encoder, pack_documents, plan_table, solve_configurations
from varscope.llm.queries import public_tokenizer


def _used(plan, capacity):
    size = np.arange(capacity + 1)
    assert all((used * size).sum() <= capacity and count > 0 for used, count in plan)
    return sum(used * count for used, count in plan) if plan else np.zeros(capacity + 1, dtype=int)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 50)), max_size=12))
def test_every_piece_is_placed_once(pieces):
    histogram = np.zeros(41, dtype=np.int64)
    for length, n in pieces:
        histogram[length] += n
    plan = solve_configurations(histogram, 40, steps=30)
    assert (_used(plan, 40) == histogram).all()
    table = plan_table(plan)
    for length, part in table.groupby("length"):
        assert part["base"].tolist() == [0, *np.cumsum(part["count"] * part["each"])[:-1]]


def test_few_sequences():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 2_049, 20_000), minlength=2_049)
    plan = solve_configurations(histogram)
    least = (histogram * np.arange(2_049)).sum() / 2_048
    halves = histogram[1_025:].sum()
    assert sum(c for _, c in plan) <= 1.01 * max(least, halves)
    # Pieces of 1025 cannot share a sequence; 600 and 1400 pair up although both leave room.
    only = np.zeros(2_049, dtype=np.int64)
    only[1_025] = 7
    assert sum(c for _, c in solve_configurations(only)) == 7
    only[[600, 1_400]] = 50
    assert sum(c for _, c in solve_configurations(only)) == 57


def test_plain_texts_encode_alike(spark):
    own = public_tokenizer()
    slow, fast = _encoder(own["json_path"], None, None), _encoder(**own)
    texts = ["", " ", "a  b\n\n c\t\td", "don't they'll 12345 ab12", "é ü ß ñ — “quoted” …", "<|endoftext|> x", "漢字　 \u0085x", "\U0001f600",
             "a b", "x" * 5_000, " " * 999, "\r\n\x0b\x0c \x1c", "$%^&*()!!!", "%%% *** ###", "é ǅ ʼn"]
    assert slow(texts) == [list(x) for x in fast(texts)]


@pytest.fixture(scope="module")
def packed(edge_docs):
    return pack_documents(edge_docs, public_tokenizer(), rows_per_cell=2).collect()


def test_round_trip(edge_docs, packed):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizer()["json_path"])
    expected = sorted((r["doc_id"] or -1, *whole.encode(r["text"] or "", add_special_tokens=False).ids, 0) for r in edge_docs.collect())
    by_doc = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and 1 <= r["length"] <= 2_048
        by_doc.setdefault((r["doc_id"] or -1), {}).setdefault(r["start"], []).append((r["piece"], ids.tolist()))
    got = []
    for doc, starts in by_doc.items():
        for copy in range(len(starts[0])):
            whole_ids = [i for s in sorted(starts) for i in starts[s][copy][1]]
            got.append((doc, *whole_ids))
    assert sorted(got) == expected
    long = sorted((r["start"], r["length"]) for r in packed if r["doc_id"] == 7)
    assert all(n == 2_048 for _, n in long[1:]) and [s for s, _ in long] == [0, *np.cumsum([n for _, n in long])[:-1]]


def test_places_are_gapless(packed):
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2_048
    assert len(sequences) == -(-sum(r["length"] for r in packed) // 2_048)


def test_no_documents(no_docs):
    assert pack_documents(no_docs, public_tokenizer()).count() == 0


def test_equal_lengths_get_different_places(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    rows = pack_documents(docs, public_tokenizer(), keep_ids=False, rows_per_cell=20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
