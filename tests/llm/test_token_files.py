import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varscope.llm.common import new_path
from varscope.llm.queries import FILE_END_ID, op13, word_tokenizer
from varscope.llm.token_files import DamagedFile, TokenFile, TokenFileReader, file_list, read_token_files, word_encoder, write_token_files

ODD = ["", " ", "a  b\n\n c\t\td", "Don't THEY'LL 12345 ab12. x", "é Ü ß ñ — “quoted” …", "<|endoftext|> x", "x<|STARTOFTEXT|>y", "漢字　 \u0085x",
       "\U0001f600", "x" * 5_000, " " * 99, "\r\n\x0b\x0c \x1c", "$%^&*()!!! a. b.. c., d", "é .̸ a.́ b", "ΑΣ. Σ, ΣΑ", "İI ıi ǅ ŉ",
       "end.", "end.\n", "9. _. a_. ²,", "Å Å Å", "µ ÿ Ÿ", "a b. c", "it's. it'S, I'D; 'tis"]


def expected(rows):
    """Starts, counts and checksums by the tokenizer alone, in ascending order of the ids."""
    whole, out, start = Tokenizer.from_file(word_tokenizer()["json_path"]), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, FILE_END_ID], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_words_encode_as_whole_texts():
    own = word_tokenizer()
    whole, width = word_encoder(own["json_path"], False)
    assert width == 2 and word_encoder(**own)[0](ODD + ODD) == whole(ODD + ODD)


def test_words_encode_as_whole_texts_on_real_texts(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own = word_tokenizer()
    assert word_encoder(**own)[0](texts) == word_encoder(own["json_path"], False)[0](texts)


def test_round_trip(spark, edge_docs):
    location = new_path(spark, "token-files-test")
    files = write_token_files(edge_docs, location, word_tokenizer(), FILE_END_ID, files=3, frame_ids=5)
    rows = read_token_files(spark, location).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows)
    want = expected([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert [g[1:] for g in got] == want
    assert files.count() > 1 and files.agg(F.sum("documents")).first()[0] == len(want)


def test_any_zstandard_tool_unpacks_the_plain_array(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "four five six")], "doc_id bigint, text string")
    write_token_files(docs, str(tmp_path / "t"), word_tokenizer(), FILE_END_ID, files=1, frame_ids=3)
    name = file_list(spark, str(tmp_path / "t")).first()["file"]
    raw = (tmp_path / "t" / name).read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    whole = Tokenizer.from_file(word_tokenizer()["json_path"])
    ids = [i for t in ("one two", "three", "four five six") for i in [*whole.encode(t, add_special_tokens=False).ids, FILE_END_ID]]
    assert np.frombuffer(plain, dtype="<u2").tolist() == ids


def test_only_frames_asked_for_are_read(spark, tmp_path):
    location = str(tmp_path / "t")
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), F.col("id")).alias("text"))
    write_token_files(docs, location, word_tokenizer(), FILE_END_ID, files=2, frame_ids=20)
    all_rows = {r["doc_id"]: tuple(r) for r in read_token_files(spark, location).collect()}
    assert [tuple(r) for r in read_token_files(spark, location, [90, 7, 7, 1_000]).orderBy("doc_id").collect()] == [all_rows[7], all_rows[90]]
    assert read_token_files(spark, location, []).count() == 0
    # A damaged frame only harms those who ask for it.
    first = file_list(spark, location).orderBy("part").first()["file"]
    path = tmp_path / "t" / first
    frames = TokenFileReader(str(path)).seek
    raw = bytearray(path.read_bytes())
    raw[frames["place"][0].as_py() + 8 + frames["list_bytes"][0].as_py() + frames["data_bytes"][0].as_py() - 1] ^= 1
    path.write_bytes(raw)
    assert read_token_files(spark, location, [90]).count() == 1
    with pytest.raises(Exception, match="damaged"):
        read_token_files(spark, location, [0]).collect()
    with pytest.raises(Exception, match="damaged"):
        read_token_files(spark, location).collect()


def test_seek_table_and_footer_are_checked(tmp_path):
    path = str(tmp_path / "x.tokens")
    file = TokenFile(path, pa.int64(), 2)
    file.add(1, b"\x01\x00")
    file.close()
    raw = bytearray(open(path, "rb").read())
    for at, what in ((-30, "seek table"), (-1, "footer")):
        bad = bytearray(raw)
        bad[at] ^= 1
        open(path, "wb").write(bad)
        with pytest.raises(DamagedFile, match=what):
            TokenFileReader(path)


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    location = str(tmp_path / "t")
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    write_token_files(docs, location, word_tokenizer(), FILE_END_ID, files=2)
    (tmp_path / "t" / "part-000000-lost.tokens").write_bytes(b"half a file")
    assert read_token_files(spark, location).count() == 10


def test_one_id_and_one_text_of_all_rows_are_spread(spark, tmp_path):
    docs = spark.range(0, 400, 1, 8).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"))
    files = write_token_files(docs, str(tmp_path / "t"), word_tokenizer(), FILE_END_ID, files=4)
    assert files.count() > 1 and files.agg(F.max("documents")).first()[0] < 300
    assert [r["start"] for r in read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()] == list(range(0, 1_200, 3))


def test_ids_of_text_and_no_rows(spark, no_docs, tmp_path):
    docs = spark.createDataFrame([("b", "x", 1), (None, None, 2), ("a", "y z", 3)], "name string, body string, id int")
    write_token_files(docs, str(tmp_path / "t"), word_tokenizer(), FILE_END_ID, id_col="name", text_col="body")
    assert [r["name"] for r in read_token_files(spark, str(tmp_path / "t"), id_col="name").orderBy("start").collect()] == [None, "a", "b"]
    assert [r["name"] for r in read_token_files(spark, str(tmp_path / "t"), ["b"], id_col="name").collect()] == ["b"]
    write_token_files(no_docs, str(tmp_path / "n"), word_tokenizer(), FILE_END_ID)
    assert read_token_files(spark, str(tmp_path / "n")).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op13(spark, folder).collect()) == expected(rows)


def test_words_in_use_stay_remembered(monkeypatch):
    """op13_token_files fails the check (CPU): a full memory of words loses those that were not met lately, not all."""
    from varscope.llm import token_files
    from varscope.llm.queries import word_tokenizer

    monkeypatch.setattr(token_files, "REMEMBERED_WORDS", 40)
    encode, _ = token_files._make_encoder(**word_tokenizer())
    whole, _ = token_files._make_encoder(word_tokenizer()["json_path"], False)
    known = lambda: dict(zip(encode.__code__.co_freevars, encode.__closure__))["known"].cell_contents
    encode(["house"])
    first = known()["house"]
    for n in range(12):
        texts = ["house " + " ".join(f"{a}{b}{'abcdefghijkl'[n]}" for a in "bcdfg" for b in "aei") + ", Ünder 12 " + "x" * 90]
        assert encode(texts) == whole(texts)
    assert known()["house"] is first
    assert len(known()) < 80


def test_older_words_are_looked_up_not_walked():
    """op13_token_files fails the check (CPU): the older half of the memory was walked for every few texts."""
    from varscope.llm import token_files

    class Unwalked(dict):
        def __iter__(self):
            raise AssertionError("all older words are walked")

    encode, width = token_files._make_encoder(**word_tokenizer())
    whole, _ = token_files._make_encoder(word_tokenizer()["json_path"], False)
    cells = dict(zip(encode.__code__.co_freevars, encode.__closure__))
    cells["older"].cell_contents = Unwalked(house=whole(["house"])[0])
    for texts in (["house of mice, house", ""], ["house"], [""], [], ODD):
        assert encode(texts) == whole(texts)
    assert cells["known"].cell_contents["house"] is cells["older"].cell_contents["house"]


def test_slices_hold_little_text():
    """op13_token_files fails the check (CPU): texts are encoded by their bytes at a time, not by their number."""
    from varscope.llm.common import text_slices

    texts = ["", "é" * 4, "ab", "x" * 35, "", "abc", "a" * 9, ""]
    parts = [s["text"].to_pylist() for s in text_slices(pa.record_batch({"text": texts}), 10)]
    assert [t for p in parts for t in p] == texts and len(parts) > 2
    assert all(sum(len(t.encode()) for t in p) - max(len(t.encode()) for t in p) < 10 for p in parts)
    assert [len(s) for s in text_slices(pa.record_batch({"text": ["", ""]}), 10)] == [2]
