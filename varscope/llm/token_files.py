"""Token ids in binary files of independent zstandard frames, with a trailing seek table and a checksum per frame.

A file holds, for each frame, a skippable frame that lists its documents (ids and numbers of token ids) and a zstandard
frame with the token ids of these documents one after the other, little-endian, 16 bits wide where the vocabulary
allows it and 32 bits otherwise. It ends with a skippable frame: the seek table (place, sizes, checksums, first and last
document of every frame) and a footer of fixed size. Any zstandard tool unpacks a file to the plain array of token ids; a
reader of some documents reads the footer, the seek table, and the frames that hold them.
"""

from __future__ import annotations

import struct
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from varscope.llm.common import small_batches, text_slices

#: Token ids after which a frame ends, at the end of a document.
FRAME_IDS = 1 << 16
#: Frames that one task of a reader takes from a file.
FRAMES_PER_READ = 64
#: Tasks of a reader at most.
MOST_READS = 10_000
#: Compression level of zstandard.
LEVEL = 3
#: Words that an encoder remembers, in two halves of which the older goes, and the longest one.
REMEMBERED_WORDS, LONGEST_WORD = 1_000_000, 64
#: Words that are encoded at a time.
JOINED_WORDS = 1_000
#: Bytes of text whose words are looked up at a time.
SLICE_BYTES = 1 << 21
# Fixed values of the format: start of a skippable frame, and the footer: bytes of the seek table, its checksum, bytes of
# a token id, mark.
SKIPPABLE, FOOTER, FOOTER_BYTES, MARK = 0x184D2A50, "<QQB7s", 24, b"TOKENS1"
SEEK_FIELDS = [("place", pa.int64()), ("list_bytes", pa.int64()), ("data_bytes", pa.int64()), ("documents", pa.int64()),
               ("ids", pa.int64()), ("start", pa.int64()), ("list_sum", pa.uint64()), ("data_sum", pa.uint64())]


class DamagedFile(ValueError):
    """A part of a token file does not have the checksum that is kept for it."""


def open_store(location: str):
    """File system and path of a location: a path that all machines share, or a URI such as ``s3://`` or ``hdfs://``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(location.replace("s3a://", "s3://", 1))


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _checked(raw: bytes, expected: int, what: str) -> bytes:
    import xxhash

    if xxhash.xxh64_intdigest(raw) != expected:
        raise DamagedFile(f"{what} is damaged")
    return raw


class TokenFile:
    """Writer of one file: documents are added in the order in which they are kept."""

    def __init__(self, location: str, id_type: pa.DataType, width: int, frame_ids: int = FRAME_IDS):
        import zstandard

        store, path = open_store(location)
        self.sink = store.open_output_stream(path)
        self.id_type, self.width, self.frame_ids = id_type, width, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[tuple[object, bytes]] = []
        self.seek: list[tuple] = []
        self.bounds: list[tuple[object, object]] = []
        self.place = self.ids = self.documents = self.pending = 0

    def add(self, key: object, raw: bytes) -> None:
        """Keep the token ids ``raw`` (``width`` bytes each) of the document ``key``."""
        self.held.append((key, raw))
        self.pending += len(raw) // self.width
        if self.pending >= self.frame_ids:
            self._end_frame()

    def _skippable(self, payload: bytes) -> bytes:
        return struct.pack("<II", SKIPPABLE, len(payload)) + payload

    def _end_frame(self) -> None:
        import xxhash

        if not self.held:
            return
        keys, parts = [k for k, _ in self.held], [r for _, r in self.held]
        listed = _packed(pa.record_batch({
            "id": pa.array(keys, self.id_type), "ids": pa.array([len(r) // self.width for r in parts], pa.int64())}))
        raw = b"".join(parts)
        data = self.compressor.compress(raw)
        head = self._skippable(listed)
        self.sink.write(head)
        self.sink.write(data)
        self.seek.append((self.place, len(listed), len(data), len(keys), self.pending, self.ids,
                          xxhash.xxh64_intdigest(listed), xxhash.xxh64_intdigest(raw)))
        self.bounds.append((keys[0], keys[-1]))
        self.place += len(head) + len(data)
        self.ids += self.pending
        self.documents += len(keys)
        self.held, self.pending = [], 0

    def close(self) -> dict:
        """End the file; what a list of files keeps of it."""
        import xxhash

        self._end_frame()
        fields = {name: pa.array([row[n] for row in self.seek], kind) for n, (name, kind) in enumerate(SEEK_FIELDS)}
        fields |= {"first_id": pa.array([a for a, _ in self.bounds], self.id_type),
                   "last_id": pa.array([b for _, b in self.bounds], self.id_type)}
        table = _packed(pa.record_batch(fields))
        self.sink.write(self._skippable(table + struct.pack(FOOTER, len(table), xxhash.xxh64_intdigest(table), self.width, MARK)))
        self.sink.close()
        return {"first_id": self.bounds[0][0], "last_id": self.bounds[-1][1], "frames": len(self.seek),
                "documents": self.documents, "ids": self.ids}


class TokenFileReader:
    """Reader of one file; it fetches the footer, the seek table, and then only the frames that are asked for."""

    def __init__(self, location: str):
        self.location = location
        store, path = open_store(location)
        self.source = store.open_input_file(path)
        size = self.source.size()
        if size < FOOTER_BYTES:
            raise DamagedFile(f"{location} has no footer")
        length, mark_sum, self.width, mark = struct.unpack(FOOTER, self._at(size - FOOTER_BYTES, FOOTER_BYTES))
        if mark != MARK or length + FOOTER_BYTES > size:
            raise DamagedFile(f"{location} has no footer")
        self.seek = _unpacked(_checked(self._at(size - FOOTER_BYTES - length, length), mark_sum, f"the seek table of {location}"))

    def _at(self, place: int, length: int) -> bytes:
        return self.source.read_at(length, place)

    def frames_of(self, wanted: Sequence) -> list[int]:
        """Numbers of the frames that may hold one of the sorted ids ``wanted``."""
        import bisect

        found = []
        for n, (first, last) in enumerate(zip(self.seek["first_id"].to_pylist(), self.seek["last_id"].to_pylist())):
            # Documents without an id come first, so that only a first id can be null while the last is not.
            at = 0 if first is None else bisect.bisect_left(wanted, first)
            if last is not None and at < len(wanted) and wanted[at] <= last:
                found.append(n)
        return found

    def frame(self, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the documents of a frame, their starts in the file, their numbers of token ids, and all token ids."""
        import zstandard

        row = {name: self.seek[name][n].as_py() for name, _ in SEEK_FIELDS}
        what = f"frame {n} of {self.location}"
        listed = _unpacked(_checked(self._at(row["place"] + 8, row["list_bytes"]), row["list_sum"], f"the list of {what}"))
        data = self._at(row["place"] + 8 + row["list_bytes"], row["data_bytes"])
        try:
            raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=row["ids"] * self.width)
        except zstandard.ZstdError as error:
            raise DamagedFile(f"{what} is damaged") from error
        ids = np.frombuffer(_checked(raw, row["data_sum"], what), dtype=f"<u{self.width}")
        counts = listed["ids"].to_numpy()
        return listed["id"], row["start"] + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts, ids

    def close(self) -> None:
        self.source.close()


def kept_by_worker(name: str, make: Callable):
    """What ``make`` returned when the running Python worker first asked for ``name``; workers serve many tasks."""
    store = sys.modules.setdefault("varscope_worker_store", types.ModuleType("varscope_worker_store")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def word_encoder(json_path: str, by_words: bool):
    """Function from texts to little-endian token ids of the width that it also returns: (function, width).

    ``by_words`` says that no token of the vocabulary spans white space or a letter and a mark, and that case is
    ignored, so that a text's ids are those of its words. Words are then encoded by the tokenizer once and remembered
    by the worker: words of plain letters by its model alone, others many at a time with a special token between them,
    which the tokenizer never joins to anything. Texts that hold a special token's name are encoded whole.
    """
    return kept_by_worker(f"encoder {json_path} {by_words}", partial(_make_encoder, json_path, by_words))


def _make_encoder(json_path: str, by_words: bool):
    import os
    import re

    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = tokenizers.Tokenizer.from_file(json_path)
    special = {t.content: n for n, t in tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
    width = 2 if max(tokenizer.get_vocab().values()) < 1 << 16 else 4
    kind = f"<u{width}"

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=kind).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not by_words or not special:
        return whole, width
    between, stop = next(iter(special.items()))
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    plain = re.compile(f"[{letters}]+").fullmatch
    # How the tokenizer itself writes these letters for its model.
    written_as = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
    own_ascii = all(written_as[ord(c)] == c for c in letters if c.isascii())
    pieces = tokenizer.model.tokenize
    marks = {m: np.array(tokenizer.encode(m, add_special_tokens=False).ids, dtype=kind).tobytes() for m in ".,;:!?"}
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    packers = [struct.Struct(f"<{n}{'H' if width == 2 else 'I'}").pack for n in range(LONGEST_WORD + 1)]

    def lowered(text: str) -> str | None:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        if any(name in text for name in special):
            return None
        return text.replace("\n", " ")

    def encoded(word: str) -> bytes:
        found = pieces(word if own_ascii and word.isascii() else word.translate(written_as))
        if len(found) <= LONGEST_WORD:
            return packers[len(found)](*[t.id for t in found])
        return np.array([t.id for t in found], dtype=kind).tobytes()

    def by_word(texts: list[str]) -> list[bytes]:
        nonlocal known, older
        if len(known) > REMEMBERED_WORDS // 2:
            known, older = {}, known
        plains = [lowered(t) for t in texts]
        split = pc.split_pattern(pa.array([t or "" for t in plains], pa.string()), " ")
        places = split.flatten().dictionary_encode()
        words = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(words).difference(known)
        # Words in use stay when the older half goes. Of the two, the new words are few: they are looked up.
        again = [w for w in new if w in older]
        known.update(zip(again, map(older.__getitem__, again)))
        new.difference_update(again)
        odd, marked = [], []
        for word in new:
            if plain(word):
                known[word] = encoded(word)
            elif word[-1:] in marks and plain(word[:-1]):
                marked.append(word)
            else:
                odd.append(word)
        # One mark after a word of letters is a token of its own.
        for word in marked:
            own = known.get(word[:-1])
            known[word] = (encoded(word[:-1]) if own is None else own) + marks[word[-1]]
        for at in range(0, len(odd), JOINED_WORDS):
            part = odd[at:at + JOINED_WORDS]
            ids = np.array(tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype=kind)
            raw = ids.tobytes()
            cuts = [0, *((np.nonzero(ids == stop)[0] + 1) * width).tolist(), len(raw) + width]
            known.update((w, raw[a:b - width]) for w, a, b in zip(part, cuts, cuts[1:]))
        # Distinct words are looked up once; their ids are then copied to wherever the words stand.
        found = list(map(known.__getitem__, words))
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // width
        at_word = places.indices.to_numpy()
        lasting = lengths[at_word]
        ends = np.concatenate([[0], np.cumsum(lasting)])
        shift = (np.cumsum(lengths) - lengths)[at_word] - ends[:-1]
        raw = np.frombuffer(b"".join(found), dtype=kind)[np.repeat(shift, lasting) + np.arange(ends[-1])].tobytes()
        bounds = (ends[split.offsets.to_numpy()] * width).tolist()
        out = [whole([t])[0] if p is None else raw[a:b] for t, p, a, b in zip(texts, plains, bounds, bounds[1:])]
        for word in [w for w in new if len(w) > LONGEST_WORD]:
            del known[word]
        return out

    return by_word, width


def write_token_files(docs: DataFrame, location: str, tokenizer: dict, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", files: int | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode the texts, add ``end_id`` to each, and write token files to ``location`` in ascending order of the ids.

    ``tokenizer`` has ``json_path`` (a file of the tokenizers library) and ``by_words`` (see ``word_encoder``).
    Returns the list of files, which is kept at ``location`` too (part, file, first_id, last_id, frames, documents,
    ids): it names the files of the tasks that Spark counted, so that files of lost or repeated tasks are never read.
    Rows are dealt to files by ranges of the id, then of a hash of the text and of the partition they come from, so that
    an id or a text with a third of all rows is spread over many files. ``files`` is their number, the session's
    number of shuffle partitions at most by default. A task holds a batch of texts and one frame.

    Null and empty texts are the end id alone. Rows with a null id come first. Repeated ids are kept as often as they
    occur. No rows give a list without files. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mix"), F.spark_partition_id().alias("from"))
    order = [F.col("id").asc_nulls_first(), F.col("mix"), F.col("from")]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    kind = dict(rows.dtypes)["id"]
    location = location.rstrip("/")
    store, path = open_store(location)
    store.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, file, name = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not len(batch):
                continue
            if file is None:
                encode, width = word_encoder(**tokenizer)
                end = int(end_id).to_bytes(width, "little")
                # Each attempt writes a file of its own; the list of files names the one that counts.
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
                file = TokenFile(f"{location}/{name}", batch["id"].type, width, frame_ids)
            for some in text_slices(batch, SLICE_BYTES):
                for key, raw in zip(some["id"].to_pylist(), encode(some["text"].to_pylist())):
                    file.add(key, raw + end)
        if file is not None:
            told = file.close()
            yield pa.record_batch({
                "part": pa.array([part], pa.int32()), "file": [name], "first_id": pa.array([told["first_id"]], file.id_type),
                "last_id": pa.array([told["last_id"]], file.id_type), "frames": pa.array([told["frames"]], pa.int64()),
                "documents": pa.array([told["documents"]], pa.int64()), "ids": pa.array([told["ids"]], pa.int64())})

    schema = f"part int, file string, first_id {kind}, last_id {kind}, frames bigint, documents bigint, ids bigint"
    dealt.sortWithinPartitions(*order).select("id", "text").mapInArrow(write, schema).write.parquet(f"{location}/files")
    return file_list(spark, location)


def file_list(spark: SparkSession, location: str) -> DataFrame:
    """The files at ``location``, a row each, with ``start``: the token ids of all files before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per file, not per document.
    return spark.read.parquet(f"{location.rstrip('/')}/files").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, location: str, wanted: Sequence | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids) from the files at ``location``; ``start`` counts the token ids of all documents
    before, ``ids`` are little-endian unsigned 32-bit integers.

    ``wanted`` is a list of document ids, all documents where it is None: then only files whose range holds one of
    them are opened, and only the frames that may hold one are read and unpacked. A frame that does not fit its
    checksum raises ``DamagedFile``. Documents with a null id are only read with all others.
    """
    location = location.rstrip("/")
    files = file_list(spark, location)
    asked = None if wanted is None else sorted(set(wanted))
    if asked is not None:
        files = files.where(F.exists(F.array(*[F.lit(x) for x in asked]), lambda x: x.between(
            F.coalesce("first_id", x), F.col("last_id"))) if asked else F.lit(False))
    kind = dict(files.dtypes)["first_id"]
    reads = files.select("file", "start", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(FRAMES_PER_READ))).alias("frame"))
    # The rows are few and small: dealt by number, they are not put together in one task.
    reads = reads.repartition(max(1, min(reads.count(), MOST_READS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFileReader(f"{location}/{row['file']}")
                frames = range(row["frame"], min(row["frame"] + FRAMES_PER_READ, len(file.seek)))
                if asked is not None:
                    frames = [n for n in file.frames_of(asked) if n in frames]
                for n in frames:
                    keys, starts, counts, ids = file.frame(n)
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    pick = range(len(keys))
                    if asked is not None:
                        pick = np.nonzero(pc.is_in(keys, pa.array(asked, keys.type)).to_numpy(zero_copy_only=False))[0].tolist()
                    yield pa.record_batch({
                        id_col: keys.take(pa.array(pick, pa.int64())), "start": pa.array(row["start"] + starts[pick], pa.int64()),
                        "n_tokens": pa.array(counts[pick], pa.int64()),
                        "ids": pa.array([ids[bounds[k]:bounds[k + 1]].astype("<u4").tobytes() for k in pick], pa.binary())})
                file.close()

    return reads.mapInArrow(read, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids binary")
