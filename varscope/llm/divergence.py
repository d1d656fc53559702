"""Divergence of sources within a language, from an index of their terms that is built in memory and merged from runs."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count as numbers_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.llm.common import buckets_for, rank_in_groups, small_batches, text_slices, written
from varscope.llm.vector_sums import add_vectors, vector_batches

#: Postings (a term in a group) that a task holds before it lets go of a run.
RUN_POSTINGS = 1_000_000
#: Rows of a batch of a run.
RUN_BATCH = 50_000
#: Sources of a cell, on average at most: the postings of a term in the sources of a cell are merged together.
CELL_SOURCES = 4_096
#: Postings of a row of a run that is shuffled, and postings that are merged at a time.
LIST_POSTINGS, FOLDED_POSTINGS = 256, 50_000
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000
#: Sources of a tile: the sums of a pair of tiles are a matrix.
TILE = 64
#: Matrices that a task holds.
HELD_TILES = 500
#: Cells by which sources are numbered.
CELLS = 64
#: Sums are kept in two parts, the lower one of so many bits, so that none can overflow.
LOW_BITS = 30
# A letter is A to Z in either case or any character beyond ASCII; everything else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POSTING = ["lang", "term", "source"]
_COLUMNS = ["lang", "source", "term", "documents", "count"]
_FOLDED = ["lang", "term", "cell"]
# Of many runs, the term first: Spark's sort tells most rows apart by the first bytes of its first key.
_MERGED = ["term", "lang", "cell"]


def index_runs(batches: Iterator[pa.RecordBatch], run_postings: int) -> Iterator[pa.RecordBatch]:
    """Term-sorted runs of postings (lang, source, term, documents, count) of the texts of a task.

    Some texts at a time are counted by group (lang, source) and term, as numbers; when the counts held reach
    ``run_postings``, equal ones are added, and if they stay half as many, they are let go as one sorted run, and
    counting starts anew.
    """
    groups, terms = _numbering(), _numbering()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def run() -> Iterator[pa.RecordBatch]:
        key, documents, counts = held[0]
        names = pa.array(list(terms), pa.binary())
        langs, sources = (np.unique(np.array([g[n] for g in groups], dtype=object), return_inverse=True)[1] for n in (0, 1))
        group, term = key >> 32, key & 0xFFFFFFFF
        rank = np.empty(len(names), dtype=np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((sources[group], langs[group] * len(names) + rank[term]))
        which, term = pa.array(group[order]), pa.array(term[order])
        table = pa.record_batch({
            "lang": pa.array([g[0] for g in groups], pa.string()).take(which), "source": pa.array([g[1] for g in groups], pa.string()).take(which),
            "term": names.take(term), "documents": documents[order], "count": counts[order]})
        for at in range(0, len(table), RUN_BATCH):
            yield table.slice(at, RUN_BATCH)

    for batch in batches:
        for some in text_slices(batch, 2 * run_postings):
            found = _counted(some, groups, terms)
            held.append(found)
            size += len(found[0])
            if size < run_postings:
                continue
            held = [_added(held)]
            size = len(held[0][0])
            if 2 * size >= run_postings:
                yield from run()
                groups, terms, held, size = _numbering(), _numbering(), [], 0
    if size:
        held = [_added(held)]
        yield from run()


def _numbering() -> dict:
    """A dictionary that numbers new keys as they are asked for."""
    return defaultdict(numbers_from().__next__)


def _counted(texts: pa.RecordBatch, groups: dict[tuple[str, str], int], terms: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Documents and count of each group and term of some texts; keys are the number of the group and, in the lower 32
    bits, that of the term. ``groups`` and ``terms`` number what is new to them."""
    lowered = pa.array([t.translate(_LETTERS) for t in texts["text"].to_pylist()], pa.binary())
    split = pc.split_pattern(lowered.view(pa.string()), " ")
    words = split.flatten().dictionary_encode()
    names = words.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    word = words.indices.to_numpy().astype(np.int64)
    document = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if b"" in names:
        there = word != names.index(b"")
        word, document = word[there], document[there]
    # A group is known by its first document here; numbers of what occurs here are short, so that two make a key.
    pairs = list(zip(texts["lang"].to_pylist(), texts["source"].to_pylist()))
    first: dict[tuple[str, str], int] = {}
    group = np.array([first.setdefault(pair, n) for n, pair in enumerate(pairs)], dtype=np.int64)
    bits = len(names).bit_length()
    low = (1 << bits) - 1
    keys, counts = _distinct(group[document] << bits | word)
    once, _ = _distinct(document << bits | word)
    _, documents = _distinct(group[once >> bits] << bits | once & low)
    group_number, term_number = np.zeros(len(texts), dtype=np.int64), np.array(list(map(terms.__getitem__, names)), dtype=np.int64)
    used = np.unique(keys >> bits).tolist()
    group_number[used] = [groups[pairs[n]] for n in used]
    return group_number[keys >> bits] << 32 | term_number[keys & low], documents, counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often they occur."""
    keys = np.sort(keys)
    starts = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[starts], np.diff(starts, append=len(keys))


def _added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Documents and counts of equal keys added up, in order of the keys."""
    key, documents, counts = (np.concatenate(part) for part in zip(*held))
    order = np.argsort(key)
    key = key[order]
    starts = np.nonzero(np.diff(key, prepend=-1))[0]
    return key[starts], np.add.reduceat(documents[order], starts), np.add.reduceat(counts[order], starts)


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether a row differs from the row before in one of the columns; the first row does."""
    new = np.zeros(len(batch), dtype=bool)
    new[:1] = True
    for name in names:
        column = batch[name]
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


def fold_runs(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, cell, source, documents, count) of runs: the last three are lists of ``LIST_POSTINGS`` postings at
    most, whose sources are of one cell."""
    for batch in batches:
        source = batch["source"].dictionary_encode()
        cell = np.array([zlib.crc32(s.encode()) % cells for s in source.dictionary.to_pylist()], dtype=np.int64)[source.indices.to_numpy()]
        if cells > 1:
            # Rows of a language and term are together; among them, those of a cell are put together.
            order = np.lexsort((cell, np.cumsum(_changes(batch, ["lang", "term"]))))
            batch, cell = batch.take(pa.array(order)), cell[order]
        starts = np.nonzero(_changes(batch, ["lang", "term"]) | (np.diff(cell, prepend=-1) != 0))[0]
        place = np.arange(len(batch)) - np.repeat(starts, np.diff(starts, append=len(batch)))
        starts = np.nonzero(place % LIST_POSTINGS == 0)[0]
        first, offsets = pa.array(starts), pa.array(np.append(starts, len(batch)), pa.int32())
        yield pa.record_batch({"lang": batch["lang"].take(first), "term": batch["term"].take(first), "cell": cell[starts]} | {
            name: pa.ListArray.from_arrays(offsets, batch[name]) for name in ("source", "documents", "count")})


def unfold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows of ``fold_runs`` in order of language, term and cell; those of equal keys follow each other.

    Rows are taken together until they hold ``FOLDED_POSTINGS``. The postings of their last language, term and cell
    wait, added up, for the next rows.
    """
    def postings(folded: pa.RecordBatch) -> pa.RecordBatch:
        row = pa.array(np.repeat(np.arange(len(folded)), np.diff(folded["source"].offsets.to_numpy())))
        return pa.record_batch({n: folded[n].take(row) if n in _FOLDED else folded[n].flatten() for n in folded.schema.names})

    def ordered(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, int]:
        """The postings with those of equal keys together, and where the last language, term and cell begins."""
        key = np.cumsum(_changes(batch, _FOLDED))
        source = batch["source"].dictionary_encode()
        order = np.argsort(key * len(source.dictionary) + source.indices.to_numpy())
        return batch.take(pa.array(order)), int(np.searchsorted(key, key[-1]))

    waiting: list[pa.RecordBatch] = []
    rows: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None and len(batch):
            rows.append(postings(batch))
            size += len(rows[-1])
        if not rows or batch is not None and size < FOLDED_POSTINGS:
            continue
        found, last = ordered(pa.Table.from_batches([*waiting, *rows]).combine_chunks().to_batches()[0])
        rows, size = [], 0
        if last:
            yield found.slice(0, last).select(_COLUMNS)
        waiting = _merged(found.slice(last))
    for batch in waiting:
        yield batch.select(_COLUMNS)


def _merged(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The postings of one language, term and cell with those of equal keys added."""
    cell = batch["cell"][0]
    return [pa.record_batch([*b.columns, pa.array([cell.as_py()] * len(b), pa.int64())], names=[*b.schema.names, "cell"]).select(
        batch.schema.names) for b in merge_runs(iter([batch.select(_COLUMNS)]))]


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the postings of equal keys, which follow each other; the last key of a batch waits for the next batch."""
    waiting = None
    for batch in batches:
        if not len(batch):
            continue
        batch = pa.record_batch(batch.columns, names=batch.schema.names)
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        starts = np.nonzero(_changes(batch, _POSTING))[0]
        sums = {n: pa.array(np.add.reduceat(batch[n].to_numpy(), starts)) for n in ("documents", "count")}
        keys = batch.take(pa.array(starts))
        added = pa.record_batch([sums.get(n, keys[n]) for n in batch.schema.names], names=batch.schema.names)
        waiting = added.slice(len(added) - 1)
        if len(added) > 1:
            yield added.slice(0, len(added) - 1)
    if waiting is not None:
        yield waiting


def term_frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     run_postings: int = RUN_POSTINGS) -> DataFrame:
    """Rows (lang, source, term, documents, count): documents of the group with the term, and its occurrences.

    Tasks index their texts in memory and write term-sorted runs, a row with lists for each language and term. A shard
    is a hash of language, term and cell of sources, of which a language with many sources has several, so that a common
    term of many sources is spread; there Spark's sort merges the runs, and equal keys are added as they pass.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    most = rows.select("lang", "source").distinct().groupBy("lang").count().agg(F.max("count")).first()[0]
    cells = buckets_for(most or 0, CELL_SOURCES)
    runs = rows.mapInArrow(
        lambda batches: fold_runs(index_runs(batches, run_postings), cells),
        "lang string, term binary, cell bigint, source array<string>, documents array<bigint>, count array<bigint>")
    merged = runs.repartition(*_FOLDED).sortWithinPartitions(*_MERGED).mapInArrow(
        lambda batches: merge_runs(unfold_runs(batches)), "lang string, source string, term binary, documents bigint, count bigint")
    return merged.withColumn("term", F.col("term").cast("string"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), in whole numbers of any size; in 64 bits where the product fits them."""
    short = F.call_function("div", (count + 1).cast("bigint") * F.lit(UNIT).cast("bigint"), total.cast("bigint"))
    wide = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    wide = F.call_function("div", wide, total.cast("decimal(20,0)"))
    return F.lit(1).cast("bigint") + F.when(count < F.lit(((1 << 63) - 1) // UNIT - 1), short).otherwise(wide)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class PairSums:
    """Matrices of sums by pair of tiles; a full store is let go of as partial sums."""

    def __init__(self):
        self.held: dict[tuple[str, int, int], np.ndarray] = {}

    def add(self, key: tuple[str, int, int], rows: np.ndarray | int, columns: np.ndarray | int, values: np.ndarray,
            times: np.ndarray | None = None, axis: int | None = None) -> None:
        """Add whole numbers below 2**62 to places of a matrix, ``times`` over, summed along ``axis`` first."""
        sums = self.held.get(key)
        if sums is None:
            sums = self.held[key] = np.zeros((2, TILE, TILE), dtype=np.int64)
        for side, part in enumerate((values >> LOW_BITS, values & ((1 << LOW_BITS) - 1))):
            if times is not None:
                part = part * times
            sums[side, rows, columns] += part if axis is None else part.sum(axis)

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.held) >= HELD_TILES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        rows = [(*key, sums.ravel()) for key, sums in self.held.items()]
        self.held = {}
        yield from vector_batches(rows, ["lang", "tile", "tile2"], [pa.string(), pa.int64(), pa.int64()])


def _dense(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the terms of a batch by slot of a tile, whether there are any, and the slots' shares without any."""
    lists = batch["members" + side]
    row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    slot = flat.field("slot").to_numpy()
    p, none = np.ones((len(batch), TILE), dtype=np.int64), np.ones(TILE, dtype=np.int64)
    there = np.zeros((len(batch), TILE), dtype=bool)
    p[row, slot], there[row, slot] = flat.field("p").to_numpy(), True
    none[slot] = flat.field("none").to_numpy()
    return p, there, none


def both_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that two sources of a language share, of what both counts add beyond one count and none.

    A row is a term of a language with its sources of a tile and of the same or a later tile.
    """
    sums = PairSums()
    for batch in batches:
        # Rows of one language and pair of tiles are taken together.
        order = pc.sort_indices(batch, sort_keys=[("lang", "ascending"), ("tile", "ascending"), ("tile2", "ascending")])
        batch = batch.take(order)
        keys = list(zip(batch["lang"].to_pylist(), batch["tile"].to_pylist(), batch["tile2"].to_pylist()))
        edges = [0, *[n for n in range(1, len(keys)) if keys[n] != keys[n - 1]], len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            lang, one, two = keys[a]
            p, there, p0 = _dense(batch.slice(a, b - a), "")
            q, there2, q0 = _dense(batch.slice(a, b - a), "2")
            used = np.nonzero(there2.any(0))[0]
            for slot in np.nonzero(there.any(0))[0].tolist():
                rows = there[:, slot]
                x, x0 = p[rows, slot][:, None], p0[slot]
                y, y0 = q[rows][:, used], q0[used][None, :]
                shared = there2[rows][:, used]
                forth = _excess(x, y) - _excess(x, y0) - _excess(x0, y) + _excess(x0, y0)
                sums.add((lang, one, two), slot, used, np.where(shared, forth, 0), axis=0)
                if one != two:
                    back = _excess(y, x) - _excess(y0, x) - _excess(y, x0) + _excess(y0, x0)
                    sums.add((lang, two, one), used, slot, np.where(shared, back, 0), axis=0)
        yield from sums.full()
    yield from sums.rest()


def one_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of a source of what its counts add against sources without these terms.

    A row is a count of a source with the number of its terms that occur so often, and a tile of sources.
    """
    sums = PairSums()
    for batch in batches:
        for row in batch.to_pylist():
            slot, x, x0, times = row["slot"], np.int64(row["p"]), np.int64(row["none"]), np.int64(row["terms"])
            others = np.array([m["slot"] for m in row["others"]], dtype=np.int64)
            y0 = np.array([m["none"] for m in row["others"]], dtype=np.int64)
            sums.add((row["lang"], row["tile"], row["tile2"]), slot, others, _excess(x, y0) - _excess(x0, y0), times)
            sums.add((row["lang"], row["tile2"], row["tile"]), others, slot, _excess(y0, x) - _excess(y0, x0), times)
        yield from sums.full()
    yield from sums.rest()


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, a, b, high, low) of matrices, a and b the numbers of two sources."""
    for batch in batches:
        for row in batch.to_pylist():
            high, low = np.frombuffer(row["sums"], dtype="<i8").reshape(2, TILE, TILE)
            a, b = np.nonzero((high != 0) | (low != 0))
            yield pa.record_batch({
                "lang": pa.array([row["lang"]] * len(a), pa.string()), "a": pa.array(row["tile"] * TILE + a), "b": pa.array(row["tile2"] * TILE + b),
                "high": pa.array(high[a, b]), "low": pa.array(low[a, b])})


def pair_values(kept: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for all ordered pairs of sources of a language: the sum of ``excess`` over all
    kept terms of the language.

    The sum as if neither source had any term is corrected for the terms of each, by count, and then for the terms that
    both have; the last are streamed by term and added to matrices of pairs of tiles of sources.
    """
    none = share(F.lit(0), F.col("total"))
    number = members.withColumn("none", none).withColumn("tile", F.floor(F.col("member") / TILE).cast("bigint")).withColumn(
        "slot", F.col("member") % TILE)
    number = written(number.select("lang", "source", "member", "terms", "total", "none", "tile", "slot"), "divergence-members")
    placed = kept.join(number.select("lang", "source", "total", "none", "tile", "slot"), ["lang", "source"])
    placed = placed.withColumn("p", share(F.col("count"), F.col("total")))
    tiles = placed.repartition("lang", "term").groupBy("lang", "term", "tile").agg(F.collect_list(F.struct("slot", "p", "none")).alias("members"))
    tiles = written(tiles, "term-tiles")
    both = tiles.join(tiles.select("lang", "term", F.col("tile").alias("tile2"), F.col("members").alias("members2")), ["lang", "term"])
    vectors = "lang string, tile bigint, tile2 bigint, sums binary"
    both = both.where("tile <= tile2").select("lang", "tile", "tile2", "members", "members2").mapInArrow(both_corrections, vectors)
    counts = placed.groupBy("lang", "source", "tile", "slot", "none", "p").agg(F.count(F.lit(1)).alias("terms"))
    others = number.groupBy("lang", F.col("tile").alias("tile2")).agg(F.collect_list(F.struct("slot", "none")).alias("others"))
    one = counts.join(others, "lang").select("lang", "tile", "slot", "p", "none", "terms", "tile2", "others").mapInArrow(one_corrections, vectors)
    sums = add_vectors(both.unionByName(one), ["lang", "tile", "tile2"]).mapInArrow(
        _unfold, "lang string, a bigint, b bigint, high bigint, low bigint")
    side = lambda end: number.select("lang", F.col("member").alias(end), F.col("source").alias(f"source_{end}"), "terms",
                                     F.col("none").alias(f"none_{end}"))
    # A source meets the others of its language tile by tile, so that the pairs of a language are spread.
    tile_of = lambda end: F.floor(F.col(end) / TILE).cast("bigint")
    last = number.groupBy("lang").agg(F.max("tile").alias("last"))
    left = side("a").join(last, "lang").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).drop("last")
    right = side("b").drop("terms").withColumn("tile", tile_of("b"))
    pairs = left.join(right, ["lang", "tile"]).where("a <> b").join(sums, ["lang", "a", "b"], "left")
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
    base = F.col("terms").cast("decimal(18,0)") * excess(F.col("none_a"), F.col("none_b")).cast("decimal(19,0)")
    value = (base + wide("high") * F.lit(1 << LOW_BITS).cast("decimal(10,0)") + wide("low")).cast("bigint")
    return pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("value"))


def audit_divergence(docs: DataFrame, least_documents: int = 3, top_terms: int = 200, text_col: str = "text",
                     lang_col: str = "lang", source_col: str = "source", run_postings: int = RUN_POSTINGS) -> DataFrame:
    """How far the sources of each language are from each other and from the language: lang, source, part, item, value, rank.

    Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A language keeps the terms of at least
    ``least_documents`` of its documents. The share of a kept term in a group is 1 + floor(UNIT * (count + 1) / total),
    total being the group's kept occurrences and one for each kept term. Part ``pair`` has every other source of the
    language with the sum over all kept terms of floor((p - q)**2 / q), p the group's share and q the item's. Part
    ``term`` has the ``top_terms`` terms of the group whose share p is greatest against the language's share q by the
    same measure, p > q. Ranks go by value descending, then item by its bytes.

    Null texts, languages and sources are empty strings. Groups without terms have all pairs, with the shares of
    counts of 0; a language without kept terms has pairs of value 0. Repeated rows count as often as they occur. No
    rows give no rows; other columns are not read.
    """
    found = written(term_frequencies(docs, text_col, lang_col, source_col, run_postings), "term-frequencies")
    same = Window.partitionBy("lang", "term")
    kept = found.withColumn("lang_documents", F.sum("documents").over(same)).withColumn("lang_count", F.sum("count").over(same)).withColumn(
        "first", F.row_number().over(same.orderBy("source")) == 1).where(F.col("lang_documents") >= least_documents)
    kept = written(kept.select("lang", "source", "term", "count", "lang_count", "first"), "kept-terms")
    langs = written(kept.groupBy("lang").agg(F.sum(F.col("first").cast("bigint")).alias("terms"), F.sum("count").alias("lang_kept")), "languages")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("group_kept"))
    groups = docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source")).distinct()
    groups = groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    terms = F.coalesce("terms", F.lit(0))
    # A group whose language keeps nothing has no share to speak of; 1 keeps the division defined.
    groups = groups.select("lang", "source", terms.alias("terms"), F.greatest(F.coalesce("group_kept", F.lit(0)) + terms, F.lit(1)).alias("total"),
                           (F.coalesce("lang_kept", F.lit(0)) + terms).alias("lang_total"),
                           F.pmod(F.xxhash64("source"), F.lit(CELLS)).alias("cell"))
    members = written(rank_in_groups(written(groups, "source-groups"), ["lang"], ["cell"], ["source"], "member"), "source-members")
    p, q = share(F.col("count"), F.col("total")), share(F.col("lang_count"), F.col("lang_total"))
    own = kept.join(members.select("lang", "source", "total", "lang_total"), ["lang", "source"]).withColumn("p", p).withColumn("q", q)
    own = own.where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    pairs = pair_values(kept.select("lang", "source", "term", "count"), members).withColumn("rank", F.row_number().over(ranked))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(top, "term"))
