"""Interaction of filters, audited on sorted lists of the rows that fail them, for every order of the filters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from varscope.llm.common import SPACE, written
from varscope.llm.vector_sums import add_vectors, vector_batches

#: Bits of a row number within a block: a list of one block holds at most 2**BLOCK_BITS row numbers.
BLOCK_BITS = 20
#: Row numbers of one list that a step of a merge takes at least.
STRIDE = 4_096
#: Parts whose sums a task holds.
HELD_PARTS = 2_000
#: A text that at least one in this many rows has is joined by broadcast; there are at most as many such texts.
HOT_SHARE = 1_000
#: Filters of an audit at most; the report has a row for every order.
MOST_FILTERS = 6


def gallop(ids: np.ndarray, at: int, bound: int) -> int:
    """First place from ``at`` on whose id is greater than ``bound``: steps that double, then halving in the last one."""
    step, low = 1, at
    while low + step <= len(ids) and ids[low + step - 1] <= bound:
        low += step
        step *= 2
    return low + int(np.searchsorted(ids[low:low + step], bound, side="right"))


def merged_windows(lists: list[np.ndarray], stride: int = STRIDE) -> Iterator[list[np.ndarray]]:
    """Sorted lists cut at common ids: each window has the ids of a range from every list.

    A range ends where the first of the lists is ``stride`` ids further, so that a window holds at most that many of
    each list; the others gallop to this id.
    """
    at = [0] * len(lists)
    while True:
        open_lists = [n for n, ids in enumerate(lists) if at[n] < len(ids)]
        if not open_lists:
            return
        bound = min(int(lists[n][min(at[n] + stride, len(lists[n])) - 1]) for n in open_lists)
        ends = [gallop(ids, a, bound) if a < len(ids) else a for ids, a in zip(lists, at)]
        yield [ids[a:b] for ids, a, b in zip(lists, at, ends)]
        at = ends


def difference_sizes(fails: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Sizes [filter, set, mark]: rows that fail a filter and none of a set of other filters, in all and by mark.

    The lists are merged window by window. Within a window each list becomes its places in the union of all, from which
    the unions of all sets and what each filter adds to them follow.
    """
    k = len(fails)
    sizes = np.zeros((k, 1 << k, 1 + len(marks)), dtype=np.int64)
    for window in merged_windows([*fails, *marks]):
        ids = np.unique(np.concatenate(window[:k]))
        if not len(ids):
            continue
        has = np.zeros((k, len(ids)), dtype=bool)
        for n in range(k):
            has[n, np.searchsorted(ids, window[n])] = True
        marked = [np.ones(len(ids), dtype=bool)]
        for rows in window[k:]:
            place = np.searchsorted(ids, rows)
            there = place < len(ids)
            there[there] = ids[place[there]] == rows[there]
            marked.append(np.zeros(len(ids), dtype=bool))
            marked[-1][place[there]] = True
        unions = np.zeros((1 << k, len(ids)), dtype=bool)
        for chosen in range(1, 1 << k):
            low = (chosen & -chosen).bit_length() - 1
            unions[chosen] = unions[chosen & (chosen - 1)] | has[low]
        for n in range(k):
            if not has[n].any():
                continue
            for chosen in range(1 << k):
                if not chosen >> n & 1:
                    rest = has[n] & ~unions[chosen]
                    for m, mark in enumerate(marked):
                        sizes[n, chosen, m] += np.count_nonzero(rest & mark)
    return sizes


def earlier_copies(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (row, id, part, digest) those with the digest of a row with a smaller id: (row, part).

    Few digests can have a thousandth of all rows; these are joined by broadcast, which leaves no key hot.
    """
    repeated = written(rows.where("id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-texts")
    least = max(2, rows.count() // HOT_SHARE)
    hot = F.broadcast(repeated.where(F.col("n") >= least).select("digest", "least"))
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(repeated.where(F.col("n") < least), "digest")
    found = rows.join(hot, "digest").select("row", "part", "id", "least").unionByName(rest.select("row", "part", "id", "least"))
    return found.where("id > least").select("row", "part")


def failing_lists(docs: DataFrame, filters: Mapping[str, Column | str], labels: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Sorted lists (part, block, list, rows) of the rows that fail each filter, and the rows (row, id, part) numbered.

    ``filters`` names a condition of failure on the columns ``text`` and ``words`` (array of the text's words), or
    ``"copy"`` for texts that a row with a smaller id has too. ``labels`` (id, good, toxic: boolean) adds the lists
    ``good`` and ``toxic``. A block is a range of row numbers.
    """
    names = list(filters)
    if not names or len(names) > MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(names)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    bits = F.lit(0)
    for n, name in enumerate(names):
        if not isinstance(filters[name], str):
            bits = bits.bitwiseOR(F.when(filters[name], 1 << n).otherwise(0))
    copies = [n for n, name in enumerate(names) if isinstance(filters[name], str)]
    digest = [F.unhex(F.sha2("text", 256)).alias("digest")] if copies else []
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "part", bits.alias("bits"), *digest), "filter-rows")
    found = rows.where("bits > 0").select("row", "part", "bits")
    for n in copies:
        found = found.unionByName(earlier_copies(rows).withColumn("bits", F.lit(1 << n)))
    marks = ["good", "toxic"] if labels is not None else []
    if labels is not None:
        told = labels.groupBy("id").agg(*[F.max(F.coalesce(F.col(m), F.lit(False))).alias(m) for m in marks]).where("good OR toxic")
        mark_bits = sum(F.when(F.col(m), 1 << len(names) + n).otherwise(0) for n, m in enumerate(marks))
        found = found.unionByName(rows.select("row", "part", "id").join(told, "id").select("row", "part", mark_bits.alias("bits")))
    lists = found.withColumn("block", F.shiftright("row", BLOCK_BITS)).groupBy("part", "block").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("bits").bitwiseAND(1 << n) > 0, F.col("row")))).alias(f"list{n}")
        for n in range(len(names) + len(marks))])
    return written(lists, "failing-lists"), rows.select("row", "id", "part")


def audit_filters(docs: DataFrame, filters: Mapping[str, Column | str], labels: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter removes at each step of every order, per part: one row per part, filter_order and step.

    Columns: part, filter_order (the filters' names in order), step (from 1), kept (rows after this step), removed
    (here), redundant (failing the step's filter, removed earlier), unique_fails (failing no other filter), good_lost
    and toxic_lost (removed here and so labelled), shapley (the filter's removed, summed over all orders).

    Words are maximal runs without white space. A null text is empty, a null part the empty string. Rows with a null
    id are never copies of a row, nor rows of them, and have no label. Repeated rows count as often as they occur; of
    rows with equal ids none is a copy of the other; several labels of an id count as each of them. Conditions that
    are null do not fail. No rows give no rows; other columns are not read.
    """
    names = list(filters)
    k, depth = len(names), 1 + (2 if labels is not None else 0)
    lists, rows = failing_lists(docs, filters, labels, id_col, text_col, part_col)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in range(len(batch)):
                own = [batch[f"list{n}"][row].values.to_numpy() for n in range(k + depth - 1)]
                sizes = difference_sizes(own[:k], own[k:]).ravel()
                part = batch["part"][row].as_py()
                held[part] = held[part] + sizes if part in held else sizes
                if len(held) >= HELD_PARTS:
                    yield from vector_batches(list(held.items()), ["part"], [pa.string()])
                    held = {}
        yield from vector_batches(list(held.items()), ["part"], [pa.string()])

    sums = add_vectors(lists.mapInArrow(merge, "part string, sums binary"), ["part"])
    orders = list(permutations(range(k)))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, total, raw in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), batch["sums"].to_pylist()):
                shape = (k, 1 << k, depth)
                sizes = np.zeros(shape, dtype=np.int64) if raw is None else np.frombuffer(raw, dtype="<i8").reshape(shape)
                every = (1 << k) - 1
                # A set of s filters comes before a filter in s! (k - 1 - s)! orders.
                weight = [0 if s >> n & 1 else factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))
                          for n in range(k) for s in range(1 << k)]
                shapley = (sizes[:, :, 0] * np.array(weight, dtype=np.int64).reshape(k, 1 << k)).sum(1)
                out = []
                for order in orders:
                    before, left = 0, total
                    for step, n in enumerate(order, 1):
                        removed, *lost = (int(x) for x in sizes[n, before])
                        left -= removed
                        out.append(("".join(names[m] for m in order), step, left, removed, int(sizes[n, 0, 0]) - removed,
                                    int(sizes[n, every ^ 1 << n, 0]), *(lost or (0, 0)), int(shapley[n])))
                        before |= 1 << n
                columns = list(zip(*out))
                yield pa.record_batch([pa.array([part] * len(out), pa.string()), pa.array(columns[0], pa.string()),
                                       pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                                      names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                             "good_lost", "toxic_lost", "shapley"])

    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(sums, "part", "left").mapInArrow(
        report, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
                "good_lost bigint, toxic_lost bigint, shapley bigint")


def failing_ids(lists: DataFrame, rows: DataFrame, filters: Mapping[str, Column | str], name: str) -> DataFrame:
    """Rows (part, id) that fail the filter ``name``, from the kept lists."""
    wanted = lists.select(F.explode(f"list{list(filters).index(name)}").alias("row"))
    return rows.join(wanted, "row", "left_semi").select("part", "id")


def corpus_filters() -> dict[str, Column | str]:
    """Five filters: short texts, few different words, capitals, signs, copies of a row with a smaller id."""
    text, words = F.col("text"), F.col("words")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * 2,
        "D": text.rlike(r"[#$%&*|]"),
        "E": "copy",
    }
