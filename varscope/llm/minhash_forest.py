"""MinHash near-dedup by an LSH forest: sorted signature orders, neighbours by common prefix, depth by density."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from varscope.llm.common import components, small_batches, written

#: MinHash values of a signature, orders of it (trees), and depths at which a tree's groups are looked at.
VALUES, TREES, FIRST_DEPTH, LAST_DEPTH = 96, 32, 5, 10
#: A group up to this size pairs all its members; a larger one is split by the next value of its order.
GROUP = 16
#: Neighbours that a member of a group of equal paths is paired with, in sorted order.
NEIGHBOURS = 2
#: Share of equal signature values from which a pair is confirmed on full sets (0.8 less five deviations).
LEAST_AGREEMENT = 0.6
#: Bits of a value in a path.
PATH_BITS = 12
#: Nodes of a frequent shingle that meet in one cell.
CELL_ROWS = 1_000
#: Words of a shingle, where the caller names no number.
WORDS = 2
#: Bytes of text hashed at a time.
CHUNK_BYTES = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``: a polynomial in an odd base modulo 2**64 over its bytes."""
    raw = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
    word = _IS_WORD[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    power = np.full(len(raw) + 1, _ODD, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    back = np.full(len(raw) + 1, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    hashes = (sums[ends] - sums[starts]) * back[starts]
    return mixed(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), starts


def _joined(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of every ``words`` words that follow each other."""
    out = hashes[:max(0, len(hashes) - words + 1)]
    for k in range(1, words):
        out = mixed(out * np.uint64(3) + (hashes[k:k + len(out)] ^ np.uint64(_ODD)))
    return out


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; a shorter text is a shingle of its own."""
    found: list[np.ndarray] = []
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        end, size = at, 0
        while end < len(encoded) and (end == at or size + len(encoded[end]) <= CHUNK_BYTES):
            size += len(encoded[end]) + 1
            end += 1
        part = encoded[at:end]
        hashes, starts = word_hashes(b"\n".join(part))
        begins = np.cumsum([0, *[len(x) + 1 for x in part]])
        bounds = np.searchsorted(starts, begins)
        runs = _joined(hashes, words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = runs[a:b - words + 1] if b - a >= words else mixed(_joined(hashes[a:b], b - a) ^ np.uint64(0x5851F42D4C957F2D))
            found.append(np.unique(own))
        at = end
    return found


def set_digest(own: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell it from any other."""
    if not len(own):
        return 0, 0
    return (int(mixed(own + np.uint64(1)).sum().astype(np.int64)), int((mixed(own ^ np.uint64(_MASK)) * own).sum().astype(np.int64)))


def _multipliers() -> np.ndarray:
    return mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)


def tree_orders() -> np.ndarray:
    """The first values that each tree sorts by: orders of the same signature, fixed for all runs."""
    rng = np.random.default_rng(6)
    return np.stack([rng.permutation(VALUES)[:LAST_DEPTH] for _ in range(TREES)])


def signatures(own: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets."""
    flat = np.concatenate(own)
    starts = np.cumsum([0, *[len(x) for x in own[:-1]]])
    out = np.empty((len(own), VALUES), dtype=np.uint32)
    for k, by in enumerate(_multipliers()):
        out[:, k] = np.minimum.reduceat((flat * by) >> np.uint64(32), starts)
    return out


def _sign(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 64):
            part = pdf.iloc[at:at + 64]
            sets = shingle_sets(part["text"].tolist(), words)
            digests = [set_digest(x) for x in sets]
            full = [n for n, x in enumerate(sets) if len(x)]
            signed: list[bytes | None] = [None] * len(sets)
            if full:
                for n, row in zip(full, signatures([sets[n] for n in full])):
                    signed[n] = row.tobytes()
            yield pd.DataFrame({"id": part["id"].tolist(), "mix": part["mix"].tolist(), "n": [len(x) for x in sets], "d1": [d[0] for d in digests],
                                "d2": [d[1] for d in digests], "signature": signed}, dtype=object)


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every tree the key of the first values of a signature in the tree's order, and the path of the next ones."""
    orders = tree_orders()
    for pdf in batches:
        for at in range(0, len(pdf), 1_000):
            part = pdf.iloc[at:at + 1_000]
            signed = np.frombuffer(b"".join(part["signature"]), dtype=np.uint32).reshape(-1, VALUES)
            keys, paths = [], []
            for tree, order in enumerate(orders):
                key = np.full(len(signed), tree + 1, dtype=np.uint64)
                for k in order[:FIRST_DEPTH]:
                    key = mixed(key * np.uint64(_ODD) + signed[:, k])
                path = np.zeros(len(signed), dtype=np.int64)
                for k in order[FIRST_DEPTH:]:
                    path = path << PATH_BITS | (signed[:, k] >> np.uint32(32 - PATH_BITS)).astype(np.int64)
                keys.append(key.astype(np.int64))
                paths.append(path)
            yield pd.DataFrame({"key": np.concatenate(keys), "path": np.concatenate(paths),
                                "node": np.tile(part["row"].to_numpy(), len(orders))})


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal values that each row is in, and the size of that run."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run] if len(run) else run


def sorted_neighbours(key: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (first, second) of neighbours in rows sorted by key and path, and whether a row is in a large group.

    A group is the rows of one key. Up to ``GROUP`` rows all are neighbours. A larger group is split by the next value
    of its order, as deep as it stays too large, so that dense regions are cut finer than sparse ones; the first rows of
    parts that follow each other are neighbours too. Rows of equal paths are neighbours of the next ``NEIGHBOURS``.
    """
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def ahead(run: np.ndarray, chosen: np.ndarray, reach: int) -> None:
        for step in range(1, reach + 1):
            first = np.nonzero(chosen[:-step] & (run[step:] == run[:-step]))[0]
            if not len(first):
                break
            pairs.append((first, first + step))

    run, size = _runs(key)
    large = size > GROUP
    ahead(run, ~large, GROUP - 1)
    open_rows, above = large.copy(), run
    for level in range(FIRST_DEPTH + 1, LAST_DEPTH + 1):
        if not open_rows.any():
            break
        run, size = _runs(key, path >> np.int64(PATH_BITS * (LAST_DEPTH - level)))
        heads = np.nonzero(open_rows & np.concatenate([[True], run[1:] != run[:-1]]))[0]
        beside = above[heads[1:]] == above[heads[:-1]]
        pairs.append((heads[:-1][beside], heads[1:][beside]))
        fine = open_rows & (size <= GROUP)
        ahead(run, fine, GROUP - 1)
        open_rows, above = open_rows & ~fine, run
    ahead(above, open_rows, NEIGHBOURS)
    first, second = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    return first, second, large


def _scan(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """Neighbours (kind 0: a, b) and members of large groups (kind 1: key, a) of a sorted partition, and with ``ends``
    the rows (kind 2: key, path, a) of its first and last group that a row of another partition may be next to."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    key, path, node = (np.concatenate([b[n].to_numpy() for b in held]) for n in ("key", "path", "node"))
    first, second, large = sorted_neighbours(key, path)
    dense = np.nonzero(large)[0]
    edge = np.zeros(len(key), dtype=bool)
    if ends:
        edge[:GROUP] = key[:GROUP] == key[0]
        edge[-GROUP:] |= key[-GROUP:] == key[-1]
    edge = np.nonzero(edge)[0]
    none = lambda rows: np.zeros(len(rows), dtype=np.int64)
    for kind, columns in enumerate(((none(first), none(first), node[first], node[second]), (key[dense], none(dense), node[dense], none(dense)),
                                    (key[edge], path[edge], node[edge], none(edge)))):
        for at in range(0, len(columns[0]), 100_000):
            part = [pa.array(c[at:at + 100_000]) for c in columns]
            yield pa.record_batch([pa.array(np.full(len(part[0]), kind, dtype=np.int32)), *part], names=["kind", "key", "path", "a", "b"])


def forest_candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of nodes (row, signature) that are neighbours in some tree, and the members (key, node) of
    the groups that were too large to pair all of them.

    The rows of all trees are sorted by range, so that a group of any size is spread over tasks and each task scans its
    rows once (``sorted_neighbours``). Rows at the ends of the ranges are scanned once more, together with the rows at
    the ends of the ranges beside them.
    """
    schema = "kind int, key bigint, path bigint, a bigint, b bigint"
    rows = nodes.select("row", "signature").mapInPandas(_plant, "key bigint, path bigint, node bigint")
    order = ["key", "path", "node"]
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_scan, ends=True), schema), "forest-scan")
    edges = found.where("kind = 2").select("key", "path", F.col("a").alias("node")).repartition("key").sortWithinPartitions(*order)
    more = edges.mapInArrow(partial(_scan, ends=False), schema)
    both = found.where("kind < 2").unionByName(more)
    pairs = both.where("kind = 0 AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, both.where("kind = 1").select("key", F.col("a").alias("node")).distinct()


def _agreement(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        left = np.frombuffer(b"".join(pdf["left"]), dtype=np.uint8).reshape(-1, VALUES)
        right = np.frombuffer(b"".join(pdf["right"]), dtype=np.uint8).reshape(-1, VALUES)
        share = (left == right).mean(1)
        fit = share >= LEAST_AGREEMENT
        yield pd.DataFrame({"a": pdf["a"][fit], "b": pdf["b"][fit], "share": share[fit]})


def _low_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        signed = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint32).reshape(-1, VALUES).astype(np.uint8)
        yield pd.DataFrame({"row": pdf["row"], "n": pdf["n"], "low": [x.tobytes() for x in signed]})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for one, two in zip(pdf["one"], pdf["two"]):
            one, two = one.view(np.uint64), two.view(np.uint64)
            if len(one) > len(two):
                one, two = two, one
            place = np.minimum(np.searchsorted(two, one), len(two) - 1)
            both = int((two[place] == one).sum())
            keep.append(100 * both >= 80 * (len(one) + len(two) - both))
        yield pdf.loc[keep, ["a", "b"]]


def _own_sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 64):
            part = pdf.iloc[at:at + 64]
            sets = shingle_sets(part["text"].tolist(), words)
            fit = [set_digest(x) == (d1, d2) for x, d1, d2 in zip(sets, part["d1"].tolist(), part["d2"].tolist())]
            yield pd.DataFrame({"node": part["node"][fit], "shingles": [x.view(np.int64) for x, good in zip(sets, fit) if good]})


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 80 * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(_confirm, "a bigint, b bigint")


def apart_in_dense(dense: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes (node, root) of the large groups whose members are in several components; ``reached`` holds those found.

    A large group that is one component has no link to add, whatever its size.
    """
    member = dense.join(reached.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = written(member, "dense-members")
    mixed_keys = member.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").select("key")
    return written(member.join(mixed_keys, "key", "left_semi").select("node", "root").distinct(), "dense-nodes")


def prefix_candidates(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a < b) of ``nodes`` (node, root) with different roots that contain every such pair alike by 0.8.

    Shingles are ordered by how few of the nodes have them. Sets alike by 0.8 share a shingle within their first
    n - ceil(0.8 n) + 1, and at the first one that they share enough of both is left to reach 0.8. A shingle whose nodes
    have one root links nothing new. The nodes of a frequent shingle meet in cells of ``CELL_ROWS``.
    """
    rows = sets.join(nodes, "node").select("node", "root", F.explode("shingles").alias("shingle"))
    rows = written(rows, "dense-shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), (F.min("root") != F.max("root")).alias("apart"))
    ordered = rows.join(often, "shingle").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("often", "shingle", "apart"))).alias("own"))
    n = F.size("own")
    first = ordered.select("node", "root", n.alias("n"), F.posexplode(F.slice("own", F.lit(1), n - F.ceil(n * 80 / F.lit(100)).cast("int") + 1)))
    first = written(first.where("col.apart").select("node", "root", "n", "pos", F.col("col.shingle").alias("shingle")), "dense-prefixes")
    cells = first.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("cells"))
    first = first.join(cells, "shingle")
    one = first.select("shingle", F.pmod(F.xxhash64("node"), F.col("cells")).alias("cell"), F.col("node").alias("a"), F.col("root").alias("ra"),
                       F.col("n").alias("na"), (F.col("n") - F.col("pos")).alias("la"))
    two = first.select("shingle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("cell"), F.col("node").alias("b"),
                       F.col("root").alias("rb"), F.col("n").alias("nb"), (F.col("n") - F.col("pos")).alias("lb"))
    fit = "a < b AND ra <> rb AND 100 * least(na, nb) >= 80 * greatest(na, nb) AND 180 * least(la, lb) >= 80 * (na + nb)"
    return one.join(two, ["shingle", "cell"]).where(fit).select("a", "b").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links) and kept (id is that id).

    Texts with equal shingle sets are one node. Candidates come from the forest, are thinned by the share of equal
    signature values, and are confirmed on full sets, first the likeliest partner of each node, then every pair whose
    ends are still in different components, so that dense groups confirm about one pair per node. Large groups that are
    then in several components are searched for every further link by an exact prefix filter. A shingle is a 64-bit hash
    of its ``words`` words.

    Null and empty texts and texts of white space have an empty set and link with nothing; a text of fewer words than
    a shingle is a set of one. Repeated rows and equal sets are linked. A null id takes part and is the smallest only where no other id is
    reachable. No rows give no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows of one id differ in their texts' hashes; rows equal in both have one set.
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mix"), text.alias("text"))
    kind = dict(plain.dtypes)["id"]
    signed = plain.mapInPandas(partial(_sign, words=words), f"id {kind}, mix bigint, n bigint, d1 bigint, d2 bigint, signature binary")
    rows = written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    groups = written(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("id").alias("least")), "shingle-groups")
    nodes = written(rows.join(groups.select(F.col("node").alias("row")), "row", "left_semi"), "forest-nodes")
    low = written(nodes.select("row", "n", "signature").mapInPandas(_low_bytes, "row bigint, n bigint, low binary"), "low-bytes")
    candidates, dense = forest_candidates(nodes)
    dense = written(dense, "forest-dense")
    both = (candidates.join(low.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("low").alias("left")), "a")
            .join(low.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("low").alias("right")), "b")
            .where("least(na, nb) * 100 >= greatest(na, nb) * 80"))
    likely = written(both.select("a", "b", "left", "right").mapInPandas(_agreement, "a bigint, b bigint, share double"), "likely-pairs")

    def sets_of(ends: DataFrame, name: str) -> DataFrame:
        wanted = nodes.join(ends, nodes["row"] == ends["node"]).select("id", "mix", "d1", "d2", "node")
        wanted = wanted.select(F.col("id").alias("__id"), F.col("mix").alias("__mix"), "d1", "d2", "node")
        found = plain.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mix") == F.col("__mix")))
        found = found.select("text", "d1", "d2", "node").mapInPandas(partial(_own_sets, words=words), "node bigint, shingles array<bigint>")
        return written(found.dropDuplicates(["node"]), name)

    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "shingle-sets")
    best = written(likely.groupBy("b").agg(F.max(F.struct("share", (-F.col("a")).alias("a"))).alias("best")).select(
        (-F.col("best.a")).alias("a"), "b"), "best-pairs")
    edges = written(confirmed(best, sets), "links")
    reached = written(components(edges), "reached")
    label = lambda end: reached.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    rest = likely.join(label("a"), "a", "left").join(label("b"), "b", "left").where(
        "coalesce(ca, a) <> coalesce(cb, b)").join(best, ["a", "b"], "left_anti")
    more = written(confirmed(rest, sets), "more-links")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        reached = written(components(edges), "reached")
    apart = apart_in_dense(dense, reached)
    if not apart.isEmpty():
        sets = sets_of(apart.select("node"), "dense-sets")
        left_out = written(confirmed(prefix_candidates(apart, sets), sets), "dense-links")
        if not left_out.isEmpty():
            reached = written(components(edges.unionByName(left_out)), "reached")
    known = groups.join(reached, "node", "left").withColumn("root", F.coalesce("component", "node"))
    known = written(known.select("d1", "d2", "least", "root"), "known-groups")
    # Settled first, so that both sides of the join are exchanges and a hot root can be split.
    smallest = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "smallest-ids")
    labels = known.join(smallest, "root").select("d1", "d2", "component_id")
    linked = rows.where("n > 0").select("id", "n", "d1", "d2").join(labels, ["d1", "d2"]).select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, one id of each group, with their columns as they are."""
    kept = near_copies(docs, id_col, text_col, words).where("kept").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")
