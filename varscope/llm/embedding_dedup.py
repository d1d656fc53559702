"""Embedding near-dedup by Int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from varscope.llm.common import checkpointed, components, new_path, written
from varscope.llm.token_files import open_store

#: Vectors of one tile, and the rows of a tile that are multiplied at a time.
TILE_ROWS, BLOCK_ROWS = 2_048, 512
#: Tiles of a group, of which a task holds two, and the bytes of a group's unit vectors at most.
GROUP_TILES, GROUP_BYTES = 4, 1 << 26
#: Tasks that compare groups at most.
MOST_TASKS = 10_000
#: Equal vectors link, and are compared as one, up to this threshold.
COPIES_LINK = 1 - 1e-9
#: Reference vectors against which tiles are bounded; the same number at every size.
PIVOTS = 64
#: Pairs recomputed in double precision at a time.
EXACT_PAIRS = 100_000
#: Products of Int8 components are exact in single precision up to this many dimensions.
EXACT_DIMENSIONS = 1_040


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which of them are usable (not zero, all components finite)."""
    x = np.array(vectors, dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        # The largest component first, so that neither tiny nor huge vectors leave the range of a double.
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x, np.isfinite(x).all(axis=1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Int8 values, their scale, and for each vector the norms of its quantised form and of its error (rounded up)."""
    scale = float(np.abs(x).max()) / 127 or 1.0
    q = np.rint(x / scale).astype(np.int8)
    back = q * scale
    up = 1 + 1e-9
    return q, scale, np.sqrt(((back) ** 2).sum(1)) * up, np.sqrt(((x - back) ** 2).sum(1)) * up


def possible_from(threshold: float, size: np.ndarray, error: np.ndarray, scale: float, other_error: float,
                  other_scale: float) -> np.ndarray:
    """Least Int8 product of each row from which its pair with a vector of the other tile may reach the threshold.

    With x = a + e and y = b + f (quantised form and error) x.y = a.b + a.f + e.y, and y has norm 1, so that
    x.y <= a.b + |a| |f| + |e|; the largest |f| of the other tile holds for all its vectors.
    """
    return (threshold - size * other_error - error - 1e-9) / (scale * other_scale)


class Tile:
    """Unit vectors with their Int8 form, made once for all tiles that they are compared with."""

    def __init__(self, x: np.ndarray):
        self.x = x
        q, self.scale, self.size, self.error = quantise(x)
        self.values = q.astype(np.float32 if x.shape[1] <= EXACT_DIMENSIONS else np.float64)
        self.most_error = float(self.error.max(initial=0))


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two tiles of unit vectors with cosine >= threshold, block by block; each pair of one tile once."""
    return linked_in(Tile(x), Tile(y), threshold, same)


def linked_in(one: Tile, two: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    least = possible_from(threshold, one.size, one.error, one.scale, two.most_error, two.scale)
    # Products are whole numbers, and so is the least one; both are exact in their type.
    least = np.ceil(least).astype(one.values.dtype)[:, None]
    right = two.values.T
    for at in range(0, len(one.x), BLOCK_ROWS):
        first = at if same else 0
        possible = one.values[at:at + BLOCK_ROWS] @ right[:, first:] >= least[at:at + BLOCK_ROWS]
        i, j = np.divmod(np.flatnonzero(possible), possible.shape[1])
        i, j = i + at, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), EXACT_PAIRS):
            a, b = i[k:k + EXACT_PAIRS], j[k:k + EXACT_PAIRS]
            close = np.einsum("ij,ij->i", one.x[a], two.x[b]) >= threshold
            if close.any():
                yield a[close], b[close]


def smallest_reached(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the label trees of nodes a and b in place until every link has one label."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def _flat(batch: pa.RecordBatch, dims: int, kind: str) -> np.ndarray:
    """The vectors of a batch, all of ``dims`` components, one per row."""
    return batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _nearest(pivots: dict[int, np.ndarray], kind: str):
    """Rows with their nearest pivot and the angle to it; rows without a usable vector have no ``dims``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].fill_null(0).to_numpy(zero_copy_only=False)
            cell, angle, fit = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch)), dims > 0
            for d in np.unique(dims[fit]).tolist():
                at = np.nonzero(dims == d)[0]
                x, good = unit_rows(_flat(batch.take(pa.array(at)), d, kind))
                fit[at[~good]] = False
                if d in pivots:
                    cosines = x[good] @ pivots[d].T
                    cell[at[good]] = cosines.argmax(1)
                    # So rounded, equal vectors have one angle.
                    angle[at[good]] = np.arccos(np.clip(cosines.max(1, initial=-1), -1, 1)).round(6)
            none = pa.array(~fit)
            place = [pa.array(v, kind, mask=~fit) for v, kind in ((dims, pa.int32()), (cell, pa.int32()), (angle, pa.float64()))]
            vector = pa.compute.if_else(none, pa.scalar(None, batch["vector"].type), batch["vector"])
            yield pa.record_batch([batch["row"], batch["id"], *place, batch["mark"], vector],
                                  names=["row", "id", "dims", "cell", "angle", "mark", "vector"])
    return run


def _tiles(pivots: dict[int, np.ndarray], tile_rows: int, kind: str, copies: bool):
    """Tiles of sorted rows. Equal vectors that follow each other stand there once: ``counts`` has how many they are."""
    def tiles(dims: int, rows: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(rows), dtype=bool)
        if copies:
            new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        starts = np.append(np.nonzero(new)[0], len(rows))
        for at in range(0, len(starts) - 1, tile_rows):
            edges = starts[at:at + tile_rows + 1]
            some = vectors[edges[:-1]]
            x, _ = unit_rows(some)
            angles = np.arccos(np.clip(x @ pivots[dims].T, -1, 1)) if dims in pivots else np.zeros((len(x), 1))
            yield pa.record_batch({
                "dims": pa.array([dims], pa.int32()), "size": pa.array([len(some)], pa.int64()),
                "rows": [rows[edges[0]:edges[-1]].tobytes()], "counts": [np.diff(edges).astype(np.int64).tobytes()],
                "vectors": [some.tobytes()], "low": [angles.min(0).tolist()], "high": [angles.max(0).tolist()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        dims = size = 0

        def full() -> Iterator[pa.RecordBatch]:
            yield from tiles(dims, *[np.concatenate(part) for part in zip(*held)])

        for batch in batches:
            lengths = batch["dims"].to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                if held and (d != dims or size >= GROUP_TILES * tile_rows):
                    yield from full()
                    held, size = [], 0
                held.append((part["row"].to_numpy(), _flat(part, d, kind)))
                dims, size = d, size + len(part)
        if held:
            yield from full()
    return run


def _compare(location: str, kind: str, threshold: float):
    """Links between the tiles of two groups, that is lists of files of tiles at ``location``: counts and spanning trees."""
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-7

    def read(files: tuple[str, ...]) -> list[tuple]:
        import pyarrow.parquet as pq

        store, path = open_store(location)
        found = []
        for file in files:
            for batch in pq.ParquetFile(f"{path}/{file}", filesystem=store).iter_batches(16):
                for t in batch.to_pylist():
                    counts = np.frombuffer(t["counts"], dtype=np.int64)
                    rows = np.frombuffer(t["rows"], dtype=np.int64)[np.cumsum(counts) - counts]
                    x, _ = unit_rows(np.frombuffer(t["vectors"], dtype=kind).reshape(len(rows), -1))
                    found.append((t["dims"], rows, counts, Tile(x), np.array(t["low"]), np.array(t["high"])))
        return found

    def links_of(files: tuple[str, ...], others: tuple[str, ...], group: Callable) -> pa.RecordBatch:
        same = files == others
        left = group(files)
        right = left if same else group(others)
        tiles = left if same else left + right
        starts = np.cumsum([0, *[len(t[1]) for t in tiles]])
        links, labels = np.zeros(starts[-1], dtype=np.int64), np.arange(starts[-1])
        for i, (dims, _, counts, tile, low, high) in enumerate(left):
            for j, (dims2, _, counts2, tile2, low2, high2) in enumerate(right):
                if dims != dims2 or same and j < i or (low - high2 > angle).any() or (low2 - high > angle).any():
                    continue
                one, two = starts[i], starts[j if same else j + len(left)]
                for a, b in linked_in(tile, tile2, threshold, same and i == j):
                    # Sums of whole numbers below 2**53 are exact in double precision.
                    links[one:one + len(counts)] += np.bincount(a, counts2[b], len(counts)).astype(np.int64)
                    links[two:two + len(counts2)] += np.bincount(b, counts[a], len(counts2)).astype(np.int64)
                    smallest_reached(labels, a + one, b + two)
        nodes, hit = np.concatenate([t[1] for t in tiles]), links > 0
        return pa.record_batch({"row": nodes[hit], "n": links[hit], "root": nodes[labels[hit]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of one group follow each other, so that it is read once for them.
        group = lru_cache(2)(read)
        for batch in batches:
            for files, others in zip(batch["files"].to_pylist(), batch["other_files"].to_pylist()):
                yield links_of(tuple(files), tuple(others), group)
    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal vectors with the row that stands for them and their number."""
    for batch in batches:
        for raw, number in zip(batch["rows"].to_pylist(), batch["counts"].to_pylist()):
            rows, counts = np.frombuffer(raw, dtype=np.int64), np.frombuffer(number, dtype=np.int64)
            first = np.repeat(rows[np.cumsum(counts) - counts], counts)
            yield pa.record_batch({"row": rows, "first": first, "copies": np.repeat(counts, counts)})


def link_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    tile_rows: int = TILE_ROWS, pivot_count: int = PIVOTS) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable by links) and kept (id is that id).

    Vectors stand in tiles of ``tile_rows``, ordered by nearest of ``pivot_count`` pivots and angle to it; equal
    vectors that meet in a tile stand there once, with their number. Tiles are written once to the shared folder, in
    groups, and a task reads the two groups that it compares, so that what is written grows with the rows and not with
    the pairs. Two tiles are compared unless some pivot proves all their pairs too far apart: the angle of two vectors
    is at least the difference of their angles to the pivot. A tile pair multiplies Int8 values, and only pairs that may
    reach the threshold by the error bound of both sides are computed in double precision. A pair of groups returns
    counts and a spanning tree, at most one row per vector, never its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
    different length do not link. Repeated rows are vectors of their own and link with each other. A null id takes
    part and is the smallest only where no other id is reachable. No rows give no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    vector = F.col(vector_col)
    fit = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                             F.when(fit, vector).alias("vector"))
    rows = rows.withColumn("dims", F.when(F.col("vector").isNotNull(), F.size("vector"))).withColumn("mark", F.xxhash64("vector"))
    types = dict(rows.dtypes)
    single = types["vector"] == "array<float>"
    kind = "<f4" if single else "<f8"
    if not single:
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    # The pivots of each length: those whose hash is smallest, so that any order of the rows gives the same.
    first = Window.partitionBy("dims").orderBy("mark")
    chosen = rows.where("dims IS NOT NULL").withColumn("n", F.row_number().over(first)).where(F.col("n") <= pivot_count)
    pivots: dict[int, np.ndarray] = {}
    for dims, part in chosen.select("dims", "vector").toPandas().groupby("dims"):
        x, good = unit_rows(part["vector"].tolist())
        if good.any():
            pivots[int(dims)] = x[good]
    schema = f"row bigint, id {types['id']}, dims int, cell int, angle double, mark bigint, vector array<{'float' if single else 'double'}>"
    rows = written(rows.select("row", "id", "dims", "mark", "vector").mapInArrow(_nearest(pivots, kind), schema), "vectors")
    usable = rows.where("dims IS NOT NULL")
    count, longest = usable.agg(F.count(F.lit(1)), F.max("dims")).first()
    group_rows = max(1, min(GROUP_TILES * tile_rows, GROUP_BYTES // (8 * (longest or 1))))
    # A file of tiles for each range; the row number last, so that a common vector is spread over ranges.
    ranges = max(-(-count // group_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["dims", "cell", "angle", "mark", "row"]
    location = new_path(spark, "tiles")
    usable.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("dims", "row", "vector").mapInArrow(
        _tiles(pivots, tile_rows, kind, threshold <= COPIES_LINK),
        "dims int, size bigint, rows binary, counts binary, vectors binary, low array<double>, high array<double>").write.parquet(location)
    tiles = spark.read.parquet(location)
    # Small files are put into one group. A row per file, not per vector.
    files = tiles.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("at", F.floor(before / group_rows))
    files = files.withColumn("number", F.dense_rank().over(Window.orderBy("at")) - 1)
    groups = checkpointed(files.groupBy("number").agg(F.sort_array(F.collect_list("file")).alias("files")))
    number = groups.count()
    # Round a circle of groups each meets itself and the half that follows, so that all have as many partners.
    later = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(number // 2))).alias("step")).where(
        (F.col("step") * 2 < number) | (F.col("number") < number // 2) | (F.col("step") == 0))
    later = later.select("number", "files", F.pmod(F.col("number") + F.col("step"), F.lit(max(1, number))).alias("other"))
    others = groups.select(F.col("number").alias("other"), F.col("files").alias("other_files"))
    pairs = later.join(others, "other").repartition(max(1, min(number * (number + 1) // 2, MOST_TASKS))).sortWithinPartitions("number", "other")
    found = written(pairs.select("files", "other_files").mapInArrow(
        _compare(location, kind, threshold), "row bigint, n bigint, root bigint"), "vector-links")
    links = found.groupBy(F.col("row").alias("first")).agg(F.sum("n").alias("n_links"))
    reached = checkpointed(components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))))
    members = tiles.select("rows", "counts").mapInArrow(_members, "row bigint, first bigint, copies bigint")
    # From row numbers back to ids: the smallest id among the rows of a component.
    known = rows.select("row", "id").join(members, "row", "left")
    known = known.join(links, "first", "left").join(reached.select(F.col("node").alias("first"), "component"), "first", "left")
    known = checkpointed(known.select(
        "id", F.coalesce("component", "first", "row").alias("root"),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("bigint").alias("n_links")))
    # Settled first, so that both sides of the join are exchanges and a hot root can be split.
    best = checkpointed(known.groupBy("root").agg(F.min("id").alias("component_id")))
    return known.join(best, "root").select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
