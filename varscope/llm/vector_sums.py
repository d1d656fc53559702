"""Sums of long vectors by key, kept as binary so that a vector is one value of a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Vectors that a batch holds.
VECTORS_PER_BATCH = 200


def vector_batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last value is a vector of 64-bit integers."""
    for at in range(0, len(rows), VECTORS_PER_BATCH):
        part = rows[at:at + VECTORS_PER_BATCH]
        columns = [pa.array([r[n] for r in part], kind) for n, kind in enumerate(types)]
        columns.append(pa.array([np.ascontiguousarray(r[-1], dtype="<i8").tobytes() for r in part], pa.binary()))
        yield pa.record_batch(columns, names=[*names, "sums"])


def add_vectors(partial: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, sums) per key: the sum of its vectors ``sums``.

    Rows are sorted by key in their partition and added one at a time: a task holds one vector, however many rows a
    key has. Producers add what they can before, so that a key has a row per task at most, more or less.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done, kinds = None, None, [], None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            rows = zip(*[batch[k].to_pylist() for k in keys], batch["sums"])
            for *key, raw in rows:
                vector = np.frombuffer(raw.as_buffer(), dtype="<i8")
                if key != now:
                    if now is not None:
                        done.append((*now, total))
                    now, total = key, vector.copy()
                else:
                    total += vector
            if len(done) >= VECTORS_PER_BATCH:
                yield from vector_batches(done, keys, kinds)
                done = []
        if now is not None:
            yield from vector_batches([*done, (*now, total)], keys, kinds)

    schema = ", ".join(f"`{n}` {t}" for n, t in partial.select(*keys).dtypes) + ", sums binary"
    return partial.select(*keys, "sums").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
