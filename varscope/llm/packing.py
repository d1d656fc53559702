"""Best-fit packing of tokenised documents by a configuration linear program over the lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from varscope.llm.common import buckets_for, rank_in_groups, small_batches, written

CAPACITY = 2_048
END_ID = 0
#: Pieces of one length that a task numbers at a time.
ROWS_PER_CELL = 10_000
#: Steps of the multiplicative weights and their rate.
STEPS, RATE = 200, 1.0
#: A filling of the program is used where its price is this share of the best one's.
TIGHT = 0.995
# Texts in which both tokenizer libraries surely split alike: no control or rare characters, no special token.
PLAIN = "[^\t-\r -~¡-ɏ‐-‧€]|<\\|"


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """Function from texts to lists of ids.

    The rank file holds the same vocabulary and merges and is about seven times as fast; it serves plain texts, and
    the tokenizer file every other text, so that ids are those of the tokenizer file.
    """
    import base64
    import functools
    import os
    import re

    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = functools.cache(lambda: tokenizers.Tokenizer.from_file(json_path))
    if not ranks_path:
        return lambda texts: [e.ids for e in whole().encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile(PLAIN).search
    # The tokenizer file is only loaded where a text needs it.
    return lambda texts: [whole().encode(t, add_special_tokens=False).ids if odd(t) else fast.encode_ordinary(t) for t in texts]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: dict, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, ids): ids of each document and its end id, long ones cut.

    Pieces have ``capacity`` ids; the first one of a longer document takes what is left over.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            encode = encode or _encoder(**tokenizer)
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at:at + 200]
                out = []
                for key, ids in zip(part["id"], encode(part["text"].tolist())):
                    ids = np.array([*ids, END_ID], dtype="<u4")
                    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        raw = ids[a:b].tobytes()
                        out.append((key, n, a, b - a, zlib.crc32(raw), raw))
                yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def best_table(values: np.ndarray, stock: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: greatest value of each room, and the last length used (0: leave one free).

    ``values[l]`` is the price of a piece of length ``l``. Lengths without stock are not used; others without limit.
    """
    lengths = np.nonzero(stock[: capacity + 1] > 0)[0]
    lengths = lengths[lengths > 0]
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    prices = values[lengths]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := usable[room]:
            tried = best[room - lengths[:n]]
            tried += prices[:n]
            top = int(tried.argmax())
            if tried[top] > best[room]:
                best[room], last[room] = tried[top], lengths[top]
    return best, last


def filling(last: np.ndarray, room: int, capacity: int) -> np.ndarray:
    """How often each length stands in the best filling of ``room``."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    while room > 0:
        if last[room]:
            used[last[room]] += 1
            room -= last[room]
        else:
            room -= 1
    return used


def solve_configurations(histogram: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS, rate: float = RATE):
    """Fillings and how often each is used, a whole number, so that all pieces of a length histogram are placed.

    The linear program has a variable per filling of a sequence and a row per length, which asks for its pieces to be
    placed. Multiplicative weights hold a price per length, at first its size and a little more for long ones, which
    are hard to place: a step finds the filling of greatest price by dynamic programming, uses it until one of its
    lengths is placed once over, and lowers the prices of its lengths by ``exp(-rate)`` for each time over. All pieces
    at these prices, divided by the best filling's price, is a lower bound of the program; the prices of the best
    bound are kept. The program's fillings that are about as dear as the best one at the kept prices are scaled to
    place no length twice and rounded down. What is left is placed longest piece first, with the best filling of the
    room beside it at the kept prices, each as often as its pieces last.
    """
    need = histogram.astype(np.float64)
    have = need > 0
    size = np.arange(capacity + 1, dtype=np.float64)
    served = np.zeros(capacity + 1)
    amounts: dict[bytes, float] = {}
    start = size * (1 + size / capacity / 2)
    price = best_price = np.where(have, start, 0.0)
    bound = 0.0
    for _ in range(steps if have.any() else 0):
        used = filling(best_table(price, histogram, capacity)[1], capacity, capacity)
        now = float((need * price).sum() / (used * price).sum())
        if now > bound * (1 + 1e-9):
            bound, best_price = now, price
        share = float(np.min(need[used > 0] / used[used > 0]))
        key = used.astype("<i8").tobytes()
        amounts[key] = amounts.get(key, 0.0) + share
        served[have] += used[have] * share / need[have]
        price = np.where(have, start * np.exp(-rate * (served - served[have].min())), 0.0)
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []

    def take(used: np.ndarray, most: float) -> None:
        count = int(min(most, np.min(left[used > 0] // used[used > 0])))
        if count > 0:
            plan.append((used, count))
            np.subtract(left, used * count, out=left)

    over = max(1.0, float(served.max()))
    dearest = float(best_table(best_price, histogram, capacity)[0][-1])
    for key, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        used = np.frombuffer(key, dtype="<i8")
        if (used * best_price).sum() >= TIGHT * dearest:
            take(used, amount / over)
    room, last = -1, np.zeros(0)
    while left.any():
        longest = int(np.nonzero(left)[0][-1])
        for fresh in (False, True):
            if fresh or room < capacity - longest:
                rest = left.copy()
                rest[longest] -= 1
                room = capacity - longest
                last = best_table(best_price, rest, room)[1]
            used = filling(last, capacity - longest, capacity)
            used[longest] += 1
            if (used <= left).all():
                break
        take(_within(used, left, capacity), np.inf)
    return plan


def _within(used: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """``used`` cut to what is left, with the room that this opens given to the longest pieces that fit (best fit)."""
    used = np.minimum(used, left)
    room = capacity - int((used * np.arange(len(used))).sum())
    spare = left - used
    while room > 0:
        fit = np.nonzero(spare[: room + 1] > 0)[0]
        if not len(fit):
            break
        used[fit[-1]] += 1
        spare[fit[-1]] -= 1
        room -= int(fit[-1])
    return used


def plan_table(plan: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """Rows (length, base, count, each, sequence, offset) in order of length and base.

    Pieces of a length ranked from ``base`` fill ``each`` places in ``count`` sequences from number ``sequence``.
    The table is bounded by the capacity, not by the data: a filling holds at most sixty-odd different lengths.
    """
    rows, base, sequence = [], {}, 0
    for used, count in plan:
        offset = 0
        for length in np.nonzero(used)[0].tolist():
            each = int(used[length])
            rows.append((length, base.get(length, 0), count, each, sequence, offset))
            base[length] = base.get(length, 0) + each * count
            offset += each * length
        sequence += count
    return pd.DataFrame(sorted(rows), columns=["length", "base", "count", "each", "sequence", "offset"], dtype=np.int64)


def pack_documents(docs: DataFrame, tokenizer: dict, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, keep_ids: bool = True, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id and offset.

    ``tokenizer`` has ``json_path`` (a tokenizers file) and may have ``ranks_path`` and ``pattern`` of the same
    vocabulary. ``keep_ids`` adds the ids as little-endian unsigned 32-bit integers. The histogram of lengths, at most
    ``capacity`` numbers, goes to the driver, which plans the sequences; pieces of equal length are ranked without
    gathering them in one task and take the planned places. Null and empty texts are a piece of the end id alone;
    repeated rows are packed as often as they occur; no rows give no rows; other columns are not read.
    """
    kept = token_pieces(docs, id_col, text_col, tokenizer, capacity)
    pieces = written(kept if keep_ids else kept.drop("ids"), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    table = plan_table(solve_configurations(histogram, capacity))
    far = 1 << 40
    keys = (table["length"] * far + table["base"]).to_numpy()
    columns = {c: table[c].to_numpy() for c in table.columns}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row = np.searchsorted(keys, (pdf["length"] * far + pdf["rank"]).to_numpy(), side="right") - 1
            turn = pdf["rank"].to_numpy() - columns["base"][row]
            count = columns["count"][row]
            yield pdf.drop(columns=["rank"]).assign(
                sequence_id=columns["sequence"][row] + turn % count,
                offset=columns["offset"][row] + turn // count * pdf["length"].to_numpy())

    cells = buckets_for(int(histogram.max()), rows_per_cell)
    dealt = pieces.withColumn("order", F.xxhash64("id", "piece")).withColumn("cell", F.pmod("order", F.lit(cells)).cast("int"))
    ranked = rank_in_groups(dealt, ["length"], ["cell"], ["order", "id", "piece"]).select(*pieces.columns, "rank")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.mapInPandas(place, f"{schema}, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
