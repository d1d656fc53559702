"""Secret scans: candidate spans by pattern, judged by how many repositories and owners hold the same value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.llm.common import written

# Kind, pattern, group that holds the value, least length, and whether the length is that of the group.
BASE_KINDS = (
    ("assign", r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is the same as any run, shorter ones dropped
)
#: Loose candidates, kept only where the corpus says that they belong to one owner.
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: A value that so many owners or repositories hold is an example that was copied.
EXAMPLE_OWNERS = 2
EXAMPLE_REPOSITORIES = 5
#: Matches of a block whose places are summed up together, at least.
LEAST_BLOCK = 16
#: Bits per character from which a value looks generated.
LEAST_ENTROPY = 3.0


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _steps(n: int, kind: str, pattern: str, group: int, least: int) -> list[dict[str, Column]]:
    """Projections, one after the other, that add ``spans<n>``: leftmost non-overlapping matches with their places.

    A match ends after the pieces and matches up to it. These sums are taken in blocks of about the root of the number
    of matches: first what each block adds, then where each begins, then the places inside, so that a text of very many
    matches takes no sum over all of them for each.
    """
    text, hit = F.col("text"), F.col("text").rlike(pattern)
    whole, value, piece, step, size, block, begin, end = (
        F.col(f"{name}{n}") for name in ("whole", "value", "piece", "step", "size", "block", "begin", "end"))
    no_text, no_number = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    found = lambda k: F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(k))).otherwise(no_text)
    part = lambda i, m: F.slice(step, i * size + 1, m)
    last = F.ceil(F.size(step) / size).cast("int") - 1
    # The last piece has no match after it.
    length = F.zip_with(F.slice(piece, F.lit(1), F.size(whole)), whole, lambda p, w: (F.char_length(p) + F.char_length(w)).cast("bigint"))
    span = lambda e, i: F.struct(
        (e - F.char_length(F.get(whole, i))).alias("start"), F.lit(n).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"),
        F.get(value, i).alias("value"))
    return [
        {f"whole{n}": found(0), f"value{n}": found(group), f"piece{n}": F.when(hit, F.split(text, pattern, -1)).otherwise(no_text)},
        {f"step{n}": length},
        {f"size{n}": F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.size(step)))).cast("int")},
        {f"block{n}": F.when(F.size(step) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: _sum(part(i, size)))).otherwise(no_number)},
        {f"begin{n}": F.transform(block, lambda _, i: _sum(F.slice(block, F.lit(1), i)))},
        {f"end{n}": F.flatten(F.transform(begin, lambda at, i: F.transform(part(i, size), lambda _, j: at + _sum(part(i, j + 1)))))},
        {f"spans{n}": F.filter(F.transform(end, span), lambda s: F.char_length(s["value"]) >= least)},
    ]


def _matches(rows: DataFrame, kinds: Sequence[tuple]) -> DataFrame:
    """Add ``spans0``, ``spans1`` …, one per kind, for the column ``text``. Each step names its arrays once."""
    for level in zip(*[_steps(n, *kind) for n, kind in enumerate(kinds)]):
        rows = rows.withColumns({name: column for part in level for name, column in part.items()})
    return rows


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits per character."""
    size = F.char_length(value).cast("double")
    share = lambda c: (size - F.char_length(F.replace(value, c, F.lit("")))) / size
    parts = F.transform(F.array_distinct(F.split(value, "")), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """Rows (row, id, owner, repository, spans), one per document; values appear only as hashes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _matches(rows, [*BASE_KINDS, OWNED])
    found = F.concat(*[F.col(f"spans{n}") for n in range(len(BASE_KINDS))],
                     F.filter(f"spans{len(BASE_KINDS)}", lambda s: s["value"].rlike("[0-9]")
                              & s["value"].rlike("[A-Za-z]") & (entropy(s["value"]) >= LEAST_ENTROPY)))
    hashed = F.transform(found, lambda s: s.withField("value", F.unhex(F.sha2(s["value"], 256))))
    return rows.select("row", "id", "owner", "repository", hashed.alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Rows (value, owners, repositories, example): who holds each value. Each level combines before it shuffles."""
    held = candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    counts = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    return counts.withColumn("example", (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_col: str = "doc_id") -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, rank, kind, end, example) in order of start and kind.

    Base kinds always stay, with ``example`` telling a widely copied value from an owner's own. Loose candidates
    (kind ``owned``: 20 characters or more with a letter and a digit, generated by their look) are added where one
    owner alone holds the value and no base span overlaps. A null owner or repository is an owner or repository of
    its own. Null and empty texts have no spans; repeated rows have the same spans and count as one repository; no
    rows give no rows. Places are code points, the end exclusive. Columns other than those named are not read.
    """
    rows = written(candidate_spans(docs, id_col, text_col, owner_col, repository_col), "secret-spans")
    each = rows.select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    judged = each.join(ownership(each), "value")
    base = F.col("rank") < len(BASE_KINDS)
    order = Window.partitionBy("row").orderBy("start", "rank")
    ended = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The rows that follow are those before it in the other direction: a frame that grows is added to, not read anew.
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"))
    begun = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    clear = (F.coalesce(ended, F.lit(-1)) <= F.col("start")) & (F.coalesce(begun, F.col("end")) >= F.col("end"))
    kept = judged.withColumn("clear", clear).where(base | (F.col("clear") & ~F.col("example")))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "example"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,example:boolean>>")
    return rows.select("row", "id").join(spans, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))
