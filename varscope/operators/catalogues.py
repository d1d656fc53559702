"""Catalogues as tables: membership by an anti-join, the nearest entry by a join on segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from varscope.functions.columns import local_rows
from varscope.functions.text import normalize
from varscope.session import freeze

#: A catalogue with more entries than this is joined, a shorter one is a literal list.
LITERAL_ENTRIES = 200
#: Distances that are searched one by one; further ones by doubling.
STEPS = 8
#: Segments of values, counted, that every task may hold.
BROADCAST_PROBES = 100_000


def catalogue_table(spark, entries: Sequence[str]) -> DataFrame:
    """``entrada, orden`` of a list of entries."""
    return local_rows(spark, [(e, i) for i, e in enumerate(entries)], "entrada string, orden bigint")


def missing_from(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The rows of ``values`` (``norma``, …) whose normal form is no entry of ``catalogue`` (``entrada, orden``)."""
    known = catalogue.select(F.col("entrada").alias("norma"))
    return values.join(known, "norma", "left_anti")


def _segments(length: str, parts: str, place: str) -> tuple[str, str]:
    """SQL of the start (from 0) and length of a segment of a text cut into parts of even length, long ones last."""
    even, odd = f"CAST(floor({length} / {parts}) AS INT)", f"({length} % {parts})"
    return f"{place} * {even} + greatest(0, {place} - ({parts} - {odd}))", f"{even} + IF({place} >= {parts} - {odd}, 1, 0)"


def _letters(word: str) -> str:
    """SQL of two words of bits for a text: letters, by a hash of 32 kinds, that it has at least once, and at least twice.

    An edit takes at most one bit away and adds at most one.
    """
    bit = f"shiftleft(1L, ascii(substring({word}, i, 1)) % 32)"
    return (f"aggregate(sequence(1, length({word})), named_struct('a', 0L, 'b', 0L), (s, i) -> "
            f"named_struct('a', s.a | {bit}, 'b', s.b | (s.a & {bit})), s -> s.a | shiftleft(s.b, 32))")


def _within(values: DataFrame, entries: DataFrame, lengths: DataFrame, edits: int) -> DataFrame:
    """``norma, orden, entrada, distancia``: entries at most ``edits`` (and the value's own limit) edits away.

    An entry is cut into ``edits + 1`` segments, of which as many edits leave one as it is: it stands in the value, off
    its place by no more than the edits before it and after it allow, and some such segment has no more edits before it
    than segments, and no more after it. Only values and entries that agree in such a segment, and whose letters as a
    whole differ by no more than the edits, are compared; a pair that agrees in several is compared for each.
    """
    start, size = _segments("largo", str(edits + 1), "parte")
    cut = entries.withColumn("parte", F.explode(F.sequence(F.lit(0), F.lit(edits)))).select(
        "entrada", "orden", "largo", "letras", "parte", F.expr(f"substring(entrada, {start} + 1, {size})").alias("segmento"))
    limited = values.withColumn("_t", F.least(F.lit(edits), F.col("limite")))
    probes = limited.select("norma", "_t", "_largo", "_letras",
                            F.explode(F.sequence(F.col("_largo") - F.col("_t"), F.col("_largo") + F.col("_t"))).alias("largo"))
    # The lengths that occur: at most as many as the longest entry has letters.
    probes = probes.join(F.broadcast(lengths), "largo").select("*", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("parte"))
    probes = probes.selectExpr("*", f"{start} AS _i", f"{size} AS _n", "_largo - largo AS _mas").selectExpr(
        "*", f"greatest(0, _i - least(parte, {edits} - parte - _mas, CAST(floor((_t - _mas) / 2) AS INT))) AS _a",
        f"least(_largo - _n, _i + least(parte, {edits} - parte + _mas, CAST(floor((_t + _mas) / 2) AS INT))) AS _b").where("_a <= _b")
    probes = probes.selectExpr("norma", "_t", "_letras", "largo", "parte", "_n", "explode(sequence(_a, _b)) AS _desde")
    probes = probes.selectExpr("norma", "_t", "_letras", "largo", "parte", "substring(norma, _desde + 1, _n) AS segmento")
    if probes.count() <= BROADCAST_PROBES:
        probes = F.broadcast(probes)
    pairs = probes.join(cut, ["largo", "parte", "segmento"]).where(
        "bit_count(_letras & ~letras) <= _t AND bit_count(letras & ~_letras) <= _t")
    far = pairs.withColumn("distancia", F.levenshtein("norma", "entrada", edits))
    return far.where((F.col("distancia") >= 0) & (F.col("distancia") <= F.col("_t"))).select("norma", "orden", "entrada", "distancia")


def nearest_entries(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``norma, sugerido``: the entry of ``catalogue`` (``entrada, orden``) nearest to each distinct ``norma`` of
    ``values``, the first by ``orden`` and then by its letters on ties, null where it is further than a third of the letters, one at least.

    Values look for entries one edit away, those without for two, and so on up to their limit, in steps of one up to
    ``STEPS`` edits and then by doubling, so that a short search serves most. A value longer than half as much again as
    every entry has none to look for. Empty values have no suggestion.
    """
    spark = values.sparkSession
    entries = freeze(catalogue.where("entrada IS NOT NULL").groupBy("entrada").agg(F.min("orden").alias("orden")).withColumn(
        "largo", F.length("entrada")).withColumn("letras", F.when(F.col("largo") > 0, F.expr(_letters("entrada"))).otherwise(0)))
    lengths = entries.select("largo").distinct()
    longest = entries.agg(F.max("largo")).first()[0] or 0
    todo = freeze(values.select("norma").distinct().withColumn("_largo", F.length("norma")).withColumn(
        "limite", F.greatest(F.lit(1), F.floor(F.col("_largo") / 3)).cast("int")))
    open_values = todo.where((F.col("_largo") > 0) & (F.col("_largo") - F.col("limite") <= longest)).withColumn(
        "_letras", F.expr(_letters("norma")))
    found = local_rows(spark, [], "norma string, sugerido string")
    edits = 1
    while True:
        least = open_values.agg(F.min(F.col("_largo") - F.least("limite", F.lit(edits)))).first()[0]
        near = _within(open_values, entries.where(F.col("largo") >= F.lit(least)), lengths, edits)
        now = freeze(near.groupBy("norma").agg(F.min(F.struct("distancia", "orden", "entrada")).alias("_m")).select(
            "norma", F.col("_m.entrada").alias("sugerido")))
        found = found.unionByName(now)
        open_values = freeze(open_values.join(now, "norma", "left_anti").where(F.col("limite") > edits))
        if open_values.isEmpty():
            break
        edits = edits + 1 if edits < STEPS else edits * 2
    return todo.select("norma").join(found, "norma", "left")
