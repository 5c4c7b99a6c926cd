"""Evaluation of recognizers: detected spans against gold ones.

Spans are gathered by text, or where there are many by clusters of spans that overlap, and matched one to one, in the order of
detection, each to the first gold span that is still free. No pairs are formed by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.functions.redact import let

GOLD = "id string, text string, annotations array<struct<type: string, start: int, end: int>>"


def matched(detected: Column, gold: Column, strict: bool = False) -> Column:
    """For each detected span the index of its gold span (from 0), or -1.

    Spans are structs of entity, start, end. Lenient: the same entity and a byte in common.
    """
    if strict:
        fits = lambda d, g: (d["entity"] == g["entity"]) & (d["start"] == g["start"]) & (d["end"] == g["end"])
    else:
        fits = lambda d, g: (d["entity"] == g["entity"]) & (d["start"] < g["end"]) & (g["start"] < d["end"])
    places = F.sequence(F.lit(0), F.size(gold) - 1)
    places = F.when(F.size(gold) > 0, places).otherwise(F.array().cast("array<int>"))

    def step(used: Column, d: Column) -> Column:
        free = F.filter(places, lambda i: fits(d, F.get(gold, i)) & ~F.array_contains(used, i))
        return F.array_append(used, F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(-1)))

    return F.aggregate(detected, F.array().cast("array<int>"), step)


#: Texts with so many pairs of a detected and a gold span, and fewer, are matched as they are.
FEW_PAIRS = 1024


def outcomes(df: DataFrame, keys: list[str], detected: str = "detected", gold: str = "gold", strict: bool = False) -> DataFrame:
    """One row a span: keys, kind (tp, fp, fn), entity, start, end, place.

    ``keys`` name a text. Where it has many spans they are swept by their start first: spans that no other one reaches across, alike in
    entity, are a cluster, and matches stay inside clusters, which are few spans each.
    """
    pairs = F.size(detected).cast("long") * F.size(gold)
    rows = df.select(*keys, F.coalesce(detected, F.array().cast(SPAN)).alias("detected"), F.coalesce(gold, F.array().cast(SPAN)).alias("gold"), (F.coalesce(pairs, F.lit(0)) > FEW_PAIRS).alias("_many"))
    few = _judged(rows.where("not _many"), keys, strict)
    return few.unionByName(_judged(_clusters(rows.where("_many"), keys, strict), keys, strict))


SPAN = "array<struct<entity: string, start: int, end: int>>"


def _spans(spans: str) -> Column:
    return F.transform(spans, lambda s, i: F.struct(s["entity"].alias("entity"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), i.alias("i")))


def _clusters(rows: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """The spans of texts by cluster, each with its place ``i`` in its text."""
    def of_side(side: str) -> Column:
        return F.transform(_spans(side), lambda s: F.struct(F.lit(side).alias("side"), s.alias("s")))

    both = F.concat(of_side("detected"), of_side("gold"))
    spans = rows.select(*keys, F.explode(both).alias("x")).select(*keys, "x.side", "x.s", "x.s.entity", "x.s.start", "x.s.end")
    if strict:
        cluster = [*keys, "entity", "start", "end"]
    else:
        by = W.partitionBy(*keys, "entity").orderBy("start", "end")
        reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
        spans = spans.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
        spans = spans.withColumn("_cluster", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
        cluster = [*keys, "entity", "_cluster"]
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("s.i", "s.entity", "s.start", "s.end"))))
    return spans.groupBy(*cluster).agg(of("detected").alias("detected"), of("gold").alias("gold")).drop("entity", "start", "end", "_cluster")


def _judged(rows: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    detected, gold = F.col("detected"), F.col("gold")
    placed = "i" in rows.schema["detected"].dataType.elementType.names
    place = lambda s, i: s["i"] if placed else i
    one = lambda kind, s, i: F.struct(kind.alias("kind"), s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"), place(s, i).alias("place"))

    def judged(m: Column) -> Column:
        found = F.transform(detected, lambda s, i: one(F.when(F.get(m, i) >= 0, "tp").otherwise("fp"), s, i))
        missed = F.filter(F.transform(gold, lambda s, i: one(F.when(~F.array_contains(m, i), "fn"), s, i)), lambda x: x["kind"].isNotNull())
        return F.concat(found, missed)

    return rows.select(*keys, F.explode(let(matched(detected, gold, strict), judged)).alias("s")).select(*keys, "s.*")


def ratios(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; a ratio over nothing is 0."""
    safe = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    df = df.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", safe(2 * p * r, p + r))


def report(spans: DataFrame) -> DataFrame:
    """tp, fp, fn and ratios by entity, and in the row TOTAL of all."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    by = spans.rollup("entity").agg(*counts).select(F.coalesce("entity", F.lit("TOTAL")).alias("entity"), "tp", "fp", "fn")
    return ratios(by)


def gate(by_entity: DataFrame) -> DataFrame:
    """One row: whether any entity with gold spans has f1 of 0 (exit code 2), else 0."""
    bad = F.bool_or((F.col("tp") + F.col("fn") > 0) & (F.col("f1") == 0.0))
    return by_entity.where("entity <> 'TOTAL'").agg(F.when(F.coalesce(bad, F.lit(False)), 2).otherwise(0).alias("exit_code"))


def examples(spans: DataFrame, kind: str, order: list[str], n: int = 5) -> DataFrame:
    """The first n false positives or negatives in the corpus' order."""
    return spans.where(F.col("kind") == kind).orderBy(*order, "place").limit(n)
