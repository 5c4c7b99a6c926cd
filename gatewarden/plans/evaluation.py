"""Queries of recognizer evaluation, with gold spans where values were put into the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.functions import redact
from gatewarden.operators import evaluate
from gatewarden.plans.registry import q, query, table
from gatewarden.rules import default_entities

RULES = tuple(r for r in default_entities() if r.entity in ("EMAIL", "SSN", "CARD"))
MAIL, NUMBER = "user@example.com", "123-45-6789"


def corpus(spark, folder):
    """doc_id, detected, gold: a mail address and a number after each text; every fifth gold is shifted by a byte.

    Of each seventh document the number is annotated as a card.
    """
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    shift = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    mail = F.struct(F.lit("EMAIL").alias("entity"), (size + 1 + shift).alias("start"), (size + 1 + len(MAIL) + shift).alias("end"))
    number = F.struct(F.when(F.col("doc_id") % 7 == 0, "CARD").otherwise("SSN").alias("entity"), (size + len(MAIL) + 2).alias("start"), (size + len(MAIL) + 2 + len(NUMBER)).alias("end"))
    text = F.concat("text", F.lit(f" {MAIL} {NUMBER}"))
    spans = F.transform(redact.spans(text, RULES), lambda s: F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end")))
    return docs.select("doc_id", F.array(mail, number).alias("gold"), spans.alias("detected"))


def _detected() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p, m = f"string_split_regex(t, {q(r.pattern)})", f"regexp_extract_all(t, {q(r.pattern)})"
        parts.append(f"SELECT doc_id, {k} AS rule, i, '{r.entity}' AS entity, CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS BIGINT) AS s, strlen(m[i]) AS n FROM (SELECT doc_id, {p} AS p, {m} AS m, unnest(range(1, len({m}) + 1)) AS i FROM (SELECT doc_id, coalesce(text, '') || ' {MAIL} {NUMBER}' AS t FROM documents) a{k}) b{k}")
    return "SELECT doc_id, entity, s AS start, s + n AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY rule, i) - 1 AS place FROM (" + " UNION ALL ".join(parts) + ") u"


GOLD = f"""SELECT doc_id, 'EMAIL' AS entity, strlen(coalesce(text, '')) + 1 + (doc_id % 5 = 0)::INT AS start, strlen(coalesce(text, '')) + {1 + len(MAIL)} + (doc_id % 5 = 0)::INT AS stop, 0 AS place FROM documents
UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'CARD' ELSE 'SSN' END, strlen(coalesce(text, '')) + {len(MAIL) + 2}, strlen(coalesce(text, '')) + {len(MAIL) + 2 + len(NUMBER)}, 1 FROM documents"""


def outcomes_sql(strict: bool) -> str:
    """Gold spans of one text and entity are one here, so the first overlapping detection has it."""
    fits = "d.start = g.start AND d.stop = g.stop" if strict else "d.start < g.stop AND g.start < d.stop"
    return f"""WITH d AS ({_detected()}), g AS ({GOLD}),
m AS (SELECT g.doc_id, g.place AS gp, min(d.place) AS dp FROM g JOIN d ON d.doc_id = g.doc_id AND d.entity = g.entity AND {fits} GROUP BY ALL)
SELECT d.doc_id, CASE WHEN m.dp IS NULL THEN 'fp' ELSE 'tp' END AS kind, entity, start, stop, d.place FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND m.dp = d.place
UNION ALL SELECT g.doc_id, 'fn', entity, start, stop, place FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.gp = g.place WHERE m.gp IS NULL"""


def report_sql(strict: bool) -> str:
    n = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("tp", "fp", "fn"))
    return f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM
(SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM
(SELECT coalesce(entity, 'TOTAL') AS entity, {n} FROM ({outcomes_sql(strict)}) o GROUP BY ROLLUP (entity)) c) p"""


@query("eval_outcomes", f"SELECT doc_id, kind, entity, start AS start_byte, stop AS end_byte FROM ({outcomes_sql(False)}) o")
def eval_outcomes(spark, folder):
    rows = evaluate.outcomes(corpus(spark, folder), ["doc_id"])
    return rows.select("doc_id", "kind", "entity", F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte"))


@query("eval_report", report_sql(False))
def eval_report(spark, folder):
    return evaluate.report(evaluate.outcomes(corpus(spark, folder), ["doc_id"]))


@query("eval_report_strict", report_sql(True))
def eval_report_strict(spark, folder):
    return evaluate.report(evaluate.outcomes(corpus(spark, folder), ["doc_id"], strict=True))


@query("eval_gate", f"SELECT CASE WHEN bool_or(tp + fn > 0 AND f1 = 0) THEN 2 ELSE 0 END AS exit_code FROM ({report_sql(False)}) r WHERE entity <> 'TOTAL'")
def eval_gate(spark, folder):
    return evaluate.gate(eval_report(spark, folder))


@query("eval_misses", f"SELECT doc_id, entity, start AS start_byte FROM ({outcomes_sql(False)}) o WHERE kind = 'fn' ORDER BY doc_id, place LIMIT 5")
def eval_misses(spark, folder):
    rows = evaluate.examples(evaluate.outcomes(corpus(spark, folder), ["doc_id"]), "fn", ["doc_id"])
    return rows.select("doc_id", "entity", F.col("start").cast("long").alias("start_byte"))


@query("eval_false_positives", f"SELECT doc_id, entity, start AS start_byte FROM ({outcomes_sql(False)}) o WHERE kind = 'fp' ORDER BY doc_id, place LIMIT 5")
def eval_false_positives(spark, folder):
    rows = evaluate.examples(evaluate.outcomes(corpus(spark, folder), ["doc_id"]), "fp", ["doc_id"])
    return rows.select("doc_id", "entity", F.col("start").cast("long").alias("start_byte"))
