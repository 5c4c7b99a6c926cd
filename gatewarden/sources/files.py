"""Rule files: keyword and entity dictionaries, policy bundles, gold corpora, reports, backups.

Each dictionary format is read twice over: on the driver (a rule file is small), and as a column
expression over lines, for folders of many files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.functions.normalize import normalized_literal
from gatewarden.operators.evaluate import GOLD
from gatewarden.rules import TIERS, EntityRule, KeywordRule, Normalize, checked, regex_body

SEVERITY = "medium"
ACTIONS = ("block", "alert", "flag", "redact", "reject", "log")


class RuleFileError(ValueError):
    """A rule file that cannot be used, with its line."""


def _lines(text: str) -> Iterator[tuple[int, str]]:
    for i, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if line and not line.startswith("#"):
            yield i, line


def keyword_rules(text: str, name: str = "line", options: Normalize = Normalize()) -> list[KeywordRule]:
    """Rules of ``pattern TAB key TAB weight`` lines; key 0 block, 1 alert, 2 flag; /body/ is a pattern."""
    out = []
    for i, line in _lines(text):
        cols = [c.strip() for c in line.split("\t")]
        if not cols[0]:
            continue
        if len(cols) < 2:
            raise RuleFileError(f"{name}:{i}: missing key")
        if not re.fullmatch(r"\+?\d+", cols[1], re.ASCII):
            raise RuleFileError(f"{name}:{i}: invalid key `{cols[1]}`")
        if int(cols[1]) > 2:
            raise RuleFileError(f"{name}:{i}: unsupported key `{cols[1]}`")
        body = regex_body(cols[0])
        try:
            pattern = checked(body) if body else cols[0]
            if not body:
                normalized_literal(pattern, options)
        except ValueError as error:
            raise RuleFileError(f"{name}:{i}: {error}") from error
        weight = float(cols[2]) if len(cols) > 2 and re.fullmatch(r"[+-]?\d+(\.\d*)?", cols[2]) else 1.0
        out.append(KeywordRule(pattern, TIERS[int(cols[1])], body is not None, weight))
    return out


def entity_rules(text: str, strict: bool = False) -> list[EntityRule]:
    """Rules of ``/pattern/ TAB entity`` lines; without a name, or with a number, the entity is PII_line.

    Lines without a pattern are passed over, as are patterns that do not compile (with ``strict`` they raise).
    """
    out = []
    for i, line in _lines(text):
        cols = line.split("\t")
        if not cols[0].startswith("/") or cols[0].rfind("/") == 0:
            continue
        pattern = cols[0][1 : cols[0].rfind("/")]
        if not pattern:
            continue
        label = cols[1].strip() if len(cols) > 1 else ""
        try:
            out.append(EntityRule(f"PII_{i}" if not label or label.isdigit() else label.upper(), checked(pattern)))
        except ValueError as error:
            if strict:
                raise RuleFileError(f"line {i}: {error}") from error
    return out


def keyword_lines(line: Column) -> Column:
    """error, kind (literal or regex), pattern, tier, weight of a dictionary line; null for blank lines and comments."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    cols = F.transform(F.split(trimmed, "\t", -1), lambda c: F.trim(c))
    pattern, key = F.get(cols, 0), F.get(cols, 1)
    body = F.nullif(F.regexp_extract(pattern, r"^/(.+)/$", 1), F.lit(""))
    number = F.when(F.regexp_like(key, F.lit(r"^\+?[0-9]+$")), key.try_cast("long"))
    error = F.when(key.isNull(), "missing key").when(number.isNull(), F.concat(F.lit("invalid key `"), key, F.lit("`"))).when(number > 2, F.concat(F.lit("unsupported key `"), key, F.lit("`")))
    tier = F.when(number == 0, "block").when(number == 1, "alert").when(number == 2, "flag")
    made = F.struct(error.alias("error"), F.when(body.isNull(), "literal").otherwise("regex").alias("kind"), F.coalesce(body, pattern).alias("pattern"), tier.alias("tier"), F.coalesce(F.get(cols, 2).try_cast("double"), F.lit(1.0)).alias("weight"))
    return F.when((trimmed != "") & ~F.startswith(trimmed, F.lit("#")) & (pattern != ""), made)


def entity_lines(line: Column, number: Column) -> Column:
    """entity and pattern of a line of an entity dictionary; null where there is no pattern."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    cols = F.split(trimmed, "\t", -1)
    pattern = F.nullif(F.regexp_extract(F.get(cols, 0), r"^/(.*)/[^/]*$", 1), F.lit(""))
    label = F.trim(F.coalesce(F.get(cols, 1), F.lit("")))
    entity = F.when((label == "") | F.regexp_like(label, F.lit("^[0-9]+$")), F.concat(F.lit("PII_"), number.cast("string"))).otherwise(F.upper(label))
    return F.when(~F.startswith(trimmed, F.lit("#")) & pattern.isNotNull(), F.struct(entity.alias("entity"), pattern.alias("pattern")))


@dataclass(frozen=True)
class PolicyRule:
    id: str
    pattern: str
    action: str
    category: str = ""
    severity: str = SEVERITY
    placeholder: str | None = None
    message: str | None = None
    compliance: tuple[str, ...] = ()

    @property
    def body(self) -> str | None:
        return self.pattern[1:-1] if len(self.pattern) >= 2 and self.pattern[0] == "/" == self.pattern[-1] else None


@dataclass(frozen=True)
class Policy:
    rules: tuple[PolicyRule, ...] = ()
    name: str | None = None

    def keywords(self) -> list[KeywordRule]:
        """Literal block, alert and flag rules; they come after inline rules and before dictionaries."""
        return [KeywordRule(r.pattern, r.action) for r in self.rules if r.body is None and r.action in TIERS]

    def entities(self) -> list[EntityRule]:
        """Patterns of redact rules by placeholder."""
        return [EntityRule(r.placeholder, r.body) for r in self.rules if r.action == "redact" and r.body and r.placeholder]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.id, r.category, r.severity, r.body or r.pattern, r.body is not None, r.action, r.placeholder, r.message, list(r.compliance)) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "ord int, rule_id string, category string, severity string, pattern string, regex boolean, action string, placeholder string, message string, compliance array<string>")


def policy(text: str) -> Policy:
    """A policy bundle in YAML, version 1; raises RuleFileError for what cannot be used."""
    try:
        import yaml
    except ImportError as error:
        raise RuleFileError("policy bundles need the yaml package") from error
    try:
        raw = yaml.safe_load(text)
        if not isinstance(raw, dict) or raw.get("version") != 1:
            raise RuleFileError("a policy bundle is a mapping of version 1")
        rules = tuple(PolicyRule(**{**r, "compliance": tuple(r.get("compliance") or ())}) for r in raw.get("rules") or [])
    except (yaml.YAMLError, TypeError) as error:
        raise RuleFileError(f"policy: {error}") from error
    seen: set[str] = set()
    for r in rules:
        if not r.id:
            raise RuleFileError("a policy rule lacks its id")
        if r.id in seen:
            raise RuleFileError(f"policy rule {r.id!r} occurs twice")
        seen.add(r.id)
        if not r.pattern:
            raise RuleFileError(f"policy rule {r.id!r} lacks a pattern")
        if r.action not in ACTIONS:
            raise RuleFileError(f"policy rule {r.id!r}: no such action as {r.action!r}")
        if r.action == "redact" and not r.placeholder:
            raise RuleFileError(f"policy rule {r.id!r} redacts, but names no placeholder")
    return Policy(rules, (raw.get("metadata") or {}).get("name"))


def policy_errors(rules: DataFrame) -> DataFrame:
    """rule_id and error of rules in a table (rule_id, pattern, action, placeholder); one row an error."""
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(
        F.when(F.coalesce("rule_id", F.lit("")) == "", "rule has empty id").otherwise(none), F.when(F.coalesce("pattern", F.lit("")) == "", "empty pattern").otherwise(none),
        F.when((F.col("action") == "redact") & F.col("placeholder").isNull(), "redact requires placeholder").otherwise(none),
    ))
    own = rules.select("rule_id", F.explode(found).alias("error"))
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1 and rule_id <> ''").select("rule_id", F.lit("duplicate rule id").alias("error"))
    return own.unionByName(twice)


def gold_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of a gold corpus in JSON lines; a malformed line fails the read."""
    return spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def kept_backups(files: DataFrame, keep: int) -> DataFrame:
    """The newest backups (stem, path, mtime) of each file with their rank; 0 keeps all."""
    ranked = files.withColumn("rank", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("mtime"), F.desc("path"))))
    return ranked.where(F.col("rank") <= keep) if keep else ranked


def file_kind(path: Column) -> Column:
    """What a rule file is by its path: policy, config, entities, keywords or unknown."""
    low = F.lower(path)
    yaml = F.endswith(low, F.lit(".yaml")) | F.endswith(low, F.lit(".yml"))
    text = F.endswith(low, F.lit(".txt"))
    return F.when(yaml, "policy").when(F.endswith(low, F.lit(".toml")), "config").when(text & F.contains(low, F.lit("pii")), "entities").when(text, "keywords").otherwise("unknown")


def validated(path: str, content: str) -> str | None:
    """The error of a file of the kind that its path names; None if it can be used."""
    low = path.lower()
    try:
        if low.endswith((".yaml", ".yml")):
            policy(content)
        elif low.endswith(".toml"):
            from gatewarden.sources.config import config

            config(content)
        elif low.endswith(".txt") and "pii" in low:
            entity_rules(content, strict=True)
        elif low.endswith(".txt"):
            keyword_rules(content)
        else:
            return f"unknown file type for `{path}`"
    except ValueError as error:
        return str(error)
    return None


def report_json(rows: list[dict]) -> str:
    return json.dumps(rows, indent=2, ensure_ascii=False)
