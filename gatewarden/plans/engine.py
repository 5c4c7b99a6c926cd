"""The guard as one plan: a configuration becomes an immutable engine, and its stages apply to tables of requests."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions import jsonshape, match, redact, spotlight
from gatewarden.operators import lookups
from gatewarden.operators.tools import ToolGate
from gatewarden.rules import BARE, EntityRule, KeywordRule, RuleSet, default_entities
from gatewarden.sources import files
from gatewarden.sources.config import Config, Pool, pool


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@dataclass(frozen=True)
class Engine:
    """All that a request meets, in order: keywords, personal data, spotlighting, budget, routing, and on the way back the rest."""

    config: Config
    keywords: RuleSet
    entities: tuple[EntityRule, ...]
    style: str
    actions: dict[str, frozenset[str]]
    spotlight: spotlight.Spotlight | None
    gate: ToolGate | None
    schemas: tuple[tuple[str, str | None, str, dict], ...]
    pool: Pool
    policy: files.Policy | None

    @classmethod
    def build(cls, config: Config, read: Callable[[str], str] = _read) -> Engine:
        """All or nothing: any error leaves an engine that runs already as it is."""
        own = config.input.keyword
        rules = [KeywordRule(p, t) for t, ps in (("block", own.inline_block), ("alert", own.inline_alert), ("flag", own.inline_flag)) for p in ps]
        bundle = files.policy(read(config.policies.bundle_path)) if config.policies.bundle_path else None
        rules += bundle.keywords() if bundle else []
        for path in own.dict_paths:
            rules += files.keyword_rules(read(path), path, own.normalize)
        pii = config.input.pii
        entities = list(default_entities())
        for path in pii.dict_paths:
            entities += files.entity_rules(read(path))
        section = config.input.spotlight
        how = None
        if section.enabled:
            how = spotlight.Spotlight(spotlight.method_of(section.method), section.untrusted_roles, section.delimiter_open, section.delimiter_close, section.datamark_char[:1] or "^", section.system_rider)
        gate = None
        if config.tools.enabled:
            t = config.tools
            gate = ToolGate(t.allow, t.deny, {x.tool_name: json.loads(read(x.schema_path)) for x in t.schemas}, frozenset(t.reject_entities), frozenset(t.mask_entities), tuple(entities))
        out = config.output.schema
        schemas = tuple((r.endpoint, r.model_pattern or None, r.name or r.schema_path, json.loads(read(r.schema_path))) for r in out.rules) if out.enabled else ()
        return cls(config, RuleSet(tuple(rules), own.normalize), tuple(entities), redact.style_of(pii.placeholder_style, pii.reversible), redact.partition_by_action(entities, pii.entities, pii.action), how, gate, schemas, pool(config), bundle)

    def guarded(self, requests: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
        """Requests (messages) with level, rule, outcome (blocked, rejected, passed) and messages as they go on.

        Blocked and rejected requests keep their messages as they came. With a reversible
        style, ``vault`` holds what the placeholders stand for; numbers run over the whole request.
        """
        cfg = self.config.input
        rows = requests.withColumn("_text", text(F.col("messages")))
        if cfg.enabled:
            rows = match.classified(rows, "_text", self.keywords, "_v", cfg.shadow, cfg.keyword.engine)
        else:
            rows = rows.withColumn("_v", F.struct(F.lit("clean").alias("level"), F.lit(None).cast("string").alias("rule")))
        reject = match.contains_entity(F.col("_text"), self.entities, set(self.actions["reject"])) if cfg.pii.enabled else F.lit(False)
        outcome = F.when(F.col("_v.level") == "block", "blocked").when(reject, "rejected").otherwise("passed")
        rows = rows.select(*requests.columns, F.col("_v.level").alias("level"), F.col("_v.rule").alias("rule"), outcome.alias("outcome")).withColumn("_kept", F.col("messages"))
        mask = set(self.actions["mask"])
        if cfg.pii.enabled and cfg.pii.reversible:
            chosen = redact.chosen(self.entities, mask)
            rows = rows.withColumn("_texts", F.flatten(F.transform("messages", lambda m: F.concat(F.array(m["content"]), F.coalesce(F.transform(m["parts"], lambda p: p["text"]), F.array().cast("array<string>"))))))
            rows = redact.with_vault(rows, "_texts", chosen, self.style)
            rows = rows.withColumn("messages", _refilled(F.col("messages"), F.col("_texts"))).drop("_texts")
        elif cfg.pii.enabled:
            rows = redact.with_redacted_messages(rows, "messages", self.entities, self.style if self.style != BARE else BARE, mask)
        if self.spotlight:
            rows = rows.withColumn("messages", spotlight.spotlighted_messages(F.col("messages"), self.spotlight))
        return rows.withColumn("messages", F.when(F.col("outcome") == "passed", F.col("messages")).otherwise(F.col("_kept"))).drop("_kept")

    def routed(self, requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        rows = [(i, r.model, r.backend, list(r.fallback)) for i, r in enumerate(self.pool.rules)]
        routes = spark.createDataFrame(rows, "ord int, pattern string, backend string, fallback array<string>")
        return lookups.routed(requests, routes, self.pool.default)

    def answered(self, replies: DataFrame, vault: str | None = None) -> DataFrame:
        """Replies (content, calls) masked, restored and gated; adds denied, and schema_passed if rules are configured."""
        content = F.col("content")
        if self.config.output.enabled:
            content = redact.masked_output(content)
        if vault and self.config.input.pii.reversible:
            content = redact.restored(content, F.col(vault), self.config.input.pii.deanonymize_strategy)
        rows = replies.withColumn("content", content)
        if self.gate:
            rows = rows.withColumn("_g", self.gate.applied(F.col("calls"))).withColumn("calls", F.col("_g.kept")).withColumn("denied", F.col("_g.denied")).drop("_g")
        if self.schemas:
            steps = [F.when((F.col("endpoint") == e) & (F.regexp_like("model", F.lit(p)) if p else F.lit(True)), jsonshape.validated(F.col("content"), s)["passed"]) for e, p, _, s in self.schemas]
            rows = rows.withColumn("schema_passed", F.coalesce(*steps))
        return rows


def _refilled(messages: Column, texts: Column) -> Column:
    """Messages with their content and parts taken from a flat list of texts, in order."""
    size = lambda m: 1 + F.coalesce(F.size(m["parts"]), F.lit(0))

    def one(m: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(messages, F.lit(1), i), F.lit(0), lambda a, x: a + F.when(x["parts"].isNull(), 1).otherwise(size(x)))
        return m.withField("content", F.get(texts, start)).withField("parts", F.transform(m["parts"], lambda p, j: p.withField("text", F.get(texts, start + 1 + j))))

    return F.transform(messages, one)


def error_label(error: BaseException) -> str:
    """What a failed build is logged as."""
    while error is not None:
        if isinstance(error, tomllib.TOMLDecodeError):
            return "config_parse_error"
        if type(error).__module__.startswith("yaml"):
            return "policy_yaml_parse_error"
        if isinstance(error, re.error):
            return "regex_compile_error"
        if isinstance(error, json.JSONDecodeError):
            return "json_parse_error"
        if isinstance(error, FileNotFoundError):
            return "file_not_found"
        if isinstance(error, PermissionError):
            return "file_permission_denied"
        if isinstance(error, OSError):
            return "io_error"
        error = error.__cause__
    return "build_failed"


def reload_entry(error: BaseException | None, request_id: str, timestamp: str, latency_us: int) -> dict:
    """The log entry of a build that worked or failed."""
    base = {"request_id": request_id, "timestamp": timestamp, "verdict": "reload_failed" if error else "reload_ok", "latency_us": latency_us}
    return base | ({"error": error_label(error)} if error else {})
