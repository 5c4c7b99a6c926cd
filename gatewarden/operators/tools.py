"""The tool gate: which calls of a model may run, and with which arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewarden.functions.jsonshape import mask_strings, schema_errors, strict_json
from gatewarden.functions.match import any_wildcard, contains_entity
from gatewarden.functions.redact import let
from gatewarden.rules import EntityRule, default_entities


# What is said of calls without a name. The other reasons in this file are fixed too.
NAMELESS_CALL, NAMELESS_BLOCK = "tool call missing function.name", "tool_use missing name"


@dataclass(frozen=True)
class ToolGate:
    """Without ``allow`` every name that is not denied may run; wildcards as in ``match.wildcard``."""

    allow: Sequence[str] | None = None
    deny: Sequence[str] = ()
    schemas: Mapping[str, dict[str, Any]] = field(default_factory=dict)
    reject: frozenset[str] = frozenset()
    mask: frozenset[str] = frozenset()
    rules: Sequence[EntityRule] = field(default_factory=default_entities)

    def decision(self, name: Column, arguments: Column, nameless: str = NAMELESS_CALL) -> Column:
        """decision (allow, deny, sanitize), reason, arguments; the first failure is the reason.

        Arguments are JSON text, parsed once.
        """
        args = F.coalesce(arguments, F.lit("{}"))
        return let(F.struct(args.alias("args"), strict_json(args).alias("value")), lambda a: self._decision(name, a["args"], a["value"], nameless))

    def block_decision(self, name: Column, input: Column) -> Column:
        """``decision`` of a tool_use block, whose input is a parsed value (a variant; null: an empty object).

        Arguments are the value's own compact text.
        """
        args = F.coalesce(F.to_json(input), F.lit("{}"))
        return let(args, lambda a: self._decision(name, a, F.coalesce(input, F.parse_json(F.lit("{}"))), NAMELESS_BLOCK))

    def _decision(self, name: Column, args: Column, value: Column, nameless: str) -> Column:
        say = lambda text: F.concat(F.lit("tool `"), name, F.lit("` " + text))
        steps = [F.when(name.isNull(), nameless), F.when(any_wildcard(name, self.deny), say("is on the deny list"))]
        if self.allow is not None:
            steps.append(F.when(~any_wildcard(name, self.allow), say("is not on the allow list")))
        steps.append(F.when(value.isNull(), say("arguments are not valid JSON")))
        for tool, schema in self.schemas.items():
            failed = let(schema_errors(value, schema), lambda e: F.when(F.size(e) > 0, F.concat(say("arguments failed schema: "), F.array_join(e, "; "))))
            steps.append(F.when(name == tool, failed))
        if self.reject:
            steps.append(F.when(contains_entity(args, self.rules, set(self.reject)), say("arguments contain rejected entity")))
        mask = contains_entity(args, self.rules, set(self.mask)) if self.mask else F.lit(False)

        def made(reason: Column) -> Column:
            kind = F.when(reason.isNotNull(), "deny").when(mask, "sanitize").otherwise("allow")
            out = lambda k: F.when(k == "sanitize", mask_strings(args, self.rules, set(self.mask))).when(k == "allow", args)
            return let(kind, lambda k: F.struct(k.alias("decision"), reason.alias("reason"), out(k).alias("arguments")))

        return let(F.coalesce(*steps), made)

    def applied(self, calls: Column) -> Column:
        """kept and denied of an array of calls (id, name, arguments): denied ones go, sanitized ones are rewritten."""
        judged = F.transform(calls, lambda c: F.struct(c.alias("c"), self.decision(c["name"], c["arguments"]).alias("d")))
        kept = F.transform(F.filter(judged, lambda j: j["d"]["decision"] != "deny"), lambda j: j["c"].withField("arguments", F.when(j["d"]["decision"] == "sanitize", j["d"]["arguments"]).otherwise(j["c"]["arguments"])))
        denied = F.transform(F.filter(judged, lambda j: j["d"]["decision"] == "deny"), lambda j: F.struct(F.coalesce(j["c"]["name"], F.lit("?")).alias("name"), j["d"]["reason"].alias("reason")))
        return F.struct(kept.alias("kept"), denied.alias("denied"))
