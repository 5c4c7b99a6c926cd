"""JSON: blobs in prose, string leaves, schema checks, chat shapes of two interfaces."""

from __future__ import annotations

import functools
import json as jsonlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewarden.functions.normalize import interleaved
from gatewarden.functions.redact import let, redacted
from gatewarden.rules import EntityRule

#: A string of a JSON text; with the colon after it, if it is a key.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'
ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}


def decoded(token: Column) -> Column:
    """The text that a JSON string (with its quotes) stands for."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0)).otherwise(plain)


def encoded(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def changed_strings(json: Column, change) -> Column:
    """JSON text with every string value changed by a function of what it stands for, at any depth.

    Keys, layout and values that do not change stay as they are; others are written anew, so the text stays JSON whatever is changed.
    """
    def new(token: Column) -> Column:
        def both(old: Column) -> Column:
            return let(change(old), lambda x: F.when(x == old, token).otherwise(encoded(x)))

        return F.when(F.endswith(token, F.lit(":")), token).otherwise(F.coalesce(let(decoded(token), both), token))

    return interleaved(json, STRING, new)


def mask_strings(json: Column, rules: Sequence[EntityRule], entities: set[str] | None = None) -> Column:
    """JSON text with every string value redacted at any depth; keys and layout stay."""
    return changed_strings(json, lambda s: redacted(s, rules, entities))


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing after it; else null.

    Spark's parser ignores what follows the first value, so the text is also parsed inside a list and an object.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(listed, lambda v: F.when((F.size(v) == 1) & inside.isNotNull(), F.get(v, 0)))


def blob(text: Column) -> Column:
    """The JSON that a reply wraps: a fenced block, else from the first opening to the last closing bracket, else the text."""
    trimmed = F.regexp_extract(text, r"(?s)^\s*(.*?)\s*$", 1)
    fence = r"(?s)^```(?:[^\n]*\n)?+(.*)```"
    inside = F.regexp_extract(F.regexp_extract(trimmed, fence, 1), r"(?s)^\s*(.*?)\s*$", 1)
    bracket = F.nullif(F.regexp_extract(trimmed, r"(?s)[{\[].*[}\]]", 0), F.lit(""))
    return F.when(F.regexp_like(trimmed, F.lit(fence)), inside).otherwise(F.coalesce(bracket, trimmed))


def _kind(value: Column) -> Column:
    """JSON type of a variant: object, array, string, boolean, null, integer or number."""
    s = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "double")
    number = F.when(whole == F.floor(whole), "integer").otherwise("number")
    return (
        F.when(F.startswith(s, F.lit("OBJECT")), "object").when(F.startswith(s, F.lit("ARRAY")), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise(number)
    )


KNOWN = {
    "type", "enum", "const", "required", "properties", "patternProperties", "additionalProperties", "items", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength",
    "minItems", "maxItems", "uniqueItems", "pattern", "minProperties", "maxProperties", "allOf", "anyOf", "oneOf", "not", "$ref", "$defs", "definitions",
    "if", "then", "else", "prefixItems", "contains", "minContains", "maxContains", "dependentRequired", "propertyNames",
}


def _target(root: dict[str, Any], ref: str) -> Any:
    """What a local reference of a schema points to."""
    if not ref.startswith("#"):
        raise NotImplementedError(f"schema reference {ref}: only references within the schema are known")
    found: Any = root
    for part in ref[1:].split("/")[1:]:
        found = found[part.replace("~1", "/").replace("~0", "~")]
    return found


#: Keywords whose schemas are for the value itself, and those whose schemas are for what it holds.
SAME = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else")
INNER = ("properties", "patternProperties", "additionalProperties", "items", "prefixItems", "contains", "propertyNames")


def _refs(schema: Any, words: Sequence[str]) -> set[str]:
    """References in a schema, under the keywords given."""
    if not isinstance(schema, dict):
        return set()
    found = {schema["$ref"]} if isinstance(schema.get("$ref"), str) else set()
    for w in words:
        sub = schema.get(w)
        for x in sub if isinstance(sub, list) else sub.values() if w in ("properties", "patternProperties") and isinstance(sub, dict) else [sub]:
            found |= _refs(x, words)
    return found


def _reach(root: dict[str, Any], refs: set[str], words: Sequence[str]) -> set[str]:
    seen: set[str] = set()
    while refs:
        seen |= refs
        refs = set().union(*(_refs(_target(root, r), words) for r in refs)) - seen
    return seen


def _recursive(root: Any) -> tuple[str, ...]:
    """References that come back to themselves. One that does so for one and the same value has no meaning and raises."""
    every = _reach(root, _refs(root, SAME + INNER), SAME + INNER)
    for r in sorted(every):
        if r in _reach(root, _refs(_target(root, r), SAME), SAME):
            raise NotImplementedError(f"schema reference {r}: refers to itself")
    return tuple(sorted(r for r in every if r in _reach(root, _refs(_target(root, r), SAME + INNER), SAME + INNER)))


def _named_like(pattern: str):
    return lambda e: F.regexp_like(e["key"], F.lit(pattern))


@dataclass(frozen=True)
class _Root:
    """The whole schema, and the references that are not written out but left for later, by number from 1."""

    schema: Any
    later: tuple[str, ...] = ()

    def holds_later(self, sub: Any) -> bool:
        return bool(_reach(self.schema, _refs(sub, SAME + INNER), SAME + INNER) & set(self.later))


def schema_errors(value: Column, schema: dict[str, Any] | bool) -> Column:
    """Errors of a variant against a JSON schema, as ``path: message``; empty if it is valid.

    Known keywords: see ``KNOWN``; references are local. Any other keyword raises. A schema that refers to itself is not written out: values that it
    is to be tried on again are put on a list with the path to them, and the list is worked off, level by level, as deep as the value goes. Such a
    reference may stand in one of the alternatives of ``anyOf``, but not within ``oneOf``, ``not``, ``if`` or ``contains``.
    """
    later = _recursive(schema)
    root = _Root(schema, later)
    if not later:
        return _schema_errors(value, schema, "", root)
    places = [schema, *[_target(schema, r) for r in later]]
    work = "array<struct<v: variant, s: int, path: string>>"

    def step(acc: Column, _: Column) -> Column:
        by_place = lambda make, w: functools.reduce(lambda x, k: F.when(w["s"] == k, make(w["v"], places[k])).otherwise(x), range(1, len(places)), make(w["v"], places[0]))
        errors = F.transform(acc["work"], lambda w: F.transform(by_place(lambda v, p: _schema_errors(v, p, "", root), w), lambda e: F.concat(w["path"], e)))
        more = F.transform(acc["work"], lambda w: F.transform(by_place(lambda v, p: _left(v, p, "", root), w), lambda x: F.struct(x["v"].alias("v"), x["s"].alias("s"), F.concat(w["path"], x["path"]).alias("path"))))
        return F.struct(F.flatten(more).cast(work).alias("work"), F.concat(acc["errors"], F.flatten(errors)).alias("errors"))

    def worked(v: Column) -> Column:
        levels = (F.regexp_count(F.to_json(v), F.lit(r"[\[{]")) + 2) * len(places)
        start = F.struct(F.array(F.struct(v.alias("v"), F.lit(0).alias("s"), F.lit("").alias("path"))).cast(work).alias("work"), F.array().cast("array<string>").alias("errors"))
        return F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda acc: acc["errors"])

    return F.when(value.isNotNull(), let(value, worked)).otherwise(F.array().cast("array<string>"))


def _schema_errors(value: Column, schema: dict[str, Any] | bool, path: str, root: _Root) -> Column:
    none = F.array().cast("array<string>")
    if isinstance(schema, bool):
        return none if schema else F.array(F.lit(f"{path}: no value is allowed"))
    if unknown := set(schema) - KNOWN - ANNOTATIONS:
        raise NotImplementedError(f"schema keywords: {', '.join(sorted(unknown))}")
    return let(value, lambda v: _errors(v, schema, path, root))


def _left(value: Column, schema: dict[str, Any] | bool, path: str, root: _Root) -> Column:
    """What a schema leaves for later: values, the number of the reference each is to be tried on, and the path to it."""
    none = F.array().cast("array<struct<v: variant, s: int, path: string>>")
    if isinstance(schema, bool) or not root.holds_later(schema):
        return none
    return let(value, lambda v: _left_of(v, schema, path, root))


def _left_of(value: Column, schema: dict[str, Any], path: str, root: _Root) -> Column:
    none = F.array().cast("array<struct<v: variant, s: int, path: string>>")
    kind, out = _kind(value), []
    below = lambda v, sub, more="": _left(v, sub, path + more, root)
    fits = lambda sub: F.size(_schema_errors(value, sub, path, root)) == 0
    for w in ("oneOf", "not", "if", "contains", "propertyNames"):
        if any(root.holds_later(x) for x in (schema[w] if isinstance(schema.get(w), list) else [schema.get(w)])):
            raise NotImplementedError(f"schema keyword {w}: a reference that comes back to itself within it")
    if "$ref" in schema:
        if schema["$ref"] in root.later:
            out.append(F.array(F.struct(value.alias("v"), F.lit(root.later.index(schema["$ref"]) + 1).alias("s"), F.lit(path).alias("path"))))
        else:
            out.append(below(value, _target(root.schema, schema["$ref"])))
    out += [below(value, sub) for sub in schema.get("allOf", [])]
    if "if" in schema:
        out.append(F.when(fits(schema["if"]), below(value, schema.get("then", True))).otherwise(below(value, schema.get("else", True))))
    if late := [sub for sub in schema.get("anyOf", []) if root.holds_later(sub)]:
        rest = functools.reduce(lambda x, y: x | y, [fits(sub) for sub in schema["anyOf"] if not root.holds_later(sub)], F.lit(False))
        out.append(F.when(rest, none).otherwise(below(value, late[0])))
    for inner, sub, more in _inner(value, schema):
        if root.holds_later(sub):
            each = F.flatten(F.transform(inner, functools.partial(_below_one, below, sub, more)))
            out.append(F.coalesce(each, none))
    return F.concat(*[x.cast("array<struct<v: variant, s: int, path: string>>") for x in out]) if out else none


def _below_one(below, sub, more, v):
    return below(v, sub, more)


def _inner(value: Column, schema: dict[str, Any]) -> list[tuple[Column, Any, str]]:
    """Arrays of what a value holds, each with the schema for its elements and their part of the path; null where it does not apply."""
    items, fields = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string, variant>")
    array, object_ = _kind(value) == "array", _kind(value) == "object"
    named, patterns, prefix = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("prefixItems", [])
    out = [(F.when(array & (F.size(items) > i), F.array(F.get(items, i))), sub, f"/items/{i}") for i, sub in enumerate(prefix)]
    if "items" in schema:
        rest = F.slice(items, len(prefix) + 1, F.greatest(F.size(items) - len(prefix), F.lit(0))) if prefix else items
        out.append((F.when(array, rest), schema["items"], "/items"))
    for k, sub in named.items():
        found = _member(value, fields, k)
        out.append((F.when(object_ & found.isNotNull(), F.array(found)), sub, f"/{k}"))
    entries = F.map_entries(fields)
    values = lambda e: F.transform(e, lambda x: x["value"])
    for p, sub in patterns.items():
        out.append((F.when(object_, values(F.filter(entries, _named_like(p)))), sub, f"/{p}"))
    if isinstance(schema.get("additionalProperties"), dict):
        out.append((F.when(object_, values(F.filter(entries, _free(named, patterns)))), schema["additionalProperties"], "/*"))
    return out


def _free(named, patterns):
    """Whether an entry is under no name and no pattern of a schema."""
    return lambda e: ~e["key"].isin(*named) & ~F.regexp_like(e["key"], F.lit("|".join(f"(?:{p})" for p in patterns) or "(?!)"))


def _member(value: Column, fields: Column, name: str) -> Column:
    """A property; a path cannot name every one."""
    return F.try_variant_get(value, f"$['{name}']", "variant") if re.fullmatch(r"[\w -]+", name, re.A) else F.try_element_at(fields, F.lit(name))


def _errors(value: Column, schema: dict[str, Any], path: str, root: _Root) -> Column:
    none = F.array().cast("array<string>")
    kind, out = _kind(value), []
    below = lambda v, sub, more="": _schema_errors(v, sub, path + more, root)
    fits = lambda sub: F.size(below(value, sub)) == 0

    def unless(good: Column, message: str) -> None:
        out.append(F.when(~F.coalesce(good, F.lit(False)), F.array(F.lit(f"{path}: {message}"))).otherwise(none))

    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        unless(kind.isin(*wanted, *(["integer"] if "number" in wanted else [])), f"is not of type {' or '.join(wanted)}")
    for options in [schema[w] if w == "enum" else [schema[w]] for w in ("enum", "const") if w in schema]:
        unless(F.to_json(value).isin(*[jsonlib.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in options]), "is not one of the values allowed")
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    for word, test, message in (
        ("minimum", lambda x: number >= x, "is less than the minimum"), ("maximum", lambda x: number <= x, "is greater than the maximum"),
        ("exclusiveMinimum", lambda x: number > x, "is not greater than the minimum"), ("exclusiveMaximum", lambda x: number < x, "is not less than the maximum"),
        ("multipleOf", lambda x: F.abs(number / x - F.round(number / x)) < 1e-9, "is not a multiple"),
    ):
        if word in schema:
            unless(~kind.isin("integer", "number") | test(F.lit(float(schema[word]))), message)
    for word, test, message in (("minLength", lambda n: F.length(text) >= n, "is too short"), ("maxLength", lambda n: F.length(text) <= n, "is too long"), ("pattern", lambda p: F.regexp_like(text, F.lit(p)), "does not match the pattern")):
        if word in schema:
            unless((kind != "string") | test(schema[word]), message)
    items = F.try_variant_get(value, "$", "array<variant>")
    if "minItems" in schema:
        unless((kind != "array") | (F.size(items) >= schema["minItems"]), "has too few items")
    if "maxItems" in schema:
        unless((kind != "array") | (F.size(items) <= schema["maxItems"]), "has too many items")
    if schema.get("uniqueItems"):
        unless((kind != "array") | let(F.transform(items, lambda v: F.to_json(v)), lambda x: F.size(F.array_distinct(x)) == F.size(x)), "has equal items")
    if "contains" in schema:
        hits = F.size(F.filter(items, lambda v: F.size(below(v, schema["contains"])) == 0))
        unless((kind != "array") | (hits >= schema.get("minContains", 1)), "contains too few items that fit")
        if "maxContains" in schema:
            unless((kind != "array") | (hits <= schema["maxContains"]), "contains too many items that fit")
    fields = F.try_variant_get(value, "$", "map<string, variant>")
    for k in schema.get("required", []):
        unless((kind != "object") | _member(value, fields, k).isNotNull(), f"lacks the property {k}")
    for k, wanted in schema.get("dependentRequired", {}).items():
        for x in wanted:
            unless((kind != "object") | _member(value, fields, k).isNull() | _member(value, fields, x).isNotNull(), f"lacks the property {x}, which {k} asks for")
    for inner, sub, more in _inner(value, schema):
        out.append(F.coalesce(F.flatten(F.transform(inner, functools.partial(_below_one, below, sub, more))), none))
    entries = F.map_entries(fields)
    if schema.get("additionalProperties", True) is False:
        free = F.filter(entries, _free(schema.get("properties", {}), schema.get("patternProperties", {})))
        unless((kind != "object") | (F.size(free) == 0), "has properties beyond those allowed")
    if "propertyNames" in schema:
        names = F.transform(entries, lambda e: F.parse_json(encoded(e["key"])))
        unless((kind != "object") | F.forall(names, lambda n: F.size(below(n, schema["propertyNames"])) == 0), "has a property whose name does not fit")
    if "minProperties" in schema:
        unless((kind != "object") | (F.size(entries) >= schema["minProperties"]), "has too few properties")
    if "maxProperties" in schema:
        unless((kind != "object") | (F.size(entries) <= schema["maxProperties"]), "has too many properties")
    out += [below(value, sub) for sub in schema.get("allOf", [])]
    if "if" in schema:
        out.append(F.when(fits(schema["if"]), below(value, schema.get("then", True))).otherwise(below(value, schema.get("else", True))))
    if late := sum(map(root.holds_later, schema.get("anyOf", []))):
        if late > 1:
            raise NotImplementedError("schema keyword anyOf: references that come back to themselves in several alternatives")
        open_one = next(sub for sub in schema["anyOf"] if root.holds_later(sub))  # what is left of it is tried later
        rest = functools.reduce(lambda x, y: x | y, [fits(sub) for sub in schema["anyOf"] if sub is not open_one], F.lit(False))
        out.append(F.when(rest, none).otherwise(below(value, open_one)))
    elif "anyOf" in schema:
        unless(functools.reduce(lambda x, y: x | y, map(fits, schema["anyOf"]), F.lit(False)), "fits none of the alternatives")
    if "oneOf" in schema:
        unless(functools.reduce(lambda x, y: x + y, [fits(sub).cast("int") for sub in schema["oneOf"]], F.lit(0)) == 1, "does not fit exactly one of the alternatives")
    if "not" in schema:
        unless(~fits(schema["not"]), "fits what is excluded")
    if "$ref" in schema and schema["$ref"] not in root.later:
        out.append(below(value, _target(root.schema, schema["$ref"])))
    return F.concat(*out) if out else none


def validated(text: Column, schema: dict[str, Any]) -> Column:
    """passed, errors and extracted (the JSON, if the reply wrapped it) of a reply."""
    found = blob(text)
    value = strict_json(found)
    errors = F.when(value.isNull(), F.array(F.lit("not valid JSON"))).otherwise(schema_errors(value, schema))
    return F.struct((F.size(errors) == 0).alias("passed"), errors.alias("errors"), F.when(value.isNotNull() & (found != text), F.to_json(value)).alias("extracted"))


def violation(passed: Column, action: str) -> Column:
    """What becomes of a reply: pass, reject or log; repair is log."""
    return F.when(passed, "pass").otherwise(F.lit("reject" if action == "reject" else "log"))


def schema_for(endpoint: Column, model: Column, rules: Sequence[tuple[str, str | None, str]]) -> Column:
    """Name of the first rule (endpoint, model pattern or None, name) that applies; patterns match anywhere."""
    steps = [F.when((endpoint == F.lit(e)) & (F.lit(True) if not p else F.regexp_like(model, F.lit(p))), F.lit(n)) for e, p, n in rules]
    return F.coalesce(*steps) if steps else F.lit(None).cast("string")


BLOCKS = "array<struct<type: string, text: string, id: string, name: string, input: string>>"


def blocks_text(content: Column, parts: Column) -> Column:
    """Text of a message: its string, or the texts of its blocks joined by spaces."""
    return F.coalesce(content, F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " "), F.lit(""))


def to_chat_messages(system: Column, messages: Column) -> Column:
    """Messages of blocks as chat messages; the system text leads if there is one."""
    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), blocks_text(m["content"], m["parts"]).alias("content")))
    lead = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(system.isNotNull(), F.concat(lead, plain)).otherwise(plain)


def max_tokens(asked: Column) -> Column:
    """The bound of a reply that a chat request carries; a request without one has 1024."""
    return F.coalesce(asked.cast("int"), F.lit(1024))


def usage_of_blocks(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Usage under the names of the interface of blocks; counts that are missing are 0."""
    return F.struct(F.coalesce(prompt_tokens, F.lit(0)).alias("input_tokens"), F.coalesce(completion_tokens, F.lit(0)).alias("output_tokens"))


def to_blocks(content: Column, calls: Column, denied: Column | None = None) -> Column:
    """Blocks of a chat reply: text, a tool_use for each call (arguments that are no JSON become {}), denied tools; never none."""
    block = lambda kind, text=None, id=None, name=None, input=None: F.struct(*[(F.lit(None).cast("string") if x is None else x).alias(n) for n, x in (("type", F.lit(kind)), ("text", text), ("id", id), ("name", name), ("input", input))])
    none = F.array().cast(BLOCKS)
    text = F.when(F.coalesce(content, F.lit("")) != "", F.array(block("text", content))).otherwise(none)
    args = lambda c: F.when(strict_json(c["arguments"]).isNotNull(), c["arguments"]).otherwise("{}")
    used = F.coalesce(F.transform(calls, lambda c: block("tool_use", None, c["id"], F.coalesce(c["name"], F.lit("unknown")), args(c))), none)
    lost = none if denied is None else F.when(F.size(denied) > 0, F.array(block("denied_tools", F.to_json(denied)))).otherwise(none)
    whole = F.concat(text, used, lost)
    return F.when(F.size(whole) > 0, whole).otherwise(F.array(block("text", F.lit(""))))


def stop_reason(calls: Column) -> Column:
    """tool_use whenever the reply has the key of calls, even if none is left."""
    return F.when(calls.isNotNull(), "tool_use").otherwise("end_turn")
