"""Redaction, spans, vault, restoring, output masks.

Rules run one after another, each on the output of the one before. Placeholders with numbers
number the distinct matches of a rule from the right: the last distinct value gets 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.normalize import interleaved, let, parted
from gatewarden.rules import BARE, INDEXED, LLM_GUARD, OUTPUT_PHRASES, EntityRule, needed, quoted

STYLES = {"bare": BARE, "indexed": INDEXED, "numbered": INDEXED, "llm_guard": LLM_GUARD, "llm-guard": LLM_GUARD}


def style_of(name: str, reversible: bool = False) -> str:
    """A style by name, unknown names are bare; what must be reversible needs numbers."""
    found = STYLES.get(name.lower(), BARE)
    return INDEXED if reversible and found == BARE else found


def affixes(entity: str, style: str) -> tuple[str, str]:
    return {BARE: (f"[{entity}", "]"), INDEXED: (f"[{entity}_", "]"), LLM_GUARD: (f"[REDACTED_{entity}_", "]")}[style]


def chosen(rules: Sequence[EntityRule], entities: set[str] | None) -> list[EntityRule]:
    return [r for r in rules if entities is None or r.entity in entities]


def redacted(text: Column, rules: Sequence[EntityRule], entities: set[str] | None = None) -> Column:
    """Every match of every rule becomes [ENTITY].

    A rule is tried where the text, as it came, holds what every match must hold: no placeholder can bring that in.
    """
    whole = text

    def tried(r: EntityRule, part: str | None, t: Column) -> Column:
        changed = F.regexp_replace(t, F.lit(r.pattern), F.lit(f"[{r.entity}]"))
        return F.when(F.contains(whole, F.lit(part)), changed).otherwise(t) if part else changed

    def trying(r: EntityRule, part: str):
        return lambda t: tried(r, part, t)

    for r in chosen(rules, entities):
        part = needed(r.pattern)
        if part and not any(part in f"[{x.entity}]" for x in rules) and not set("[]") & set(part):
            text = let(text, trying(r, part))
        else:
            text = tried(r, None, text)
    return text


def _rule_rows(rules: Sequence[EntityRule], style: str) -> Column:
    """Rules as an array of pattern, head, tail, to be folded over: each rule's result is then made once."""
    fields = lambda r: (("pattern", r.pattern), ("part", needed(r.pattern) or ""), ("head", affixes(r.entity, style)[0]), ("tail", affixes(r.entity, style)[1]))
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in fields(r)]) for r in rules])


def _matches(text: Column, rule: Column) -> Column:
    """All matches of a rule's pattern; where the text lacks what every match holds, there is no search."""
    return F.when(F.contains(text, rule["part"]), F.regexp_extract_all(text, rule["pattern"], F.lit(0))).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


#: Up to so many values are numbered by looking each up in the list of distinct ones.
LOOKED_UP = 64


def numbers(values: Column) -> Column:
    """For each element of an array the number of its value, from 1 in the order of first occurrence.

    Many values are sorted and numbered by their runs, so ten thousand of them take no hundred million comparisons.
    """
    number = lambda known: F.transform(values, lambda v: F.array_position(known, v).cast("int"))
    return F.when(F.size(values) > LOOKED_UP, _by_runs(values)).otherwise(let(F.array_distinct(values), number))


def _runs(rows: Column, field: str, made) -> Column:
    """``made`` of a run's first row, its number and each row, for all runs of equal fields of sorted rows."""
    def cut(t: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: (j == 0) | (F.get(t, j)[field] != F.get(t, j - 1)[field]))

        def runs(h: Column) -> Column:
            size = lambda a, k: F.coalesce(F.get(h, k + 1), F.size(t)) - a
            return F.flatten(F.transform(h, lambda a, k: F.transform(F.slice(t, a + 1, size(a, k)), lambda x: made(F.get(t, a), k, x))))

        return let(heads, runs)

    return let(F.sort_array(rows), cut)


def _by_runs(values: Column) -> Column:
    placed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    first = _runs(placed, "v", lambda head, _, x: F.struct(head["i"].alias("first"), x["i"].alias("i")))
    number = _runs(first, "first", lambda _, k, x: F.struct(x["i"].alias("i"), (k + 1).alias("n")))
    return F.transform(F.sort_array(number), lambda x: x["n"])


def _renamed(text: Column, rule: Column, number: Column) -> Column:
    """The text with the matches of a rule named by their numbers."""
    names = F.transform(number, lambda n: F.concat(rule["head"], n.cast("string"), rule["tail"]))
    both = F.zip_with(F.split(text, rule["pattern"], -1), names, lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    return F.when(F.size(number) > 0, F.array_join(both, "")).otherwise(text)


def _renumbered(text: Column, rule: Column) -> Column:
    return let(_matches(text, rule), lambda m: F.when(F.size(m) > 0, _renamed(text, rule, F.reverse(numbers(F.reverse(m))))).otherwise(text))


def all_numbered(text: Column, rules: Sequence[EntityRule], style: str) -> Column:
    """All rules' matches by number, rule after rule."""
    if not rules:
        return text
    return F.aggregate(_rule_rows(rules, style), text, lambda t, r: _renumbered(t, r))


def with_redacted(df: DataFrame, text: str, rules: Sequence[EntityRule], style: str = BARE, entities: set[str] | None = None) -> DataFrame:
    """Replaces the column by its redaction; rules are folded over, so that no match is sought twice."""
    if style == BARE:
        return df.withColumn(text, redacted(F.col(text), rules, entities))
    return df.withColumn(text, all_numbered(F.col(text), chosen(rules, entities), style))


def _messages(messages: Column, change) -> Column:
    """Messages with a function applied to their string content and to the text of their parts."""
    part = lambda p: p.withField("text", change(p["text"]))
    return F.transform(messages, lambda m: m.withField("content", change(m["content"])).withField("parts", F.transform(m["parts"], part)))


def with_redacted_messages(df: DataFrame, messages: str, rules: Sequence[EntityRule], style: str = BARE, entities: set[str] | None = None, changed: str | None = None) -> DataFrame:
    """Redacts the texts of messages (role, content, parts), each text on its own; ``changed`` names a flag."""
    if changed:
        df = df.withColumn("_before", F.col(messages))
    if style == BARE:
        df = df.withColumn(messages, _messages(F.col(messages), lambda t: redacted(t, rules, entities)))
    else:
        df = df.withColumn(messages, _messages(F.col(messages), lambda t: all_numbered(t, chosen(rules, entities), style)))
    return df.withColumn(changed, ~F.col("_before").eqNullSafe(F.col(messages))).drop("_before") if changed else df


def with_vault(df: DataFrame, texts: str, rules: Sequence[EntityRule], style: str = INDEXED, vault: str = "vault") -> DataFrame:
    """Redacts an array of texts of one request with common numbers, and adds placeholder -> original.

    Numbers count the texts in order, in each the matches from the right.
    """
    none = F.array().cast("array<struct<placeholder: string, original: string>>")
    if not rules:
        return df.withColumn(vault, none)

    def step(acc: Column, r: Column) -> Column:
        found = F.transform(acc["texts"], lambda t: F.coalesce(F.reverse(_matches(t, r)), F.array().cast("array<string>")))

        def made(m: Column) -> Column:
            flat = F.flatten(m)
            before = lambda k: F.aggregate(F.slice(m, F.lit(1), k), F.lit(0), lambda n, x: n + F.size(x))
            new = lambda number: F.transform(acc["texts"], lambda t, k: _renamed(t, r, F.reverse(F.slice(number, before(k) + 1, F.size(F.get(m, k))))))
            entries = F.transform(F.array_distinct(flat), lambda v, i: F.struct(F.concat(r["head"], (i + 1).cast("string"), r["tail"]).alias("placeholder"), v.alias("original")))
            done = let(numbers(flat), lambda number: F.struct(new(number).alias("texts"), F.concat(acc["vault"], entries).alias("vault")))
            return F.when(F.exists(m, lambda x: F.size(x) > 0), done).otherwise(acc)

        return let(found, made)

    folded = F.aggregate(_rule_rows(rules, style), F.struct(F.col(texts).alias("texts"), none.alias("vault")), step)
    return df.withColumn("_fold", folded).withColumn(texts, F.col("_fold.texts")).withColumn(vault, F.col("_fold.vault")).drop("_fold")


SPANS = "array<struct<entity: string, start: int, end: int, text: string>>"


def spans(text: Column, rules: Sequence[EntityRule]) -> Column:
    """All matches of all rules on the raw text, by rule and place: entity, start, end (bytes), text.

    Each rule's matches are sought once and walked once, with the place reached so far.
    """
    none = F.array().cast(SPANS)

    def of(r: EntityRule) -> Column:
        def walked(parts: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                end = acc["at"] + F.octet_length(x)
                one = F.struct(F.lit(r.entity).alias("entity"), acc["at"].alias("start"), end.alias("end"), x.alias("text"))
                out = F.when(acc["match"], F.array_append(acc["out"], one)).otherwise(acc["out"])
                return F.struct(end.alias("at"), (~acc["match"]).alias("match"), out.alias("out"))

            start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))
            return F.when(F.size(parts) > 1, F.aggregate(parts, start, step)["out"]).otherwise(none)

        found = parted(text, r.pattern)
        return let(F.when(F.contains(text, F.lit(needed(r.pattern))), found) if needed(r.pattern) else found, walked)

    return F.flatten(F.array(*[of(r) for r in rules]))


def partition_by_action(rules: Sequence[EntityRule], overrides: dict[str, str], default: str = "mask") -> dict[str, frozenset[str]]:
    """Entities by what is done with them: mask, reject or log."""
    out: dict[str, set[str]] = {"mask": set(), "reject": set(), "log": set()}
    for r in rules:
        action = overrides.get(r.entity, default).lower()
        out[action if action in out else "mask"].add(r.entity)
    return {k: frozenset(v) for k, v in out.items()}


def restored(text: Column, vault: Column, strategy: str = "exact") -> Column:
    """Placeholders replaced by their originals, in the vault's order; unknown strategies are exact."""
    if strategy == "case_insensitive":
        quote = lambda t: F.regexp_replace(t, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
        safe = lambda t: F.regexp_replace(t, r"([\\$])", r"\\$1")
        return F.aggregate(vault, text, lambda t, e: F.regexp_replace(t, F.concat(F.lit("(?i)"), quote(e["placeholder"])), safe(e["original"])))
    one_by_one = F.aggregate(vault, text, lambda t, e: F.replace(t, e["placeholder"], e["original"]))
    return F.when(F.size(vault) > LOOKED_UP, F.coalesce(_at_once(text, vault), one_by_one)).otherwise(one_by_one)


def _at_once(text: Column, vault: Column) -> Column:
    """The text cut at its brackets once, each looked up by its number; null if the vault does not allow that.

    It does if the entries of each name stand together and are numbered from 1, as ``with_vault`` leaves them, and no original
    holds a bracket, so that nothing that was put in can be a placeholder again.
    """
    parsed = F.transform(vault, lambda e, i: F.struct(F.regexp_extract(e["placeholder"], r"^(\[[^\[\]]*_)[1-9][0-9]*\]$", 1).alias("head"), F.regexp_extract(e["placeholder"], r"_([1-9][0-9]*)\]$", 1).try_cast("int").alias("n"), i.alias("i")))

    def of(rows: Column) -> Column:
        def found(bases: Column) -> Column:
            base = lambda head: F.get(F.filter(bases, lambda b: b["head"] == head), 0)["i"]
            regular = F.forall(rows, lambda x: F.coalesce((x["head"] != "") & (base(x["head"]) + x["n"] - 1 == x["i"]), F.lit(False)))
            fits = regular & ~F.exists(vault, lambda e: F.regexp_like(e["original"], F.lit(r"[\[\]]")))
            place = lambda m: base(F.regexp_extract(m, r"^(.*_)[0-9]+\]$", 1)) + F.regexp_extract(m, r"_([0-9]+)\]$", 1).try_cast("int") - 1
            known = lambda m: F.filter(F.array(F.get(vault, place(m))), lambda e: e["placeholder"] == m)
            return F.when(fits, interleaved(text, r"\[[^\[\]]*\]", lambda m: F.coalesce(F.get(known(m), 0)["original"], m)))

        return let(F.filter(rows, lambda x: x["n"] == 1), found)

    return let(parsed, of)


def masked_output(text: Column, phrases: Sequence[str] = OUTPUT_PHRASES) -> Column:
    """Phrases become stars of their length; what stands after an open square bracket is left alone."""
    hit = "(?i)" + "|".join(map(quoted, phrases))
    segments = F.regexp_extract_all(text, F.lit(r"(\[[^\[\]]*|\]?[^\[\]]+|\])"), F.lit(0))
    def stars(s: Column) -> Column:
        for p in phrases:
            s = F.regexp_replace(s, "(?i)" + quoted(p), "*" * len(p))
        return s
    changed = F.transform(segments, lambda s: F.when(F.startswith(s, F.lit("[")), s).otherwise(stars(s)))
    return F.when(F.regexp_like(text, F.lit(hit)), F.array_join(changed, "")).otherwise(text)
