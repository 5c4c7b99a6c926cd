"""Keyword rules as predicates: literals and patterns in tiers, and the verdict they give."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.normalize import let, normalized_literal, with_normalized
from gatewarden.rules import TIERS, EntityRule, RuleSet, any_of, needed, quoted

#: So many literals or patterns are searched for one by one.
FEW = 64
#: A factor that begins so many others tells too little: its pattern is always tried.
SHARED = 64
VERDICT = "struct<level: string, rule: string>"


def java(pattern: str, ignore_case: bool = False, unicode: bool = False) -> str:
    """A pattern for Java: with ``unicode``, its classes \\d \\w \\s cover all scripts."""
    flags = "i" * ignore_case + "U" * (unicode and re.search(r"\\[dwsDWS]", pattern) is not None)
    return f"(?{flags}){pattern}" if flags else pattern


def first_literal(norm: Column, literals: Sequence[str]) -> Column:
    """The literal found leftmost, of several at one place the first declared; null if none is found."""
    if not literals:
        return F.lit(None).cast("string")
    one = "(" + "|".join(map(quoted, literals)) + ")"
    found = F.nullif(F.regexp_extract(norm, one, 1), F.lit(""))
    if len(literals) > FEW:
        return found
    # most texts hold none, which searches for each tell sooner than the alternation
    return F.when(functools.reduce(lambda x, y: x | y, [F.contains(norm, F.lit(x)) for x in literals]), found)


def first_pattern(norm: Column, patterns: Sequence[str], unicode: bool = False, known: Column | None = None) -> Column:
    """The first declared pattern that matches anywhere, as its text.

    Many patterns are told by their factors, the texts that each match of them must hold: all are sought in one
    search, and only patterns whose factor the text holds are tried. ``known`` are the factors found, if that was done before.
    """
    if not patterns:
        return F.lit(None).cast("string")
    tried = lambda p: F.when(F.regexp_like(norm, F.lit(java(p, True, unicode))), F.lit(p))
    if known is None and len(patterns) <= FEW:
        return F.coalesce(*[F.when(_may_hold(norm, p, unicode), tried(p)) for p in patterns])
    if known is None:
        return let(factors_found(norm, patterns, unicode), lambda x: first_pattern(norm, patterns, unicode, x))
    words = _factors(patterns, unicode)
    open_ones = [tried(p) for p in patterns if factor(p, unicode) is None]
    every = [tried(p) if factor(p, unicode) is None else F.when(_holds(known, factor(p, unicode), words), tried(p)) for p in patterns]
    return F.when(F.size(known) > 0, F.coalesce(*every)).otherwise(F.coalesce(*open_ones, F.lit(None).cast("string")))


def factor(pattern: str, unicode: bool = False) -> str | None:
    """What each match of a pattern holds, in lower case; null if that cannot be told, or not by case alone."""
    part = needed(pattern, True)
    return None if not part or (unicode and part.lower() != part.upper()) else part.lower()


def _factors(patterns: Sequence[str], unicode: bool) -> tuple[str, ...]:
    return tuple(sorted({f for p in patterns if (f := factor(p, unicode)) is not None}))


def factors_found(norm: Column, patterns: Sequence[str], unicode: bool = False) -> Column:
    """The factors of patterns that a text holds, from one search; of factors that begin at one place the longest."""
    words = _factors(patterns, unicode)
    if not words:
        return F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(norm), F.lit(f"(?=({any_of(words, True)}))"), F.lit(1))), F.array().cast("array<string>"))


def _holds(known: Column, word: str, words: tuple[str, ...]) -> Column:
    """Whether a factor was found, itself or in a longer one that begins with it."""
    longer = [w for w in words[bisect.bisect_left(words, word) :][:SHARED] if w.startswith(word)]
    if len(longer) == SHARED:
        return F.lit(True)
    return F.array_contains(known, F.lit(word)) if len(longer) == 1 else F.arrays_overlap(known, F.array(*map(F.lit, longer)))


def _may_hold(norm: Column, pattern: str, unicode: bool) -> Column:
    """Whether the text holds what every match of a pattern holds, in any case."""
    part = factor(pattern, unicode)
    if part is None:
        return F.lit(True)
    return F.contains(norm if part.upper() == part else F.lower(norm), F.lit(part))


def tree_literal(norm: Column, literals: Sequence[str]) -> Column:
    """``first_literal`` by a tree of all literals, which dictionaries of thousands of phrases need."""
    if not literals:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(norm, "(?s)" + any_of(tuple(literals)), 0), F.lit(""))


def literal(norm: Column, literals: Sequence[str]) -> Column:
    """The literal found leftmost, by searches for a few of them, by their tree for a dictionary."""
    return (first_literal if len(literals) <= FEW else tree_literal)(norm, literals)


def verdict(norm: Column, rules: RuleSet, engine: str = "aho-corasick", unicode: bool = False) -> Column:
    """level and rule: block before alert before flag, in each tier literals before patterns.

    ``aho-corasick`` seeks a few literals of a tier one by one and a dictionary by its tree; ``automaton`` always takes the tree.
    The factors of all patterns are sought once for all tiers, if there are many.
    """
    if engine not in ("aho-corasick", "automaton"):
        raise ValueError(f"unknown keyword engine: {engine}")
    scan = tree_literal if engine == "automaton" else literal
    every = [r.pattern for tier in TIERS for r in rules.of(tier, True)]

    def decided(known: Column | None) -> Column:
        steps = []
        for tier in TIERS:
            literals = [normalized_literal(r.pattern, rules.normalize) for r in rules.of(tier, False)]
            patterns = [r.pattern for r in rules.of(tier, True)]
            for present, rule in ((literals, scan(norm, literals)), (patterns, first_pattern(norm, patterns, unicode, known))):
                if present:
                    steps.append(F.when(rule.isNotNull(), F.struct(F.lit(tier).alias("level"), rule.alias("rule"))))
        clean = F.struct(F.lit("clean").alias("level"), F.lit(None).cast("string").alias("rule"))
        return F.coalesce(*steps, clean)

    return let(factors_found(norm, every, unicode), decided) if len(every) > FEW else decided(None)


def shadowed(found: Column) -> Column:
    """A block becomes a flag that names what would have been blocked."""
    block = F.struct(F.lit("flag").alias("level"), F.concat(F.lit("shadow_block:"), found["rule"]).alias("rule"))
    return F.when(found["level"] == "block", block).otherwise(found)


def weighted_verdict(norm: Column, rules: RuleSet) -> Column:
    """The second engine: block and alert by their phrases, flag by the weights of the phrases found."""
    tiers = {t: [(normalized_literal(r.pattern, rules.normalize), r.weight) for r in rules.of(t, False)] for t in TIERS}
    block, alert = (first_literal(norm, [p for p, _ in tiers[t]]) for t in ("block", "alert"))
    score = sum((F.when(F.contains(norm, F.lit(p)), F.lit(w)).otherwise(F.lit(0.0)) for p, w in tiers["flag"]), F.lit(0.0))
    made = lambda level, rule: F.struct(F.lit(level).alias("level"), rule.cast("string").alias("rule"))
    return F.when(block.isNotNull(), made("block", block)).when(alert.isNotNull(), made("alert", alert)).when(score > 0, made("flag", F.concat(F.lit("score="), F.format_string("%.1f", score)))).otherwise(made("clean", F.lit(None)))


def classified(df: DataFrame, text: str, rules: RuleSet, out: str = "verdict", shadow: bool = False, engine: str = "aho-corasick") -> DataFrame:
    """Adds the verdict of each text; the normalized text is made once, in a projection of its own."""
    if engine == "weighted":
        found = with_normalized(df, text, "_norm", rules.normalize).withColumn(out, weighted_verdict(F.col("_norm"), rules))
    else:
        found = with_normalized(df, text, "_norm", rules.normalize).withColumn(out, verdict(F.col("_norm"), rules, engine))
    if shadow:
        found = found.withColumn(out, shadowed(F.col(out)))
    return found.drop("_norm")


def contains_entity(text: Column, rules: Sequence[EntityRule], entities: set[str] | None = None) -> Column:
    """Whether any rule (of the entities, if given) matches the raw text."""
    chosen = [r for r in rules if entities is None or r.entity in entities]
    if not chosen:
        return F.lit(False)
    found = lambda r: F.regexp_like(text, F.lit(r.pattern))
    one = lambda r: F.contains(text, F.lit(needed(r.pattern))) & found(r) if needed(r.pattern) else found(r)
    return F.coalesce(functools.reduce(lambda x, y: x | y, map(one, chosen)), F.lit(False))


def wildcard(name: Column, pattern: str) -> Column:
    """A trailing * is a prefix, else a leading * is a suffix, else equality."""
    if pattern.endswith("*"):
        return F.startswith(name, F.lit(pattern[:-1]))
    if pattern.startswith("*"):
        return F.endswith(name, F.lit(pattern[1:]))
    return name == F.lit(pattern)


def model_glob(model: Column, pattern: Column) -> Column:
    """A trailing * is a prefix, else equality; both sides are columns."""
    star = F.endswith(pattern, F.lit("*"))
    return F.when(star, F.startswith(model, F.left(pattern, F.length(pattern) - 1))).otherwise(model == pattern)


def any_wildcard(name: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | wildcard(name, p)
    return F.coalesce(out, F.lit(False))


__all__ = ["any_wildcard", "classified", "contains_entity", "first_literal", "first_pattern", "literal", "model_glob", "shadowed", "tree_literal", "verdict", "weighted_verdict", "wildcard"]
