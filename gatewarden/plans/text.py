"""Queries over single texts: normalization, literal and pattern rules, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.functions import match, normalize
from gatewarden.plans.registry import MODELS, PROMPTS, TURNS, chats, prompts, q, query, sql_list, table, turns
from gatewarden.rules import ALERT_PHRASES, BLOCK_PHRASES, ENTITY_PATTERNS, FLAG_PHRASES, KeywordRule, Normalize, RuleSet, default_entities, default_keywords, quoted

# Patterns of a regex dictionary, personal data and addresses, by tier.
PATTERNS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "block"),
    (r"\bAKIA[0-9A-Z]{16}\b", "block"),
    (r"\bghp_[A-Za-z0-9]{36}\b", "block"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "alert"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "alert"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "flag"),
)
RULES = RuleSet(default_keywords() + tuple(KeywordRule(p, t, True) for p, t in PATTERNS))
LITERALS = RuleSet(default_keywords())

ZW = normalize.ZERO_WIDTH


def norm_sql(x: str, leet: bool = False) -> str:
    x = f"lower(translate({x}, {q(ZW)}, ''))"
    if leet:
        x = f"translate({x}, {q(normalize.LEET_FROM)}, {q(normalize.LEET_TO)})"
    return f"trim(regexp_replace({x}, '[ \\n\\r\\t]+', ' ', 'g'), ' ')"


def separators_sql(x: str) -> str:
    p, m = f"string_split_regex({x}, {q(normalize.SPELLED)})", f"regexp_extract_all({x}, {q(normalize.SPELLED)})"
    return f"array_to_string(list_transform(range(1, len({p}) + 1), lambda i: ({p})[i] || coalesce(translate(({m})[i], {q(normalize.SEPARATORS)}, ''), '')), '')"


def literal_sql(x: str, phrases) -> str:
    return f"nullif(regexp_extract({x}, {q('(' + '|'.join(map(quoted, phrases)) + ')')}, 1), '')"


def first_of_sql(x: str, phrases) -> str:
    """``literal_sql`` by a search for each phrase, which many phrases need: the least place, then the first declared."""
    places = f"list_transform(range(1, {len(phrases) + 1}), lambda i: [instr({x}, ({sql_list(phrases)})[i]), i])"
    return f"({sql_list(phrases)})[list_min(list_filter({places}, lambda p: p[1] > 0))[2]]"


def pattern_sql(x: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN {q(p)} END" for p in patterns) + ")"


def verdict_sql(source: str, patterns: bool = True, keys: str = "doc_id, lang", norm: str | None = None) -> str:
    tiers = {"block": BLOCK_PHRASES, "alert": ALERT_PHRASES, "flag": FLAG_PHRASES}
    parts = []
    for tier, phrases in tiers.items():
        parts.append((tier, "l_" + tier, literal_sql("norm", phrases)))
        if patterns:
            parts.append((tier, "r_" + tier, pattern_sql("norm", [p for p, t in PATTERNS if t == tier])))
    found = ", ".join(f"{sql} AS {name}" for _, name, sql in parts)
    level = " ".join(f"WHEN {name} IS NOT NULL THEN {q(tier)}" for tier, name, _ in parts)
    return f"""SELECT {keys}, CASE {level} ELSE 'clean' END AS level, coalesce({', '.join(n for _, n, _ in parts)}) AS rule
FROM (SELECT {keys}, {found} FROM (SELECT {keys}, {norm or norm_sql('text')} AS norm FROM {source}) n) v"""


@query("input_verdict", f"SELECT lang, level, rule, count(*) AS n FROM ({verdict_sql(PROMPTS)}) x GROUP BY ALL")
def input_verdict(spark, folder):
    found = match.classified(prompts(spark, folder), "text", RULES)
    return found.groupBy("lang", F.col("verdict.level").alias("level"), F.col("verdict.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("verdict_rows", verdict_sql(PROMPTS))
def verdict_rows(spark, folder):
    return match.classified(prompts(spark, folder), "text", RULES).select("doc_id", "lang", "verdict.level", "verdict.rule")


@query("verdict_shadow", f"SELECT doc_id, lang, CASE level WHEN 'block' THEN 'flag' ELSE level END AS level, CASE level WHEN 'block' THEN 'shadow_block:' || rule ELSE rule END AS rule FROM ({verdict_sql(PROMPTS)}) x")
def verdict_shadow(spark, folder):
    return match.classified(prompts(spark, folder), "text", RULES, shadow=True).select("doc_id", "lang", "verdict.level", "verdict.rule")


@query("verdict_automaton", verdict_sql(PROMPTS, patterns=False))
def verdict_automaton(spark, folder):
    return match.classified(prompts(spark, folder), "text", LITERALS, engine="automaton").select("doc_id", "lang", "verdict.level", "verdict.rule")


#: A dictionary of 660 phrases, by rule.
DICTIONARY = tuple(f"{a}{b}{c} {d}" for a in "bdfglmnprst" for b in "aeiou" for c in "nrst" for d in "adi")


@query("verdict_dictionary", f"SELECT doc_id, CASE WHEN rule IS NULL THEN 'clean' ELSE 'alert' END AS level, rule FROM (SELECT doc_id, {literal_sql('norm', DICTIONARY)} AS rule FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM {PROMPTS}) x) y")
def verdict_dictionary(spark, folder):
    """Rules by the hundred: literals of a tier beyond a few are sought by their tree."""
    rules = RuleSet(tuple(KeywordRule(p, "alert") for p in DICTIONARY))
    return match.classified(prompts(spark, folder), "text", rules).select("doc_id", "verdict.level", "verdict.rule")


#: A dictionary of the size of those that are shipped together: 5,000 phrases and 200 patterns, by rule, of syllables that texts hold.
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "nt", "ea", "ti", "to", "it", "st", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "un")


def syllables(i: int, n: int) -> list[str]:
    i = i * 7919 + 17
    return [SYLLABLES[i // len(SYLLABLES) ** k % len(SYLLABLES)] for k in range(n)]


LARGE_LITERALS = tuple(dict.fromkeys("{}{} {}{}".format(*syllables(i, 4)) for i in range(5000)))
LARGE_PATTERNS = tuple(dict.fromkeys("{}{}{}[a-z]{{2}}[ ,.]".format(*syllables(31 * i, 3)) for i in range(200)))


@query("verdict_large_dictionary", f"SELECT doc_id, CASE WHEN pattern IS NOT NULL THEN 'alert' WHEN literal IS NOT NULL THEN 'flag' ELSE 'clean' END AS level, coalesce(pattern, literal) AS rule FROM (SELECT doc_id, {pattern_sql('norm', LARGE_PATTERNS)} AS pattern, {first_of_sql('norm', LARGE_LITERALS)} AS literal FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM {PROMPTS}) x) y")
def verdict_large_dictionary(spark, folder):
    """Literals by their tree, patterns by their factors, which are sought once for all."""
    rules = RuleSet((*(KeywordRule(p, "alert", True) for p in LARGE_PATTERNS), *(KeywordRule(p, "flag") for p in LARGE_LITERALS)))
    return match.classified(prompts(spark, folder), "text", rules).select("doc_id", "verdict.level", "verdict.rule")


@query("verdict_weighted", f"SELECT doc_id, level, CASE WHEN level = 'flag' THEN printf('score=%.1f', w) ELSE rule END AS rule FROM (SELECT *, {' + '.join(f'contains(norm, {q(p)})::INT' for p in FLAG_PHRASES)} + 0.0 AS w FROM ({verdict_sql(PROMPTS, False, 'doc_id')}) x JOIN (SELECT doc_id, {norm_sql('text')} AS norm FROM {PROMPTS}) y USING (doc_id)) z")
def verdict_weighted(spark, folder):
    return match.classified(prompts(spark, folder), "text", LITERALS, engine="weighted").select("doc_id", "verdict.level", "verdict.rule")


@query("verdict_obfuscated", verdict_sql(PROMPTS, False, "doc_id", separators_sql(norm_sql("text", leet=True))))
def verdict_obfuscated(spark, folder):
    rules = RuleSet(default_keywords(), Normalize(separators=True, leet=True))
    # literals are normalized with the same options
    return match.classified(prompts(spark, folder), "text", rules).select("doc_id", "verdict.level", "verdict.rule")


@query("normalize_nfkc")
def normalize_nfkc(spark, folder):
    """The compatibility form of every text; SQL here has none, so it is tested by the library's own."""
    return prompts(spark, folder).select("doc_id", normalize.compatible(F.col("text")).alias("norm"))


@query("normalize_all_steps")
def normalize_all_steps(spark, folder):
    return normalize.with_normalized(prompts(spark, folder), "text", "norm").select("doc_id", "norm")


def _one(name: str, sql: str, change) -> None:
    @query(name, f"SELECT doc_id, {sql} AS norm FROM {PROMPTS}")
    def run(spark, folder):
        return prompts(spark, folder).select("doc_id", change(F.col("text")).alias("norm"))


_one("normalize_zero_width", f"translate(text, {q(ZW)}, '')", normalize.zero_width)
_one("normalize_leet", f"translate(lower(text), {q(normalize.LEET_FROM)}, {q(normalize.LEET_TO)})", lambda t: normalize.leet(normalize.lower(t)))
_one("normalize_lower", "lower(text)", normalize.lower)
_one("normalize_spaces", "trim(regexp_replace(text, '[ \\n\\r\\t]+', ' ', 'g'), ' ')", normalize.spaces)
_one("normalize_separators", separators_sql("text"), normalize.collapse_separators)
_one("normalize_full", norm_sql("text"), normalize.normalized)


@query("literal_first", f"SELECT doc_id, {literal_sql('norm', BLOCK_PHRASES + ALERT_PHRASES + FLAG_PHRASES)} AS rule FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM {PROMPTS}) x")
def literal_first(spark, folder):
    norm = prompts(spark, folder).select("doc_id", normalize.normalized(F.col("text")).alias("norm"))
    return norm.select("doc_id", match.first_literal(F.col("norm"), BLOCK_PHRASES + ALERT_PHRASES + FLAG_PHRASES).alias("rule"))


@query("pattern_first", f"SELECT doc_id, {pattern_sql('norm', [p for p, _ in PATTERNS])} AS rule FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM {PROMPTS}) x")
def pattern_first(spark, folder):
    norm = prompts(spark, folder).select("doc_id", normalize.normalized(F.col("text")).alias("norm"))
    return norm.select("doc_id", match.first_pattern(F.col("norm"), [p for p, _ in PATTERNS]).alias("rule"))


TEXT = "array_to_string(list(text ORDER BY turn) FILTER (WHERE (conv_id + turn) % 4 <> 0), ' ')"


@query("chat_text", f"SELECT conv_id, coalesce({TEXT}, '') AS text FROM {TURNS} GROUP BY conv_id")
def chat_text(spark, folder):
    """String contents only: what array parts hold is not read, as the chat path does."""
    return chats(spark, folder).select("conv_id", message_text(F.col("messages")).alias("text"))


@query("chat_text_parts", f"SELECT conv_id, array_to_string(list(text ORDER BY turn), ' ') AS text FROM {TURNS} GROUP BY conv_id")
def chat_text_parts(spark, folder):
    return chats(spark, folder).select("conv_id", message_text(F.col("messages"), scan_parts=True).alias("text"))


def message_text(messages, scan_parts: bool = False):
    """Contents of all messages joined by spaces; with ``scan_parts`` also the texts of parts."""
    parts = lambda m: F.array_join(F.transform(F.filter(m["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), " ")
    own = (lambda m: F.coalesce(m["content"], parts(m))) if scan_parts else (lambda m: m["content"])
    return F.array_join(F.filter(F.transform(messages, own), lambda t: t.isNotNull()), " ")


ENTITY = dict(ENTITY_PATTERNS)


@query("contains_pii", f"SELECT doc_id, {' OR '.join(f'regexp_matches(text, {q(p)})' for p in ENTITY.values())} AS any_entity, regexp_matches(text, {q(ENTITY['EMAIL'])}) OR regexp_matches(text, {q(ENTITY['SSN'])}) AS some_entity FROM {PROMPTS}")
def contains_pii(spark, folder):
    text = F.col("text")
    return prompts(spark, folder).select("doc_id", match.contains_entity(text, default_entities()).alias("any_entity"), match.contains_entity(text, default_entities(), {"EMAIL", "SSN"}).alias("some_entity"))


TOOL_NAMES = ("delete_user", "search_web", "web_search", "send_mail", "search")


@query("wildcard_names", "SELECT event_id, (n LIKE 'delete\\_%' ESCAPE '\\') OR (n LIKE '%\\_mail' ESCAPE '\\') AS denied, starts_with(n, 'search') OR n = 'web_search' AS allowed, true AS every FROM (SELECT event_id, " + sql_list(TOOL_NAMES) + f"[1 + event_id % {len(TOOL_NAMES)}] AS n FROM events) x")
def wildcard_names(spark, folder):
    from gatewarden.plans.registry import pick

    rows = table(spark, folder, "events").select("event_id", pick(TOOL_NAMES, F.col("event_id") % len(TOOL_NAMES)).alias("n"))
    n = F.col("n")
    return rows.select("event_id", match.any_wildcard(n, ("delete_*", "*_mail")).alias("denied"), match.any_wildcard(n, ("search*", "web_search")).alias("allowed"), match.any_wildcard(n, ("*",)).alias("every"))


GLOBS = ("fast-*", "premium", "gpt-*")


@query("model_globs", f"SELECT conv_id, model, list_filter({sql_list(GLOBS)}, lambda p: CASE WHEN ends_with(p, '*') THEN starts_with(model, p[:-2]) ELSE model = p END)[1] AS glob FROM (SELECT DISTINCT conv_id, {sql_list(MODELS)}[1 + conv_id % {len(MODELS)}] AS model FROM conversations) x")
def model_globs(spark, folder):
    from gatewarden.plans.registry import pick

    rows = turns(spark, folder).select("conv_id").distinct().withColumn("model", pick(MODELS, F.col("conv_id") % len(MODELS)))
    hits = F.filter(F.array(*[F.lit(g) for g in GLOBS]), lambda p: match.model_glob(F.col("model"), p))
    return rows.select("conv_id", "model", F.try_element_at(hits, F.lit(1)).alias("glob"))
