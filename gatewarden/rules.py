"""Rules: keyword rules in tiers, redaction rules by entity, and their defaults."""

from __future__ import annotations

import functools
import os.path
import re
from dataclasses import dataclass, field

TIERS = ("block", "alert", "flag")
BARE, INDEXED, LLM_GUARD = "bare", "indexed", "llm_guard"

# The built-in phrases and patterns, in the order in which they are tried.
BLOCK_PHRASES = ("ignore previous instructions", "disregard your instructions", "jailbreak", "dan mode", "you are now")
ALERT_PHRASES = ("password", "api_key", "secret")
FLAG_PHRASES = ("bitcoin", "crypto", "gambling")
OUTPUT_PHRASES = ("ssn", "social security", "credit card")
ENTITY_PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    ("AWS_ACCESS_KEY_ID", r"\bAKIA[0-9A-Z]{16}\b"),
    ("GITHUB_PAT", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("GITHUB_FINE_GRAINED_PAT", r"\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    ("OPENAI_KEY", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("ANTHROPIC_KEY", r"\bsk-ant-[A-Za-z0-9_\-]{80,}\b"),
    ("STRIPE_KEY", r"\b(?:sk|rk)_live_[A-Za-z0-9]{20,}\b"),
    ("GOOGLE_API_KEY", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b"),
    ("SLACK_TOKEN", r"\bxox[abpors]-[A-Za-z0-9-]{10,}\b"),
    ("TOKEN", r"\b[A-Za-z0-9_\-]{32,}\b"),
)


@dataclass(frozen=True)
class KeywordRule:
    pattern: str
    tier: str = "block"
    regex: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class EntityRule:
    entity: str
    pattern: str


@dataclass(frozen=True)
class Normalize:
    nfkc: bool = True
    zero_width: bool = True
    separators: bool = False
    leet: bool = False


@dataclass(frozen=True)
class RuleSet:
    """Keyword rules in declaration order, and how text is normalized before they are tried."""

    rules: tuple[KeywordRule, ...]
    normalize: Normalize = field(default_factory=Normalize)

    def of(self, tier: str, regex: bool) -> list[KeywordRule]:
        return [r for r in self.rules if r.tier == tier and r.regex == regex]


def default_keywords() -> tuple[KeywordRule, ...]:
    return tuple(KeywordRule(p, t) for t, ps in zip(TIERS, (BLOCK_PHRASES, ALERT_PHRASES, FLAG_PHRASES), strict=True) for p in ps)


def default_entities() -> tuple[EntityRule, ...]:
    return tuple(EntityRule(e, p) for e, p in ENTITY_PATTERNS)


@functools.cache
def needed(pattern: str, any_case: bool = False) -> str | None:
    """The longest text that every match of a pattern holds, if one can be told from its outermost sequence.

    A search for it is far cheaper than the pattern, so texts without it need not be tried. A pattern with flags has none, as
    it may match in another case; with ``any_case`` the text is to be sought in any case, so that flag does no harm.
    """
    try:
        from re import _constants, _parser

        items = _parser.parse(pattern)
    except (ImportError, re.error, RecursionError, OverflowError):
        return None
    if items.state.flags & ~(re.UNICODE | (re.IGNORECASE if any_case else 0)):
        return None
    best = run = ""
    for kind, value in items:
        run = run + chr(value) if kind is _constants.LITERAL else ""
        best = max(best, run, key=len)
    return best or None


def _tree(words: set[str]) -> str:
    """A pattern of words as a tree: for each first letter what they share, then what follows; longer words come first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        if w:
            heads.setdefault(w[0], []).append(w)
    branches = []
    for letter, group in heads.items():
        common = os.path.commonprefix(group)
        rest = {w[len(common) :] for w in group}
        branches.append((letter, quoted(common) + ("" if rest == {""} else _tree(rest))))
    step = max(4, round(len(branches) ** 0.5))
    if len(branches) > step:  # a look at the letter tells which few branches are to be tried
        parts = [branches[i : i + step] for i in range(0, len(branches), step)]
        out = ["(?=[" + "".join(_in_class(x) for x, _ in part) + "])(?:" + "|".join(p for _, p in part) + ")" for part in parts]
    else:
        out = [p for _, p in branches]
    if "" in words:
        out.append("")
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def _in_class(letter: str) -> str:
    return "\\" + letter if letter in "\\^-[]&~" else letter


@functools.cache
def any_of(words: tuple[str, ...], longest: bool = False) -> str:
    """A pattern for the first declared of the words that match at a place; with ``longest`` for the longest one.

    Words are put together by what they begin with, so a place in a text is compared with few of them. Of two
    words of which one begins with the other, the longer one can only come first if it is declared first.
    """
    kept: set[str] = set()
    for w in words:
        if w and (longest or not any(w[:n] in kept for n in range(1, len(w)))):
            kept.add(w)
    return _tree(kept) if kept else "(?!)"


def regex_body(pattern: str) -> str | None:
    """The body of a ``/body/`` pattern; None for a literal."""
    return pattern[1:-1] if len(pattern) > 2 and pattern[0] == "/" == pattern[-1] else None


def quoted(literal: str) -> str:
    """A literal as a pattern that Java, RE2 and Python read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def checked(pattern: str) -> str:
    """The pattern if it compiles; ValueError otherwise."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from error
    return pattern
