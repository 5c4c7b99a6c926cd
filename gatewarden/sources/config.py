"""Configuration from TOML text or the environment, as plain dataclasses."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from gatewarden.rules import ALERT_PHRASES, BLOCK_PHRASES, FLAG_PHRASES, Normalize

ENGINES = ("aho-corasick", "weighted", "automaton")


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Keyword:
    engine: str = "aho-corasick"
    dict_paths: tuple[str, ...] = ()
    inline_block: tuple[str, ...] = BLOCK_PHRASES
    inline_alert: tuple[str, ...] = ALERT_PHRASES
    inline_flag: tuple[str, ...] = FLAG_PHRASES
    normalize: Normalize = field(default_factory=Normalize)


@dataclass(frozen=True)
class Pii:
    enabled: bool = True
    action: str = "mask"
    dict_paths: tuple[str, ...] = ()
    placeholder_style: str = "bare"
    entities: dict[str, str] = field(default_factory=dict)
    reversible: bool = False
    deanonymize_strategy: str = "exact"


@dataclass(frozen=True)
class SpotlightSection:
    enabled: bool = False
    method: str = "datamarking"
    untrusted_roles: tuple[str, ...] = ("tool",)
    delimiter_open: str = "<<UNTRUSTED>>"
    delimiter_close: str = "<</UNTRUSTED>>"
    datamark_char: str = "^"
    system_rider: str | None = None


@dataclass(frozen=True)
class Input:
    enabled: bool = False
    shadow: bool = False
    keyword: Keyword = field(default_factory=Keyword)
    pii: Pii = field(default_factory=Pii)
    spotlight: SpotlightSection = field(default_factory=SpotlightSection)


@dataclass(frozen=True)
class SchemaRule:
    endpoint: str
    schema_path: str
    model_pattern: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class SchemaSection:
    enabled: bool = False
    on_violation: str = "log"
    rules: tuple[SchemaRule, ...] = ()


@dataclass(frozen=True)
class Output:
    enabled: bool = False
    pii: Pii = field(default_factory=Pii)
    schema: SchemaSection = field(default_factory=SchemaSection)


@dataclass(frozen=True)
class Backend:
    provider: str
    endpoint: str
    api_key: str | None = None
    model: str | None = None


@dataclass(frozen=True)
class Route:
    model: str
    backend: str
    fallback: tuple[str, ...] = ()


@dataclass(frozen=True)
class Routing:
    default: str | None = None
    rules: tuple[Route, ...] = ()


@dataclass(frozen=True)
class ToolSchema:
    tool_name: str
    schema_path: str


@dataclass(frozen=True)
class Tools:
    enabled: bool = False
    allow: tuple[str, ...] | None = None
    deny: tuple[str, ...] = ()
    schemas: tuple[ToolSchema, ...] = ()
    reject_entities: tuple[str, ...] = ()
    mask_entities: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policies:
    bundle_path: str | None = None


@dataclass(frozen=True)
class Audit:
    enabled: bool = False
    path: str = "audit.jsonl"
    hash_only: bool = True
    fsync_every_write: bool = False


@dataclass(frozen=True)
class Budget:
    enabled: bool = False
    db_path: str = ""
    admin_api_key: str | None = None


@dataclass(frozen=True)
class Config:
    backend: Backend | None = None
    backends: dict[str, Backend] = field(default_factory=dict)
    routing: Routing = field(default_factory=Routing)
    input: Input = field(default_factory=Input)
    output: Output = field(default_factory=Output)
    budget: Budget = field(default_factory=Budget)
    audit: Audit = field(default_factory=Audit)
    tools: Tools = field(default_factory=Tools)
    policies: Policies = field(default_factory=Policies)
    #: Sections that no query reads (serving, sign-in, console, reloading) stay as they were written.
    rest: dict[str, Any] = field(default_factory=dict)


NESTED = {"keyword": Keyword, "normalize": Normalize, "pii": Pii, "spotlight": SpotlightSection, "schema": SchemaSection, "input": Input, "output": Output, "routing": Routing, "budget": Budget, "audit": Audit, "tools": Tools, "policies": Policies, "backend": Backend}
LISTS = {(SchemaSection, "rules"): SchemaRule, (Routing, "rules"): Route, (Tools, "schemas"): ToolSchema}
#: In a section that is present, guards are on unless it says otherwise; lists of keywords must be given.
ON = {Input: "enabled", Output: "enabled"}
MANDATORY = {Keyword: ("dict_paths", "inline_block", "inline_alert", "inline_flag"), Pii: ("action",), Budget: ("enabled", "db_path")}


def _made(kind: type, raw: Any, where: str) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"[{where}] is not a table")
    for name in MANDATORY.get(kind, ()):
        if name not in raw:
            raise ConfigError(f"[{where}] lacks `{name}`")
    values: dict[str, Any] = {ON[kind]: True} if kind in ON else {}
    for f in fields(kind):
        if f.name not in raw:
            continue
        value = raw[f.name]
        if (kind, f.name) in LISTS:
            value = tuple(_made(LISTS[kind, f.name], x, f"{where}.{f.name}") for x in value)
        elif f.name in NESTED and (kind is Config or isinstance(value, dict)):
            value = _made(NESTED[f.name], value, f"{where}.{f.name}".lstrip("."))
        elif isinstance(value, list):
            value = tuple(value)
        values[f.name] = value
    try:
        return kind(**values)
    except TypeError as error:
        raise ConfigError(f"[{where}]: {error}") from error


def config(text: str) -> Config:
    """A configuration in TOML; raises ConfigError for what cannot be used."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"parsing config TOML: {error}") from error
    named = {f.name for f in fields(Config)} - {"rest"}
    backends = {k: _made(Backend, v, f"backends.{k}") for k, v in raw.get("backends", {}).items()}
    made = _made(Config, {k: v for k, v in raw.items() if k in named and k != "backends"}, "")
    found = Config(**{**{f.name: getattr(made, f.name) for f in fields(Config)}, "backends": backends, "rest": {k: v for k, v in raw.items() if k not in named}})
    if found.input.keyword.engine not in ENGINES:
        raise ConfigError(f"unknown keyword engine: {found.input.keyword.engine}")
    return found


def config_from(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The file, if it exists; else one backend from the environment."""
    env = dict(os.environ) if env is None else env
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return config(f.read())
    backend = Backend(env.get("BACKEND_PROVIDER", "ollama"), env.get("BACKEND_ENDPOINT", "http://localhost:11434"), env.get("BACKEND_API_KEY") or env.get("OPENAI_API_KEY"), env.get("BACKEND_MODEL"))
    return Config(backend=backend, budget=Budget(admin_api_key=env.get("ADMIN_API_KEY")))


@dataclass(frozen=True)
class Pool:
    backends: dict[str, Backend]
    rules: tuple[Route, ...]
    default: str
    warnings: tuple[str, ...] = ()


def pool(found: Config) -> Pool:
    """Backends, ordered rules and the default; raises ConfigError for references that lead nowhere."""
    warnings = ("[backend] is ignored beside [backends.*]",) if found.backends and found.backend else ()
    backends = dict(found.backends) or ({"default": found.backend} if found.backend else {})
    if not backends:
        raise ConfigError("routing needs a backend, and none is given")
    for r in found.routing.rules:
        at = f"routing, models like {r.model!r}:"
        if r.backend not in backends:
            raise ConfigError(f"{at} there is no backend {r.backend!r}")
        for i, b in enumerate(r.fallback):
            if b not in backends:
                raise ConfigError(f"{at} there is no backend {b!r} to fall back on")
            if b == r.backend:
                raise ConfigError(f"{at} {b!r} cannot be its own fallback")
            if b in r.fallback[:i]:
                raise ConfigError(f"{at} {b!r} is a fallback twice")
    default = found.routing.default
    if default is not None and default not in backends:
        raise ConfigError(f"routing: there is no backend {default!r} to be the default")
    if default is None and len(backends) > 1:
        raise ConfigError(f"routing: one of the {len(backends)} backends must be named as the default")
    return Pool(backends, found.routing.rules, default or next(iter(backends)), warnings)
