"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from gatewarden.plans import audit, chat, evaluation, files, ledger, lookups, redaction, streams, text, tools
from gatewarden.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audit", "chat", "evaluation", "files", "ledger", "lookups", "redaction", "streams", "text", "tools"]
