"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["toxicity", "substring", "media", "minhash", "decontaminate", "sharding", "mixing", "pii", "lm", "html"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"simforge.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
