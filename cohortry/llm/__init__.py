"""Operators for preparing training text; nothing else in the package imports this folder."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tokens", "mixing", "packing", "linededup", "sharding", "jaccard", "repeats", "quality", "licenses", "topk", "bestfit", "lloyd", "turns")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"cohortry.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
