"""Queries of the training-data operators, and their SQL."""

from importlib import import_module

_MODULES = ("mixing", "chat", "exact_dedup", "packing", "simhash", "toxicity", "topk", "langid", "quality", "lmscore", "whitening", "ranked", "edits")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"ashlar.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
