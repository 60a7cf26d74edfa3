"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "anchors", "neighbours", "exact_dedup", "bpe", "simhash", "chat", "repeats", "url_filter", "mixing", "fill_middle", "decontaminate", "divergence")

CORPUS_QUERIES: dict = {}
CORPUS_ORACLE: dict = {}
for _module in (import_module(f"{__package__}.{name}") for name in MODULES):
    CORPUS_QUERIES.update(_module.QUERIES)
    CORPUS_ORACLE.update(_module.ORACLE)
