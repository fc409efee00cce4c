"""name -> (query, sql or None) of this subpackage."""
from __future__ import annotations

from importlib import import_module

MODULES = (
    "lm_scoring", "exact_dedup", "token_counts", "jaccard_join", "decontamination", "packing", "toxicity", "language_id", "chat_format", "warc",
    "prefix_trie", "repair", "secrets",
)


def registry() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(import_module(f"citeline.llm.{module}").QUERIES)
    return found
