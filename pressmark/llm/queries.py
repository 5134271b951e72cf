"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("quality_crf", "quality_rules", "bpe_tree", "packing", "prefix_hash", "chat_parts", "html_crf", "license_index", "suffix_dedup", "order_minhash", "covering_simhash", "turn_trie", "whitening")


def queries() -> dict:
    found = {}
    for name in _MODULES:
        module = import_module(f"pressmark.llm.{name}")
        found |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        found |= getattr(import_module(f"pressmark.llm.{name}"), "SQL", {})
    return found
