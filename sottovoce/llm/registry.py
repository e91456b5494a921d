"""The corpus operators' registered queries and their SQL."""

from importlib import import_module

MODULES = ["line_dedup", "revisits", "token_counts", "url_filters", "secret_scans", "packing", "audio_fingerprints", "mixing", "near_dedup", "quality_rules", "importance", "periodic_runs", "word_bpe"]
QUERIES, ORACLE = {}, {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= getattr(_module, "ORACLE", {})
