"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query -> module of this subpackage; the module holds a function of that name
#: and, where SQL can express it, its DuckDB text in ORACLE_SQL.
MODULES = {
    "op1_quality_rules": "quality",
    "op2_simhash": "simhash",
    "op3_bpe": "bpe",
    "op4_lm_scores": "lm",
    "op5_line_dedup": "lines",
    "op6_pii": "pii",
    "op7_url_filters": "urls",
    "op8_packing": "packing",
    "op9_sharding": "sharding",
    "op10_fingerprints": "syncmers",
    "op11_variants": "variants",
    "op12_secrets": "secretscan",
    "op13_periods": "periods",
}

QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
ORACLE_SQL = {name: sql for name, module in MODULES.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None))}
