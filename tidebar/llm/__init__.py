"""Training-data operators: search, packing, tokenising, sharding, deduplication, classifiers.

``queries()`` and ``oracle_sql()`` list what ``__spark_entry__`` registers from here.
"""

from __future__ import annotations

import importlib

#: Modules of the numbered operators, in their order.
MODULES = ("op1_ann", "op2_packing", "op3_bpe", "op4_sharding", "op5_exact_dedup", "op6_chat", "op7_licenses", "op8_near_dedup", "op9_quality", "op10_toxicity", "op11_vector_dedup", "op12_spelling", "op13_alignment")


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        found[module.QUERY] = module.query
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        if module.ORACLE_SQL:
            found[module.QUERY] = module.ORACLE_SQL
    return found
