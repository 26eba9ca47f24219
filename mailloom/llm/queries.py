"""All queries of the package and their SQL."""

from __future__ import annotations

from mailloom.llm import p2, p3, p4, p6, p7, p8, p9, p10

MODULES = [p2, p3, p4, p6, p7, p8, p9, p10]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
