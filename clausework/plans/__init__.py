"""All queries of the library outside ``llm``, with their SQL."""

from . import checks, evaluation, integrity, journal, layout, rules, schema_drift, search, text

_MODULES = [integrity, schema_drift, search, journal, layout, evaluation, checks, text, rules]
FLAGSHIP = "r03_bm25_topk"
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
