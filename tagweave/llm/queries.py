"""The queries of this subpackage and their DuckDB counterparts."""

from . import backoff, cascade, classifier, extraction, linededup, mixing, packing, repair, simhash, sketches

MODULES = (backoff, repair, simhash, cascade, sketches, classifier, extraction, packing, mixing, linededup)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
