"""All registered queries of the timed-text operators and their SQL. Queries and SQL read whole tables and texts; where
the SQL has some of the checks or fixers, ``whole_`` before the name is the query with all of them."""

from importlib import import_module

MODULES = ["check_queries", "file_queries", "timing_queries", "track_queries", "language_queries", "source_queries", "job_queries", "reference_queries", "name_queries", "rule_queries"]
QUERIES, ORACLE = {}, {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
