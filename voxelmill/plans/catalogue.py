"""All queries of the library by name, and the SQL that gives the same rows."""

from . import files, imaging, series, statistics

PARTS = (statistics, imaging, series, files)

QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
