"""All registered queries and their SQL, gathered from the modules beside this one."""

from corpuslens.plans import comparisons, evidence, rankings, relational, scanned, scans

MODULES = (scans, rankings, comparisons, relational, scanned, evidence)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
