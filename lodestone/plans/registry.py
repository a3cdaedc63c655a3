"""All registered catalog queries and their SQL."""

from lodestone.plans import catalog, intake, values

MODULES = (values, catalog, intake)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
