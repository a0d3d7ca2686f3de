"""All registered queries by name, with SQL where SQL can express the same result."""

from riskloom.plans import chains, describe, learn, score

_MODULES = (describe, learn, score, chains)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql.strip() for module in _MODULES for name, sql in module.ORACLES.items()}
