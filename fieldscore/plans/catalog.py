"""All queries of the scoring engine."""

from fieldscore.plans import operators_catalog, scoring

QUERIES: dict = {**scoring.QUERIES, **operators_catalog.QUERIES}
ORACLES: dict = {**scoring.ORACLES, **operators_catalog.ORACLES}
