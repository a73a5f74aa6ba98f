"""Queries over the driver's tables, each with the SQL that must give the same rows.

Every module has ``QUERIES`` (name to function of session and folder) and
``ORACLES`` (name to SQL). Queries without SQL are checked by tests instead.
"""

from gradeloom.plans.checks import attribution, code, curation, monitoring, properties, splits, stats, storage, text, vectors

MODULES = [storage, curation, text, code, stats, splits, vectors, attribution, monitoring, properties]


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
