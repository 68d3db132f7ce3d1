"""All registered queries with their SQL."""
from . import cluster, corpus, engine, forms, shuffle

MODULES = (corpus, forms, shuffle, engine, cluster)


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
