"""Registered queries over the given tables and their SQL twins."""

from ticketloom.catalog import evaluation, hygiene, labelling, retrieval, routing, streams

FAMILIES = (hygiene, retrieval, labelling, routing, evaluation, streams)


def all_queries() -> dict:
    return {name: fn for module in FAMILIES for name, fn in module.FAMILY.queries.items()}


def all_oracles() -> dict:
    return {name: sql for module in FAMILIES for name, sql in module.FAMILY.oracles.items()}
