"""Registered queries over the given tables, with the SQL that checks them."""

import sys

from pyspark import cloudpickle

from catalog import (
    budgets, casting, cleaning, manuscripts, planning, registry, roundtrip, segmenting, sources, streams, tagging,
    windows)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECTIONS = [sources, cleaning, manuscripts, segmenting, casting, windows, budgets, tagging, roundtrip, registry, planning,
            streams]


def all_queries():
    return {name: fn for section in SECTIONS for name, fn in section.QUERIES.items()}


def all_sql():
    return {name: sql for section in SECTIONS for name, sql in section.SQL.items()}
