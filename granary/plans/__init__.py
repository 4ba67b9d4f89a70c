"""Registered queries. Importing the package registers all of them."""

from granary.plans import (  # noqa: F401
    aggregates,
    commands,
    flows,
    joins,
    learning,
    lookups,
    quality,
    series,
    state,
    streams,
)
from granary.plans.registry import QUERIES, callables, oracles  # noqa: F401
