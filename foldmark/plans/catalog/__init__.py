"""Named queries over the given tables, each with its SQL where SQL can say it."""

from foldmark.plans.catalog import (  # noqa: F401  (imported to register)
    eda, evaluation, features, fitted, framing, journal, lookups, modelling,
    sequences, sources, streams,
)
from foldmark.plans.catalog.base import QUERIES, SQL  # noqa: F401
