"""Named queries over the given tables, one module per part of the inventory."""

from . import (  # noqa: F401
    aggregates,
    cleaning,
    effects,
    joins,
    labels,
    reshapes,
    sources,
    statistics,
    texts,
    tokens,
    windows,
)
from .registry import CHECKS, QUERIES  # noqa: F401
