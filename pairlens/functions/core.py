"""Small column helpers the other modules build on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def alternation(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def first_rule(token: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """Rewrite ``token`` by the first pattern that matches it."""
    out = otherwise
    for pattern, replacement in reversed(list(rules)):
        hit = F.regexp_replace(token, pattern, replacement)
        out = F.when(token.rlike(pattern), hit).otherwise(out)
    return out


def r6(c: Column | str) -> Column:
    """Six decimals, the precision results are compared at."""
    return F.round(col(c), 6)
