"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score.

Each kind has a regex, a check of what it matched and of the characters next to it, a score, and
words that raise the score when one stands within ``NEAR`` characters of the match (and of no
other match of the kind). The four base kinds keep every match that passes its check; a match of
another kind needs a score of ``ENOUGH`` too: an IBAN has its remainder modulo 97 for that, while
a social security number or a national phone number needs a word that says what it is.

Everything is a projection of Spark's own functions, row by row: a regex gives a text's matches,
splitting by it gives what stands between, and summed lengths give each match's place in code
points. Sums are taken by doubling steps, so a text of many matches costs n log n. The base
patterns are written so that the engine never tries a place twice: possessive repeats, and a start
only where the one before it can't belong to the match or a match has just ended. They match what the plain
patterns match, and long runs of digits or letters cost no more than others.

Nulls: a null text is the empty text, without spans; a null or repeated ``doc_id`` is handed
through, row by row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

NEAR, ENOUGH = 40, 0.5
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Kind(NamedTuple):
    name: str
    regex: str
    score: float
    words: str
    check: Callable[[Column, Column, Column], Column]
    base: bool = True
    needs: str = ""  # a character without which nothing matches


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass Luhn's check."""
    own = digits(text)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(own, -i, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(own)), F.lit(0), add)
    return F.when(F.length(own) > 0, total % 10 == 0).otherwise(False)


def mod97(text: Column) -> Column:
    """The remainder modulo 97 of an account number: four characters moved to the end, letters as 10 to 35."""
    own = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(own, F.lit(5), F.length(own)), F.substring(own, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        value = F.instr(F.lit(_VALUES), F.substring(turned, i, F.lit(1))) - 1
        return (rest * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _small_parts(hit: Column, before: Column, after: Column) -> Column:
    """Whether four numbers are at most 255, whatever zeros they begin with."""
    return hit.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def _apart(inside: str, hit: Column, before: Column, after: Column) -> Column:
    """Whether no character of a class stands on either side."""
    return ~before.rlike(f"[{inside}]$") & ~after.rlike(f"^[{inside}]")


#: Kinds in order; the base patterns' meaning is fixed.
KINDS = (
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
        0.9,
        "mail|contact|write|address",
        lambda hit, before, after: F.lit(True),
        needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login", _small_parts, needs="."),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
        0.8,
        "card|visa|credit|pay|kart|tarjet|carte",
        lambda hit, before, after: luhn(hit),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.7,
        "tel|phone|call|mobile|fax|anruf",
        lambda hit, before, after: F.length(digits(hit)).between(9, 15),
        needs="+",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        0.8,
        "iban|account|bank|konto|cuenta|compte",
        lambda hit, before, after: _apart("A-Za-z0-9", hit, before, after) & (mod97(hit) == 1),
        base=False,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.3,
        "ssn|social|security",
        lambda hit, before, after: _apart("A-Za-z0-9-", hit, before, after) & ~hit.rlike("^(000|666|9)|-00-|-0000$"),
        base=False,
        needs="-",
    ),
    Kind(
        "local_phone",
        r"[0-9]{3}[\x20.-][0-9]{3}[.-][0-9]{4}",
        0.3,
        "tel|phone|call|mobile|fax|anruf",
        lambda hit, before, after: _apart("A-Za-z0-9.-", hit, before, after),
        base=False,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
RAISE = 0.2


def _running(steps: Column) -> Column:
    """Running sums of an array: each step adds the sums of twice as many items."""

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - back), F.lit(0)))

    rounds = F.ceil(F.log2(F.greatest(F.size(steps), F.lit(1)).cast("double"))).cast("int")
    return F.when(F.size(steps) < 2, steps).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), steps, add))


def _spans(rank: int, kind: Kind) -> Column:
    """start, rank, end, kind, score, text of the kind's matches that pass; see ``spans`` for the columns used."""
    hits, parts, ends = (F.col(f"{name}_{kind.name}") for name in ("hits", "parts", "ends"))

    def one(hit: Column, i: Column) -> Column:
        end = F.get(ends, i)
        before, after = F.get(parts, i), F.get(parts, i + 1)
        near = F.lower(F.concat_ws(" ", F.substring(before, -NEAR, NEAR), F.substring(after, 1, NEAR)))
        score = F.lit(kind.score) + F.when(near.rlike(f"(^|[^a-z])({kind.words})"), RAISE).otherwise(0.0)
        return F.struct(
            (end - F.length(hit)).alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            F.round(F.least(score, F.lit(0.99)), 2).alias("score"),
            hit.alias("text"),
            kind.check(hit, F.substring(before, -1, 1), F.substring(after, 1, 1)).alias("good"),
        )

    found = F.filter(F.transform(hits, one), lambda s: s["good"])
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= ENOUGH)
    return F.transform(
        found, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "end", "kind", "score", "text")))
    )


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: start, rank (the kind's place in KINDS), end, kind, score, text of each find,
    by start, then rank. Places are code points, ends exclusive."""
    rows = texts(docs)
    none = F.array().cast("array<string>")

    def hits(kind: Kind) -> Column:
        every = F.regexp_extract_all("text", F.lit(kind.regex), F.lit(0))
        return F.when(F.contains("text", F.lit(kind.needs)), every).otherwise(none) if kind.needs else every

    rows = rows.select("doc_id", "text", *(hits(k).alias(f"hits_{k.name}") for k in KINDS))
    rows = rows.select(
        "doc_id",
        *(f"hits_{k.name}" for k in KINDS),
        *(
            F.when(F.size(f"hits_{k.name}") > 0, F.split("text", k.regex, -1)).otherwise(none).alias(f"parts_{k.name}")
            for k in KINDS
        ),
    )

    def ends(kind: Kind) -> Column:
        steps = F.transform(f"hits_{kind.name}", lambda h, i: F.length(h) + F.length(F.get(f"parts_{kind.name}", i)))
        return steps.alias(f"ends_{kind.name}")

    rows = rows.select("*", *(ends(k) for k in KINDS))
    rows = rows.select(
        "doc_id",
        *(c for k in KINDS for c in (f"hits_{k.name}", f"parts_{k.name}")),
        *(_running(F.col(f"ends_{k.name}")).alias(f"ends_{k.name}") for k in KINDS),
    )
    every = [_spans(rank, kind) for rank, kind in enumerate(KINDS)]
    return rows.select("doc_id", F.array_sort(F.concat(*every)).alias("spans"))


def listed(some: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
