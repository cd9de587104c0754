"""Per-token lists: decoding, divergence, alignment to words, regions, entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import col, let, literal_array


def decode_list(value: Column | str) -> Column:
    """JSON text to array<double>. Bad JSON or no list is empty; non-numbers are dropped."""
    entries = F.coalesce(
        F.from_json(col(value), "array<string>"), F.array().cast("array<string>")
    )
    numbers = F.transform(entries, lambda x: x.try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull())


def decode_strings(value: Column | str) -> Column:
    return F.coalesce(
        F.from_json(col(value), "array<string>"), F.array().cast("array<string>")
    )


def safe_get(values: Column | str, index: int) -> Column:
    """Zero-based element, negative from the end, null when outside."""
    return F.try_element_at(col(values), F.lit(index + 1 if index >= 0 else index))


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """Number of leading entries the two lists share."""
    a, b = col(a), col(b)
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, True).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(a))


def divergence_index(a: Column | str, b: Column | str, prefix_rule: int | None = -1) -> Column:
    """Index of the first difference. When one list starts the other: ``prefix_rule``,
    or the shorter length if that is None."""
    a, b = col(a), col(b)
    shorter = F.least(F.size(a), F.size(b))
    at = shared_prefix(a, b)
    return at if prefix_rule is None else F.when(at < shorter, at).otherwise(prefix_rule)


def aligned_difference(a: Column | str, b: Column | str) -> Column:
    """a - b entry by entry, cut to the shorter list; :func:`unaligned` counts what is left out."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x - y)


def unaligned(a: Column | str, b: Column | str) -> Column:
    """How many entries of the longer list have no partner in the other; null if a list is."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(F.size(a) - F.size(b)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    """Mean of a list, null when empty."""
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def location_metrics(
    ids_a: str, ids_b: str, logprobs_a: str, logprobs_b: str
) -> dict[str, Column]:
    """Log-probs of the first, second, last and divergence token of two candidates and
    their differences; the aligned difference list with its mean, first and last."""
    out: dict[str, Column] = {
        "shared_prefix_token_count": shared_prefix(ids_a, ids_b),
        "divergence_token_index": divergence_index(ids_a, ids_b),
    }
    for name, index in (("first", 0), ("second", 1), ("last", -1)):
        a, b = safe_get(logprobs_a, index), safe_get(logprobs_b, index)
        out[f"candidate_a_{name}_token_logprob"] = a
        out[f"candidate_b_{name}_token_logprob"] = b
        out[f"preference_{name}_token"] = a - b
    at = out["divergence_token_index"]
    a, b = (F.when(at >= 0, F.get(F.col(x), at)) for x in (logprobs_a, logprobs_b))
    out["candidate_a_divergence_token_logprob"] = a
    out["candidate_b_divergence_token_logprob"] = b
    out["preference_divergence_token"] = a - b
    diffs = aligned_difference(logprobs_a, logprobs_b)
    out["preference_tokenwise_aligned_diffs"] = diffs
    out["preference_aligned_mean"] = array_mean(diffs)
    out["preference_aligned_first"] = F.get(diffs, 0)
    out["preference_aligned_last"] = F.try_element_at(diffs, F.lit(-1))
    out["aligned_length"] = F.size(diffs)
    return out


def clean_piece(piece: Column | str) -> Column:
    """Token piece without word-start marks, quotes and edge symbols; marks as one mark."""
    body = F.lower(F.translate(F.trim(F.coalesce(col(piece), F.lit(""))), "▁ĠĊ\"'", ""))
    edged = F.regexp_replace(body, r"^[^a-z.?!]+|[^a-z.?!]+$", "")
    return F.regexp_replace(edged, r"^[.?!]*([.?!])$", "$1")


_AHEAD, _PIECES = 16, 128


def align_tokens(pieces: Column | str, word_list: Column | str) -> Column:
    """Word index of each token piece, -1 when none fits.

    Walks the pieces with the state (next word, unfinished text, its word). A
    sentence mark jumps to the next equal mark; a piece that extends the unfinished
    word stays on it; any other piece goes to the first later word that equals it,
    starts with it, or is its start. The next ``_AHEAD`` words are looked at first, and the
    others only if none of them fits; indexes are gathered in blocks of ``_PIECES``.
    """
    # Bound once: inside the walk an expression would be evaluated again for every piece.
    return let(col(word_list), lambda words: let(col(pieces), lambda some: _aligned(some, words)))


def _aligned(pieces: Column, word_list: Column) -> Column:
    def step(state, raw):
        def move(piece):
            current, partial, at = state["current"], state["partial"], state["at"]
            n = F.size(word_list)
            mark = piece.isin(".", "?", "!")
            extended = F.concat(partial, piece)
            unfinished = F.coalesce(F.get(word_list, at), F.lit(""))
            extends = (at >= 0) & ~mark & unfinished.startswith(extended)
            start = F.when(mark & (at >= 0), at).otherwise(current)

            def fits(word, index):
                ok = F.when(mark, word == piece).otherwise(
                    word.startswith(piece) | piece.startswith(word)
                )
                return F.when(ok & (index >= start), index)

            ahead = F.slice(word_list, start + 1, F.lit(_AHEAD))
            found = F.coalesce(
                F.array_min(F.transform(ahead, lambda word, i: fits(word, i + start))),
                F.array_min(F.transform(word_list, fits)),
                F.lit(-1),
            )
            target = (
                F.when(piece == "", -1).when(extends, at).otherwise(found)
            )

            def settle(match):
                word = F.coalesce(F.get(word_list, match), F.lit(""))
                text = F.when(extends, extended).otherwise(piece)
                whole = F.when(extends, extended == unfinished).otherwise(
                    mark | piece.startswith(word)
                )
                hit = match >= 0
                idle = piece == ""
                same = F.struct(current.alias("current"), partial.alias("partial"), at.alias("at"))
                done = F.struct(
                    (match + 1).alias("current"),
                    F.lit("").alias("partial"),
                    F.lit(-1).alias("at"),
                )
                opened = F.struct(
                    current.alias("current"), text.alias("partial"), match.alias("at")
                )
                lost = F.struct(
                    current.alias("current"),
                    F.lit("").alias("partial"),
                    F.lit(-1).alias("at"),
                )
                nxt = (
                    F.when(idle, same)
                    .when(hit & whole, done)
                    .when(hit, opened)
                    .when(mark, lost)
                    .otherwise(same)
                )
                return F.struct(
                    F.concat(state["out"], F.array(match)).alias("out"),
                    nxt["current"].alias("current"),
                    nxt["partial"].alias("partial"),
                    nxt["at"].alias("at"),
                )

            return let(target.cast("int"), settle)

        return let(clean_piece(raw), move)

    start = F.struct(
        F.array().cast("array<int>").alias("out"),
        F.lit(0).alias("current"),
        F.lit("").alias("partial"),
        F.lit(-1).alias("at"),
    )

    def walk(state, block):
        own = F.struct(F.array().cast("array<int>").alias("out"), *(state[c].alias(c) for c in ("current", "partial", "at")))
        some = F.slice(pieces, block * _PIECES + 1, F.lit(_PIECES))

        def joined(end):
            return F.struct(F.concat(state["out"], end["out"]).alias("out"), *(end[c].alias(c) for c in ("current", "partial", "at")))

        return F.aggregate(some, own, step, joined)

    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _PIECES).cast("int"))
    walked = F.aggregate(blocks, start, walk, lambda s: s["out"])
    return F.when(F.size(pieces) > 0, walked).when(pieces.isNotNull(), start["out"])


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of ints, in steps that each add the sums of twice as many items."""

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - back), F.lit(0)))

    rounds = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)).cast("double"))).cast("int")
    return F.when(F.size(numbers) < 2, numbers).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), numbers, add))


def word_spans(text: Column | str) -> Column:
    """array<struct<start,end>> of the blank-separated words of a compact text."""
    sizes = F.transform(F.split(col(text), " "), lambda t: F.length(t) + 1)
    both = F.arrays_zip(running_sums(sizes).alias("after"), sizes.alias("size"))
    return F.transform(both, lambda w: F.struct((w["after"] - w["size"]).alias("start"), (w["after"] - 1).alias("end")))


def align_by_offset(offsets: Column | str, spans: Column | str) -> Column:
    """Word index of each token from character offsets; a token outside all words is an error.

    The spans are in order, so each token's word is found by halving steps.
    """
    return let(col(spans), lambda s: _placed(col(offsets), s))


def _placed(offsets: Column, spans: Column) -> Column:
    n = F.size(spans)
    steps = F.sequence(F.ceil(F.log2(n.cast("double") + 1)).cast("int"), F.lit(0))

    def place(token, halves):
        def halve(low, k):
            to = low + F.pow(F.lit(2.0), k).cast("int")
            return F.when((to <= n) & (F.get(spans, to - 1)["end"] <= token["start"]), to).otherwise(low)

        def checked(index):
            word = F.get(spans, index)
            fine = word.isNotNull() & (token["end"] > word["start"])
            return F.when(F.coalesce(fine, F.lit(False)), index).otherwise(
                F.raise_error(F.lit("token offset outside every word"))
            )

        return F.aggregate(halves, F.lit(0), halve, checked)

    return let(steps, lambda halves: F.transform(offsets, lambda token: place(token, halves)))


def region_label(voice: Column | str, word_index: Column | str) -> Column:
    """Region of a word by voice and position."""
    voice, index = col(voice), col(word_index).cast("int")
    passive = F.coalesce(
        F.get(literal_array(fixed.PASSIVE_REGIONS), index), F.lit("other_passive")
    )
    active = F.coalesce(
        F.get(literal_array(fixed.ACTIVE_REGIONS), index), F.lit("other_active")
    )
    return (
        F.when(index < 0, "unaligned")
        .when(voice == "passive", passive)
        .when(voice == "active", active)
        .otherwise("other")
    )


def token_pe(
    congruent: Column | str,
    incongruent: Column | str,
    ids_a: Column | str | None = None,
    ids_b: Column | str | None = None,
) -> Column:
    """Per-token difference of two scorings of one target; different token ids are an error."""
    diff = aligned_difference(congruent, incongruent)
    if ids_a is None or ids_b is None:
        return diff
    return F.when(col(ids_a) == col(ids_b), diff).otherwise(
        F.raise_error(F.lit("the two scorings have different tokens"))
    )


def item_pe(
    pe: str,
    divergence: Column | str,
    structure_start: Column | str,
    critical_start: Column | str,
    critical_end: Column | str,
) -> dict[str, Column]:
    """Sum and mean of a token-difference list overall, before and after the divergence,
    in the structure region and on the critical word."""
    values = F.col(pe)
    cut, region = col(divergence), col(structure_start)
    first, last = col(critical_start), col(critical_end)

    def tail(start):
        return F.slice(values, start + 1, F.greatest(F.size(values) - start, F.lit(0)))

    post, structure = tail(cut), tail(region)
    critical = F.slice(values, first + 1, last - first)
    return {
        "target_length": F.size(values),
        "sentence_pe": array_sum(values),
        "sentence_pe_mean": array_mean(values),
        "critical_word_token_count": last - first,
        "critical_word_pe": array_sum(critical),
        "critical_word_pe_mean": array_mean(critical),
        "post_divergence_pe": array_sum(post),
        "post_divergence_token_count": F.size(post),
        "post_divergence_pe_mean": array_mean(post),
        "pre_divergence_pe": array_sum(F.slice(values, 1, cut)),
        "structure_region_pe": array_sum(structure),
        "structure_region_token_count": F.size(structure),
        "structure_region_pe_mean": array_mean(structure),
    }


def entropy(probabilities: Column | str) -> Column:
    """Entropy of a probability list in nats; zero and negative entries add nothing."""
    return F.aggregate(
        col(probabilities),
        F.lit(0.0),
        lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(0.0),
    )


def array_positions(values: Column, allowed: Sequence[str]) -> Column:
    """Zero-based positions of the entries that are in ``allowed``."""
    return F.array_compact(F.transform(values, lambda t, i: F.when(t.isin(*allowed), i)))
