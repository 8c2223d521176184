"""Expressions on conversations and on token columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _col


def conversation(prompt: Column | str, completion: Column | str) -> Column:
    """The two-message conversation of a prompt and a completion."""
    return F.array(
        F.struct(F.lit("user").alias("role"), _col(prompt).alias("content")),
        F.struct(F.lit("assistant").alias("role"), _col(completion).alias("content")),
    )


def render(
    conv: Column | str, prefixes: Column | str, suffixes: Column | str
) -> Column:
    """One string out of a conversation; ``prefixes`` and ``suffixes`` are MAP<role, text>."""
    before, after = _col(prefixes), _col(suffixes)
    pieces = F.transform(
        _col(conv),
        lambda m: F.concat(
            F.coalesce(F.try_element_at(before, m["role"]), F.lit("")),
            F.coalesce(m["content"], F.lit("")),
            F.coalesce(F.try_element_at(after, m["role"]), F.lit("")),
        ),
    )
    return F.concat_ws("", pieces)


def split_words(text: Column | str) -> Column:
    """Tokens between single spaces; empty tokens are kept."""
    return F.split(_col(text), " ", -1)


def fit_length(
    tokens: Column | str,
    max_length: int,
    pad: Column,
    truncation_side: str = "right",
    padding_side: str = "right",
) -> tuple[Column, Column]:
    """Tokens cut and padded to ``max_length``, and the attention mask (1 for a token, 0 for padding)."""
    for side in (truncation_side, padding_side):
        if side not in ("left", "right"):
            raise ValueError(f"side must be 'left' or 'right', not {side!r}")
    tokens = _col(tokens)
    n = F.size(tokens)
    start = F.lit(1) if truncation_side == "right" else F.greatest(n - max_length + 1, F.lit(1))
    kept = F.slice(tokens, start, F.lit(max_length))
    missing = F.greatest(F.lit(max_length) - n, F.lit(0))
    filler = F.array_repeat(pad, missing)
    ones = F.array_repeat(F.lit(1), F.least(n, F.lit(max_length)))
    zeros = F.array_repeat(F.lit(0), missing)
    if padding_side == "right":
        return F.concat(kept, filler), F.concat(ones, zeros)
    return F.concat(filler, kept), F.concat(zeros, ones)


def drop_double_start(tokens: Column | str, start_token: Column) -> Column:
    """Remove the first of two start tokens, row by row."""
    tokens = _col(tokens)
    doubled = (F.get(tokens, F.lit(0)) == start_token) & (F.get(tokens, F.lit(1)) == start_token)
    return F.when(
        doubled, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    ).otherwise(tokens)


def pad_to_multiple(tokens: Column | str, multiple: int, pad: Column) -> Column:
    tokens = _col(tokens)
    missing = F.pmod(F.lit(multiple) - F.size(tokens) % multiple, F.lit(multiple))
    return F.concat(tokens, F.array_repeat(pad, missing))


def overlapping_chunks(tokens: Column | str, overlap: int, pad: Column) -> Column:
    """ARRAY of chunks of 2·overlap tokens, each starting ``overlap`` after the one before."""
    padded = pad_to_multiple(tokens, 2 * overlap, pad)
    chunks = F.transform(
        F.array(padded),
        lambda t: F.when(
            F.size(t) > 0,
            F.transform(
                F.sequence(F.lit(0), F.size(t) - 2 * overlap, F.lit(overlap)),
                lambda i: F.slice(t, i + 1, F.lit(2 * overlap)),
            ),
        ),
    ).getItem(0)
    return chunks


def role_maps(templates: Mapping[str, tuple[str, str]]) -> tuple[Column, Column]:
    """Literal MAP columns for ``render`` out of {role: (prefix, suffix)}."""
    before = F.create_map(*[F.lit(x) for role, (p, _) in templates.items() for x in (role, p)])
    after = F.create_map(*[F.lit(x) for role, (_, s) in templates.items() for x in (role, s)])
    return before, after
