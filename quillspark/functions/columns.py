"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.chars import STRIP_CHARS

SLICE_CHARS = 1 << 20  # results of a text function that a Python worker holds at a time


def as_col(value: Column | str) -> Column:
    """Accept a column or a column name."""
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column that appears several times in one expression is otherwise computed
    several times; a one-element ``transform`` gives it a name.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_where(text: Column, marks: list[str], pattern: str, replacement: str) -> Column:
    """``regexp_replace`` for texts that hold one of the marks, others pass through.

    Looking for a literal is a byte search; running a pattern decodes the whole
    text first and is many times dearer.
    """

    def body(value: Column) -> Column:
        found = F.contains(value, F.lit(marks[0]))
        for mark in marks[1:]:
            found = found | F.contains(value, F.lit(mark))
        return F.when(found, F.regexp_replace(value, pattern, replacement)).otherwise(value)

    return bind(text, body)


def strip(value: Column | str) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(as_col(value), F.lit(STRIP_CHARS))


def is_blank(value: Column | str) -> Column:
    return F.length(strip(value)) == 0


def explode_with_pos(df: DataFrame, values: Column, pos: str, name: str) -> DataFrame:
    """One row per array element, with its 0-based position.

    The outer form is used on purpose: for the inner form Spark infers a
    ``size(array) > 0`` filter, pushes it below the projection and so computes
    an expensive array twice.
    """
    exploded = df.select("*", F.posexplode_outer(values).alias(pos, name))
    return exploded.filter(F.col(pos).isNotNull())


def in_slices(fn: Callable[..., str | None], texts: pa.Array, *more: pa.Array) -> Iterator[pa.Array]:
    """``fn`` of each row as string arrays of about ``SLICE_CHARS`` characters, so that one slice of results is held at a time."""
    out, held = [], 0
    for i in range(len(texts)):
        out.append(fn(texts[i].as_py(), *(column[i].as_py() for column in more)))
        held += len(out[-1] or "")
        if held >= SLICE_CHARS:
            yield pa.array(out, pa.string())
            out, held = [], 0
    if out:
        yield pa.array(out, pa.string())
