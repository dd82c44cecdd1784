"""Places of pattern matches in texts of any length, by column functions whose work grows with the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Code points of a piece of text that places are looked up in.
SEGMENT = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Each value merged with all before it; ``merge`` is associative, as a sum or a maximum of longs.

    Blocks of about the root of the array's size are run through one by one, then what is before each: an array that grows to the whole
    size would be copied at every step.
    """
    def grown(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(F.when(F.size(a) > 0, merge(F.element_at(a, -1), x)).otherwise(x)))

    none = F.expr("cast(array() as array<bigint>)")

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(0), F.size(v) - 1, width)
        inner = F.transform(starts, lambda i: F.aggregate(F.slice(v, i + 1, width), none, grown))
        return let(inner, lambda each: let(
            F.aggregate(F.transform(each, lambda b: F.element_at(b, -1)), none, grown),
            lambda tops: F.flatten(F.transform(each, lambda b, k: F.when(k == 0, b).otherwise(
                F.transform(b, lambda x: merge(F.get(tops, k - 1), x)))))))

    return let(F.transform(values, lambda x: x.cast("long")), lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the leftmost matches that do not overlap, in code points; no match is empty."""
    def zipped(pieces: Column, hits: Column) -> Column:
        gaps = F.slice(pieces, F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda p, h: F.length(p) + F.length(h)), lambda a, b: a + b)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).cast("int").alias("start"), h.alias("value")))

    return let(text, lambda t: let(F.split(t, pattern, -1), lambda p: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda h: zipped(p, h))))


def segments(text: Column) -> Column:
    """The text in pieces of ``SEGMENT`` code points, for :func:`between`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text given in segments; nothing outside the text."""
    first = F.floor(start / SEGMENT).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / SEGMENT).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(part, start - first * SEGMENT + 1, end - start)).otherwise("")
