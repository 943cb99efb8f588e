"""Spans of a text as arrays of offsets: running figures, union of overlapping spans, and cutting at offsets.

Built-in expressions only. Folding an array into a growing one copies it at each step, so long arrays are folded in
blocks of about the root of their size: n hits of one text take n ** 1.5 copies of a number at most, and cutting at n
places reads the text about 2 n ** 0.5 times. Nothing is made per character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import bind

#: Arrays up to this size are folded at once.
SHORT = 24


def _fold(values: Column, start: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running figures of an array that start from a figure; the figure itself is left out."""
    return F.slice(F.aggregate(
        values, F.array(start), lambda acc, x: F.concat(acc, F.array(both(F.element_at(acc, -1), x)))),
        F.lit(2), F.greatest(F.size(values), F.lit(0)))


def running(values: Column, both: Callable[[Column, Column], Column], start: int) -> Column:
    """both(... both(start, values[0]) ..., values[i]) for every i; both is associative, and start changes nothing."""

    def blocked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), ((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))

        def joined(b: Column) -> Column:
            totals = F.transform(b, lambda x: F.aggregate(x, F.lit(start), both))
            before = _fold(totals, F.lit(start), both)
            return bind(before, lambda t: F.flatten(F.transform(b, lambda x, i: _fold(
                x, F.when(i == 0, F.lit(start)).otherwise(F.get(t, i - 1)), both))))

        return bind(blocks, joined)

    return bind(values, lambda v: F.when(F.size(v) <= SHORT, _fold(v, F.lit(start), both)).otherwise(blocked(v)))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x, 0)


def running_maxima(values: Column) -> Column:
    return running(values, lambda a, x: F.greatest(a, x), -1)


def united(spans: Column) -> Column:
    """Spans (start, end, score, entity_type) -> array<struct<start, end, entity_type>>, in order, with those that
    overlap in one. Touching ones stay apart; an empty one is none. Of several types the one of the highest score counts,
    of equals the first by name."""

    def merged(s: Column) -> Column:
        def groups(most: Column) -> Column:
            firsts = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(most, i - 1)))

            def one(at: Column) -> Column:
                def group(i: Column, k: Column) -> Column:
                    after = F.coalesce(F.get(at, k + 1), F.size(s))
                    members = F.slice(s, i + 1, after - i)
                    best = F.array_min(F.transform(members, lambda m: F.struct(
                        (-m["score"]).alias("worse"), m["entity_type"].alias("entity_type"))))
                    return F.struct(
                        F.get(s, i)["start"].alias("start"), F.get(most, after - 1).alias("end"),
                        best["entity_type"].alias("entity_type"))

                return F.transform(at, group)

            return bind(firsts, one)

        return bind(running_maxima(F.transform(s, lambda x: x["end"])), groups)

    plain = F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["entity_type"].alias("entity_type")))
    nothing = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    return bind(F.array_sort(plain), lambda s: F.when(F.size(s) > 0, merged(s)).otherwise(nothing))


def rewrite_spans(c: Column, spans: Column, how: Callable[[Column, Column], Column]) -> Column:
    """The text with each of the united spans put through how(hit, entity_type)."""

    def piece(t: Column, low: Column, start: Column, end: Column) -> Column:
        return F.substr(t, start - low + 1, end - start)

    def block(t: Column, s: Column, size: Column, k: Column) -> Column:
        mine = F.slice(s, k * size + 1, size)
        low = F.when(k > 0, F.get(s, k * size - 1)["end"]).otherwise(F.lit(0))
        high = F.element_at(mine, -1)["end"]

        def cut(m: Column, low: Column, part: Column) -> Column:
            return F.concat_ws("", F.transform(m, lambda x, i: F.concat(
                bind(F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(low), lambda last: piece(part, low, last, x["start"])),
                how(piece(part, low, x["start"], x["end"]), x["entity_type"]))))

        return bind(mine, lambda m: bind(low, lambda lo: bind(piece(t, F.lit(0), lo, high), lambda part: cut(m, lo, part))))

    def whole(t: Column, s: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(s))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), ((F.size(s) - 1) / size).cast("int")), lambda k: block(t, s, size, k))
        rest = F.substr(t, F.element_at(s, -1)["end"] + 1, F.char_length(t))
        return F.concat(F.concat_ws("", blocks), rest)

    return bind(c, lambda t: bind(spans, lambda s: F.when(F.size(s) > 0, whole(t, s)).otherwise(t)))
