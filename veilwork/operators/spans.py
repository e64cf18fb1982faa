"""Spans: placing, choosing, splicing and measuring them. A span is a struct with start and end (exclusive)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def non_overlapping(spans: str, order: str = "start, -(end - start)") -> Column:
    """The spans that a greedy choice keeps: by start, longer first, a span that starts before the end of the last kept
    one is dropped. ``spans`` names an array column, ``order`` sorts by its fields; a fold, as the rule looks at kept spans only."""
    return F.expr(non_overlapping_sql(spans, order))


def non_overlapping_sql(spans: str, order: str) -> str:
    keys = ", ".join(f"'k{i}', {part}" for i, part in enumerate(re.sub("[a-z_]+", r"x.\g<0>", order).split(", ")))
    return (
        f"aggregate(sort_array(transform({spans}, x -> named_struct({keys}, 'x', x))), named_struct('last', 0, 'kept', slice({spans}, 1, 0)), "
        "(acc, y) -> if(y.x.start >= acc.last, named_struct('last', y.x.end, 'kept', array_append(acc.kept, y.x)), acc), acc -> acc.kept)"
    )


def splice(text: str, spans: str, standin: str = "standin") -> Column:
    """text with each of its sorted, disjoint spans replaced by the span's field standin."""
    return F.expr(
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (acc, x) -> named_struct('at', x.end, 'out', concat(acc.out, substring({text}, acc.at + 1, x.start - acc.at), x.{standin})), "
        f"acc -> concat(acc.out, substring({text}, acc.at + 1, length({text}))))"
    )


def place(text: Column, value: Column, hint: Column) -> Column:
    """Where value stands: at the hint, else next after it, else first, else -1."""
    exact = F.substring(text, hint + 1, F.length(value)) == value
    later = F.call_function("locate", value, text, hint + 2)
    first = F.call_function("locate", value, text)
    return F.when(exact, hint).when(later > 0, later - 1).when(first > 0, first - 1).otherwise(F.lit(-1))


def fragments(start: str, end: str, covers: str) -> Column:
    """The parts of [start, end) that no cover (sorted by start, array of structs) hides."""
    return F.expr(
        f"aggregate({covers}, named_struct('at', {start}, 'out', array_remove(array(named_struct('start', {start}, 'end', {start})), named_struct('start', {start}, 'end', {start}))), "
        f"(acc, x) -> named_struct('at', greatest(acc.at, least(x.end, {end})), 'out', if(x.start > acc.at, array_append(acc.out, named_struct('start', acc.at, 'end', least(x.start, {end}))), acc.out)), "
        f"acc -> if(acc.at < {end}, array_append(acc.out, named_struct('start', acc.at, 'end', {end})), acc.out))"
    )


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Code points that two spans share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
