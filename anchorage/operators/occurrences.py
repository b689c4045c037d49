"""Where names stand in texts, and which of those places lie within spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans are held in bins of 2^4, 2^8, ... characters, the first that is as long as the span: a span is in two bins at most.
LEVELS = (4, 8, 12, 16, 20, 24, 28, 32)
#: Places that are sent on at once.
BATCH = 20_000


def found(text: str, names: Iterable[str]) -> Iterator[tuple[str, int]]:
    """(name, start) of every place of every name, those that overlap included, by one pass over the text. Empty names stand nowhere."""
    automaton = ahocorasick.Automaton()
    for name in names:
        if name:
            automaton.add_word(name, name)
    if len(automaton):
        automaton.make_automaton()
        for last, name in automaton.iter(text):
            yield name, last + 1 - len(name)


class Spans:
    """Spans [start, end] of one text, asked whether any of them holds a place."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.reach = [], []
        for start, end in sorted(spans):
            self.starts.append(start)
            self.reach.append(max(end, self.reach[-1]) if self.reach else end)

    def hold(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.reach[i - 1] >= end


def occurrences(rows: DataFrame, key: str, text: str, names: str) -> DataFrame:
    """rows(key, text, names array<string>) -> (key, name, start, end): every place of each row's own names, ends inclusive, in code points.

    A null or empty text and a null, empty or repeated name bring nothing of their own. Texts are read where they lie;
    only places leave the task, in batches.
    """
    kind = rows.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            types = (batch.schema.types[0], pa.string(), pa.int64(), pa.int64())
            flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(held, types, strict=True)], names=[key, "name", "start", "end"])  # noqa: B023, E731
            for at in range(batch.num_rows):  # a text is a Python string only while it is searched
                k, t, own = (batch.column(i)[at].as_py() for i in range(3))
                for name, start in found(t, (x for x in own if x is not None)):
                    for c, v in zip(held, (k, name, start, start + len(name) - 1), strict=True):
                        c.append(v)
                    if len(held[0]) >= BATCH:
                        yield flush()
                        held = ([], [], [], [])
            if held[0]:
                yield flush()
                held = ([], [], [], [])

    asked = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull() & (F.size(names) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(names).alias("n"))
    return asked.mapInArrow(search, f"`{key}` {kind}, name string, start long, end long")


def within(places: DataFrame, spans: DataFrame, key: str, *carried: str) -> DataFrame:
    """places(key, start, end, ...) beside every span(key, start, end, carried...) of the same key that holds it, ends inclusive.

    An interval join by bins: a span stands in the one or two bins that it touches at the level of its length, a place in
    one bin of each level that any span has, so that a pair meets once. The join's keys are bins, not texts: a text with very many
    places and spans is spread over tasks. Repeated places count each; repeated spans too. Nulls lie nowhere.
    """
    width = F.col("__to") - F.col("__from") + 1
    level = F.lit(LEVELS[-1])
    for at in reversed(LEVELS[:-1]):
        level = F.when(width <= (1 << at), at).otherwise(level)
    bin_of = lambda c, at: F.floor(c / F.pow(F.lit(2.0), at)).cast("long")
    s = spans.select(F.col(key).alias("__key"), F.col("start").cast("long").alias("__from"), F.col("end").cast("long").alias("__to"), *carried).where("__to >= __from")
    s = s.withColumn("__level", level).withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__from"), F.col("__level")), bin_of(F.col("__to"), F.col("__level")))))
    used = sorted(r[0] for r in s.select("__level").distinct().collect())  # one of LEVELS each
    p = places.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in used]) if used else F.array().cast("array<int>")))
    p = p.withColumn("__bin", bin_of(F.col("start"), F.col("__level")))
    on = (F.col(key) == F.col("__key")) & (p["__level"] == s["__level"]) & (p["__bin"] == s["__bin"]) & (F.col("start") >= F.col("__from")) & (F.col("end") <= F.col("__to"))
    return p.join(s, on).select(*places.columns, F.col("__from").alias("span_start"), F.col("__to").alias("span_end"), *carried)
