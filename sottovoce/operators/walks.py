"""Walks along the rows of a file, as a window by file has put them in order, in the partition where they lie.

Two tracks are walked as one: each text is dealt by file once and never meets another one in a join. What is kept between
rows is bounded by the cues that are near each other in time, or by the lines of one script.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sottovoce.functions.similar import words_of

#: Rows of a result that are handed on together.
ROWS = 2048


def walked(rows: DataFrame, order: list[str | Column], walk: Callable[[], Any], result: StructType, at_once: int = ROWS) -> DataFrame:
    """``rows`` by file in ``order`` through a walk: an object that ``take``s rows as tuples, a file's ``end``, and gives lists of results.

    A file's rows are numbered by the window that puts them in order, so rows that lie by file already are not dealt again.
    """
    names = rows.columns
    dealt = rows.withColumn("at", F.row_number().over(Window.partitionBy("file_id").orderBy(*order))).sortWithinPartitions("file_id", *order)
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, started = walk(), None, False

        def given() -> pa.RecordBatch:
            columns = list(zip(*own.done, strict=True)) or [()] * len(schema)
            own.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if started and row[0] != last:
                    own.end()
                last, started = row[0], True
                own.take(row)
                if len(own.done) >= at_once:
                    yield given()
        if started:
            own.end()
        if own.done:
            yield given()

    return dealt.mapInArrow(run, result)


class Lines:
    """Word lists of a script's lines, each made when it is first looked at; what lies before ``free`` is let go."""

    def __init__(self) -> None:
        self.texts: list[str | None] = []
        self.words: dict[int, list[str]] = {}

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, j: int) -> list[str]:
        if j not in self.words:
            self.words[j] = words_of(self.texts[j] or "")
        return self.words[j]

    def passed(self, free: int) -> None:
        for j in [j for j in self.words if j < free]:
            del self.words[j]


class _Cue:
    __slots__ = ("row", "words", "known", "limit", "open", "used", "gone", "wishes", "matcher")

    def __init__(self, row: tuple, window: int) -> None:
        self.row, self.words = row, words_of(row[5] or "")
        self.known, self.limit = set(self.words), max(row[3], row[4]) + window
        self.open, self.used, self.gone, self.wishes, self.matcher = 0, False, False, [], None


class Matching:
    """Rows (file_id, side, idx, start_ms, end_ms, text) by start, side and idx to (file_id, times and texts of both, score).

    A cue meets those of the other side that it may match when the later one of both begins. A reference cue (side 1) takes
    the best cue still free when all that it may match have come, and after the reference cues before it.
    """

    def __init__(self, window: int, least: float) -> None:
        self.window, self.least, self.done = window, least, []
        self.near: tuple[list[_Cue], list[_Cue]] = ([], [])
        self.waiting: deque[_Cue] = deque()

    def score(self, o: _Cue, t: _Cue) -> float:
        """Likeness of the words, and the accepting bound for shared time; 0 where the bound is not reached."""
        bonus = 0.3 if min(o.row[4], t.row[4]) > max(o.row[3], t.row[3]) else 0.0
        both = o.known & t.known
        if not both:
            return bonus if bonus >= self.least else 0.0
        # The ratio is at most twice the words in both over all words; below the bound, texts need not be aligned.
        own, theirs = [w for w in o.words if w in both], [w for w in t.words if w in both]
        most = 2.0 * min(len(own), len(theirs)) / (len(o.words) + len(t.words))
        if most + bonus < self.least:
            return 0.0
        # Words that stand once, in the same order, are all found; of texts of 200 words, frequent ones are left out.
        if own == theirs and len(own) == len(both) and len(t.words) < 200:
            return most + bonus
        if t.matcher is None:
            t.matcher = SequenceMatcher(None, [], t.words)
        t.matcher.set_seq1(o.words)
        score = t.matcher.ratio() + bonus
        return score if score >= self.least else 0.0

    def give(self, o: _Cue | None, t: _Cue | None, score: float | None) -> None:
        own, other = (c.row[2:] if c else (None,) * 4 for c in (o, t))
        self.done.append(((o or t).row[0], *own, *other, score))

    def left(self, o: _Cue) -> None:
        if o.gone and not o.used and not o.open:
            self.give(o, None, None)

    def decide(self, t: _Cue) -> None:
        free = [w for w in t.wishes if not w[3].used]
        best = min(free, key=lambda w: w[:3]) if free else None
        if best is None:
            self.give(None, t, None)
        else:
            best[3].used = True
            self.give(best[3], t, -best[0])
        for *_, o in t.wishes:
            o.open -= 1
            self.left(o)
        t.wishes, t.matcher = [], None

    def passed(self, now: float) -> None:
        for side, near in enumerate(self.near):
            if any(c.limit < now for c in near):
                gone = [c for c in near if c.limit < now]
                near[:] = [c for c in near if c.limit >= now]
                for c in gone:
                    c.gone = True
                    if side == 0:
                        self.left(c)
        while self.waiting and self.waiting[0].gone:
            self.decide(self.waiting.popleft())

    def take(self, row: tuple) -> None:
        _, side, _, start, end, _ = row
        if None in (row[0], start, end):  # is near nothing
            self.done.append((row[0], *row[2:], None, None, None, None, None) if side == 0 else (row[0], None, None, None, None, *row[2:], None))
            return
        self.passed(start)
        c = _Cue(row, self.window)
        for other in self.near[1 - side]:
            o, t = (c, other) if side == 0 else (other, c)
            if o.row[4] >= t.row[3] - self.window and o.row[3] <= t.row[4] + self.window and (score := self.score(o, t)):
                t.wishes.append((-score, o.row[3], (o.row[2] is not None, o.row[2]), o))
                o.open += 1
        self.near[side].append(c)
        if side == 1:
            self.waiting.append(c)

    def end(self) -> None:
        self.passed(float("inf"))
