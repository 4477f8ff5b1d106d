"""Runs of identical or near-identical consecutive events, by optimal segmentation.

A segmentation of an entity's events costs, per run, the weighted number of events whose field
differs from the run's most frequent value, plus a penalty per run. The least total is found by
dynamic programming with pruning: a start that is no cheaper than the best segmentation so far can
never win later and is dropped, which leaves one or two starts at a time on repetitive streams.
Identical neighbours enter as one weighted event: the cost of giving k of them to the left run is
concave in k, so some optimum never parts them.

Runs never cross a silence longer than `max_gap_us`, and the events between two silences, a stretch,
are segmented as one: the result is the optimum of the whole stream. Events are sorted by range, so
that a task gets a slice of the (entity, time) order wherever it falls; stretches inside a slice are
finished there, the first and last of each slice, which may go on in the next task, are passed on as
weighted events and finished after one more exchange. An entity that is never silent is one stretch
and its weighted events are one stream of the second step, in memory that does not grow with it.
With `mismatch` above twice the `penalty` every difference is a border and the result is exactly the
runs of equal neighbours; with less, short deviations are absorbed.

Events without entity or time are left out. Equal times go by `seq`. Null field values equal each
other. Repeated rows count as events. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelot.session import materialise

#: Weighted events that a task holds of one stretch before it passes the stretch on.
HELD = 1 << 18
#: Finished rows that are sent on together.
_SEND = 8192


class Segmenter:
    """Pruned dynamic programme over one stretch of weighted events; finished runs leave as soon as no open start can change them."""

    def __init__(self, mismatch: float, penalty: float):
        self.mismatch, self.penalty = mismatch, penalty
        self.starts: list[list] = []
        self.best: tuple = (0.0, None)  # cost so far; last run as (previous, start, end, n, cost, values)

    def push(self, first: int, last: int, n: int, values: tuple) -> None:
        """Add `n` identical events from `first` to `last`."""
        cost0, chain0 = self.best
        # A start: [cost before it, chain before it, first time, events, most frequent values, run cost, counts by field]; counts are None while all events are alike.
        fresh = [cost0, chain0, first, 0, values, 0.0, None]
        least, winner, w = cost0 + self.penalty, fresh, self.mismatch
        costs = []
        for s in self.starts:
            off = 0
            if s[6] is None:
                for v, mode in zip(values, s[4], strict=True):
                    if v != mode:
                        off += min(s[3], n)
            else:
                total = s[3] + n
                for v, mode, counts in zip(values, s[4], s[6], strict=True):
                    off += total - max(counts[mode], counts.get(v, 0) + n)
            costs.append(cost := w * off)
            if s[0] + cost + self.penalty <= least:  # of equal totals the longest run counts
                if winner is fresh or s[0] + cost + self.penalty < least:
                    winner = s
                least = s[0] + cost + self.penalty
        kept = []
        for s, cost in zip(self.starts, costs, strict=True):
            if s[0] + cost < least:
                self._grow(s, n, values, cost)
                kept.append(s)
        if cost0 < least:
            self._grow(fresh, n, values, 0.0)
            kept.append(fresh)
        self.starts = kept
        self.best = (least, (winner[1], winner[2], last, winner[3], winner[5], winner[4]))

    @staticmethod
    def _grow(s: list, n: int, values: tuple, cost: float) -> None:
        if s[6] is None and s[3] and s[4] != values:
            s[6] = [{mode: s[3]} for mode in s[4]]
        if s[6] is not None:
            modes = []
            for v, mode, counts in zip(values, s[4], s[6], strict=True):
                counts[v] = counts.get(v, 0) + n
                modes.append(v if counts[v] > counts[mode] else mode)
            s[4] = tuple(modes)
        s[3] += n
        s[5] = cost

    def settled(self) -> list[tuple]:
        """Runs that are final because a single start is left; they are taken out of the chain."""
        if len(self.starts) != 1 or self.starts[0][1] is None:
            return []
        only = self.starts[0]
        done = _unwind(only[1])
        only[1] = None
        cost, last = self.best
        self.best = (cost, (None, *last[1:]))
        return done

    def finish(self) -> list[tuple]:
        done = _unwind(self.best[1])
        self.starts, self.best = [], (0.0, None)
        return done


def _unwind(chain: tuple | None) -> list[tuple]:
    done = []
    while chain is not None:
        done.append(chain[1:])
        chain = chain[0]
    return done[::-1]


def _weighted(b: pa.RecordBatch, nk: int, nf: int, weighted: bool, max_gap_us: int) -> Iterator[tuple]:
    """(entity or None where it is that of the event before, whether a silence comes before, first, last, n, values) of each stretch of identical neighbours in a sorted batch."""
    n = b.num_rows
    if not n:
        return
    codes = [b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for i in (*range(nk), *range(b.num_columns - nf, b.num_columns))]
    first = b.column(nk).to_numpy()
    last = b.column(nk + 1).to_numpy() if weighted else first
    counts = b.column(nk + 2).to_numpy() if weighted else np.ones(n, np.int64)
    moved = np.zeros(n, bool)
    for c in codes[:nk]:
        moved[1:] |= c[1:] != c[:-1]
    moved[0] = True
    silent = np.zeros(n, bool)
    silent[1:] = first[1:] - last[:-1] > max_gap_us
    differs = moved | silent
    for c in codes[nk:]:
        differs[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(differs)
    ends = np.append(at[1:], n) - 1
    keys = list(zip(*(b.column(i).take(pa.array(at)).to_pylist() for i in range(nk)), strict=True))
    values = list(zip(*(b.column(i).take(pa.array(at)).to_pylist() for i in range(b.num_columns - nf, b.num_columns)), strict=True)) if nf else [()] * len(at)
    sums = np.add.reduceat(counts, at)
    yield from zip(keys, silent[at].tolist(), first[at].tolist(), last[ends].tolist(), sums.tolist(), values, strict=True)


def collapse_runs(df: DataFrame, keys: list[str], ts_us: str, seq: str, fields: list[str], max_gap_us: int, mismatch: float = 3.0, penalty: float = 1.0) -> DataFrame:
    """One row per run: (`keys`, `start_us`, `end_us`, `n_events`, `cost`, `fields` as each field's most frequent value)."""
    if mismatch < 0 or penalty <= 0:
        raise ValueError("mismatch must not be negative and penalty must be positive")
    nk, nf = len(keys), len(fields)
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in [*keys, ts_us]))
    rows = rows.select(*(F.col(c).cast("string") for c in keys), F.col(ts_us).alias("_ts"), F.col(seq).alias("_seq"), *(F.col(c).cast("string") for c in fields))
    order = [*keys, "_ts", "_seq"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_seq")

    names = [*keys, "start_us", "end_us", "n_events", "cost", *fields, "_part", "_place"]
    types = [pa.string()] * nk + [pa.int64()] * 3 + [pa.float64()] + [pa.string()] * nf + [pa.int64()] * 2
    ddl = ", ".join([*(f"`{k}` string" for k in keys), "start_us bigint, end_us bigint, n_events bigint, cost double", *(f"`{f}` string" for f in fields), "_part bigint, _place bigint"])

    def send(out: list[tuple]) -> pa.RecordBatch:
        # A row: (entity, first, last, n, cost, values, part, place); part and place are null once it is a run.
        flat = [[r[0][i] for r in out] for i in range(nk)] + [[r[i] for r in out] for i in (1, 2, 3, 4)] + [[r[5][i] for r in out] for i in range(nf)] + [[r[i] for r in out] for i in (6, 7)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flat, types, strict=True)], names=names)

    def first_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, out, held, dp = TaskContext.get().partitionId(), 0, [], [], Segmenter(mismatch, penalty)
        where, before, passes = None, 0, True  # the stretch at hand is passed on: the first of a task may have begun in another

        def pass_on() -> None:
            nonlocal place
            for first, last, n, values in held:
                out.append((where, first, last, n, None, values, part, place))
                place += 1
            held.clear()

        for b in batches:
            for entity, silent, first, last, n, values in _weighted(b, nk, nf, False, max_gap_us):
                if entity != where or silent or first - before > max_gap_us:
                    if passes:
                        pass_on()
                        passes = where is None
                    else:
                        for event in held:
                            dp.push(*event)
                        held.clear()
                        out += [(where, *run, None, None) for run in dp.finish()]
                    where = entity
                held.append((first, last, n, values))
                before = last
                if len(held) > HELD:
                    passes = True
                if passes and len(held) > _SEND:
                    pass_on()
                if len(out) > _SEND:
                    yield send(out)
        pass_on()
        yield send(out)

    def second_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, dp, where, before = [], Segmenter(mismatch, penalty), None, 0
        for b in batches:
            for entity, silent, first, last, n, values in _weighted(b, nk, nf, True, max_gap_us):
                if entity != where or silent or first - before > max_gap_us:
                    out += [(where, *run, None, None) for run in dp.finish()]
                    where = entity
                dp.push(first, last, n, values)
                before = last
                if len(dp.starts) == 1:
                    out += [(where, *run, None, None) for run in dp.settled()]
                if len(out) > _SEND:
                    yield send(out)
        out += [(where, *run, None, None) for run in dp.finish()]
        yield send(out)

    step = materialise(rows.mapInArrow(first_step, ddl), "runs")
    rest = step.filter("_part is not null").drop("cost").repartition(*keys).sortWithinPartitions(*keys, "_part", "_place").select(*keys, "start_us", "end_us", "n_events", *fields)
    cols = names[:-2]
    return step.filter("_part is null").select(*cols).unionByName(rest.mapInArrow(second_step, ddl).select(*cols))
