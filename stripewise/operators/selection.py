"""Selections of rows by position: sorted ranges over a known number of rows, and their algebra."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selector:
    """A run of rows that are taken or left out."""

    rows: int
    skip: bool

    @staticmethod
    def select(n: int) -> Selector:
        return Selector(n, False)

    @staticmethod
    def skip_rows(n: int) -> Selector:
        return Selector(n, True)


def _runs(masks: Iterable):
    """Starts and ends of the runs of true values of consecutive boolean masks, of each by itself, and their rows in all."""
    at, starts, ends = 0, [], []
    for m in masks:
        if not (isinstance(m, np.ndarray) and m.dtype == bool):
            values = list(m)
            if any(v is None for v in values):
                raise ValueError("a mask has nulls")
            m = np.array(values, bool)
        edges = np.flatnonzero(np.diff(np.r_[0, m.view(np.int8), 0])) + at
        starts.append(edges[::2])
        ends.append(edges[1::2])
        at += m.size
    none = np.empty(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), at


def _both(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what two lists of sorted disjoint ranges have in common."""
    low, high = np.searchsorted(b1, a0, "right"), np.searchsorted(b0, a1, "left")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(a0.size), n)
    j = np.arange(i.size) - np.repeat(np.cumsum(n) - n, n) + low[i]
    return np.maximum(a0[i], b0[j]), np.minimum(a1[i], b1[j])


class RowSelection:
    """Rows that are selected, as sorted disjoint ranges [start, end) of ``total`` rows. Rows at or beyond total are not selected.

    The ranges are two arrays, ``starts`` and ``ends``, so there can be many."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = (), total: int = 0):
        both = np.array(list(ranges), np.int64).reshape(-1, 2)
        self._set(both[:, 0], both[:, 1], total)

    def _set(self, a: np.ndarray, b: np.ndarray, total: int) -> None:
        if (wrong := np.flatnonzero(~((a >= 0) & (a <= b) & (b <= total)))).size:
            raise ValueError(f"range [{a[wrong[0]]}, {b[wrong[0]]}) is not within {total} rows")
        if a.size > 1 and (a[1:] < np.maximum.accumulate(np.where(a < b, b, 0))[:-1]).any():
            raise ValueError("ranges overlap or are out of order")
        some = a < b
        a, b = a[some], b[some]
        apart = a[1:] != b[:-1]
        self.starts, self.ends, self.total = (a[np.r_[True, apart]], b[np.r_[apart, True]], int(total)) if a.size else (a, b, int(total))

    @classmethod
    def of(cls, starts: np.ndarray, ends: np.ndarray, total: int) -> RowSelection:
        """From arrays of starts and ends."""
        out = cls.__new__(cls)
        out._set(starts, ends, total)
        return out

    @property
    def ranges(self) -> tuple[tuple[int, int], ...]:
        return tuple(zip(self.starts.tolist(), self.ends.tolist(), strict=True))

    @property
    def positions(self) -> np.ndarray:
        """The selected rows."""
        n = self.ends - self.starts
        return np.arange(int(n.sum())) + np.repeat(self.starts - (np.cumsum(n) - n), n)

    def to_bytes(self) -> bytes:
        """Ranges, or a bit a row where that is shorter."""
        total = np.array([self.total], np.int64).tobytes()
        if 128 * self.starts.size <= self.total:
            return b"r" + total + self.starts.tobytes() + self.ends.tobytes()
        mask = np.zeros(self.total, bool)
        mask[self.positions] = True
        return b"b" + total + zlib.compress(np.packbits(mask).tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> RowSelection:
        total = int(np.frombuffer(data, np.int64, 1, 1)[0])
        if data[:1] == b"r":
            both = np.frombuffer(data, np.int64, offset=9)
            return cls.of(both[: both.size // 2], both[both.size // 2 :], total)
        return cls.from_filters([np.unpackbits(np.frombuffer(zlib.decompress(data[9:]), np.uint8), count=total).view(bool)])

    @classmethod
    def from_selectors(cls, selectors: Iterable[Selector]) -> RowSelection:
        at, ranges = 0, []
        for s in selectors:
            if not s.skip:
                ranges.append((at, at + s.rows))
            at += s.rows
        return cls(ranges, at)

    @classmethod
    def from_filters(cls, masks: Iterable) -> RowSelection:
        """From boolean masks of consecutive batches, without nulls."""
        return cls.of(*_runs(masks))

    @classmethod
    def from_consecutive_ranges(cls, ranges: Iterable[tuple[int, int]], total: int) -> RowSelection:
        return cls(ranges, total)

    @classmethod
    def from_row_groups(cls, kept: list[bool], stride: int, total: int) -> RowSelection:
        """Whole row groups of ``stride`` rows, the last as long as the rows go."""
        return cls([(k * stride, min((k + 1) * stride, total)) for k, keep in enumerate(kept) if keep and k * stride < total], total)

    @classmethod
    def select_all(cls, n: int) -> RowSelection:
        return cls([(0, n)], n)

    @classmethod
    def skip_all(cls, n: int) -> RowSelection:
        return cls([], n)

    @property
    def selectors(self) -> list[Selector]:
        out, at = [], 0
        for a, b in self.ranges:
            out += [Selector(a - at, True)] * (a > at) + [Selector(b - a, False)]
            at = b
        return out + [Selector(self.total - at, True)] * (self.total > at)

    def __iter__(self):
        return iter(self.selectors)

    def __eq__(self, other) -> bool:
        return isinstance(other, RowSelection) and self.total == other.total and np.array_equal(self.starts, other.starts) and np.array_equal(self.ends, other.ends)

    def __hash__(self) -> int:
        return hash((self.starts.tobytes(), self.ends.tobytes(), self.total))

    def __repr__(self) -> str:
        return f"RowSelection({list(self.ranges)}, total={self.total})"

    @property
    def row_count(self) -> int:
        return self.total

    @property
    def selected_row_count(self) -> int:
        return int((self.ends - self.starts).sum())

    @property
    def skipped_row_count(self) -> int:
        return self.total - self.selected_row_count

    @property
    def selects_any(self) -> bool:
        return self.starts.size > 0

    def window(self, start: int, end: int) -> RowSelection:
        """The selection of rows start..end, counted from start."""
        low, high = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.starts, end, "left")
        return RowSelection.of(np.maximum(self.starts[low:high], start) - start, np.minimum(self.ends[low:high], end) - start, end - start)

    def split_off(self, n: int) -> tuple[RowSelection, RowSelection]:
        """The selections of the first n rows and of the rest."""
        n = min(n, self.total)
        return self.window(0, n), self.window(n, self.total)

    def and_then(self, other: RowSelection) -> RowSelection:
        """Of the rows selected here those that other selects, whose positions count these rows only."""
        if other.total > self.selected_row_count:
            raise ValueError("the second selection has more rows than the first selects")
        n = self.ends - self.starts
        seen = np.cumsum(n) - n
        a, b = _both(seen, seen + n, other.starts, other.ends)
        moved = (self.starts - seen)[np.searchsorted(seen, a, "right") - 1] if a.size else a
        return RowSelection.of(a + moved, b + moved, self.total)

    def intersection(self, other: RowSelection) -> RowSelection:
        """Rows that both select; positions mean the same rows in both."""
        return RowSelection.of(*_both(self.starts, self.ends, other.starts, other.ends), max(self.total, other.total))

    def condition(self, position: Column) -> Column:
        """Whether a position is selected, as a Spark condition."""
        out = F.lit(False)
        for a, b in self.ranges:
            out = out | ((position >= a) & (position < b))
        return out

    def applied(self, df: DataFrame, position: str = "row_index") -> DataFrame:
        """Rows of df whose position column is selected: a filter for few ranges, otherwise a range lookup by join."""
        if self.starts.size <= 64:
            return df.where(self.condition(F.col(position)))
        spark = df.sparkSession
        step = max(1, self.total // self.starts.size)
        rows = [(k, a, b) for a, b in self.ranges for k in range(a // step, (b - 1) // step + 1)]
        pieces = spark.createDataFrame(rows, "__k bigint, __a bigint, __b bigint")
        keyed = df.withColumn("__k", F.floor(F.col(position) / step))
        return keyed.join(pieces, "__k").where((F.col(position) >= F.col("__a")) & (F.col(position) < F.col("__b"))).drop("__k", "__a", "__b")
