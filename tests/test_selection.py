import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from stripewise.operators.selection import RowSelection, Selector

masks = st.lists(st.booleans(), max_size=60)


def mask_of(s: RowSelection) -> list[bool]:
    out = [False] * s.total
    for a, b in s.ranges:
        out[a:b] = [True] * (b - a)
    return out


@given(masks, masks)
def test_intersection_and_counts(a, b):
    x, y = RowSelection.from_filters([a]), RowSelection.from_filters([b])
    n = max(len(a), len(b))
    pad = lambda m: m + [False] * (n - len(m))
    assert mask_of(x.intersection(y)) == [p and q for p, q in zip(pad(a), pad(b), strict=True)]
    assert (x.row_count, x.selected_row_count, x.skipped_row_count, x.selects_any) == (len(a), sum(a), len(a) - sum(a), any(a))


@given(masks, st.data())
def test_and_then_is_relative(a, data):
    x = RowSelection.from_filters([a])
    own = data.draw(st.lists(st.booleans(), min_size=sum(a), max_size=sum(a)))
    at = np.flatnonzero(a)
    want = [False] * len(a)
    for k, keep in zip(at, own, strict=True):
        want[k] = keep
    assert mask_of(x.and_then(RowSelection.from_filters([own]))) == want


@given(masks, st.integers(0, 70))
def test_split_and_selectors(a, n):
    x = RowSelection.from_filters([a])
    left, right = x.split_off(n)
    assert mask_of(left) + mask_of(right) == a
    assert RowSelection.from_selectors(x.selectors) == x


def test_merging_and_errors():
    assert RowSelection([(0, 2), (2, 5), (7, 7)], 10).ranges == ((0, 5),)
    assert RowSelection.from_selectors([Selector.skip_rows(0), Selector.select(2), Selector.select(3)]).selectors == [Selector(5, False)]
    for bad in ([(5, 6), (0, 1)], [(0, 3), (2, 4)], [(0, 11)]):
        with pytest.raises(ValueError):
            RowSelection.from_consecutive_ranges(bad, 10)
    with pytest.raises(ValueError):
        RowSelection([(0, 2)], 5).and_then(RowSelection.select_all(3))
    with pytest.raises(ValueError):
        RowSelection.from_filters([[True, None]])


def test_row_groups_and_all():
    assert RowSelection.from_row_groups([True, False, True], 10, 25).ranges == ((0, 10), (20, 25))
    assert RowSelection.select_all(3).ranges == ((0, 3),) and RowSelection.skip_all(3).ranges == ()
    assert not RowSelection().selects_any


def test_applied_as_filter_and_as_join(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_index")
    few, many = RowSelection([(3, 5), (990, 1000)], 1000), RowSelection([(k, k + 1) for k in range(0, 1000, 3)], 1000)
    assert sorted(r[0] for r in few.applied(df).collect()) == [3, 4, *range(990, 1000)]
    assert sorted(r[0] for r in many.applied(df).collect()) == list(range(0, 1000, 3))


@given(masks)
def test_bytes_and_positions(a):
    x = RowSelection.from_filters([a[:20], np.array(a[20:], bool)])
    assert RowSelection.from_bytes(x.to_bytes()) == x and x.positions.tolist() == np.flatnonzero(a).tolist()
    wide = RowSelection(x.ranges, 1000)
    assert RowSelection.from_bytes(wide.to_bytes()) == wide and hash(RowSelection.from_bytes(wide.to_bytes())) == hash(wide)


def test_many_ranges_take_no_square_of_time():
    n = 3_000_000
    x = RowSelection.from_filters(np.arange(k, k + 100_000) % 3 == 0 for k in range(0, n, 100_000))
    began = time.process_time()
    assert sum(x.window(k, k + 1000).selected_row_count for k in range(0, n, 1000)) == x.selected_row_count == n // 3
    assert x.intersection(RowSelection.select_all(n)) == x and x.and_then(RowSelection.select_all(n // 3)) == x
    assert time.process_time() - began < 20  # 3000 windows over a million tuples took minutes
