"""Golden values of the window, seam and catch-up rules."""

import pytest

from hitfeed.functions.timebounds import (
    catchup_seam, day_range_bounds, hours_ago_bound, strict_seam, window_bounds,
)

NOW = 1612873200 + 1200  # 2021-02-09 12:20 UTC


def test_hours_bound():
    assert hours_ago_bound(NOW, 12) == 1612828800
    assert hours_ago_bound(NOW, 5) == 1612854000          # 07:00
    assert hours_ago_bound(NOW, 5, full_days=True) == 1612828800  # 00:00
    assert hours_ago_bound(NOW, 0) == 1612872000          # current hour 12:00


def test_hour_key():
    # 2021-01-19 19:00 UTC
    assert hours_ago_bound(1611082800 + 59, 0) == 1611082800


def test_day_range():
    assert day_range_bounds("20201230-20210119") == (1609286400, 1611100800)
    assert day_range_bounds("20210119-20210119") == (1611014400, 1611100800)


@pytest.mark.parametrize("bad", ["2020123-20210119", "20201330-20210119", "20210120-20210119", "", "x-y"])
def test_day_range_invalid(bad):
    with pytest.raises(ValueError):
        day_range_bounds(bad)


@pytest.mark.parametrize("bad", [-1, "abc", 1.5, True])
def test_hours_invalid(bad):
    with pytest.raises(ValueError):
        hours_ago_bound(NOW, bad)


def test_window_exactly_one():
    with pytest.raises(ValueError):
        window_bounds(NOW)
    with pytest.raises(ValueError):
        window_bounds(NOW, 5, "20201230-20210119")
    assert window_bounds(NOW, 12) == (1612828800, None)


def test_seams():
    assert strict_seam(NOW, hourly=True) == 1612868400     # 11:00
    assert strict_seam(NOW, hourly=False) == 1612872000 - 86400
    # catch-up, last seen 09:32, 12 h -> 09:00
    assert catchup_seam(hours_ago_bound(NOW, 12), 1612861200) == 1612861200
    # catch-up, last seen 05:14, 5 h -> 07:00 (the floor wins)
    assert catchup_seam(hours_ago_bound(NOW, 5), 1612847640 // 3600 * 3600) == 1612854000
    assert catchup_seam(1612854000, None) == 1612854000
