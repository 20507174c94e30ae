"""Property tests (hypothesis) for the pure rules and the renderer."""

from hypothesis import given, settings, strategies as st

from hitfeed.functions.policies import parse_policy_list
from hitfeed.functions.timebounds import (
    DAY, HOUR, catchup_seam, day_range_bounds, hours_ago_bound, strict_seam,
)

NOWS = st.integers(min_value=946684800, max_value=4102444800)  # 2000 .. 2100
HOURS = st.integers(min_value=0, max_value=24 * 400)


@given(NOWS, HOURS, st.booleans())
def test_bound_is_aligned_and_covers_window(now, hours, full):
    b = hours_ago_bound(now, hours, full)
    align = DAY if full else HOUR
    assert b % align == 0
    assert b <= now - hours * HOUR < b + align          # floor of the window start
    assert hours_ago_bound(now, hours + 1, full) <= b   # wider window, lower bound


@given(NOWS, st.booleans())
def test_seams(now, hourly):
    s = strict_seam(now, hourly)
    assert s % HOUR == 0 and s <= now - (HOUR if hourly else DAY)
    assert now - s < (2 if hourly else 25) * HOUR


@given(NOWS, HOURS, st.one_of(st.none(), NOWS))
def test_catchup_never_below_floor(now, hours, last):
    floor = hours_ago_bound(now, hours)
    assert catchup_seam(floor, last) >= floor


@given(st.dates(min_value=__import__("datetime").date(1971, 1, 1)), st.integers(0, 800))
def test_day_range(start, span):
    import datetime as dt
    end = start + dt.timedelta(days=span)
    if end.year > 9999:
        return
    lo, hi = day_range_bounds(f"{start:%Y%m%d}-{end:%Y%m%d}")
    assert (hi - lo) == (span + 1) * DAY and lo % DAY == 0


@given(st.lists(st.text(alphabet="abc ,|", max_size=4), max_size=6), st.sampled_from([",", "|"]))
def test_policy_list(parts, delim):
    text = delim.join(parts)
    expected = [p for p in text.split(delim) if p]
    if not expected:
        return
    assert parse_policy_list(text, delim) == expected


VALUES = st.one_of(st.none(), st.text(alphabet="xy= ,{}", max_size=3))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.dictionaries(st.text(alphabet="kn", min_size=1, max_size=2), VALUES,
                                                     max_size=3)), min_size=1, max_size=6))
def test_map_rendering_matches_python(spark, maps):
    from hitfeed.functions.render import render_nested
    rows = [(i, m) for i, m in enumerate(maps)]
    df = spark.createDataFrame(rows, "i int, m map<string,string>")
    got = {r["i"]: r["m"] for r in render_nested(df).collect()}
    from pyspark.sql import functions as F
    # Spark's own entry order (a collected dict does not keep it)
    back = {r["i"]: r["e"] for r in df.select("i", F.map_entries("m").alias("e")).collect()}
    for i, entries in back.items():
        want = None if entries is None else "{" + ", ".join(
            f"{e['key']}={'None' if e['value'] is None else e['value']}" for e in entries) + "}"
        assert got[i] == want
