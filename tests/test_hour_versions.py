"""Hour outputs through the catalog: late files of any age, hours that readers never miss, runs that died."""

import uuid

import pytest
from pyspark.sql import functions as F

from hitfeed.fixtures import NOW, write_partitioned
from hitfeed.functions.render import csv_safe
from hitfeed.plans import hour_versions as hv
from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from hitfeed.session import scratch_path
from hitfeed.sources.logs import read_logs
from hitfeed.sources.partitions import hour_versions

H = 3600
SPEC = FeedSpec(parent_policies="error,p3", hours_ago=24)


def output(spark, format="parquet"):
    return hv.HourOutput(f"hv_{uuid.uuid4().hex[:10]}", scratch_path(spark, "hv"), format)


def same(a, b):
    a, b = csv_safe(a.select(*b.columns)), csv_safe(b)
    text = lambda d: sorted(map(str, (tuple(map(str, r)) for r in d.collect())))
    return text(a) == text(b)


def as_of(log, t):
    return log.filter(F.col("start_time") < t * 1_000_000)


@pytest.fixture(scope="module")
def recent(small_log):
    """The log of the last days, where the windows of these tests lie."""
    return small_log.filter(f"hour >= {NOW - 40 * H}").cache()


def store(rows, root, hours="hour"):
    rows.repartition(4, hours).write.mode("append").partitionBy(hours).parquet(root)


def delete(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def test_late_files_of_any_age(spark, recent):
    root, out = scratch_path(spark, "logs"), output(spark)
    logs = lambda: read_logs(spark, root, recent.schema)
    run = lambda t=NOW: hv.refresh_hours(spark, logs(), SPEC, t, out, source_root=root)
    late = recent.filter("event_id % 5 = 0")
    store(recent.filter("event_id % 5 <> 0"), root)
    run()
    assert run().changed == []  # nothing came, nothing is written
    old = late.filter(f"hour >= {NOW - 22 * H}").agg(F.min("hour")).first()[0]  # far below any seam
    store(late.filter(F.col("hour") == old), root)
    assert run().changed == [old]
    store(late.filter(F.col("hour") > old), root)
    run()
    delete(spark, f"{root}/hour={NOW - 3 * H}")
    assert run().dropped == [NOW - 3 * H]
    want = export_feed(logs(), SPEC, NOW)
    assert same(hv.read_hours(spark, out), want) and want.count() > 0
    later = run(NOW + 5 * H)  # retention moves on
    assert later.changed == [] and same(hv.read_hours(spark, out), want.filter(F.col("hour") >= later.floor))


def test_partition_layout_and_kind(spark, recent):
    root, out = scratch_path(spark, "logs"), output(spark)
    rows = recent.filter(f"hour >= {NOW - 3 * H}")
    write_partitioned(rows, root)
    found = {r["hour"]: r["version"] for r in hour_versions(spark, root, since_hour=NOW - 2 * H, until=NOW).collect()}
    assert set(found) == {r[0] for r in rows.filter(f"hour >= {NOW - 2 * H}").select("hour").distinct().collect()}
    every = {r["hour"]: r["version"] for r in hour_versions(spark, root).collect()}
    assert {h: v for h, v in every.items() if h in found} == found
    for kind in ("dns", "proxy"):
        spec = FeedSpec(parent_policies="error,p3", hours_ago=3)
        one = hv.HourOutput(f"{out.table}_{kind}", f"{out.root}-{kind}")
        hv.refresh_hours(spark, read_logs(spark, root, recent.schema, kind), spec, NOW, one, source_root=root, kind=kind)
        assert same(hv.read_hours(spark, one), export_feed(read_logs(spark, root, recent.schema, kind), spec, NOW))


def test_seam_runs_and_csv(spark, recent):
    table, csv = output(spark), output(spark, "csv")
    t0 = NOW - 10 * H
    hv.refresh_hours_feed(spark, as_of(recent, t0), SPEC, t0, table, csv)
    first = set(spark.table(csv.table).inputFiles())
    run, text = hv.refresh_hours_feed(spark, recent, SPEC, NOW, table, csv, hourly=True)
    second = set(spark.table(csv.table).inputFiles())
    want = export_feed(recent, SPEC, NOW)
    assert same(hv.read_hours(spark, table), want) and same(hv.read_hours(spark, csv), want)
    kept = [h for h in range(run.floor, t0 - H, H) if h not in run.changed]
    assert {f for f in first if any(f"hour={h}/" in f for h in kept)} <= second  # hours in between were not touched
    assert set(text.changed) == set(run.changed)
    files = sorted(second, key=lambda f: (f.split("hour=")[1].split("/")[0], f.rsplit("/", 1)[1]))
    read = lambda f: spark.read.options(header=True, escape='"', multiLine=True).csv(f).select("start_time").collect()
    times = [int(r[0]) for f in files for r in read(f)]
    assert times == sorted(times) and len(times) == want.count()


def test_a_hot_hour_is_written_by_many_tasks(spark, recent):
    table, csv = output(spark), output(spark, "csv")
    hot = recent.withColumn("hour", F.lit(NOW - H).cast("int"))
    hv.refresh_hours(spark, hot, SPEC, NOW, table, buckets=4)
    hv.refresh_hours_csv(spark, table, csv, num_partitions=6)
    assert 2 <= len(spark.table(table.table).inputFiles()) <= 4 and len(spark.table(csv.table).inputFiles()) >= 5
    assert same(hv.read_hours(spark, csv), export_feed(hot, SPEC, NOW))


def test_another_feed_is_built_anew(spark, recent):
    out = output(spark)
    hv.refresh_hours(spark, recent, SPEC, NOW, out)
    other = FeedSpec(parent_policies="view", hours_ago=24)
    hv.refresh_hours(spark, recent, other, NOW, out, hourly=True)
    assert same(hv.read_hours(spark, out), export_feed(recent, other, NOW))


def test_unused_directories_go_after_a_while(spark, recent):
    out = output(spark)
    runs = lambda: {s.getPath().getName() for s in hv._fs(spark, out.root)[0].listStatus(hv._fs(spark, out.root)[1])
                    if s.getPath().getName().startswith("run-")}
    hv.refresh_hours(spark, recent, SPEC, NOW, out)
    frame = spark.table(out.table)
    frame.count()
    hv.refresh_hours(spark, recent, SPEC, NOW, out, catch_up=False)
    assert len(runs()) == 2 and frame.count() == export_feed(recent, SPEC, NOW).count()  # a reader's old files are there
    hv.refresh_hours(spark, recent, SPEC, NOW, out, catch_up=False, keep_seconds=-60)
    hv.refresh_hours(spark, recent, SPEC, NOW, out, catch_up=False, keep_seconds=-60)
    assert len(runs()) <= 2
    assert same(hv.read_hours(spark, out), export_feed(recent, SPEC, NOW))


class Died(Exception):
    pass


@pytest.mark.parametrize("stored", [True, False])
def test_every_hour_is_old_or_new_at_every_step(spark, recent, monkeypatch, stored):
    """The second run is stopped before each of its catalog statements in turn; a reader sees whole hours only, and the
    run after it brings everything up to date."""
    real, t0 = hv._sql, NOW - 6 * H
    spec = FeedSpec(parent_policies="error,view,click,purchase,signup,p0,p1,p2,p3,p4", hours_ago=10)
    root = scratch_path(spark, "logs")
    first = as_of(recent, t0).filter("event_id % 4 <> 0") if stored else as_of(recent, t0)
    store(first, root)
    by_hour = lambda df: {h: sorted(x) for h, x in csv_safe(df).select("hour", F.concat_ws("|", "event_id", "policy")).rdd
                          .map(lambda r: (int(r[0]), r[1])).groupByKey().mapValues(list).collect()}
    old = by_hour(export_feed(first, spec, t0))
    new = by_hour(export_feed(recent, spec, NOW))

    def refresh(out, log, t):
        if stored:
            hv.refresh_hours(spark, read_logs(spark, root, recent.schema), spec, t, out, source_root=root)
        else:
            hv.refresh_hours(spark, log, spec, t, out, hourly=True)

    outs = []
    for _ in range(9):  # tables that stand at t0
        outs.append(output(spark))
        refresh(outs[-1], first, t0)
    store(recent.join(first.select("event_id"), "event_id", "left_anti"), root)
    stopped = 0
    for step, out in enumerate(outs):
        left = [step]

        def sql(session, statement):
            if statement.startswith("ALTER"):
                if not left[0]:
                    raise Died(statement)
                left[0] -= 1
            return real(session, statement)

        monkeypatch.setattr(hv, "_sql", sql)
        try:
            refresh(out, recent, NOW)
        except Died:
            stopped += 1
        monkeypatch.setattr(hv, "_sql", real)
        got = by_hour(hv.read_hours(spark, out))
        for h in old.keys() | new.keys() | got.keys():
            assert got.get(h) in (old.get(h), new.get(h))
        refresh(out, recent, NOW)
        assert by_hour(hv.read_hours(spark, out)) == new
    assert 4 <= stopped < len(outs)  # every step was among them


@pytest.mark.parametrize("died", ["before the CSV", "while the CSV was published", "table alone"])
def test_csv_makes_up_for_a_run_that_lost_it(spark, recent, monkeypatch, died):
    table, csv = output(spark), output(spark, "csv")
    run = lambda t, **kw: hv.refresh_hours_feed(spark, as_of(recent, t), SPEC, t, table, csv, hourly=True)
    run(NOW - 15 * H)
    t, real = NOW - H, hv._sql
    if died == "table alone":
        hv.refresh_hours(spark, as_of(recent, t), SPEC, t, table, hourly=True)
    elif died == "before the CSV":
        hv.refresh_hours(spark, as_of(recent, t), SPEC, t, table, hourly=True)
        monkeypatch.setattr(hv, "write_hours", lambda *a: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            hv.refresh_hours_csv(spark, table, csv)
        monkeypatch.undo()
    else:
        def sql(session, statement):
            if csv.table in statement and "ADD IF NOT EXISTS" in statement:
                raise Died(statement)
            return real(session, statement)

        monkeypatch.setattr(hv, "_sql", sql)
        with pytest.raises(Died):
            run(t)
        monkeypatch.undo()
    run(NOW)
    assert same(hv.read_hours(spark, csv), export_feed(recent, SPEC, NOW))


def test_hours_in():
    text = str(hv.hours_in([0, H, 2 * H, 10 * H]))
    assert text.count("AND") == 2 or text.count("and") == 2
    assert "false" in str(hv.hours_in([])).lower()
