"""Every query against the same in SQL, by another engine."""

import os
from pathlib import Path

import duckdb
import pytest

from tidemill.plans import catalog

TABLES = "events".split()


def rows(table):
    return sorted(map(repr, table))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(want)
    assert rows(got) == rows([tuple(r) for r in want])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_stream_equals_batch(spark, sf):
    a = catalog.stream_ingest(spark, sf).collect()
    b = catalog.ingest_categories(spark, sf).select("arrival_seq", "category").collect()
    assert sorted(a) == sorted(b)


def test_stream_goes_on_from_a_log(spark, sf):
    """A new query, without a checkpoint, begins with what a log of the earlier messages implies."""
    from tidemill.streaming import ingest as stream
    from tidemill.streaming.replay import replayed

    m = catalog._messages(spark, sf)
    tags = [f"LINE_A.U{i}" for i in range(2000) if i % 10 != 7]
    want = {r["arrival_seq"]: r["category"] for r in catalog.ingest_categories(spark, sf).collect()}
    middle = sorted(want)[len(want) // 2]
    first = replayed(m.where(f"arrival_seq < {middle}"), lambda s: stream.classify_stream(s, tags), 1)
    then = replayed(m.where(f"arrival_seq >= {middle}"), lambda s: stream.classify_stream(s, tags, log=first), 2)
    got = {r["arrival_seq"]: r["category"] for r in first.unionByName(then).collect()}
    assert got == want
    late = [c for a, c in want.items() if a >= middle]
    assert "duplicate" in late and "reading_conflict" in late


def test_stream_goes_on_after_a_crash(spark, sf, tmp_path):
    """A query that fails in its second batch leaves the first; started again it handles every message once."""
    from tidemill.streaming import ingest as stream

    m = catalog._messages(spark, sf).cache()
    tags = [f"LINE_A.U{i}" for i in range(2000) if i % 10 != 7]
    want = {r["arrival_seq"]: r["category"] for r in catalog.ingest_categories(spark, sf).collect()}
    middle = sorted(want)[len(want) // 2]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)

    def start(operator):
        rows = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return stream.write_log(operator(rows), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    def failing(rows):
        broken = catalog.F.when(catalog.F.col("arrival_seq") == middle, catalog.F.raise_error(catalog.F.lit("crash"))).otherwise(catalog.F.col("raw"))
        return stream.classify_stream(rows.withColumn("raw", broken), tags)

    try:
        spark.conf.set(key, stream.STORE)
        m.where(f"arrival_seq < {middle}").coalesce(1).write.parquet(f"{tmp_path}/in")
        start(failing).awaitTermination()
        done = spark.read.parquet(f"{tmp_path}/out").count()
        assert done == sum(a < middle for a in want)
        m.where(f"arrival_seq >= {middle}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with pytest.raises(Exception, match="crash"):
            start(failing).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == done
        start(lambda rows: stream.classify_stream(rows, tags)).awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(want) and {r["arrival_seq"]: r["category"] for r in got} == want


def test_alert_log_of_all_assets(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    al = "al AS (SELECT asset AS machine, window_start, 'rule' AS source, worst AS sensor FROM w WHERE alert)"
    query = f"WITH RECURSIVE {catalog._alert_sql()}, {al} SELECT * FROM al ORDER BY window_start DESC, machine, source, sensor".replace("count_if(", "count(*) FILTER (WHERE ")
    want = con.sql(query).fetchall()
    assert {r[0] for r in want} == {"click", "error", "purchase", "signup", "view"}
    log = catalog.alert_log_upsert(spark, sf).select("machine", "window_start", "source", "sensor").collect()
    assert rows(map(tuple, log)) == rows(r for r in want if r[1] >= catalog.START + 10 * 86400)
    assert list(map(tuple, catalog.recent_alerts(spark, sf).collect())) == want[:50]
    assert [tuple(r) for r in catalog.alert_summary(spark, sf).collect()] == [("rule", min(100, sum(r[0] == "error" for r in want)))]


def test_generator_readings_of_all_splits(spark, sf):
    got = {(r["split"], r["asset"]): r["seconds"] for r in catalog.generator_readings(spark, sf).collect()}
    assert got == {(s["split"], a): s["end"] - s["start"] for s in catalog.generator.splits("dev") for a in s["assets"]}


def test_iforest_is_the_whole_forest(spark, sf, monkeypatch):
    fitted = []
    fit = catalog.models.fit_isolation_forest
    monkeypatch.setattr(catalog.models, "fit_isolation_forest", lambda *a, **kw: fitted.append((a[1], a[3:])) or fit(*a, **kw))
    assert catalog.iforest_scores(spark, sf).where("eligible and score is null").isEmpty()
    assert {c.split("__")[1].split("_")[0] for c in fitted[0][0]} >= {"mean", "std", "slope"} and {c[:2] for c in fitted[0][0]} == {"s1", "s2"}
    assert fitted[0][1] == tuple(catalog.DEFAULT["forest"][x] for x in ("trees", "sample", "seed"))


def test_replay_has_a_micro_batch_for_each_file(spark):
    from tidemill.streaming.replay import replayed

    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS arrival_seq", "'x' AS raw").repartition(5)
    out = replayed(df, lambda s: s, 4)
    top = out.inputFiles()[0].removeprefix("file://").split("/out/")[0]
    assert sum(f.isdigit() for f in os.listdir(f"{top}/checkpoint/commits")) == 4
    assert sorted(r["arrival_seq"] for r in out.collect()) == list(range(1000))
    files = sorted(Path(f"{top}/in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    first = [duckdb.sql(f"select min(arrival_seq) from '{p}'").fetchall()[0][0] for p in files]
    assert first == sorted(first) and len(first) == 4


@pytest.mark.parametrize("name", ["ingest_categories", "ingest_reconciliation", "ingest_summary", "message_round_trip", "sensor_long", "stream_ingest"])
def test_equals_sql_with_more_users(spark, sf, tmp_path, name):
    """Users beyond those of the small tables are declared by the same rule."""
    con = duckdb.connect()
    con.sql(f"create view small as select * from '{sf}/events.parquet'")
    con.sql(f"copy (select * from small union all select * replace (event_id + 100000 as event_id, user_id + 1995 as user_id) from small) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want)
