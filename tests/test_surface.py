"""Prompt, streams, external tables and the driver contract."""

import pytest

import __spark_entry__ as entry
from millrace.cli import Prompt
from millrace.errors import ValueError_
from millrace.session import Engine
from millrace.sources import external
from millrace.streaming import queries as streams


def test_prompt(session):
    p = Prompt(session)
    assert p.feed("CREATE TABLE t") == [] and p.feed("(id INTEGER PRIMARY KEY, s STRING);") == ["Created table t"]
    assert p.feed("INSERT INTO t VALUES (1, 'a'), (2, NULL);") == ["Created 2 rows"]
    assert p.feed("!headers on") == ["Headers on"] and p.feed("SELECT * FROM t ORDER BY id;") == ["id|s", "1|a", "2|NULL"]
    assert p.feed("UPDATE t SET s = 'b' WHERE id = 1;") == ["Updated 1 rows"] and p.feed("DELETE FROM t WHERE id = 2;") == ["Deleted 1 rows"]
    assert p.feed("!tables") == ["t"] and p.feed("!table t")[0] == "CREATE TABLE t (" and p.feed("!table x") == ["Error: Table x does not exist"]
    assert p.feed("SELECT 1 +;") == ["Error: Expected expression atom, found ;"] and p.feed("!help")[0].startswith("!headers") and p.feed("!what") == ["Unknown command !what"]
    assert p.feed("BEGIN;")[0].startswith("Began") and p.feed("ROLLBACK;")[0].startswith("Rolled back") and any(x.startswith("commits") for x in p.feed("!status"))


def test_external(spark, tmp_path):
    spark.sql("SELECT CAST(1 AS INT) i, CAST(2.5 AS FLOAT) f, 'x' s, TIMESTAMP '2024-01-02 03:04:05Z' t, DATE '2024-01-02' d, array(1) a, true b").write.parquet(f"{tmp_path}/x.parquet")
    s = Engine(spark, str(tmp_path / "db"), external.folder(spark, str(tmp_path))).session()
    r = s.execute("SELECT * FROM x")
    assert r.labels == ["i", "f", "s", "t", "d", "b"] and r.rows() == [(1, 2.5, "x", "2024-01-02 03:04:05", "2024-01-02", True)] and r.kinds == ["INTEGER", "FLOAT", "STRING", "STRING", "STRING", "BOOLEAN"]
    with pytest.raises(ValueError_, match="Table y does not exist"):
        s.execute("SELECT * FROM y")


def test_streams(spark, tmp_path, session):
    spark.sql("SELECT id, id % 3 AS k FROM range(30)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id LONG, k LONG").parquet(f"{tmp_path}/in")
    df = streams.select(spark, "SELECT k, COUNT(*) AS n, MAX(id) AS m FROM s WHERE id >= 3 GROUP BY k", {"s": stream})
    q = df.writeStream.format("memory").queryName("millrace_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("millrace_test").collect())) == [(0, 9, 27), (1, 9, 28), (2, 9, 29)]
    with pytest.raises(ValueError_, match="need all rows"):
        streams.select(spark, "SELECT id FROM s ORDER BY id", {"s": stream})
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, k INTEGER)")
    load = streams.append_to(session, "t")
    q = stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert session.execute("SELECT COUNT(*) FROM t").rows() == [(30,)]


def test_batches_are_loaded_once_for_each_stream(spark, session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    a, b = streams.append_to(session, "t", "a"), streams.append_to(session, "t", "b")
    rows = lambda i: spark.sql(f"SELECT {i}L AS id")
    for load, i, batch in ((a, 1, 0), (a, 2, 1), (b, 100, 0), (b, 101, 1), (a, 2, 1), (b, 100, 0)):  # the last two again
        load(rows(i), batch)
    with pytest.raises(ValueError_, match="already exists"):
        a(rows(1), 2)
    a(rows(3), 2)  # the failed batch left no mark
    assert sorted(session.execute("SELECT id FROM t").rows()) == [(1,), (2,), (3,), (100,), (101,)]
    with pytest.raises(ValueError_, match="needs a name"):
        streams.append_to(session, "t")(rows(4), 0)
    again = streams.append_to(Engine(spark, session.engine.store.root).session(), "t", "a")
    again(rows(1), 2)  # also by an engine that was started later


def test_watermark(spark, tmp_path):
    """Groups by event time come out in append mode, once the watermark has passed them."""
    spark.sql("SELECT id, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id div 3, 0.25) AS ts FROM range(90)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id LONG, ts TIMESTAMP").parquet(f"{tmp_path}/in")
    df = streams.select(spark, "SELECT ts, COUNT(*) AS n FROM s GROUP BY ts", {"s": stream}, "ts", "5 minutes")
    q = df.writeStream.format("memory").queryName("millrace_marked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("millrace_marked").collect()))
    assert len(got) == 25 and got[1] == ("2024-01-01 00:01:00.25", 3)


def test_timestamps(spark, tmp_path):
    """Fractions stay, instants show in UTC in any zone, and comparisons with constants reach the scan."""
    spark.sql("SELECT id, TIMESTAMP '2024-01-01 00:00:00Z' + make_interval(0, 0, 0, 0, 0, 0, id / 4) AS t, CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 4) AS TIMESTAMP_NTZ) AS u FROM range(8)").write.parquet(f"{tmp_path}/x.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = [f"2024-01-01 00:00:0{i // 4}" + ["", ".25", ".5", ".75"][i % 4] for i in range(8)]
    try:
        for z in (zone, "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            s = Engine(spark, str(tmp_path / "db"), external.folder(spark, str(tmp_path))).session()
            assert s.execute("SELECT t, u FROM x ORDER BY id").rows() == [(x, x) for x in texts]
            assert len(s.execute("SELECT t, COUNT(*) FROM x GROUP BY t").rows()) == 8
            for column in ("t", "u"):
                for value in ("2024-01-01 00:00:00.5", "2024-01-01", "2024-01-01 00:00:01", "2024-01-01 00:00:00.50", "2024-02-30", "abc"):
                    for op, f in (("<", str.__lt__), ("<=", str.__le__), (">", str.__gt__), (">=", str.__ge__), ("=", str.__eq__), ("!=", str.__ne__)):
                        assert sorted(r[0] for r in s.execute(f"SELECT {column} FROM x WHERE {column} {op} '{value}'").rows()) == [x for x in texts if f(x, value)], (column, op, value)
            plan = s.execute("SELECT id FROM x WHERE '2024-01-01 00:00:00.5' < u").df._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThan(u,2024-01-01T00:00:00.5" in plan
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).take(1)) == 1
