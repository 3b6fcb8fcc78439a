"""SELECT over an allotment garden: gardeners, their beds, and what these yielded."""

import math

import pytest

from millrace.errors import EngineError
from millrace.session import Engine


@pytest.fixture(scope="module")
def garden(spark, tmp_path_factory):
    s = Engine(spark, str(tmp_path_factory.mktemp("garden"))).session()
    s.execute("BEGIN")
    for q in (
        "CREATE TABLE gardeners (no INTEGER PRIMARY KEY, nick STRING NOT NULL, born INTEGER)",
        "INSERT INTO gardeners VALUES (11, 'Ivo', 1950), (12, 'Mara', 1988), (13, 'Pim', NULL), (14, 'Zoe', 2001)",
        "CREATE TABLE beds (code STRING PRIMARY KEY, keeper INTEGER INDEX REFERENCES gardeners, metres FLOAT NOT NULL, shady BOOLEAN)",
        "INSERT INTO beds VALUES ('A1', 11, 4.5, FALSE), ('A2', 11, 6.0, TRUE), ('B1', 12, 2.25, NULL), ('C7', NULL, 9.0, TRUE)",
        "CREATE TABLE yields (id INTEGER PRIMARY KEY, bed STRING NOT NULL INDEX REFERENCES beds, plant STRING NOT NULL, week INTEGER NOT NULL, kilos FLOAT)",
        "INSERT INTO yields VALUES (1, 'A1', 'beet', 23, 1.5), (2, 'A1', 'leek', 31, 0.75), (3, 'A2', 'beet', 24, 3.25), (4, 'B1', 'kale', 44, NULL), (5, 'B1', 'kale', 45, 2.0), (6, 'A2', 'pea', 24, 0.5), (7, 'A1', 'pea', 22, 1.5)",
        "CREATE TABLE odd (id INTEGER PRIMARY KEY, b BOOLEAN, i INTEGER, f FLOAT, s STRING)",
        "INSERT INTO odd VALUES (1, TRUE, 40, 2.5, 'm'), (2, NULL, NULL, NULL, NULL), (3, FALSE, -9, NAN, 'Ü'), (4, NULL, 1, -0.25, 'ZZ')",
    ):
        s.execute(q)
    s.execute("COMMIT")
    return s


CASES = [
    # projection, labels, resolution
    ("SELECT id AS x, yields.plant, week + 1 FROM yields WHERE id = 2", ["x", "plant", "?"], [(2, "leek", 32)]),
    ("SELECT plant p, plant p FROM yields WHERE id = 6", ["p", "p"], [("pea", "pea")]),
    ("SELECT 5, 'y', NULL", ["?", "?", "?"], [(5, "y", None)]),
    ("SELECT * FROM gardeners g WHERE g.no < 13", ["no", "nick", "born"], [(11, "Ivo", 1950), (12, "Mara", 1988)]),
    ("SELECT y.id FROM yields y WHERE NULL", ["id"], []),
    ("SELECT code FROM beds WHERE NOT shady", ["code"], [("A1",)]),
    ("SELECT id FROM yields WHERE kilos > 1.25 AND week / 10 = 2", ["id"], [(1,), (3,), (7,)]),
    ("SELECT id FROM yields WHERE id = 4 OR id = 6 OR id = 60", ["id"], [(4,), (6,)]),
    ("SELECT id FROM yields WHERE plant LIKE '_e%'", ["id"], [(1,), (2,), (3,), (6,), (7,)]),
    # NaN and null
    ("SELECT id FROM odd WHERE f > 0", ["id"], [(1,)]),
    ("SELECT id FROM odd WHERE f != f", ["id"], [(3,)]),
    ("SELECT id FROM odd WHERE f = f", ["id"], [(1,), (4,)]),
    ("SELECT id, i / 7, i % 7, i ^ 3, f / 0 FROM odd WHERE id = 3 OR id = 1", None, [(1, 5, 5, 64000, math.inf), (3, -1, -2, -729, math.nan)]),
    ("SELECT id, i ^ id, 2 ^ id FROM odd", None, [(1, 40, 2), (2, None, 4), (3, -729, 8), (4, 1, 16)]),
    # joins
    ("SELECT b.code, g.nick FROM beds b JOIN gardeners g ON b.keeper = g.no WHERE b.metres > 3", ["code", "nick"], [("A1", "Ivo"), ("A2", "Ivo")]),
    ("SELECT b.code, g.no FROM beds b LEFT JOIN gardeners g ON b.keeper = g.no", None, [("A1", 11), ("A2", 11), ("B1", 12), ("C7", None)]),
    ("SELECT b.code, g.no FROM beds b RIGHT JOIN gardeners g ON b.keeper = g.no", None, [("A1", 11), ("A2", 11), ("B1", 12), (None, 13), (None, 14)]),
    ("SELECT g.no, b.code FROM gardeners g CROSS JOIN beds b WHERE g.no = 14", None, [(14, "A1"), (14, "A2"), (14, "B1"), (14, "C7")]),
    ("SELECT a.no, b.no FROM gardeners a, gardeners b WHERE a.born < b.born", None, [(11, 12), (11, 14), (12, 14)]),
    ("SELECT y.id, g.nick FROM yields y JOIN beds b ON y.bed = b.code JOIN gardeners g ON b.keeper = g.no AND g.nick = 'Mara'", None, [(4, "Mara"), (5, "Mara")]),
    ("SELECT g.no FROM gardeners g JOIN beds b ON FALSE", ["no"], []),
    # aggregates
    ("SELECT MIN(b), MAX(b), SUM(b), COUNT(b), AVG(b) FROM odd", None, [(None, None, None, 2, None)]),
    ("SELECT MIN(i), MAX(i), SUM(i), COUNT(i), AVG(i) FROM odd WHERE i IS NOT NULL", None, [(-9, 40, 32, 3, 10)]),
    ("SELECT MIN(s), MAX(s), SUM(s), COUNT(*) FROM odd WHERE s IS NOT NULL", None, [("ZZ", "Ü", None, 3)]),
    ("SELECT MIN(id), SUM(id), COUNT(id), AVG(id) FROM yields WHERE FALSE", None, [(None, None, 0, None)]),
    ("SELECT COUNT(*) FROM yields WHERE FALSE GROUP BY id", None, []),
    ("SELECT COUNT(*), SUM(8), AVG(9)", None, [(1, 8, 9)]),
    ("SELECT bed, MAX(week) AS last FROM yields GROUP BY bed HAVING last > 30 ORDER BY last DESC, bed", ["bed", "last"], [("B1", 45), ("A1", 31)]),
    ("SELECT week / 10 AS k, COUNT(*) FROM yields GROUP BY k ORDER BY k", ["k", "?"], [(2, 4), (3, 1), (4, 2)]),
    ("SELECT yields.bed, SUM(week * 2) / COUNT(*) + MIN(id) FROM yields GROUP BY bed", None, [("A1", 51), ("A2", 51), ("B1", 93)]),
    ("SELECT plant FROM yields GROUP BY plant", None, [("beet",), ("kale",), ("leek",), ("pea",)]),
    ("SELECT MAX(week) FROM yields GROUP BY bed ORDER BY MIN(week)", None, [(31,), (24,), (45,)]),
    ("SELECT plant FROM yields GROUP BY plant HAVING MIN(kilos) * 2 > 2", None, [("beet",)]),
    ("SELECT id * 3 AS d FROM yields HAVING d > 16", ["d"], [(18,), (21,)]),
    ("SELECT b.shady, COUNT(*) FROM yields y JOIN beds b ON y.bed = b.code GROUP BY b.shady HAVING COUNT(*) > 2", None, [(False, 3)]),
    # order, limit, offset
    ("SELECT i FROM odd ORDER BY i", None, [(None,), (-9,), (1,), (40,)]),
    ("SELECT s FROM odd ORDER BY s DESC", None, [("Ü",), ("m",), ("ZZ",), (None,)]),
    ("SELECT b FROM odd ORDER BY b, id", None, [(None,), (None,), (False,), (True,)]),
    ("SELECT plant FROM yields ORDER BY week DESC, id LIMIT 2 OFFSET 1", None, [("kale",), ("leek",)]),
    ("SELECT id FROM yields ORDER BY id LIMIT 2 + 1", None, [(1,), (2,), (3,)]),
    ("SELECT id FROM yields LIMIT 0", None, []),
    ("SELECT no FROM gardeners LIMIT 9223372036854775807", None, [(11,), (12,), (13,), (14,)]),
    ("SELECT no FROM gardeners OFFSET 9223372036854775807", None, []),
]


def plain(rows):
    return [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]


@pytest.mark.parametrize(("sql", "labels", "rows"), CASES, ids=[c[0][:60] for c in CASES])
def test_rows(garden, sql, labels, rows):
    result = garden.execute(sql)
    got, want = plain(result.rows()), plain(rows)
    if "ORDER BY" not in sql:
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert got == want
    if labels:
        assert result.labels == labels


ERRORS = [
    ("SELECT *", "Can't select * without a table"),
    ("SELECT nope FROM yields", "Unknown field nope"),
    ("SELECT yields.nope FROM yields", "Unknown field yields.nope"),
    ("SELECT x.id FROM yields", "Unknown table x"),
    ("SELECT yields.id FROM yields y", "Unknown table yields"),
    ("SELECT id FROM yields y, odd o", "Ambiguous field id"),
    ("SELECT y.id FROM yields y JOIN beds y ON TRUE", "Duplicate table name y"),
    ("SELECT * FROM beds, beds", "Duplicate table name beds"),
    ("SELECT * FROM nope", "Table nope does not exist"),
    ("SELECT id AS x FROM yields WHERE x = 1", "Unknown field x"),
    ("SELECT * FROM yields WHERE 7", "Filter returned 7, expected boolean"),
    ("SELECT * FROM yields y JOIN beds b ON 1", "Join predicate returned 1, expected boolean"),
    ("SELECT MAX(MIN(id)) FROM yields", "Aggregate functions can't be nested"),
    ("SELECT bed, MAX(id) FROM yields", "Unknown field bed"),
    ("SELECT week * 2 + 1, MAX(id) FROM yields GROUP BY week * 2", "Unknown field week"),
    ("SELECT MAX(kilos) AS m FROM yields GROUP BY bed HAVING MIN(m) > 1", "Aggregate function cannot reference aggregate"),
    ("SELECT bed FROM yields GROUP BY unknown", "Unknown field unknown"),
    ("SELECT id FROM yields ORDER BY unknown", "Unknown field unknown"),
    ("SELECT id FROM yields LIMIT -1", "Invalid limit -1"),
    ("SELECT id FROM yields LIMIT 1.5", "Invalid limit 1.5"),
    ("SELECT id FROM yields LIMIT NULL", "Invalid limit NULL"),
    ("SELECT id FROM yields LIMIT TRUE", "Invalid limit TRUE"),
    ("SELECT id FROM yields LIMIT 'a'", "Invalid limit a"),
    ("SELECT id FROM yields LIMIT week", "Expression must be constant, found field week"),
    ("SELECT id FROM yields OFFSET -1", "Invalid offset -1"),
    ("SELECT id", "Expression must be constant, found field id"),
    ("SELECT upper(plant) FROM yields", "Unknown function upper"),
    ("SELECT * FROM yields WHERE plant = 1", "Can't compare STRING and 1"),
]


@pytest.mark.parametrize(("sql", "text"), ERRORS, ids=[e[0][:60] for e in ERRORS])
def test_errors(garden, sql, text):
    with pytest.raises(EngineError) as e:
        garden.execute(sql)
    assert str(e.value) == text


@pytest.mark.parametrize(("sql", "text"), [("SELECT 1 / (id - id) FROM yields", "Can't divide by zero"), ("SELECT (id - 9)! FROM yields", "Can't take factorial of negative number"), ("SELECT id + 9223372036854775807 FROM yields", "Integer overflow"), ("SELECT (week * 1000) ^ week FROM yields", "Integer overflow"), ("SELECT week ^ (id - 8) FROM yields", "Integer power with negative exponent")])
def test_errors_of_rows(garden, sql, text):
    result = garden.execute(sql)
    with pytest.raises(EngineError) as e:
        result.rows()
    assert str(e.value) == text


def test_explain(garden):
    text = garden.execute("EXPLAIN SELECT plant FROM yields y JOIN beds b ON y.bed = b.code WHERE week > 1 ORDER BY plant LIMIT 1").text
    assert text.splitlines()[:2] == ["Projection: plant", "└─ Limit: 1"] and "HashJoin: inner on y.bed = b.code" in text
    assert garden.execute("EXPLAIN SELECT * FROM yields WHERE id = 1 OR id = 2").text == "KeyLookup: yields (1, 2)"
    assert garden.execute("EXPLAIN SELECT * FROM beds WHERE keeper = 12").text == "IndexLookup: beds column keeper (12)"


def test_plan_is_pushed_down(garden):
    """Filters and the columns in use reach the Parquet scan."""
    df = garden.execute("SELECT plant FROM yields WHERE week > 30").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(week,30)" in plan and "ReadSchema: struct<plant:string,week:bigint>" in plan
