"""Tables, constraints, changes and transactions."""

import pytest

from millrace.errors import EngineError, ReadOnlyError, SerializationError, ValueError_
from millrace.session import Engine, Session


def ask(s, sql):
    return sorted(s.execute(sql).rows(), key=repr)


def fails(s, sql, text):
    with pytest.raises(EngineError) as e:
        s.execute(sql)
    assert str(e.value) == text


DEFINITIONS = [
    ("CREATE TABLE t (id INTEGER)", "No primary key in table t"),
    ("CREATE TABLE t (a INTEGER PRIMARY KEY, b INTEGER PRIMARY KEY)", "Multiple primary keys in table t"),
    ("CREATE TABLE t (id INTEGER PRIMARY KEY NULL)", "Primary key id cannot be nullable"),
    ("CREATE TABLE t (id INTEGER PRIMARY KEY, f FLOAT DEFAULT 1)", "Default value for column f has datatype INTEGER, must be FLOAT"),
    ("CREATE TABLE t (id INTEGER PRIMARY KEY, f FLOAT NOT NULL DEFAULT NULL)", "Can't use NULL as default value for non-nullable column f"),
    ("CREATE TABLE t (id INTEGER PRIMARY KEY, x INTEGER REFERENCES nope)", "Table nope referenced by column x does not exist"),
    ("CREATE TABLE t (id INTEGER PRIMARY KEY, x STRING REFERENCES t)", "Can't reference INTEGER primary key of table t from STRING column x"),
]


@pytest.mark.parametrize(("sql", "text"), DEFINITIONS)
def test_definitions(session, sql, text):
    fails(session, sql, text)


def test_create_and_drop(session):
    session.execute('CREATE TABLE "Käse" (id INTEGER PRIMARY KEY, "select" STRING DEFAULT \'x\' UNIQUE, f FLOAT DEFAULT 1.5 + 1.5 INDEX)')
    assert session.get_table("Käse").ddl() == 'CREATE TABLE "Käse" (\n  id INTEGER PRIMARY KEY,\n  "select" STRING DEFAULT x UNIQUE,\n  f FLOAT DEFAULT 3 INDEX\n)'
    fails(session, 'CREATE TABLE "Käse" (id INTEGER PRIMARY KEY)', "Table Käse already exists")
    session.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, b INTEGER REFERENCES a)")
    session.execute("CREATE TABLE c (id INTEGER PRIMARY KEY, a_id INTEGER REFERENCES a)")
    assert session.list_tables() == ["Käse", "a", "c"]
    fails(session, "DROP TABLE a", "Cannot delete table a because it is referenced by table c column a_id")
    session.execute("DROP TABLE c")
    session.execute("DROP TABLE a")
    fails(session, "DROP TABLE a", "Table a does not exist")


def test_insert(session):
    session.execute("CREATE TABLE o (id STRING PRIMARY KEY)")
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY DEFAULT 0, s STRING UNIQUE, f FLOAT NOT NULL DEFAULT 2.0, o STRING REFERENCES o, me INTEGER REFERENCES t)")
    session.execute("INSERT INTO o VALUES ('x')")
    assert session.execute("INSERT INTO t (s, id) VALUES ('a', 1), (NULL, 2), (NULL, 1 + 2)").count == 3
    session.execute("INSERT INTO t VALUES (4, 'b', NAN, 'x', 4), (5, 'c', 1.0, NULL, 4)")
    for sql, text in (
        ("INSERT INTO t VALUES (1)", "Primary key 1 already exists for table t"),
        ("INSERT INTO t VALUES (7), (7)", "Primary key 7 already exists for table t"),
        ("INSERT INTO t VALUES (7, 'a')", "Unique value a already exists for column s"),
        ("INSERT INTO t VALUES (7, 'q'), (8, 'q')", "Unique value q already exists for column s"),
        ("INSERT INTO t VALUES (7, 'q', NULL)", "NULL value not allowed for column f"),
        ("INSERT INTO t VALUES (7, 'q', 1)", "Invalid datatype INTEGER for FLOAT column f"),
        ("INSERT INTO t VALUES (7, 'q', 1.0, 'y')", "Referenced primary key y in table o does not exist"),
        ("INSERT INTO t VALUES (7, 'q', 1.0, 'x', 8), (8, 'r', 1.0, 'x', 8)", "Referenced primary key 8 in table t does not exist"),
        ("INSERT INTO t VALUES (7, 'q', 1.0, 'x', 7, 9)", "Row has 6 columns, expected 5"),
        ("INSERT INTO t (id, s) VALUES (7)", "Column and value counts do not match"),
        ("INSERT INTO t (id, id) VALUES (7, 8)", "Column id given multiple times"),
        ("INSERT INTO t (nope) VALUES (7)", "Column nope does not exist in table t"),
        ("INSERT INTO nope VALUES (7)", "Table nope does not exist"),
        ("INSERT INTO t VALUES (7, '" + "ü" * 513 + "')", "Strings cannot be more than 1024 bytes"),
    ):
        fails(session, sql, text)
    session.execute("INSERT INTO t VALUES (8, '" + "ü" * 512 + "', 1.0, 'x', 8), (9, NULL, 1.0, 'x', 8)")
    assert [r[0] for r in ask(session, "SELECT id FROM t")] == [1, 2, 3, 4, 5, 8, 9]


def test_float_keys(session):
    session.execute("CREATE TABLE t (id FLOAT PRIMARY KEY)")
    session.execute("INSERT INTO t VALUES (NAN), (INFINITY), (-INFINITY), (0.5)")
    fails(session, "INSERT INTO t VALUES (NAN)", "Primary key NaN already exists for table t")
    fails(session, "INSERT INTO t VALUES (INFINITY)", "Primary key inf already exists for table t")


def test_update(session):
    session.execute("CREATE TABLE r (id INTEGER PRIMARY KEY)")
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, u INTEGER UNIQUE, r INTEGER REFERENCES r, s STRING NOT NULL)")
    session.execute("INSERT INTO r VALUES (1), (2), (3)")
    session.execute("INSERT INTO t VALUES (1, 10, 1, 'a'), (2, 20, 2, 'b'), (3, NULL, NULL, 'c')")
    assert session.execute("UPDATE t SET s = 'z', u = id WHERE id > 1").count == 2
    assert session.execute("UPDATE t SET s = 'q' WHERE FALSE").count == 0
    assert ask(session, "SELECT * FROM t") == [(1, 10, 1, "a"), (2, 2, 2, "z"), (3, 3, None, "z")]
    for sql, text in (
        ("UPDATE t SET id = id + 1", "Primary key 2 already exists for table t"),
        ("UPDATE t SET id = 7", "Primary key 7 already exists for table t"),
        ("UPDATE t SET u = 10 WHERE id = 2", "Unique value 10 already exists for column u"),
        ("UPDATE t SET s = NULL", "NULL value not allowed for column s"),
        ("UPDATE t SET s = 1", "Invalid datatype INTEGER for STRING column s"),
        ("UPDATE t SET r = 9 WHERE id = 1", "Referenced primary key 9 in table r does not exist"),
        ("UPDATE r SET id = 9 WHERE id = 1", "Cannot delete row 1 from table r because it is referenced by column r in table t"),
        ("UPDATE t SET nope = 1", "Column nope does not exist in table t"),
        ("UPDATE t SET s = 'a' WHERE nope", "Unknown field nope"),
        ("UPDATE t SET s = 'a' WHERE 1", "Filter returned 1, expected boolean"),
    ):
        fails(session, sql, text)
    assert session.execute("UPDATE t SET id = id - 10").count == 3
    session.execute("UPDATE r SET id = 9 WHERE id = 3")
    session.execute("UPDATE t SET u = NULL")
    assert ask(session, "SELECT id, u FROM t") == [(-7, None), (-8, None), (-9, None)]
    assert ask(session, "SELECT id FROM r") == [(1,), (2,), (9,)]


def test_update_of_self_reference(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, me INTEGER REFERENCES t)")
    session.execute("INSERT INTO t VALUES (1, 1), (2, 1), (3, 3), (4, NULL)")
    fails(session, "UPDATE t SET id = 9 WHERE id = 3", "Referenced primary key 3 in table t does not exist")
    fails(session, "UPDATE t SET id = 9 WHERE id = 1", "Cannot delete row 1 from table t because it is referenced by column me in table t")
    session.execute("UPDATE t SET id = 9 WHERE id = 4")
    session.execute("UPDATE t SET me = 9 WHERE id = 3")
    assert ask(session, "SELECT * FROM t") == [(1, 1), (2, 1), (3, 9), (9, None)]


def test_delete(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, me INTEGER REFERENCES t)")
    session.execute("INSERT INTO t VALUES (1, 1), (2, 1), (3, 3), (4, NULL)")
    fails(session, "DELETE FROM t", "Cannot delete row 1 from table t because it is referenced by column me in table t")
    fails(session, "DELETE FROM t WHERE id = 1", "Cannot delete row 1 from table t because it is referenced by column me in table t")
    assert session.execute("DELETE FROM t WHERE id > 2").count == 2
    assert session.execute("DELETE FROM t WHERE me IS NULL").count == 0
    session.execute("DELETE FROM t WHERE id = 2")
    assert session.execute("DELETE FROM t").count == 1


def test_indexes(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s STRING INDEX)")
    session.execute("INSERT INTO t VALUES (1, 'b'), (2, 'a'), (3, 'b'), (4, NULL)")
    with session.with_txn() as txn:
        assert [tuple(r) for r in txn.scan_index("t", "s").collect()] == [(None, [4]), ("a", [2]), ("b", [1, 3])]
        assert [r[0] for r in txn.read_index("t", "s", "b").collect()] == [1, 3]
        assert [r[0] for r in txn.read_index("t", "s", None).collect()] == [4]
        assert [r[0] for r in txn.lookup("t", [2, 9]).select("id").collect()] == [2]
        with pytest.raises(ValueError_, match="is not indexed"):
            txn.scan_index("t", "id")


def test_load(session, spark):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, me INTEGER REFERENCES t, s STRING UNIQUE)")
    session.execute("BEGIN")
    assert session.txn.load("t", spark.sql("SELECT id, id % 10 AS me, concat('n', id) AS s FROM range(1000)")) == 1000
    for sql, text in (("SELECT 5L id, 1L me, 'x' s", "Primary key 5"), ("SELECT 5000L id, 7777L me, 'x' s", "Referenced primary key 7777"), ("SELECT 5000L id, 1L me, 'n3' s", "Unique value n3")):
        with pytest.raises(ValueError_, match=text):
            session.txn.load("t", spark.sql(sql))
    session.execute("COMMIT")
    assert ask(session, "SELECT COUNT(*) FROM t") == [(1000,)]


def test_inserts_append(session, monkeypatch):
    """An INSERT writes its own rows only; parts become one when there are many."""
    import millrace.session as module

    monkeypatch.setattr(module, "MOST_PARTS", 3)
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    sizes = []
    for i in range(5):
        session.execute(f"INSERT INTO t VALUES ({i})")
        sizes.append(len(session.engine.at("t", session.engine.seq)["paths"]))
    assert sizes == [1, 2, 3, 1, 2] and ask(session, "SELECT id FROM t") == [(i,) for i in range(5)]
    a, b = Session(session.engine), Session(session.engine)
    for x in (a, b):
        x.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (10)")
    b.execute("INSERT INTO t VALUES (11)")
    a.execute("COMMIT")
    b.execute("COMMIT")
    assert [r[0] for r in ask(session, "SELECT id FROM t WHERE id > 4")] == [10, 11]


def test_changes_leave_other_parts(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, u INTEGER UNIQUE)")
    for i in range(3):
        session.execute(f"INSERT INTO t VALUES ({i}, {i})")
    before = session.engine.at("t", session.engine.seq)["paths"]
    session.execute("UPDATE t SET u = 9 WHERE id = 1")
    paths = session.engine.at("t", session.engine.seq)["paths"]
    assert paths[:2] == [before[0], before[2]] and len(paths) == 3
    fails(session, "UPDATE t SET u = 2 WHERE id = 1", "Unique value 2 already exists for column u")
    fails(session, "UPDATE t SET id = 0 WHERE id = 2", "Primary key 0 already exists for table t")
    session.execute("DELETE FROM t WHERE id = 0")
    assert before[2] in session.engine.at("t", session.engine.seq)["paths"] and ask(session, "SELECT * FROM t") == [(1, 9), (2, 2)]


def test_statements_sent_again(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)", sequence=1)
    assert session.execute("INSERT INTO t VALUES (1)", sequence=2) is session.execute("INSERT INTO t VALUES (1)", sequence=2)
    fails_with = pytest.raises(ValueError_, match="is older than")
    with fails_with:
        session.execute("INSERT INTO t VALUES (2)", sequence=1)


def test_transactions(session):
    fails(session, "COMMIT", "Not in a transaction")
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")  # transaction 1
    session.execute("INSERT INTO t VALUES (1, 1), (2, 2)")  # transaction 2
    begun = session.execute("BEGIN")
    fails(session, "BEGIN", "Already in a transaction")
    session.execute("UPDATE t SET v = 9 WHERE id = 1")
    other = Session(session.engine)
    assert ask(other, "SELECT v FROM t") == [(1,), (2,)]  # no dirty read
    assert ask(session, "SELECT v FROM t") == [(2,), (9,)]
    session.execute("ROLLBACK")
    assert ask(session, "SELECT v FROM t") == [(1,), (2,)]
    session.execute("DELETE FROM t WHERE id = 1")
    session.execute(f"BEGIN READ ONLY AS OF SYSTEM TIME {begun.version}")
    assert ask(session, "SELECT id FROM t") == [(1,), (2,)]
    with pytest.raises(ReadOnlyError):
        session.execute("DELETE FROM t")
    session.execute("COMMIT")
    fails(session, "BEGIN READ ONLY AS OF SYSTEM TIME 999", "Snapshot not found for version 999")
    fails(session, "BEGIN AS OF SYSTEM TIME 1", "Cannot specify version for read-write transactions")


def test_conflicts(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    session.execute("INSERT INTO t VALUES (1, 1), (2, 2), (3, 3)")
    a, b = Session(session.engine), Session(session.engine)
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("UPDATE t SET v = 10 WHERE id = 1")
    with pytest.raises(SerializationError):  # dirty write
        b.execute("UPDATE t SET v = 11 WHERE id = 1")
    b.execute("UPDATE t SET v = 20 WHERE id = 2")  # another key
    a.execute("COMMIT")
    with pytest.raises(SerializationError):  # lost update
        b.execute("UPDATE t SET v = 12 WHERE id = 1")
    assert ask(b, "SELECT v FROM t") == [(1,), (20,), (3,)]  # repeatable read
    b.execute("COMMIT")  # merges
    assert ask(session, "SELECT v FROM t") == [(10,), (20,), (3,)]


def test_write_skew(spark, tmp_path):
    for strict in (False, True):
        e = Engine(spark, str(tmp_path / f"db{strict}"), serializable=strict)
        s, a, b = Session(e), Session(e), Session(e)
        s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
        s.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
        for x, key in ((a, 1), (b, 2)):
            x.execute("BEGIN")
            x.execute("SELECT * FROM t").rows()
            x.execute(f"UPDATE t SET v = 0 WHERE id = {key}")
        a.execute("COMMIT")
        if strict:
            with pytest.raises(SerializationError):
                b.execute("COMMIT")
            b.execute("ROLLBACK")
        else:
            b.execute("COMMIT")


def test_reopened(spark, tmp_path):
    s = Engine(spark, str(tmp_path / "db")).session()
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, f FLOAT DEFAULT NAN)")
    s.execute("INSERT INTO t (id) VALUES (1)")
    s.engine.set_metadata("k", "v")
    again = Engine(spark, str(tmp_path / "db"))
    assert ask(again.session(), "SELECT id, f != f FROM t") == [(1, True)]
    assert again.get_metadata("k") == "v" and again.status()["tables"] == ["t"] and again.next == s.engine.next + 1
    with pytest.raises(ValueError_):
        again.resume(99)


def test_two_engines_on_one_root(spark, tmp_path):
    """Both commits stay; writers of one row conflict; numbers and values go to whoever comes later."""
    root = str(tmp_path / "db")
    a, b = Engine(spark, root).session(), Engine(spark, root).session()
    a.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    a.execute("INSERT INTO t VALUES (1, 1)")
    b.execute("INSERT INTO t VALUES (7, 7)")
    assert ask(a, "SELECT id FROM t") == ask(b, "SELECT id FROM t") == [(1,), (7,)]
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (2, 2)")
    b.execute("INSERT INTO t VALUES (3, 3)")
    a.execute("COMMIT")
    b.execute("COMMIT")
    assert [r[0] for r in ask(a, "SELECT id FROM t")] == [1, 2, 3, 7]
    for x in (a, b):
        x.execute("BEGIN")
    a.execute("UPDATE t SET v = 10 WHERE id = 1")
    b.execute("UPDATE t SET v = 11 WHERE id = 1")
    a.execute("COMMIT")
    with pytest.raises(SerializationError):
        b.execute("COMMIT")
    b.execute("ROLLBACK")
    assert ask(b, "SELECT v FROM t WHERE id = 1") == [(10,)]
    a.engine.set_metadata("k", "v")
    assert b.engine.get_metadata("k") == "v"


def test_manifests_stay_small(session):
    """Reading writes nothing, and old manifests go."""
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    before = session.engine.number
    for _ in range(20):
        session.execute("SELECT id FROM t")
    assert session.engine.number == before and len(session.engine.snapshots) <= 2
    for i in range(14):
        session.engine.set_metadata("k", str(i))
    assert len(session.engine.store._numbers()) <= 11


def test_vacuum(session):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    session.execute("INSERT INTO t VALUES (1), (2)")
    session.engine.store.write(session.engine.spark.range(3).selectExpr("id"), "t")  # left by whoever died
    assert session.engine.vacuum() == 1 and session.engine.vacuum() == 0 and ask(session, "SELECT id FROM t") == [(1,), (2,)]


def test_parts_have_the_columns_of_the_table_only(session, spark):
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    session.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    session.execute("UPDATE t SET v = 5 WHERE id = 1")
    paths = session.engine.at("t", session.engine.seq)["paths"]
    assert spark.read.parquet(*[f"{session.engine.store.root}/{p}" for p in paths]).columns == ["id", "v"]
