"""Named queries, one or more for each operator, with the SQL that says the same to DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.results import Query
from millrace.session import Engine
from millrace.sources import external

#: Decimals of the columns in ROUNDED: sums of doubles depend on their order, powers on the library.
DIGITS = 2
ROUNDED = {"total_price", "mean", "sum_quantity", "inverse", "root", "rest", "third"}


def engine(spark: SparkSession, sf_dir: str | None = None) -> Engine:
    """An engine over a folder of Parquet tables; what it writes lies in the shared folder, if there is one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    root = f"{shared}/millrace-db/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="millrace-")
    return Engine(spark, root, external.folder(spark, sf_dir) if sf_dir else None)


#: Engines that only read, by application and folder: they needn't look at files' schemas again.
_READERS: dict[tuple[str, str], Engine] = {}


def reader(spark: SparkSession, sf_dir: str) -> Engine:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _READERS:
        _READERS[key] = engine(spark, sf_dir)
    return _READERS[key]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(n, DIGITS).alias(n) if t == "double" and n in ROUNDED else F.col(n) for n, t in df.dtypes])


def ask(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs statements of the dialect; the last one's rows are the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reads = all(s.startswith("SELECT") for s in statements)
        session = (reader if reads else engine)(spark, sf_dir).session()
        for s in statements:
            result = session.execute(s)
        assert isinstance(result, Query)
        return rounded(result.df.toDF(*result.labels))

    return run


READS: dict[str, tuple[str, str]] = {
    # Scans, projection, labels
    "scan_star": ("SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "scan_project_filter": ("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45"),
    "project_cols": ("SELECT o_orderkey, o_orderstatus FROM orders", "SELECT o_orderkey, o_orderstatus FROM orders"),
    "project_expr": ("SELECT l_orderkey, l_linenumber * 2 + 1 AS n, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 2 + 1 AS n, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "alias_labels": ("SELECT n_name AS country, n.n_regionkey region FROM nation AS n", "SELECT n_name AS country, CAST(n_regionkey AS BIGINT) AS region FROM nation"),
    "quoted_identifiers": ('SELECT doc_id, "text" FROM documents WHERE lang = \'de\'', "SELECT doc_id, \"text\" FROM documents WHERE lang = 'de'"),
    "timestamp_as_text": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < '1996-01-01'", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders WHERE CAST(o_orderdate AS VARCHAR) < '1996-01-01'"),
    "timestamp_fractions": ("SELECT event_id, ts FROM events WHERE ts >= '2024-01-10 12:30:00.5' AND ts < '2024-01-12'", "SELECT event_id, CAST(ts AS VARCHAR) AS ts FROM events WHERE CAST(ts AS VARCHAR) >= '2024-01-10 12:30:00.5' AND CAST(ts AS VARCHAR) < '2024-01-12'"),
    "timestamp_group": ("SELECT ts, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY ts", "SELECT CAST(ts AS VARCHAR) AS ts, count(*) AS n, max(event_id) AS last FROM events GROUP BY CAST(ts AS VARCHAR)"),
    "fromless_const": ("SELECT 1 + 2 * 3 AS a, 'x' AS b, TRUE AND NULL AS c, 7 / 2 AS d, 1.0 / 3 AS third", "SELECT CAST(7 AS BIGINT) AS a, 'x' AS b, CAST(NULL AS BOOLEAN) AS c, CAST(3 AS BIGINT) AS d, CAST(0.33 AS DOUBLE) AS third"),
    # Filters
    "filter_eq": ("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_range": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20"),
    "filter_and_or_not": ("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND (NOT (p_brand = 'Brand#1'))", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#1')"),
    "filter_not_equal": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F' AND o_orderpriority <> '1-URGENT'", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F' AND o_orderpriority <> '1-URGENT'"),
    "filter_null_false": ("SELECT r_name FROM region WHERE NULL", "SELECT r_name FROM region WHERE FALSE"),
    "filter_true": ("SELECT r_name FROM region WHERE TRUE", "SELECT r_name FROM region"),
    "filter_is_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL"),
    "filter_is_not_null": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "three_valued_logic": ("SELECT d.doc_id, l.toxic = 1 AND d.lang = 'en' AS both_true, l.toxic = 1 OR d.lang = 'en' AS either, NOT (l.toxic = 1) AS clean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, l.toxic = 1 AND d.lang = 'en' AS both_true, l.toxic = 1 OR d.lang = 'en' AS either, NOT (l.toxic = 1) AS clean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    # LIKE
    "like_prefix": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'P%'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'P%'"),
    "like_underscore": ("SELECT n_name FROM nation WHERE n_name LIKE '_ATION%' AND n_name LIKE '%2_'", "SELECT n_name FROM nation WHERE n_name LIKE '_ATION%' AND n_name LIKE '%2_'"),
    "like_escaped": ("SELECT '50%' LIKE '50%%' AS percent, 'a_c' LIKE 'a__c' AS under, 'abc' LIKE 'a__c' AS plain, 'aXc' LIKE 'a_c' AS one", "SELECT TRUE AS percent, TRUE AS under, FALSE AS plain, TRUE AS one"),
    "like_column": ("SELECT c_custkey FROM customer WHERE c_name LIKE c_name AND c_mktsegment LIKE '%ING'", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%ING'"),
    # Scalar operators
    "int_arith": ("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS b, o_custkey * 3 AS c FROM orders", "SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS b, o_custkey * 3 AS c FROM orders"),
    "int_div_trunc": ("SELECT o_orderkey, o_orderkey / 7 AS q, (o_orderkey - 500) / 7 AS s FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, CAST(trunc((o_orderkey - 500) / 7.0) AS BIGINT) AS s FROM orders"),
    "int_mod_sign": ("SELECT o_orderkey, (o_orderkey - 500) % 7 AS m FROM orders", "SELECT o_orderkey, (o_orderkey - 500) % 7 AS m FROM orders"),
    "float_div_zero": ("SELECT s_suppkey, s_acctbal / 0 AS a, (s_acctbal - s_acctbal) / 0 AS b FROM supplier", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'inf'::DOUBLE WHEN s_acctbal < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS a, 'nan'::DOUBLE AS b FROM supplier"),
    "float_mod": ("SELECT s_suppkey, s_acctbal % 7 AS rest FROM supplier", "SELECT s_suppkey, round(s_acctbal - 7 * trunc(s_acctbal / 7), 2) AS rest FROM supplier"),
    "int_power": ("SELECT p_partkey, p_size ^ 3 AS cube, 2 ^ 10 AS k, p_size ^ 0 AS one FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * p_size AS cube, CAST(1024 AS BIGINT) AS k, CAST(1 AS BIGINT) AS one FROM part"),
    "float_power": ("SELECT p_partkey, p_size ^ -1 AS inverse, p_size ^ 0.5 AS root FROM part", "SELECT p_partkey, round(1.0 / p_size, 2) AS inverse, round(sqrt(p_size), 2) AS root FROM part"),
    "factorial": ("SELECT n_nationkey, (n_nationkey % 10)! AS f FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(factorial(n_nationkey % 10) AS BIGINT) AS f FROM nation"),
    "unary_minus_plus": ("SELECT n_nationkey, -n_nationkey AS m, +n_nationkey AS p FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(-n_nationkey AS BIGINT) AS m, CAST(n_nationkey AS BIGINT) AS p FROM nation"),
    "bool_compare": ("SELECT n_nationkey, (n_nationkey > 10) > (n_regionkey > 2) AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, (n_nationkey > 10) > (n_regionkey > 2) AS b FROM nation"),
    "mixed_numeric_compare": ("SELECT p_partkey FROM part WHERE p_size * 30 > p_retailprice", "SELECT p_partkey FROM part WHERE p_size * 30 > p_retailprice"),
    "nan_compare": ("SELECT s_suppkey, s_acctbal > NAN AS a, NAN = NAN AS b, s_acctbal != NAN AS c, INFINITY > s_acctbal AS d FROM supplier", "SELECT s_suppkey, FALSE AS a, FALSE AS b, TRUE AS c, TRUE AS d FROM supplier"),
    "precedence_not": ("SELECT -2 ^ 2 AS a, 2 ^ 3 ^ 2 AS b, NOT TRUE = FALSE AS c, 2 + 3 * 4 % 5 AS d", "SELECT CAST(4 AS BIGINT) AS a, CAST(512 AS BIGINT) AS b, TRUE AS c, CAST(4 AS BIGINT) AS d"),
    # Lookups
    "pk_lookup": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42"),
    "pk_lookup_in": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 1 OR c_custkey = 7 OR c_custkey = 999999999", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 7, 999999999)"),
    "index_lookup": ("SELECT o_orderkey FROM orders WHERE o_custkey = 3 OR o_custkey = 5", "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 5)"),
    # Joins
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_comma": ("SELECT r_name, n_name FROM region, nation", "SELECT r_name, n_name FROM region, nation"),
    "join_comma_where": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey"),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_inner_chain": ("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_inner_multi_key": ("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey"),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_on_true": ("SELECT r_name, n_name FROM region JOIN nation ON TRUE", "SELECT r_name, n_name FROM region, nation"),
    "join_on_false": ("SELECT r_name, n_name FROM region JOIN nation ON FALSE", "SELECT r_name, n_name FROM region, nation WHERE FALSE"),
    "join_theta": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey > n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey > n_nationkey"),
    "join_left": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "join_left_unmatched": ("SELECT d.doc_id FROM documents d LEFT OUTER JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1 WHERE l.doc_id IS NULL", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "join_right": ("SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id", "SELECT CAST(l.quality AS BIGINT) AS quality, d.doc_id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id"),
    "join_then_filter": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice > 100000.0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice > 100000.0"),
    # Aggregates
    "agg_global": ("SELECT COUNT(l_orderkey) AS n, MIN(l_quantity) AS low, MAX(l_quantity) AS high, SUM(l_linenumber) AS total, AVG(l_discount) AS mean FROM lineitem", "SELECT count(l_orderkey) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_discount), 2) AS mean FROM lineitem"),
    "agg_count_star": ("SELECT COUNT(*) AS n FROM events", "SELECT count(*) AS n FROM events"),
    "agg_count_nulls": ("SELECT COUNT(*) AS a, COUNT(l.toxic) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT count(*) AS a, count(l.toxic) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "agg_null_poison": ("SELECT MIN(l.toxic) AS a, MAX(l.toxic) AS b, SUM(l.toxic) AS c, AVG(l.toxic) AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS d"),
    "agg_null_poison_grouped": ("SELECT d.lang, SUM(l.toxic) AS s, COUNT(l.toxic) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, l.toxic", "SELECT d.lang, CAST(CASE WHEN count(l.toxic) = count(*) THEN sum(l.toxic) END AS BIGINT) AS s, count(l.toxic) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, l.toxic"),
    "agg_int_avg": ("SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) // count(*) AS BIGINT) AS a FROM part GROUP BY p_brand"),
    "agg_bool_minmax": ("SELECT MIN(p_size > 10) AS low, MAX(p_size > 10) AS high, SUM(p_size > 10) AS s FROM part", "SELECT min(p_size > 10) AS low, max(p_size > 10) AS high, CAST(NULL AS BOOLEAN) AS s FROM part"),
    "agg_string_minmax": ("SELECT MIN(c_name) AS low, MAX(c_name) AS high, AVG(c_name) AS a FROM customer", "SELECT min(c_name) AS low, max(c_name) AS high, CAST(NULL AS VARCHAR) AS a FROM customer"),
    "agg_empty": ("SELECT MIN(p_size) AS a, MAX(p_size) AS b, SUM(p_size) AS c, COUNT(p_size) AS d, AVG(p_size) AS e FROM part WHERE FALSE", "SELECT CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, CAST(NULL AS BIGINT) AS e"),
    "agg_empty_grouped": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE FALSE GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE FALSE GROUP BY p_brand"),
    "agg_const": ("SELECT COUNT(*) AS n, SUM(3) AS s, AVG(2.5) AS a", "SELECT CAST(1 AS BIGINT) AS n, CAST(3 AS BIGINT) AS s, CAST(2.5 AS DOUBLE) AS a"),
    "agg_expr": ("SELECT l_returnflag, SUM(l_linenumber * 10) / COUNT(*) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber * 10) // count(*) AS BIGINT) AS a FROM lineitem GROUP BY l_returnflag"),
    "group_col": ("SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS total_price FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY o_orderstatus"),
    "group_multi": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_quantity, MAX(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_quantity, max(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_expr": ("SELECT p_size % 10 AS k, COUNT(*) AS n FROM part GROUP BY p_size % 10", "SELECT CAST(p_size % 10 AS BIGINT) AS k, count(*) AS n FROM part GROUP BY p_size % 10"),
    "group_alias": ("SELECT p_size / 10 AS k, COUNT(*) AS n FROM part GROUP BY k", "SELECT CAST(p_size // 10 AS BIGINT) AS k, count(*) AS n FROM part GROUP BY p_size // 10"),
    "group_no_agg": ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", "SELECT DISTINCT c_mktsegment FROM customer"),
    "group_unselected": ("SELECT COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT count(*) AS n FROM customer GROUP BY c_nationkey"),
    "group_join": ("SELECT n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"),
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "having_agg_hidden": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 100000.0 AND COUNT(*) > 5", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 100000.0 AND count(*) > 5"),
    "having_key": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING c_nationkey > 10", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING c_nationkey > 10"),
    "having_no_group": ("SELECT n_nationkey * 2 AS d FROM nation HAVING d > 20", "SELECT CAST(n_nationkey AS BIGINT) * 2 AS d FROM nation WHERE n_nationkey * 2 > 20"),
    # Order, limit, offset
    "order_asc_desc": ("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey ASC, c_custkey DESC", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer ORDER BY 2, 1 DESC"),
    "order_hidden": ("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20", "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20"),
    "order_hidden_agg": ("SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 5", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 5"),
    "order_alias": ("SELECT p_partkey, p_size * 2 AS d FROM part ORDER BY d DESC, p_partkey LIMIT 10", "SELECT p_partkey, CAST(p_size AS BIGINT) * 2 AS d FROM part ORDER BY d DESC, p_partkey LIMIT 10"),
    "order_nulls": ("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic, d.doc_id LIMIT 30", "SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic NULLS FIRST, d.doc_id LIMIT 30"),
    "order_nulls_desc": ("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic DESC, d.doc_id LIMIT 30", "SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic DESC NULLS LAST, d.doc_id LIMIT 30"),
    "limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    "limit_expr": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 + 2 * 2", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5"),
    "limit_large": ("SELECT r_name FROM region LIMIT 9223372036854775807", "SELECT r_name FROM region"),
    "offset": ("SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20", "SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20"),
    "offset_large": ("SELECT n_name FROM nation OFFSET 9223372036854775807", "SELECT n_name FROM nation WHERE FALSE"),
    "limit_offset": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3"),
    "topk": ("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 10 OFFSET 5", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY lineitem.l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 10 OFFSET 5"),
}

CUSTOMER = "CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_name STRING NOT NULL, c_nationkey INTEGER INDEX, c_acctbal FLOAT)"


def stored(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Loads the customers into a table of the engine's own, then runs statements; the last one's rows come back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        session = e.session()
        session.execute("BEGIN")
        session.execute(CUSTOMER)
        session.txn.load("c", external.typed(spark.read.parquet(f"{sf_dir}/customer.parquet"))[0])
        session.execute("COMMIT")
        for s in statements:
            result = session.execute(s)
        return rounded(result.df.toDF(*result.labels))

    return run


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    txn = e.begin()
    session = e.session()
    session.txn = txn
    session.execute(CUSTOMER)
    txn.load("c", external.typed(spark.read.parquet(f"{sf_dir}/customer.parquet"))[0])
    found = txn.scan_index("c", "c_nationkey")
    txn.commit()
    return found.select("value", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


def answers(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs statements of the dialect one by one; a row for each: its number and what came of it, errors included."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session, rows = engine(spark, sf_dir).session(), []
        for i, s in enumerate(statements):
            try:
                result = session.execute(s)
                rows.append((i, f"{result.kind} {result.count}"))
            except EngineError as e:
                rows.append((i, str(e)))
        return spark.createDataFrame(rows, "step long, answer string")

    return run


def said(*answers: str) -> str:
    return "SELECT CAST(step AS BIGINT) AS step, answer FROM (VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(answers)) + ") x(step, answer)"


def conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions write one row: the first one wins, the other gets an error; another row is no conflict."""
    e = engine(spark, sf_dir)
    s, a, b = e.session(), e.session(), e.session()
    for q in (SMALL, FILL):
        s.execute(q)
    rows = []
    steps = ((a, "BEGIN"), (b, "BEGIN"), (a, "UPDATE t SET v = 0.0 WHERE id = 1"), (b, "UPDATE t SET v = 1.0 WHERE id = 1"), (b, "UPDATE t SET v = 2.0 WHERE id = 2"), (a, "COMMIT"), (b, "DELETE FROM t WHERE id = 1"), (b, "COMMIT"))
    for i, (x, q) in enumerate(steps):
        try:
            result = x.execute(q)
            rows.append((i, f"{result.kind} {result.count}"))
        except EngineError as error:
            rows.append((i, str(error)))
    rows += [(100 + r[0], str(r[1])) for r in s.execute("SELECT id, v FROM t").rows()]
    return spark.createDataFrame(rows, "step long, answer string")


BASE = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer"
ALL = "SELECT * FROM c"
SMALL = "CREATE TABLE t (id INTEGER PRIMARY KEY, name STRING DEFAULT 'none', v FLOAT DEFAULT 1.5, flag BOOLEAN)"
FILL = "INSERT INTO t VALUES (1, 'a', 2.5, TRUE), (2, 'b', 3.5, FALSE), (3, 'c', 4.5, NULL)"

WRITES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "load_table": (stored(ALL), BASE),
    "insert_values": (ask(SMALL, FILL, "SELECT * FROM t"), "SELECT CAST(id AS BIGINT) AS id, name, CAST(v AS DOUBLE) AS v, flag FROM (VALUES (1, 'a', 2.5, TRUE), (2, 'b', 3.5, FALSE), (3, 'c', 4.5, NULL)) x(id, name, v, flag)"),
    "insert_defaults": (ask(SMALL, "INSERT INTO t (id) VALUES (1 + 1), (3)", "INSERT INTO t VALUES (4, 'd')", "SELECT * FROM t"), "SELECT CAST(id AS BIGINT) AS id, name, CAST(v AS DOUBLE) AS v, CAST(NULL AS BOOLEAN) AS flag FROM (VALUES (2, 'none', 1.5), (3, 'none', 1.5), (4, 'd', 1.5)) x(id, name, v)"),
    "update_where": (stored("UPDATE c SET c_acctbal = c_acctbal * 2, c_nationkey = c_nationkey + 100 WHERE c_nationkey < 5", ALL), "SELECT c_custkey, c_name, CAST(CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS c_nationkey, CASE WHEN c_nationkey < 5 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "update_pk": (stored("UPDATE c SET c_custkey = -c_custkey - 1 WHERE c_nationkey = 3", ALL), "SELECT CASE WHEN c_nationkey = 3 THEN -c_custkey - 1 ELSE c_custkey END AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer"),
    "delete_where": (stored("DELETE FROM c WHERE c_acctbal < 0", ALL), BASE + " WHERE NOT (c_acctbal < 0)"),
    "delete_all": (stored("DELETE FROM c", "SELECT COUNT(*) AS n FROM c"), "SELECT CAST(0 AS BIGINT) AS n"),
    "index_lookup_managed": (stored("SELECT c_custkey, c_name FROM c WHERE c_nationkey = 3 OR c_nationkey = 7"), "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (3, 7)"),
    "index_after_write": (stored("UPDATE c SET c_nationkey = 3 WHERE c_nationkey = 7", "DELETE FROM c WHERE c_custkey < 20", "SELECT c_custkey FROM c WHERE c_nationkey = 3"), "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7) AND c_custkey >= 20"),
    "power_of_columns": (ask("SELECT n_nationkey, n_regionkey ^ n_nationkey AS p, (0 - n_regionkey) ^ n_regionkey AS q, (n_regionkey - 1) ^ (n_nationkey * 1000) AS r FROM nation WHERE n_regionkey < 3"), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey ** n_nationkey AS BIGINT) AS p, CAST((-n_regionkey) ** n_regionkey AS BIGINT) AS q, CAST((n_regionkey - 1) ** (n_nationkey * 1000) AS BIGINT) AS r FROM nation WHERE n_regionkey < 3"),
    "not_null": (answers("CREATE TABLE t (id INTEGER PRIMARY KEY, s STRING NOT NULL)", "INSERT INTO t VALUES (1, NULL)", "INSERT INTO t VALUES (1, 'a')", "UPDATE t SET s = NULL", "INSERT INTO t (id) VALUES (2)"), said("create_table 0", "NULL value not allowed for column s", "create 1", "NULL value not allowed for column s", "Column s not given and has no default value")),
    "unique": (answers("CREATE TABLE t (id INTEGER PRIMARY KEY, u INTEGER UNIQUE)", "INSERT INTO t VALUES (1, 5), (2, NULL), (3, NULL)", "INSERT INTO t VALUES (4, 5)", "UPDATE t SET u = 5 WHERE id = 2", "UPDATE t SET u = 6 WHERE id = 1", "INSERT INTO t VALUES (4, 5)", "INSERT INTO t VALUES (1, 9)"), said("create_table 0", "create 3", "Unique value 5 already exists for column u", "Unique value 5 already exists for column u", "update 1", "create 1", "Primary key 1 already exists for table t")),
    "foreign_key": (answers("CREATE TABLE a (id INTEGER PRIMARY KEY)", "CREATE TABLE b (id INTEGER PRIMARY KEY, a INTEGER REFERENCES a)", "INSERT INTO b VALUES (1, 7)", "INSERT INTO a VALUES (7), (8)", "INSERT INTO b VALUES (1, 7), (2, NULL)", "DELETE FROM a WHERE id = 7", "UPDATE b SET a = 9", "UPDATE a SET id = 9 WHERE id = 7", "DELETE FROM a WHERE id = 8", "UPDATE b SET a = NULL", "DELETE FROM a"), said("create_table 0", "create_table 0", "Referenced primary key 7 in table a does not exist", "create 2", "create 2", "Cannot delete row 7 from table a because it is referenced by column a in table b", "Referenced primary key 9 in table a does not exist", "Cannot delete row 7 from table a because it is referenced by column a in table b", "delete 1", "update 2", "delete 1")),
    "drop_table": (answers("CREATE TABLE a (id INTEGER PRIMARY KEY)", "CREATE TABLE b (id INTEGER PRIMARY KEY, a INTEGER REFERENCES a)", "DROP TABLE a", "DROP TABLE b", "DROP TABLE a", "SELECT * FROM a", "DROP TABLE a"), said("create_table 0", "create_table 0", "Cannot delete table a because it is referenced by table b column a", "drop_table 0", "drop_table 0", "Table a does not exist", "Table a does not exist")),
    "write_conflict": (conflict, "SELECT CAST(step AS BIGINT) AS step, answer FROM (VALUES (0, 'begin 0'), (1, 'begin 0'), (2, 'update 1'), (3, 'Serialization failure, retry transaction'), (4, 'update 1'), (5, 'commit 0'), (6, 'Serialization failure, retry transaction'), (7, 'commit 0'), (101, '0.0'), (102, '2.0'), (103, '4.5')) x(step, answer)"),
    "managed_lookup": (stored("SELECT c_name FROM c WHERE c_custkey = 5 OR c_custkey = 6"), "SELECT c_name FROM customer WHERE c_custkey IN (5, 6)"),
    "index_scan": (index_scan, "SELECT CAST(c_nationkey AS BIGINT) AS value, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS keys FROM customer GROUP BY c_nationkey"),
    "txn_commit": (stored("BEGIN", "DELETE FROM c WHERE c_custkey < 50", "UPDATE c SET c_nationkey = NULL WHERE c_custkey < 100", "COMMIT", ALL), "SELECT c_custkey, c_name, CAST(CASE WHEN c_custkey >= 100 THEN c_nationkey END AS BIGINT) AS c_nationkey, c_acctbal FROM customer WHERE c_custkey >= 50"),
    "txn_rollback": (stored("BEGIN", "DELETE FROM c", "ROLLBACK", ALL), BASE),
    "time_travel": (stored("DELETE FROM c WHERE c_custkey > 10", "BEGIN READ ONLY AS OF SYSTEM TIME 2", ALL), BASE),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: ask(v[0]) for k, v in READS.items()} | {k: v[0] for k, v in WRITES.items()}
SQL: dict[str, str] = {k: v[1] for k, v in READS.items()} | {k: v[1] for k, v in WRITES.items() if v[1]}
