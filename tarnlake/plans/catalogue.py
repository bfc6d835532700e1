"""Registered queries of the engine's own operators, each with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.functions.predicates import Expr, Op, and_, cmp, col, compile_value, const_int, const_str, not_, or_
from tarnlake.operators.relational import SortKey, filter_rows, first_per_key, index_entries, index_scan, lookup_many, merge_join, range_scan, row_count, sort_rows, with_rid
from tarnlake.plans import recovery
from tarnlake.schema import Schema, TypeId
from tarnlake.sources.catalog import Catalog
from tarnlake.sources.log import LogManager, RecordType
from tarnlake.sources.staging import materialize, shared_dir
from tarnlake.sources.transactions import TransactionManager

_NATIONS = Schema([("id", TypeId.INTEGER), ("name", TypeId.VARCHAR)])

Query = Callable[[SparkSession, str], DataFrame]


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scan_in_order(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A scan with ``_rid``, the insertion order."""
    return with_rid(scan(spark, sf_dir, table))


def ranked(df: DataFrame, keys: list[SortKey]) -> DataFrame:
    """A sorted result whose order shows in ``rank``: places within the sort's partitions, chained by their sizes.

    A row number over the whole table in one window would be a single task.  The sorted rows are
    staged once, because two evaluations of a range exchange need not cut alike.
    """
    place = F.monotonically_increasing_id()  # partition number, then the row's place in it
    staged = materialize(sort_rows(df, keys).withColumn("_id", place), "ranked")
    staged = staged.withColumn("_part", F.shiftright("_id", 33))
    sizes = staged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition of the sort
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.col("_id") - F.shiftleft("_part", 33) + 1
    return staged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(*df.columns, (F.col("_before") + row).cast("long").alias("rank"))


# -- the log that orders and line items stand for -------------------------------


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order begins a transaction, its line items are inserts, status F commits and P aborts."""
    orders, items = scan(spark, sf_dir, "orders"), scan(spark, sf_dir, "lineitem")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("l_partkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"))]

    def record(rows: DataFrame, kind: RecordType, id_col: str, table: str, payload: list) -> DataFrame:
        return rows.select(F.col(id_col).alias("txn_id"), F.lit(int(kind)).alias("type"), F.lit(table).alias("table_name"), *payload)

    begins = record(orders, RecordType.BEGIN, "o_orderkey", "", nothing)
    inserts = record(items, RecordType.INSERT, "l_orderkey", "lineitem", [F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity")])
    commits = record(orders.filter("o_orderstatus = 'F'"), RecordType.COMMIT, "o_orderkey", "", nothing)
    aborts = record(orders.filter("o_orderstatus = 'P'"), RecordType.ABORT, "o_orderkey", "", nothing)
    return begins.union(inserts).union(commits).union(aborts)


_LOG_SQL = """
WITH log AS (
  SELECT o_orderkey AS txn_id, 1 AS type, 0 AS ins FROM orders
  UNION ALL SELECT l_orderkey, 2, 1 FROM lineitem
  UNION ALL SELECT o_orderkey, 3, 0 FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 4, 0 FROM orders WHERE o_orderstatus = 'P'
), per AS (SELECT txn_id, count(*) AS n, max(CASE WHEN type = 3 THEN 1 ELSE 0 END) AS c, sum(ins) AS i FROM log GROUP BY txn_id)
SELECT CAST(sum(n) AS BIGINT) AS records_scanned, CAST(sum(c) AS BIGINT) AS txns_committed, CAST(sum(1 - c) AS BIGINT) AS txns_uncommitted,
  CAST({redone} AS BIGINT) AS inserts_redone, CAST(sum(i) - {redone} AS BIGINT) AS inserts_skipped FROM per
"""


# -- builders -----------------------------------------------------------------


def _filtered(table: str, predicate: Expr, semantics: str = "exact") -> Query:
    return lambda spark, sf_dir: filter_rows(scan(spark, sf_dir, table), predicate, semantics)


#: Ordinals of the columns that the queries below name.
ORDER = {"key": 0, "cust": 1, "status": 2, "price": 3}
CUST = {"key": 0, "name": 1, "nation": 2, "segment": 4}
EVENT = {"id": 0, "user": 2, "type": 3}

_CUSTKEY = col(ORDER["cust"])
_STATUS = col(ORDER["status"])
_INT_OPS = {"eq": Op.EQ, "ne": Op.NE, "lt": Op.LT, "le": Op.LE, "gt": Op.GT, "ge": Op.GE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large line items joined with finished orders of low customer numbers, sorted."""
    items = filter_rows(scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), cmp(col(2), Op.LE, const_int(3)))
    orders = filter_rows(scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), and_(cmp(col(1), Op.LT, const_int(100)), cmp(col(2), Op.EQ, const_str("F"))))
    return sort_rows(merge_join(items, orders, 0, 0), [SortKey(0), SortKey(2), SortKey(1, False)])


def _join_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    pairs = merge_join(items, items, 0, 0)
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum("r_l_linenumber").alias("numbers"))


def _join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = merge_join(scan(spark, sf_dir, "nation"), scan(spark, sf_dir, "region"), 2, 0)
    return merge_join(scan(spark, sf_dir, "customer"), nations, CUST["nation"], 0)


def _derived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.redo(derived_log(spark, sf_dir), ["lineitem"]).select("txn_id", "l_partkey", "l_linenumber", "l_quantity")


def _session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the session sees: inserts of all transactions, committed or not."""
    inserts = derived_log(spark, sf_dir).filter(F.col("type") == int(RecordType.INSERT))
    return inserts.groupBy("txn_id").agg(F.count("*").alias("rows"))


def _lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_in_order(spark, sf_dir, "events")
    keys = scan(spark, sf_dir, "customer").select("c_custkey")
    return lookup_many(rows, EVENT["user"], keys).select("event_id", "user_id", "event_type")


def _first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(scan_in_order(spark, sf_dir, "events"), EVENT["user"]).select("event_id", "user_id", "event_type")


def _index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = index_entries(scan_in_order(spark, sf_dir, "events"), EVENT["user"], F.col("event_id"))
    return entries.select(F.col("key").alias("user_id"), F.col("rid").alias("first_event"))


def _recovered(spark: SparkSession, sf_dir: str) -> str:
    """A catalog's folder after recovery: each region's nations were one transaction, and region 3's never committed."""
    root = shared_dir(spark, "catalog")
    log = LogManager(spark, f"{root}/log")
    lost = Catalog(spark, f"{root}/lost")
    lost.create_table("nations", _NATIONS)
    manager = TransactionManager(lost, log)
    rows = scan(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # a fixed, small table
    for region in sorted({r["n_regionkey"] for r in rows}):
        t = manager.begin()
        for r in rows:
            if r["n_regionkey"] == region:
                manager.insert(t, "nations", (r["n_nationkey"], r["n_name"]))
        if region != 3:
            log.append(t.id, RecordType.COMMIT)  # the crash comes before any row is published
    log.flush()
    again = Catalog(spark, f"{root}/data")
    again.create_table("nations", _NATIONS)
    recovery.recover(again, log.records())
    return f"{root}/data"


def _recover_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalog that is opened after recovery shows."""
    opened = Catalog(spark, _recovered(spark, sf_dir))
    opened.create_table("nations", _NATIONS)
    return opened.table("nations")


def _index_after_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups of all keys after recovery and later rows of the same keys: the recovered ones come first."""
    opened = Catalog(spark, _recovered(spark, sf_dir))
    opened.create_table("nations", _NATIONS)
    opened.create_index("by_key", "nations", "id")
    opened.append("nations", scan(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("later").alias("name")))
    return opened.lookup_many("by_key", scan(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")))


def _equal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of three joins whose columns share names, filtered and sorted by position."""
    nations = scan(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").alias("r_id"))
    once = merge_join(nations, scan(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")), 0, 0)  # id, r_id, r_id
    twice = merge_join(scan(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("r_r_id")), once, 0, 1)
    kept = filter_rows(twice, and_(cmp(col(4), Op.LT, const_int(3)), cmp(col(1), Op.NE, const_int(7))))
    return sort_rows(kept, [SortKey(4, False), SortKey(1)]).toDF("nation", "customer", "region", "nation_again", "region_again")


def _empty(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "seq_scan": lambda s, d: scan(s, d, "customer"),
    "count_rows": lambda s, d: row_count(scan(s, d, "lineitem")),
    **{f"filter_int_{k}": _filtered("orders", cmp(_CUSTKEY, op, const_int(70))) for k, op in _INT_OPS.items()},
    "filter_str_eq": _filtered("orders", cmp(_STATUS, Op.EQ, const_str("F"))),
    "filter_str_lt_exact": _filtered("orders", cmp(_STATUS, Op.LT, const_str("F"))),
    "filter_str_lt_sql": _filtered("orders", cmp(_STATUS, Op.LT, const_str("O")), "sql"),
    "filter_mixed_eq": _filtered("orders", cmp(_CUSTKEY, Op.EQ, _STATUS)),
    "filter_mixed_ne": _filtered("orders", cmp(_CUSTKEY, Op.GT, _STATUS)),
    "filter_and_or": _filtered("orders", or_(and_(cmp(_CUSTKEY, Op.LT, const_int(50)), cmp(_STATUS, Op.EQ, const_str("F"))), cmp(col(0), Op.GE, const_int(14000)))),
    "filter_not": _filtered("orders", not_(and_(cmp(_CUSTKEY, Op.LT, const_int(100)), cmp(_STATUS, Op.EQ, const_str("F"))))),
    "filter_cmp_of_cmp": _filtered("orders", cmp(cmp(_CUSTKEY, Op.LT, const_int(500)), Op.EQ, cmp(_STATUS, Op.EQ, const_str("F")))),
    "filter_truthy": _filtered("orders", _CUSTKEY),
    "filter_truthy_str": _filtered("orders", _STATUS),
    "filter_double": _filtered("lineitem", cmp(col(6), Op.GT, const_int(0))),
    "expression_value": lambda s, d: (lambda o: o.select("o_orderkey", compile_value(or_(cmp(_CUSTKEY, Op.LT, const_int(9)), cmp(_STATUS, Op.EQ, const_str("P"))), o).alias("truth")))(scan(s, d, "orders")),
    "index_hit": lambda s, d: index_scan(scan(s, d, "orders"), 0, 777),
    "index_miss": lambda s, d: index_scan(scan(s, d, "orders"), 0, -1),
    "index_duplicate_key": lambda s, d: index_scan(scan(s, d, "events"), EVENT["user"], 5),
    "index_first_wins": _first_wins,
    "index_build": _index_build,
    "index_lookup_many": _lookup_many,
    "range_scan": lambda s, d: range_scan(scan(s, d, "orders"), 0, 100, 900),
    "sort_multi": lambda s, d: ranked(scan(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [SortKey(2), SortKey(1, False), SortKey(0)]),
    "sort_desc": lambda s, d: ranked(scan(s, d, "customer").select("c_custkey", "c_name"), [SortKey(0, False)]),
    "sort_bytes": lambda s, d: ranked(scan(s, d, "pages").select("page_id", "url"), [SortKey(1), SortKey(0)]),
    "sort_top_k": lambda s, d: sort_rows(scan(s, d, "orders").select("o_orderkey", "o_custkey"), [SortKey(1, False), SortKey(0)]).limit(25),
    "join_1n": lambda s, d: merge_join(scan(s, d, "orders").select("o_orderkey", "o_custkey"), scan(s, d, "customer").select("c_custkey", "c_name"), 1, 0),
    "join_nm": _join_nm,
    "join_chain": _join_chain,
    "join_empty": lambda s, d: merge_join(_empty(scan(s, d, "orders").select("o_orderkey", "o_custkey")), scan(s, d, "customer").select("c_custkey", "c_name"), 1, 0),
    "join_varchar_key_exact": lambda s, d: merge_join(scan(s, d, "nation").select("n_name", "n_nationkey"), scan(s, d, "region").select("r_name"), 0, 0, "exact"),
    "filter_after_join": lambda s, d: filter_rows(_join_chain(s, d).select("c_custkey", "c_name", "r_n_name"), cmp(col(2), Op.EQ, const_str("NATION_7"))),
    "sort_after_join": lambda s, d: ranked(merge_join(scan(s, d, "customer").select("c_custkey", "c_nationkey"), scan(s, d, "nation").select("n_nationkey", "n_name"), 1, 0), [SortKey(3), SortKey(0)]),
    "recover_rows": _derived_rows,
    "recover_stats": lambda s, d: recovery.stats(derived_log(s, d), ["lineitem"]),
    "recover_missing_table": lambda s, d: recovery.stats(derived_log(s, d), ["accounts"]),
    "session_view": _session_view,
    "catalog_recover_reopen": _recover_reopen,
    "catalog_index_after_recovery": _index_after_recovery,
    "join_equal_names": _equal_names,
}

_RANGE = "CAST(row_number() OVER (ORDER BY {}) AS BIGINT) AS rank"
_CHAIN = """SELECT c.*, n_nationkey AS r_n_nationkey, n_name AS r_n_name, n_regionkey AS r_n_regionkey, r_regionkey AS r_r_r_regionkey, r_name AS r_r_r_name
FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_SQL_OPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}

ORACLES: dict[str, str] = {
    "flagship": """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_orderkey AS r_o_orderkey, o_custkey AS r_o_custkey, o_orderstatus AS r_o_orderstatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 AND o_custkey < 100 AND o_orderstatus = 'F'""",
    "seq_scan": "SELECT * FROM customer",
    "count_rows": "SELECT count(*) AS row_count FROM lineitem",
    **{f"filter_int_{k}": f"SELECT * FROM orders WHERE o_custkey {op} 70" for k, op in _SQL_OPS.items()},
    "filter_str_eq": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "filter_str_lt_exact": "SELECT * FROM orders WHERE o_orderstatus <> 'F'",
    "filter_str_lt_sql": "SELECT * FROM orders WHERE o_orderstatus < 'O'",
    "filter_mixed_eq": "SELECT * FROM orders WHERE o_orderstatus = ''",
    "filter_mixed_ne": "SELECT * FROM orders WHERE o_orderstatus <> ''",
    "filter_and_or": "SELECT * FROM orders WHERE (o_custkey < 50 AND o_orderstatus = 'F') OR o_orderkey >= 14000",
    "filter_not": "SELECT * FROM orders WHERE NOT (o_custkey < 100 AND o_orderstatus = 'F')",
    "filter_cmp_of_cmp": "SELECT * FROM orders WHERE (o_custkey < 500) = (o_orderstatus = 'F')",
    "filter_truthy": "SELECT * FROM orders WHERE o_custkey <> 0",
    "filter_truthy_str": "SELECT * FROM orders WHERE false",
    "filter_double": "SELECT * FROM lineitem WHERE l_discount > 0",
    "expression_value": "SELECT o_orderkey, CAST(o_custkey < 9 OR o_orderstatus = 'P' AS BIGINT) AS truth FROM orders",
    "index_hit": "SELECT * FROM orders WHERE o_orderkey = 777",
    "index_miss": "SELECT * FROM orders WHERE o_orderkey = -1",
    "index_duplicate_key": "SELECT * FROM events WHERE user_id = 5 ORDER BY event_id LIMIT 1",
    "index_first_wins": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "index_build": "SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id",
    "index_lookup_many": """SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "range_scan": "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900",
    "sort_multi": f"SELECT o_orderkey, o_custkey, o_orderstatus, {_RANGE.format('o_orderstatus, o_custkey DESC, o_orderkey')} FROM orders",
    "sort_desc": f"SELECT c_custkey, c_name, {_RANGE.format('c_custkey DESC')} FROM customer",
    "sort_bytes": f"SELECT page_id, url, {_RANGE.format('url, page_id')} FROM pages",
    "sort_top_k": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25",
    "join_1n": "SELECT o_orderkey, o_custkey, c_custkey AS r_c_custkey, c_name AS r_c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_nm": "SELECT a.l_orderkey, count(*) AS pairs, CAST(sum(b.l_linenumber) AS BIGINT) AS numbers FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey",
    "join_chain": _CHAIN,
    "join_empty": "SELECT o_orderkey, o_custkey, c_custkey AS r_c_custkey, c_name AS r_c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE false",
    "join_varchar_key_exact": "SELECT n_name, n_nationkey, r_name AS r_r_name FROM nation CROSS JOIN region",
    "filter_after_join": f"SELECT c_custkey, c_name, r_n_name FROM ({_CHAIN}) WHERE r_n_name = 'NATION_7'",
    "sort_after_join": f"SELECT c_custkey, c_nationkey, n_nationkey AS r_n_nationkey, n_name AS r_n_name, {_RANGE.format('n_name, c_custkey')} FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "recover_rows": "SELECT l_orderkey AS txn_id, l_partkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "recover_stats": _LOG_SQL.format(redone="sum(CASE WHEN c = 1 THEN i ELSE 0 END)"),
    "recover_missing_table": _LOG_SQL.format(redone="sum(0)"),
    "catalog_recover_reopen": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey <> 3",
    "catalog_index_after_recovery": "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey <> 3 THEN n_name ELSE 'later' END AS name FROM nation",
    "join_equal_names": """SELECT c_nationkey AS nation, c_custkey AS customer, n_regionkey AS region, n_nationkey AS nation_again, r_regionkey AS region_again
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 AND c_custkey <> 7""",
    "session_view": "SELECT l_orderkey AS txn_id, count(*) AS rows FROM lineitem GROUP BY l_orderkey",
}
