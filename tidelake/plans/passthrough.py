"""Pass-through SQL: any text a user sends runs as Spark SQL (tier C).

The library claims no code for these; each query is one smoke test per
category of the SQL surface, written in plain ANSI SQL that Spark and the
DuckDB oracle both run unchanged over the test tables.  Windows run over
pre-aggregated rows (one per nation), never over a raw table's hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.operators.sqltext import run_sql
from tidelake.sources.tables import register_views

QUERIES: dict[str, tuple[list[str], str]] = {
    "pt_join_revenue_by_nation": (["lineitem", "orders", "customer", "nation", "region"], """
SELECT r_name, n_name, count(*) AS n_lines,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name
"""),
    "pt_rollup_flags": (["lineitem"], """
SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(l_quantity) AS qty
FROM lineitem
GROUP BY ROLLUP (l_returnflag, l_linestatus)
"""),
    "pt_grouping_sets_orders": (["orders"], """
SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders
FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
"""),
    "pt_semi_anti_customers": (["customer", "orders"], """
SELECT 'with_orders' AS kind, count(*) AS n FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL
SELECT 'without_orders' AS kind, count(*) AS n FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
"""),
    "pt_full_outer_suppliers": (["nation", "supplier"], """
SELECT n_name, count(s_suppkey) AS n_suppliers
FROM nation FULL OUTER JOIN supplier ON s_nationkey = n_nationkey
GROUP BY n_name
"""),
    "pt_window_rank_nations": (["customer", "nation"], """
WITH per_nation AS (
  SELECT n_regionkey, n_name, count(*) AS n_customers
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_regionkey, n_name)
SELECT n_regionkey, n_name, n_customers,
       CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY n_customers DESC) AS BIGINT) AS rnk,
       n_customers - lag(n_customers) OVER (PARTITION BY n_regionkey ORDER BY n_customers DESC, n_name) AS gap
FROM per_nation
"""),
    "pt_topk_customers": (["orders"], """
SELECT o_custkey, round(sum(o_totalprice), 2) AS total_spent, count(*) AS n_orders
FROM orders
GROUP BY o_custkey
ORDER BY total_spent DESC, o_custkey
LIMIT 10
"""),
    "pt_set_ops_status": (["orders"], """
SELECT 'both' AS kind, count(*) AS n FROM (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') t
UNION ALL
SELECT 'only_f' AS kind, count(*) AS n FROM (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') t
UNION ALL
SELECT 'either' AS kind, count(*) AS n FROM (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') t
"""),
    "pt_subqueries": (["orders", "customer"], """
SELECT o_orderpriority, count(*) AS n_orders
FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
GROUP BY o_orderpriority
"""),
    "pt_recursive_nation_chain": (["nation"], """
WITH RECURSIVE chain (k, depth) AS (
  SELECT min(n_nationkey), 0 FROM nation
  UNION ALL
  SELECT n.n_nationkey, c.depth + 1 FROM chain c JOIN nation n ON n.n_nationkey = c.k + 1)
SELECT count(*) AS n_steps, max(depth) AS max_depth FROM chain
"""),
    # Recursion over a bounded dimension (suppliers of a nation follow each other), joined to the lines once.
    "pt_recursive_line_chain": (["nation", "lineitem", "supplier"], """
WITH RECURSIVE chain (k, depth) AS (
  SELECT n_nationkey, 1 FROM nation WHERE n_nationkey = 0
  UNION ALL
  SELECT n.n_nationkey, c.depth + 1 FROM chain c JOIN nation n ON n.n_nationkey = c.k + 1)
SELECT depth, count(*) AS n_lines
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN chain ON s_nationkey = k
GROUP BY depth
"""),
    # Inline rows, numeric literals in several notations, a timestamp literal.
    "pt_inline_rows": (["lineitem"], """
SELECT f.meaning, count(*) AS n_lines,
       count(CASE WHEN l_quantity >= 1.5E1 THEN 1 END) AS n_from_15,
       count(CASE WHEN l_discount > .05 THEN 1 END) AS n_discounted,
       count(CASE WHEN l_quantity - 3.2e+1 > -2.50 THEN 1 END) AS n_large,
       count(CASE WHEN l_shipdate >= TIMESTAMP '1995-06-17 00:00:00' THEN 1 END) AS n_late
FROM lineitem JOIN (VALUES ('A', 'accepted'), ('N', 'none'), ('R', 'returned')) AS f (flag, meaning)
  ON l_returnflag = f.flag
GROUP BY f.meaning
"""),
    "pt_select_without_from": (["lineitem", "orders"], """
SELECT 1 + 1 AS two, 15e-03 AS small, 'text' AS txt, NULL IS NULL AS unknown,
       (SELECT count(*) FROM lineitem) AS n_lines,
       (SELECT count(*) FROM orders WHERE o_totalprice > 1e5) AS n_large_orders
"""),
    "pt_distinct_aggregates": (["orders"], """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers,
       count(DISTINCT o_orderpriority) AS n_priorities, count(*) AS n_orders
FROM orders
GROUP BY o_orderstatus
"""),
    "pt_cube_flags": (["lineitem"], """
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_lines
FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)
"""),
    "pt_framed_window_days": (["orders"], """
WITH per_day AS (
  SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders
  FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))
SELECT o_orderpriority, day, n_orders,
       CAST(sum(n_orders) OVER (PARTITION BY o_orderpriority ORDER BY day
                                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_7_days
FROM per_day
"""),
    "pt_except_all": (["orders", "customer"], """
SELECT o_custkey, count(*) AS n_left FROM (
  SELECT o_custkey FROM orders
  EXCEPT ALL
  SELECT c_custkey FROM customer) t
GROUP BY o_custkey
"""),
    "pt_left_join_customers": (["customer", "orders"], """
SELECT c_mktsegment, count(*) AS n_rows, count(o_orderkey) AS n_orders,
       count(*) - count(o_orderkey) AS n_without
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_mktsegment
"""),
    # A range join bounded by an equi-key: lines shipped within 30 days of their order.
    "pt_range_join_shipping": (["orders", "lineitem"], """
SELECT o_orderpriority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY
GROUP BY o_orderpriority
"""),
}


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which a join's side found small at run time is broadcast
    even if its few rows leave most shuffle partitions empty. What a recursion yields has no size before it
    runs; without this, millions of rows are sorted by its few keys, in a few tasks."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin", "0")
    return own


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = QUERIES[name]
    if "WITH RECURSIVE" in text:
        spark = own_session(spark)
    register_views(spark, sf_dir, tables)
    return run_sql(spark, text)


def job(name: str):
    def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, name)
    _job.__name__ = name
    _job.__doc__ = f"Pass-through SQL smoke query {name}."
    return _job
