"""Messy views over the clean test tables. The same text runs on Spark and in the SQL check. They keep every row of
their table; CASE arms inject faults, and events_dups adds copies on top of the whole table."""

ORDERS_DIRTY = """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 40 = 0 THEN '?'
       WHEN o_orderkey % 41 = 0 THEN concat('(', cast(cast(floor(o_totalprice) AS bigint) AS string), ')')
       WHEN o_orderkey % 43 = 0 THEN concat(cast(cast(floor(o_totalprice) AS bigint) AS string), '%')
       ELSE concat('$', cast(cast(floor(o_totalprice / 1000) AS bigint) AS string), ',',
                   lpad(cast(cast(floor(o_totalprice) AS bigint) % 1000 AS string), 3, '0')) END AS price_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'YES' ELSE 'No' END AS flag,
  CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority)
       WHEN o_orderkey % 11 = 0 THEN concat(o_orderpriority, '  ')
       WHEN o_orderkey % 13 = 0 THEN ' N/A '
       ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 20 = 0 THEN -999 ELSE 20 + o_custkey % 50 END AS age,
  CASE WHEN o_orderkey % 30 = 0 THEN cast('Infinity' AS double) ELSE o_totalprice / 1000 END AS ratio,
  concat(lpad(cast(day(o_orderdate) AS string), 2, '0'), '/', lpad(cast(month(o_orderdate) AS string), 2, '0'), '/',
         cast(year(o_orderdate) AS string)) AS date_text,
  lpad(cast(o_custkey AS string), 5, '0') AS zip
FROM orders"""

EVENTS_GAPS = """
SELECT event_id, user_id, event_type,
  CASE WHEN event_id % 10 < 2 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 10 < 2 THEN NULL ELSE user_id * 2 + 1 END AS paired,
  CASE WHEN event_id % 25 = 3 THEN NULL ELSE event_type END AS kind,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS sparse_kind,
  CASE WHEN event_id % 5 <> 0 THEN NULL ELSE value END AS mostly_null,
  CASE WHEN event_id % 200 = 0 THEN 'b' ELSE 'a' END AS rare,
  'x' AS const,
  CASE event_type WHEN 'click' THEN 'p' WHEN 'view' THEN 'q' WHEN 'error' THEN 'r' WHEN 'signup' THEN 's' ELSE 't' END
    AS twin,
  CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'High' ELSE 'medium ' END AS tier,
  value - 40 AS shifted
FROM events"""

EVENTS_DUPS = """
SELECT event_id, event_type, user_id, ts, value FROM events
UNION ALL SELECT event_id + 10000000, event_type, user_id, ts, value FROM events WHERE event_id % 100 = 0
UNION ALL SELECT event_id, event_type, user_id, ts, value FROM events WHERE event_id % 500 = 0"""

VIEWS = {"orders_dirty": ORDERS_DIRTY, "events_gaps": EVENTS_GAPS, "events_dups": EVENTS_DUPS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark, sf_dir: str, name: str):
    """A base table, or a messy view expanded over its base table. No session state is registered."""
    if name in VIEWS:
        base = "orders" if name == "orders_dirty" else "events"
        path = f"{sf_dir}/{base}.parquet"
        return spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: spark.read.parquet(path)})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
