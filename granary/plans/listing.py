"""Queries of listing, statistics and state over the order and event tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import dedup, ordered, relational
from granary.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("page_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def page_orders(spark, d):
    orders = relational.where_given(table(spark, d, "orders"), F.col("o_orderstatus") == "O", relational.between_days("o_orderdate", "1995-01-01", "1997-12-31"), None)
    return relational.page(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)


@query("keyword_search", """
SELECT doc_id, lang, source FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND lang = 'en'""")
def keyword_search(spark, d):
    return relational.where_given(table(spark, d, "documents"), relational.keyword(["text", "source"], "License"), F.col("lang") == "en").select("doc_id", "lang", "source")


@query("soft_delete_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def soft_delete_filter(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus")


@query("status_counts", """
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS partial FROM orders""")
def status_counts(spark, d):
    s = F.col("o_orderstatus")
    return relational.count_total_and(table(spark, d, "orders"), open=s == "O", finished=s == "F", partial=s == "P")


@query("status_total_rollup", """
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def status_total_rollup(spark, d):
    return relational.counts_with_total(table(spark, d, "orders"), "o_orderstatus")


@query("category_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def category_counts(spark, d):
    return relational.counts_by(table(spark, d, "events"), "event_type")


@query("weekly_zero_filled", """
WITH days AS (SELECT CAST(day AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-29', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) t(day))
SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM days LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def weekly_zero_filled(spark, d):
    return relational.week_counts(table(spark, d, "events"), "ts", "2024-01-31").withColumn("day", F.col("day").cast("string"))


@query("latest_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_group(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return relational.extreme_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("first_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_group(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return relational.extreme_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], latest=False).drop("o_orderdate")


@query("version_bounds", """
SELECT l_partkey, max(l_orderkey) AS last_l_orderkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1""")
def version_bounds(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.col("l_orderkey").alias("order"))
    return relational.first_and_last(lines, "l_partkey", "l_orderkey", "order").select("l_partkey", "last_l_orderkey", "first_order")


@query("latest_nonnull_fallback", """
SELECT user_id, arg_max(v, struct_pack(a := ts, b := event_id)) AS value FROM (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS v FROM events) WHERE v IS NOT NULL GROUP BY 1
UNION ALL SELECT user_id, NULL FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) = 0""")
def latest_nonnull_fallback(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.round("value", 2)).alias("value"))
    return relational.latest_with_fallback(events, "user_id", "value", ["ts", "event_id"])


@query("semi_chain", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def semi_chain(spark, d):
    customers = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").withColumn("__none", F.lit(0))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.semi_chain(lines, (table(spark, d, "orders").select("o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "o_custkey"), (customers.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "o_custkey"))


@query("anti_orphans", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_orphans(spark, d):
    urgent = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return relational.orphans(table(spark, d, "customer").select("c_custkey", "c_name"), urgent, "c_custkey", "o_custkey")


@query("n_plus_one_join", """
SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'""")
def n_plus_one_join(spark, d):
    orders = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    joined = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


LEVELS = "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'signup' THEN 'low' ELSE 'info' END"


def level():
    e = F.col("event_type")
    return F.when(e == "error", "high").when(e == "purchase", "medium").when(e == "signup", "low").otherwise("info")


@query("severity_summary", f"""
SELECT count(*) FILTER (WHERE l = 'high') AS high, count(*) FILTER (WHERE l = 'medium') AS medium, count(*) FILTER (WHERE l = 'low') AS low,
  count(*) FILTER (WHERE l = 'info') AS info, count(*) FILTER (WHERE value > 90) AS critical FROM (SELECT {LEVELS} AS l, value FROM events)""")
def severity_summary(spark, d):
    return relational.level_summary(table(spark, d, "events"), level(), F.col("value") > 90, ["high", "medium", "low", "info"])


@query("report_buckets", f"""
WITH b AS (SELECT user_id, CASE WHEN value > 95 THEN 'critical' WHEN l = 'high' THEN 'high' WHEN l IN ('medium', 'low') THEN 'warning' ELSE 'info' END AS bucket FROM (SELECT *, {LEVELS} AS l FROM events)),
c AS (SELECT user_id, count(*) FILTER (WHERE bucket = 'critical') AS critical, count(*) FILTER (WHERE bucket = 'high') AS high, count(*) FILTER (WHERE bucket = 'warning') AS warning FROM b GROUP BY 1)
SELECT *, CASE WHEN critical > 0 THEN 'reject' WHEN high > 0 THEN 'revise' WHEN warning > 0 THEN 'pass with remarks' ELSE 'pass' END AS verdict FROM c""")
def report_buckets(spark, d):
    rows = table(spark, d, "events").select("user_id", relational.report_bucket(level(), F.col("value") > 95).alias("bucket"))
    found = rows.groupBy("user_id").agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in ("critical", "high", "warning")))
    return found.withColumn("verdict", relational.verdict(F.col("critical"), F.col("high"), F.col("warning")))


@query("pass_rate", """
SELECT c_nationkey, count(*) AS total, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE c_acctbal >= 0) / count(*), 1) ELSE 0.0 END AS rate FROM customer GROUP BY 1""")
def pass_rate(spark, d):
    found = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") >= 0).alias("passed"))
    return found.select("c_nationkey", "total", relational.pass_rate(F.col("passed"), F.col("total")).alias("rate"))


@query("report_rollup", """
SELECT l_orderkey, string_agg(format('{}. part {} x {}', l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS report FROM lineitem GROUP BY 1""")
def report_rollup(spark, d):
    line = F.format_string("%d. part %d x %d", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("line")))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("report"))


@query("replay_cursor", "SELECT event_id, event_type, user_id FROM events WHERE event_id > 137 ORDER BY event_id LIMIT 100")
def replay_cursor(spark, d):
    return relational.after_cursor(table(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id", 137)


@query("patched_rows", """
SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 10 = 3 THEN 'renamed' END, s_name) AS s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier""")
def patched_rows(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    patches = supplier.filter(F.col("s_suppkey") % 10 == 3).select("s_suppkey", F.lit("renamed").alias("s_name"))
    return relational.patched(supplier, patches, "s_suppkey", ["s_name"])


@query("replaced_children", """
SELECT l_orderkey, l_linenumber, false AS new FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 1, true FROM orders WHERE o_orderstatus = 'P'""")
def replaced_children(spark, d):
    new = table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(True).alias("new"))
    return relational.replaced_children(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(False).alias("new")), new, "l_orderkey")


@query("cascade_delete", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))""")
def cascade_delete(spark, d):
    customers = table(spark, d, "customer")
    chain = [("orders", table(spark, d, "orders"), "o_custkey", "o_orderkey"), ("lines", table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")]
    return relational.cascaded(customers, chain, customers.filter("c_nationkey = 7"), "c_custkey")["lines"]


@query("capped_upsert", """
SELECT p_partkey, p_size FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part) ORDER BY p_size DESC, p_partkey LIMIT 20""")
def capped_upsert(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    new = part.filter("p_partkey % 5 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return relational.capped_upsert(part, new, "p_partkey", "p_size")


@query("progress_fold", """
SELECT user_id, coalesce(max(CASE WHEN event_type IN ('view', 'click') THEN coalesce(event_id, 0) END), 0) AS event_id FROM events GROUP BY 1""")
def progress_fold(spark, d):
    return relational.progress_fold(table(spark, d, "events"), "user_id", "event_id", "event_type", ["view", "click"])


@query("stage_share", """
WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(100.0 * n / (SELECT sum(n) FROM s), 1) AS share FROM s""")
def stage_share(spark, d):
    return relational.share_of_total(relational.counts_by(table(spark, d, "events"), "event_type"), "n")


@query("neighbour_snippets", """
SELECT conv_id, turn, substr(lag(text) OVER w, 1, 200) AS previous, substr(lead(text) OVER w, 1, 200) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_snippets(spark, d):
    return ordered.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "previous", "next")


@query("sequential_ids", """
SELECT conv_id, turn, format('ch_{:03d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id FROM conversations""")
def sequential_ids(spark, d):
    return ordered.sequential_ids(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])


@query("history_tail6", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
def history_tail6(spark, d):
    return ordered.tail(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 6)


@query("page_islands", """
WITH days AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events),
k AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM days)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS size FROM k GROUP BY user_id, k""")
def page_islands(spark, d):
    events = table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"))
    return ordered.islands(events, ["user_id"], "day")


@query("same_shape_runs", """
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS size, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY user_id, run HAVING count(*) >= 2""")
def same_shape_runs(spark, d):
    return ordered.runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


ROLE = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END"


def role():
    return F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)


@query("boundary_join", f"""
WITH r AS (SELECT conv_id, turn, {ROLE} AS level FROM conversations)
SELECT conv_id, turn, level, coalesce((SELECT min(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.level <= a.level), -1) AS boundary FROM r a""")
def boundary_join(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", role().alias("level"))
    return ordered.next_boundary(rows, ["conv_id"], "turn", "level", 2).withColumn("boundary", F.coalesce("boundary", F.lit(-1)))


@query("parent_stack", f"""
WITH r AS (SELECT conv_id, turn, {ROLE} AS level FROM conversations)
SELECT conv_id, turn, level, coalesce((SELECT max(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level), -1) AS parent FROM r a""")
def parent_stack(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", role().alias("level"))
    return ordered.parent(rows, ["conv_id"], "turn", "level", 2).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query("interval_cover", """
SELECT DISTINCT o_custkey, CAST(CAST(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS covered FROM orders, generate_series(0, 3) t(i)""")
def interval_cover(spark, d):
    return order_days(table(spark, d, "orders"))


def order_days(orders):
    day = F.to_date("o_orderdate")
    covered = ordered.covered_days(orders, day, F.date_add(day, 3), "o_custkey")
    return covered.withColumn("covered", F.col("covered").cast("string"))


@query("disorder", """
SELECT event_id, value, before FROM (SELECT event_id, round(value, 2) AS value, user_id, lag(round(value, 2)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before > value""")
def disorder(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.round("value", 2).alias("value"))
    return ordered.disorder(events, ["user_id"], "event_id", "value").select("event_id", "value", "before")


@query("split_complete", """
SELECT conv_id, max(total) AS total, count(*) AS parts, (count(*) = max(total) AND count(DISTINCT part) = max(total) AND min(part) = 1 AND max(part) = max(total)) AS complete
FROM (SELECT conv_id, turn + 1 AS part, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) GROUP BY 1""")
def split_complete(spark, d):
    turns = table(spark, d, "conversations")
    parts = turns.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), "conv_id").withColumn("part", F.col("turn") + 1)
    return ordered.complete_splits(parts, ["conv_id"], "part", "total")


@query("exact_dedup_keep_first", """
SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR length(text) < 20""")
def exact_dedup_keep_first(spark, d):
    return dedup.keep_first(table(spark, d, "documents").select("doc_id", "text"), [], "text", "doc_id").select("doc_id")


@query("dedup_keep_best", """
SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def dedup_keep_best(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return dedup.keep_best(rows, ["l_partkey", "l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("set_intersection3", """
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def set_intersection3(spark, d):
    return dedup.set_intersection(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", ["A", "N", "R"])


@query("distinct_first", """
SELECT url, page_id FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS url, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id) AS r FROM pages) WHERE r = 1 AND trim(url) <> ''""")
def distinct_first(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("url"), "page_id")
    return dedup.distinct_first(pages, "url", "page_id")


@query("set_operations", """
SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT r_regionkey + 1000 FROM region""")
def set_operations(spark, d):
    nations = table(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(nations).union(table(spark, d, "region").select(F.col("r_regionkey") + 1000)).distinct()
