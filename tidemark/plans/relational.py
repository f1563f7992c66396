"""Scans, predicates, joins, set operations, sorts and upserts on the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from .registry import ORACLES, Tables, query, r6


@query("""
    WITH last_leg AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1)
    SELECT o_orderkey, o_custkey, o_orderpriority, l_linenumber, l_quantity FROM orders LEFT JOIN last_leg ON l_orderkey = o_orderkey
    WHERE l_orderkey IS NULL OR l_linestatus = 'O'""")
def latest_child_pending(t: Tables) -> DataFrame:
    """Orders with no line, or whose newest line is still open: the predicate stays above the outer join.

    Lines that share order, date and number go by what is returned of them, so that each run gives the same rows.
    """
    last = R.newest(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_shipdate"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_linestatus", "l_quantity"])
    both = t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.where(F.col("l_orderkey").isNull() | (F.col("l_linestatus") == "O")).select("o_orderkey", "o_custkey", "o_orderpriority", "l_linenumber", "l_quantity")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def sector_map(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    chosen = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return chosen.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("""SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 2 LEFT JOIN region ON n_regionkey = r_regionkey""")
def sector_map_uncovered(t: Tables) -> DataFrame:
    """Rows without a place are kept."""
    some = t.nation.where("n_regionkey < 2").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.supplier.join(some, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 4) AS total FROM events
    WHERE ts >= '2024-01-05' AND ts < '2024-01-20' AND event_type IN ('view', 'click') GROUP BY user_id""")
def bars_scan(t: Tables) -> DataFrame:
    """List and range predicates that reach the scan."""
    chosen = t.events.where((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-20") & F.col("event_type").isin("view", "click"))
    return chosen.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r6(F.sum("value"), 4).alias("total"))


@query("""SELECT event_type, value, ts FROM events WHERE ts <= '2024-01-15' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""")
def macro_latest_asof(t: Tables) -> DataFrame:
    return R.newest_values(t.events.where("ts <= timestamp_ntz'2024-01-15'"), ["event_type"], ["ts", "event_id"], ["value", "ts"])


@query("""
    SELECT event_type, CAST(ts AS DATE) AS obs_date, value, ts AS vintage FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""")
def latest_vintage(t: Tables) -> DataFrame:
    """The newest revision of each observation date."""
    dated = t.events.withColumn("obs_date", F.to_date("ts"))
    return R.newest_values(dated, ["event_type", "obs_date"], ["ts", "event_id"], ["value", "ts"]).withColumnRenamed("ts", "vintage")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n_items FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5""")
def common_dates_division(t: Tables) -> DataFrame:
    return R.divide(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", 5)


@query("""SELECT o_orderkey, o_totalprice, l_linenumber, p_brand, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE o_orderstatus = 'F' AND l_returnflag = 'R' AND p_size > 25""")
def four_way_inner(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = t.part.where("p_size > 25").select("p_partkey", "p_brand")
    out = t.orders.where("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return out.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "o_totalprice", "l_linenumber", "p_brand", "s_name")


@query("""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti_unlabelled(t: Tables) -> DataFrame:
    return R.missing(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("""SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)
    AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def semi_then_anti(t: Tables) -> DataFrame:
    return R.missing(R.present(t.documents.select("doc_id", "source"), t.labels.where("quality = 1"), ["doc_id"]), t.labels.where("toxic = 1"), ["doc_id"])


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > c.c_acctbal)""")
def correlated_not_exists(t: Tables) -> DataFrame:
    orders = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_totalprice")
    hit = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal"))
    return t.customer.join(orders, hit, "left_anti").select("c_custkey")


@query("""SELECT count(*) > 0 AS found FROM events WHERE event_type = 'purchase' AND value > 400""")
def exists_probe(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase' AND value > 400").limit(1).agg((F.count("*") > 0).alias("found"))


@query("""
    SELECT p_partkey, coalesce((SELECT min(s_name) FROM supplier WHERE s_suppkey = p_partkey), (SELECT min(n_name) FROM nation WHERE n_nationkey = p_partkey), '') AS name FROM part""")
def conditional_fallback_names(t: Tables) -> DataFrame:
    """A name in one language, else in another, else empty."""
    first = t.supplier.groupBy(F.col("s_suppkey").alias("p_partkey")).agg(F.min("s_name").alias("a"))
    second = t.nation.groupBy(F.col("n_nationkey").cast("long").alias("p_partkey")).agg(F.min("n_name").alias("b"))
    return t.part.select("p_partkey").join(first, "p_partkey", "left").join(second, "p_partkey", "left").select("p_partkey", F.coalesce("a", "b", F.lit("")).alias("name"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')""")
def scalar_subquery_predicate(t: Tables) -> DataFrame:
    last = t.orders.where("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("o_orderdate"))  # one row
    return t.orders.join(F.broadcast(last), "o_orderdate").select("o_orderkey", "o_totalprice")


@query("""
    SELECT o_custkey, round(min(o_totalprice), 2) AS close, count(*) AS n FROM (
        SELECT o.* FROM orders o JOIN (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders GROUP BY 1) m ON m.k = o_custkey AND m.d = o_orderdate) GROUP BY 1""")
def latest_close_per_key(t: Tables) -> DataFrame:
    """Rows on each key's last date, by one window over the keys."""
    last = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    return t.orders.withColumn("last", last).where("o_orderdate = last").groupBy("o_custkey").agg(F.round(F.min("o_totalprice"), 2).alias("close"), F.count("*").alias("n"))


@query("""
    SELECT p.event_id, p.user_id, q.event_id AS asof_event_id, q.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) q ON p.user_id = q.user_id AND p.ts >= q.ts""")
def macro_asof(t: Tables) -> DataFrame:
    """Each purchase with the newest view of its user at or before it."""
    left, right = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), t.events.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return R.asof(left, right, ["user_id"], "ts", "ts", ["event_id", "value"], ["event_id"]).select("event_id", "user_id", "asof_event_id", "asof_value")


@query("""
    WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')
    SELECT d.user_id, d.day, e.value, CAST(row_number() OVER (PARTITION BY d.user_id, d.day ORDER BY e.ts DESC, e.event_id DESC) AS INT) AS rank
    FROM days d JOIN events e ON e.user_id = d.user_id AND e.event_type = 'click' AND CAST(e.ts AS DATE) < d.day
    QUALIFY row_number() OVER (PARTITION BY d.user_id, d.day ORDER BY e.ts DESC, e.event_id DESC) <= 2""")
def strict_asof_last_two(t: Tables) -> DataFrame:
    """The last two observations strictly before each date, carried along one sort of the key's rows."""
    days = t.events.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).distinct()
    seen = t.events.where("event_type = 'click'").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value")
    none = F.lit(None)
    both = days.select("user_id", "day", F.lit(0).alias("side"), none.cast("timestamp_ntz").alias("ts"), none.cast("long").alias("event_id"), none.cast("double").alias("value")).unionByName(seen.withColumn("side", F.lit(1)))
    before = Window.partitionBy("user_id").orderBy("day", "side", "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("user_id").orderBy("day", "side", "ts", "event_id")
    number = F.sum("side").over(own)
    numbered = both.withColumn("n", number)
    pair = F.struct(F.col("value").alias("value"))
    last = F.last(F.when(F.col("side") == 1, F.struct(F.col("value").alias("a"), F.col("prev").alias("b"))), ignorenulls=True)
    prev = F.last(F.when(F.col("side") == 1, pair), ignorenulls=True).over(before)
    out = numbered.withColumn("prev", prev["value"]).withColumn("two", last.over(own.rowsBetween(Window.unboundedPreceding, 0))).where("side = 0 AND two IS NOT NULL")
    rows = F.explode(F.filter(F.array(F.struct(F.lit(1).alias("rank"), F.col("two.a").alias("value")), F.struct(F.lit(2).alias("rank"), F.col("two.b").alias("value"))), lambda x: x["value"].isNotNull()))
    return out.select("user_id", "day", rows.alias("x")).select("user_id", "day", "x.value", "x.rank")


@query("""
    WITH x AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS row_id, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity / 10 AS INT) AS b FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < '1996-01-01')
    SELECT p.l_suppkey, p.row_id AS a_row_id, q.row_id AS b_row_id FROM x p JOIN x q ON p.l_suppkey = q.l_suppkey AND p.row_id < q.row_id AND NOT (p.b < q.a OR q.b < p.a)""")
def overlap_pairs(t: Tables) -> DataFrame:
    """Pairs of a supplier's shipments whose [start, end] intervals overlap."""
    rows = t.lineitem.where("l_quantity >= 45 AND l_shipdate < timestamp_ntz'1996-01-01'")
    rows = rows.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.to_date("l_shipdate").alias("a"), F.expr("date_add(to_date(l_shipdate), cast(bround(l_quantity / 10) as int))").alias("b"))
    return R.overlaps(rows, "l_suppkey", "row_id", "a", "b").select("l_suppkey", "a_row_id", "b_row_id")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, round(last(value ORDER BY ts, event_id) - first(value ORDER BY ts, event_id), 6) AS delta FROM events GROUP BY ALL""")
def first_last_delta(t: Tables) -> DataFrame:
    dated = t.events.withColumn("day", F.to_date("ts"))
    return R.first_last(dated, ["user_id", "day"], ["ts", "event_id"], "value").select("user_id", "day", r6("delta").alias("delta"))


@query("""SELECT a.s_suppkey, b.s_suppkey AS peer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def exchange_peers(t: Tables) -> DataFrame:
    a, b = t.supplier.select("s_suppkey", "s_nationkey"), t.supplier.select(F.col("s_suppkey").alias("peer"), "s_nationkey")
    return a.join(b, "s_nationkey").where("s_suppkey <> peer").select("s_suppkey", "peer")


@query("""SELECT o_orderkey, coalesce(filled, 0) AS filled, c_acctbal < 0 AS short FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS filled FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 OR filled IS NULL""")
def negative_signal_pending(t: Tables) -> DataFrame:
    """Filled quantity per order, kept where either joined side asks for action."""
    filled = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("filled"))
    out = t.orders.join(filled, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.where("c_acctbal < 0 OR filled IS NULL").select("o_orderkey", F.coalesce("filled", F.lit(0).cast("long")).alias("filled"), (F.col("c_acctbal") < 0).alias("short"))


@query("""
    SELECT DISTINCT c_custkey, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size >= 48""")
def theme_bridge(t: Tables) -> DataFrame:
    parts = t.part.where("p_size >= 48").select("p_partkey", "p_brand")
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "p_brand").distinct().join(t.customer.select("c_custkey"), "c_custkey", "left_semi")


@query("""
    WITH direct AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' AND value > 300 GROUP BY 1), themed AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT * FROM direct UNION ALL SELECT * FROM themed WHERE user_id NOT IN (SELECT user_id FROM direct)""")
def fallback_source(t: Tables) -> DataFrame:
    best = lambda p: t.events.where(p).groupBy("user_id").agg(F.max("value").alias("v"))
    return R.first_choice(best("event_type = 'purchase' AND value > 300"), best("event_type = 'view'"), ["user_id"])


@query("""SELECT l_orderkey, l_linenumber, coalesce(a.o_custkey, b.o_custkey) AS owner FROM lineitem LEFT JOIN orders a ON a.o_orderkey = l_partkey LEFT JOIN orders b ON b.o_orderkey = l_suppkey WHERE l_quantity > 49""")
def two_key_lookup(t: Tables) -> DataFrame:
    first, second = (t.orders.select(F.col("o_orderkey").alias(k), F.col("o_custkey").alias(o)) for k, o in (("l_partkey", "a"), ("l_suppkey", "b")))
    lines = t.lineitem.where("l_quantity > 49").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(first, "l_partkey", "left").join(second, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("a", "b").alias("owner"))


@query("""SELECT coalesce(a.n_nationkey, b.s_suppkey) AS place, n_name, s_name FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_suppkey""")
def outer_merge(t: Tables) -> DataFrame:
    a, b = t.nation.select(F.col("n_nationkey").cast("long").alias("place"), "n_name"), t.supplier.select(F.col("s_suppkey").alias("place"), "s_name")
    return a.join(b, "place", "full")


@query("""
    WITH latest AS (SELECT user_id, max(ts) AS news FROM events WHERE event_type = 'view' GROUP BY 1), done AS (SELECT user_id, max(ts) AS rec FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT user_id, news FROM latest LEFT JOIN done USING (user_id) WHERE rec IS NULL OR rec <= news""")
def stale_recommendation(t: Tables) -> DataFrame:
    """Keys with news and no newer recommendation, in one aggregation."""
    last = lambda k: F.max(F.when(F.col("event_type") == k, F.col("ts")))
    out = t.events.groupBy("user_id").agg(last("view").alias("news"), last("purchase").alias("rec"))
    return out.where("news IS NOT NULL AND (rec IS NULL OR rec <= news)").select("user_id", "news")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, substr(event_type, 1, 3) AS kind FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90""")
def json_path(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", k.alias("k"), F.substring("event_type", 1, 3).alias("kind")).where("k >= 90")


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (toxic = 0) IS DISTINCT FROM FALSE""")
def not_distinct_from_false(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(~(F.col("toxic") == 0).eqNullSafe(F.lit(False))).select("doc_id")


@query("""SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE coalesce(l_shipdate, o_orderdate) >= '1997-01-01' AND coalesce(l_shipdate, o_orderdate) < '1997-02-01'""")
def half_open_window(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_shipdate")
    at = F.coalesce("l_shipdate", "o_orderdate")
    return t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").where((at >= "1997-01-01") & (at < "1997-02-01")).select("o_orderkey")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%0001%' OR s_name ILIKE 'SUPPLIER%9'""")
def ilike_match(t: Tables) -> DataFrame:
    return t.supplier.where(F.col("s_name").ilike("%0001%") | F.col("s_name").ilike("SUPPLIER%9")).select("s_suppkey", "s_name")


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice DESC NULLS LAST, o_orderkey) AS INT) AS place FROM orders ORDER BY place LIMIT 25""")
def case_priority_order(t: Tables) -> DataFrame:
    first = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    top = t.orders.orderBy(first, F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25)
    place = F.row_number().over(Window.orderBy(first, F.col("o_totalprice").desc_nulls_last(), "o_orderkey"))  # 25 rows
    return top.select("o_orderkey", place.alias("place"))


@query("""
    WITH n AS (SELECT count(DISTINCT source) AS s FROM documents), x AS (SELECT doc_id, source, n_chars FROM documents, n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= greatest(1, 50 // s))
    SELECT doc_id, source FROM x ORDER BY n_chars DESC, doc_id LIMIT 50""")
def per_source_quota(t: Tables) -> DataFrame:
    return R.fair_quota(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 50).select("doc_id", "source")


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey OFFSET 10 LIMIT 15""")
def offset_page(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(15).select("p_partkey", "p_retailprice")


@query("""SELECT event_type, ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 4)""")
def tail_in_ascending_order(t: Tables) -> DataFrame:
    last = R.top_per(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 4, "from_end")
    return last.select("event_type", "ts", (F.lit(5) - F.col("from_end")).cast("int").alias("place"))


@query("""SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def set_union(t: Tables) -> DataFrame:
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).union(t.customer.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("""SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49""")
def set_difference(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").subtract(t.lineitem.where("l_returnflag = 'R' AND l_quantity >= 49").select("l_partkey"))


@query("""SELECT user_id, day, value, rank FROM (SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END AS rank FROM events WHERE event_type IN ('purchase', 'click'))
    QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY rank, event_id) = 1""")
def concat_first_wins(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'purchase'").withColumn("rank", F.lit(1))
    b = t.events.where("event_type = 'click'").withColumn("rank", F.lit(2))
    both = a.unionByName(b).withColumn("day", F.to_date("ts"))
    return R.top_per(both, ["user_id", "day"], [F.col("rank"), F.col("event_id")]).select("user_id", "day", "value", "rank")


#: All orders against all orders with keys moved by 700, so that keys are new, shared and old.
NEW = "SELECT o_orderkey + 700 AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders"
OLD = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return old, t.orders.select((F.col("o_orderkey") + 700).alias("o_orderkey"), "o_custkey", price.alias("o_totalprice"))


def upserts(sql: str):
    """Register a function of the old and the new side over all orders."""

    def register(f: Callable[[DataFrame, DataFrame], DataFrame]):
        over = lambda t: f(*_old_new(t))
        over.__name__ = f.__name__
        query(sql)(over)
        return f

    return register


@upserts(f"WITH n AS ({NEW}), o AS ({OLD}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def upsert_last_wins(old: DataFrame, new: DataFrame) -> DataFrame:
    return R.upsert(old, new, ["o_orderkey"])


@upserts(f"WITH n AS ({NEW}), o AS ({OLD}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def insert_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    return R.insert_ignore(old, new, ["o_orderkey"])


@upserts(f"""WITH n AS ({NEW}), o AS ({OLD})
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, greatest(o.o_custkey, n.o_custkey) AS o_custkey FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert_coalesce(old: DataFrame, new: DataFrame) -> DataFrame:
    """A null does not overwrite; the customer only ever rises."""
    return R.upsert_with(old, new, ["o_orderkey"], {"o_totalprice": "coalesce", "o_custkey": "greatest"})


@upserts(f"""WITH n AS ({NEW}), o AS ({OLD}), j AS (SELECT o.o_orderkey AS k, o.o_totalprice AS a, n.o_totalprice AS b FROM n LEFT JOIN o ON o.o_orderkey = n.o_orderkey)
    SELECT count(*) FILTER (k IS NULL) AS inserted, count(*) FILTER (k IS NOT NULL AND a IS DISTINCT FROM b) AS updated, count(*) FILTER (k IS NOT NULL AND a IS NOT DISTINCT FROM b) AS unchanged FROM j""")
def upsert_if_changed_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    return R.upsert_counts(old, new, ["o_orderkey"], "o_totalprice")


@upserts(f"WITH n AS (SELECT * FROM ({NEW}) WHERE o_totalprice > 300000), o AS ({OLD}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)")
def replace_group_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Customers with a dear new order have their old ones replaced, the others keep theirs."""
    return R.replace_members(old, new.where("o_totalprice > 300000"), "o_custkey")


@upserts(f"WITH o AS ({OLD}) SELECT * FROM o WHERE NOT coalesce(o_custkey BETWEEN 10 AND 60, FALSE)")
def delete_range(old: DataFrame, new: DataFrame) -> DataFrame:
    return R.delete_where(old, F.col("o_custkey").between(10, 60))


@query("""SELECT n_nationkey, 'n_name' AS name, NULL::DOUBLE AS value, n_name AS text FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::DOUBLE, NULL FROM nation""")
def melt_metrics(t: Tables) -> DataFrame:
    return R.melt(t.nation, ["n_nationkey"])


@query("""SELECT url, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY url""")
def rss_dedup(t: Tables) -> DataFrame:
    return t.pages.where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN floor(500000 / o_totalprice)::BIGINT ELSE 0 END AS qty, coalesce(nullif(o_totalprice, 0), 1.0) AS price FROM orders""")
def budget_quantity(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.quantity(F.lit(500000.0), F.col("o_totalprice")).alias("qty"), S.or_default(F.col("o_totalprice"), 1.0).alias("price"))


@query("""
    WITH x AS (SELECT p_partkey, p_retailprice * 37 AS price FROM part), y AS (SELECT *, CASE WHEN price < 1000 THEN 1 WHEN price < 5000 THEN 5 WHEN price < 10000 THEN 10 WHEN price < 50000 THEN 50 WHEN price < 100000 THEN 100 WHEN price < 500000 THEN 500 ELSE 1000 END AS tick FROM x)
    SELECT p_partkey, (floor(CAST(price AS DECIMAL(18,6)) / tick) * tick)::DOUBLE AS buy, (ceil(CAST(price AS DECIMAL(18,6)) / tick) * tick)::DOUBLE AS sell, (floor(CAST(price AS DECIMAL(18,6)) / tick + 0.5) * tick)::DOUBLE AS near FROM y""")
def tick_rounding(t: Tables) -> DataFrame:
    price = F.round(F.col("p_retailprice") * 37, 6)
    return t.part.select("p_partkey", *(S.round_to_tick(price, "KR", side).alias(name) for side, name in (("BUY", "buy"), ("SELL", "sell"), ("", "near"))))


@query("""SELECT s_suppkey, translate(trim(s_name), '#/.', '---') AS dashed, upper(trim(s_name)) AS name_key, try_cast(replace('1,' || s_suppkey, ',', '') AS DOUBLE) AS number, s_suppkey % 2 = 1 AS flag FROM supplier""")
def text_codes(t: Tables) -> DataFrame:
    odd = F.when(F.col("s_suppkey") % 2 == 1, " Yes").otherwise("0")
    name = F.translate("s_name", "#", "/")
    return t.supplier.select("s_suppkey", S.symbol_dash(name).alias("dashed"), S.lookup_key(F.col("s_name")).alias("name_key"), S.number(F.concat(F.lit("1,"), F.col("s_suppkey").cast("string"))).alias("number"), S.flag(odd).alias("flag"))


@query("""SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS local_day, last_day(CAST(ts AS DATE)) AS month_end, CAST(quarter(ts) AS INT) AS quarter, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 21 HOUR AS close_utc FROM events""")
def session_times(t: Tables) -> DataFrame:
    """Local date in Seoul and the UTC time of the 16:00 New York close (all of January is winter time)."""
    close = S.close_to_utc(F.to_date("ts"), "16:00:00", "America/New_York").cast("timestamp_ntz")
    return t.events.select("event_id", S.local_date(F.col("ts")).alias("local_day"), F.last_day("ts").alias("month_end"), F.quarter("ts").cast("int").alias("quarter"), close.alias("close_utc"))
