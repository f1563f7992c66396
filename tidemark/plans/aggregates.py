"""Aggregation, ranking and calibration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import statistics as A
from .registry import Tables, exact_mean, query, r6


@query("""SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def counts_and_ranges(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r6(F.avg("value")).alias("mean"))


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL""")
def group_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, round(percent_rank() OVER (ORDER BY round(avg(l_extendedprice), 4)), 6) AS rank FROM lineitem GROUP BY 1""")
def percent_rank_turnover(t: Tables) -> DataFrame:
    """Percent rank of group means, without a window over all groups. Means are exact, so that equal ones stay equal."""
    mean = t.lineitem.groupBy("l_suppkey").agg(r6(exact_mean("l_extendedprice"), 4).alias("m"))
    return A.percent_ranks(mean, "m", "rank").select("l_suppkey", r6("rank").alias("rank"))


@query("""SELECT user_id, round(count(DISTINCT CASE WHEN ts >= '2024-01-08' THEN event_id END) / 7.0, 6) AS heat FROM events WHERE ts < '2024-01-15' GROUP BY 1""")
def news_heat(t: Tables) -> DataFrame:
    recent = F.when(F.col("ts") >= "2024-01-08", F.col("event_id"))
    return t.events.where("ts < timestamp_ntz'2024-01-15'").groupBy("user_id").agg(r6(F.count_distinct(recent) / 7.0).alias("heat"))


@query("""SELECT o_orderkey, coalesce(q, 0) AS q FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(coalesce(l_quantity, 0)) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_orderkey = o_orderkey""")
def pending_qty_unfilled(t: Tables) -> DataFrame:
    q = t.lineitem.where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.sum(F.coalesce("l_quantity", F.lit(0.0))).cast("long").alias("q"))
    return t.orders.select("o_orderkey").join(q, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("q", F.lit(0).cast("long")).alias("q"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS gross, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL""")
def pnl_summary(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(F.sum("l_quantity"), 2).alias("qty"), r6(F.sum("l_extendedprice"), 2).alias("gross"), r6(F.sum(net), 2).alias("net"),
        r6(F.sum(net * (1 + F.col("l_tax"))), 2).alias("charge"), r6(F.avg("l_discount")).alias("discount"),
    )


@query("""SELECT user_id, max(ts) AS last_ts FROM (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, max(ts) FROM events WHERE event_type = 'click' GROUP BY 1) GROUP BY 1""")
def latest_of_two_sources(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("view", "click")).groupBy("user_id").agg(F.max("ts").alias("last_ts"))


@query("""SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_returnflag = 'A'""")
def distinct_counts(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'A'").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT l_partkey, CASE WHEN sum(l_quantity) > 0 THEN round(sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity), 4) END AS price FROM lineitem GROUP BY 1""")
def weighted_average_price(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_partkey").agg(r6(A.weighted_mean(F.col("l_extendedprice") / q, q), 4).alias("price"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'FULL' WHEN bool_or(l_returnflag = 'A') THEN 'PARTIAL' ELSE min(l_returnflag) END AS status FROM lineitem GROUP BY 1""")
def fill_status_collapse(t: Tables) -> DataFrame:
    has = lambda v: F.bool_or(F.col("l_returnflag") == v)
    return t.lineitem.groupBy("l_orderkey").agg(F.when(has("R"), "FULL").when(has("A"), "PARTIAL").otherwise(F.min("l_returnflag")).alias("status"))


@query("""SELECT round(l_discount, 1) AS bucket, count(*) AS n FROM (SELECT round(l_discount + 0.003, 3) AS l_discount FROM lineitem) GROUP BY 1""")
def value_histogram(t: Tables) -> DataFrame:
    return t.lineitem.select(r6(F.round(F.col("l_discount") + 0.003, 3), 1).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
    WITH x AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 1000 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda v: v IS NOT NULL) AS reasons
               FROM documents LEFT JOIN labels USING (doc_id))
    SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM x) GROUP BY 1""")
def reason_histogram(t: Tables) -> DataFrame:
    """Reasons of each row from its conditions, counted."""
    given = (("short", F.col("n_chars") < 1000), ("foreign", F.col("lang") != "en"), ("poor", F.col("quality") == 0), ("toxic", F.col("toxic") == 1))
    reasons = F.array_compact(F.array(*(F.when(c, name) for name, c in given)))
    docs = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left")
    return docs.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS good, round(avg(CAST(toxic = 1 AS DOUBLE)), 6) AS toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS usable,
    avg(CAST(quality = 1 AS DOUBLE)) > 0.5 AS ready FROM labels""")
def flag_ratios(t: Tables) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    good = share(F.col("quality") == 1)
    return t.labels.agg(r6(good).alias("good"), r6(share(F.col("toxic") == 1)).alias("toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("usable"), (good > 0.5).alias("ready"))


SCORED = "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_discount * 5 + l_tax AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS hit FROM lineitem"


def _scored(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("hit"))


BUCKETS = f"""WITH s AS ({SCORED}), b AS (SELECT *, CAST((row_number() OVER (ORDER BY score, row_id) - 1) // greatest(1, (count(*) OVER ()) // 5) AS INT) AS bucket FROM s),
    g AS (SELECT bucket, count(*) AS n, CAST(sum(CAST(score AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS score, avg(hit) AS hit FROM b GROUP BY 1)"""


def _bucketed(t: Tables) -> DataFrame:
    """Buckets with exact sums, in hundredths: a mean of doubles would depend on the order in which tasks finish."""
    exact = F.sum(F.col("score").cast("decimal(18,2)")).cast("double") / F.count("*")
    return A.buckets(_scored(t), "score", "row_id", 5).groupBy("bucket").agg(F.count("*").alias("n"), exact.alias("score"), F.avg("hit").alias("hit"))


@query(f"{BUCKETS} SELECT bucket, n, round(score, 6) AS score, round(hit, 6) AS hit FROM g")
def calibration_buckets(t: Tables) -> DataFrame:
    return _bucketed(t).select("bucket", "n", r6("score").alias("score"), r6("hit").alias("hit"))


@query(f"""{BUCKETS}, o AS (SELECT *, hit >= coalesce(lag(hit) OVER (ORDER BY bucket), hit) AS up FROM g)
    SELECT round(avg(abs(score - hit)), 6) AS ece, bool_and(up) AS monotone FROM o""")
def calibration_error(t: Tables) -> DataFrame:
    """Mean gap between score and hit rate over the buckets, and whether hit rates rise."""
    g = _bucketed(t)
    before = F.lag("hit").over(Window.orderBy("bucket"))  # six rows at most
    return g.withColumn("up", F.col("hit") >= F.coalesce(before, "hit")).agg(r6(F.avg(F.abs(F.col("score") - F.col("hit")))).alias("ece"), F.every("up").alias("monotone"))


@query(f"WITH s AS ({SCORED}) SELECT round(avg(hit), 6) AS precision FROM (SELECT * FROM s ORDER BY score DESC, row_id LIMIT 20)")
def precision_at_k(t: Tables) -> DataFrame:
    return _scored(t).orderBy(F.desc("score"), "row_id").limit(20).agg(r6(F.avg("hit")).alias("precision"))


@query(f"""WITH s AS ({SCORED}), m AS (SELECT avg(hit) AS y, avg(score) AS x, CASE WHEN var_pop(score) <= 1e-12 THEN 1.0 ELSE greatest(0.1, least(10.0, covar_pop(score, hit) / var_pop(score) * 10)) END AS slope FROM s)
    SELECT round(slope, 6) AS slope, round(ln(greatest(1e-6, y) / greatest(1e-6, 1 - y)) - slope * x, 6) AS intercept FROM m""")
def calibration_line(t: Tables) -> DataFrame:
    return A.calibration_fit(_scored(t), "score", "hit").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 4) AS expectancy, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM lineitem GROUP BY 1""")
def group_expectancy(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.avg("l_extendedprice"), 4).alias("expectancy"), r6(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0))).alias("hit_rate"))


@query("""SELECT feature, round(m, 6) AS mean, round(greatest(1e-8, s), 6) AS std FROM (SELECT 'l_quantity' AS feature, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem
    UNION ALL SELECT 'l_discount', avg(l_discount), stddev_pop(l_discount) FROM lineitem)""")
def scaler_fit(t: Tables) -> DataFrame:
    return A.scaler(t.lineitem, ["l_quantity", "l_discount"]).select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


@query("""
    WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS z FROM lineitem, m WHERE l_returnflag = 'A'""")
def scaler_zscore(t: Tables) -> DataFrame:
    """The fitted scaler is one row, joined to every row of another selection."""
    fit = t.lineitem.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    rows = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(1).alias("one"))
    out = rows.join(F.broadcast(fit.withColumn("one", F.lit(1))), "one")  # one row
    return out.select("l_orderkey", "l_linenumber", r6((F.col("l_quantity") - F.col("m")) / F.col("s")).alias("z"))


@query("""SELECT l_shipmode_proxy, n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(q10, 4) AS q10, round(q90, 4) AS q90, round(win, 6) AS win FROM (
    SELECT l_linenumber AS l_shipmode_proxy, count(*) AS n, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, stddev_pop(l_extendedprice) AS std, quantile_cont(l_extendedprice, 0.1) AS q10,
    quantile_cont(l_extendedprice, 0.9) AS q90, avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0.0 END) AS win FROM lineitem GROUP BY 1)""")
def prototype_stats(t: Tables) -> DataFrame:
    """Statistics of each group. Equal prices are counted first, and one exact percentile over the counts gives all quantiles."""
    x = F.col("l_extendedprice")
    counts = t.lineitem.groupBy(F.col("l_linenumber").alias("l_shipmode_proxy"), x).agg(F.count("*").alias("c"), F.count_if(F.col("l_discount") > 0.04).alias("wins"))
    c = F.when(x.isNotNull(), F.col("c"))
    q = F.percentile(x, F.array(*map(F.lit, (0.1, 0.5, 0.9))), F.col("c"))
    out = counts.groupBy("l_shipmode_proxy").agg(F.sum("c").alias("n"), F.sum(c).alias("seen"), F.sum(x * c).alias("s"), F.sum(x * x * c).alias("qs"), q.alias("q"), F.sum("wins").alias("wins"))
    mean = F.col("s") / F.nullif(F.col("seen"), F.lit(0))
    std = F.sqrt(F.greatest(F.col("qs") / F.nullif(F.col("seen"), F.lit(0)) - mean * mean, F.lit(0.0)))
    return out.select("l_shipmode_proxy", "n", r6(mean, 4).alias("mean"), r6(F.col("q")[1], 4).alias("median"), r6(std, 4).alias("std"), r6(F.col("q")[0], 4).alias("q10"), r6(F.col("q")[2], 4).alias("q90"), r6(F.col("wins") / F.col("n")).alias("win"))


@query("""SELECT l_suppkey, round(sum(pow(0.5, greatest(0, date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-31')) / 90.0)), 6) AS support FROM lineitem GROUP BY 1""")
def decayed_support(t: Tables) -> DataFrame:
    age = F.greatest(F.lit(0), F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("l_shipdate")))
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.sum(F.pow(F.lit(0.5), age / 90.0))).alias("support"))


@query("""
    WITH c AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS cdf FROM lineitem)
    SELECT l_returnflag, min(v) FILTER (cdf >= 0.1) AS q10, min(v) FILTER (cdf >= 0.5) AS q50, min(v) FILTER (cdf >= 0.9) AS q90 FROM c GROUP BY 1""")
def weighted_quantile(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.weighted_quantiles(rows, ["l_returnflag"], "l_extendedprice", "l_quantity", [0.1, 0.5, 0.9], "row_id")


@query("""
    SELECT l_returnflag, round(m / 0.1 + ln(sum(exp((l_discount - m) / 0.1)) + 1e-12), 6) AS lse FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY l_returnflag, m""")
def lse_aggregate(t: Tables) -> DataFrame:
    return A.log_sum_exp(t.lineitem.select("l_returnflag", "l_discount"), ["l_returnflag"], "l_discount", 0.1).select("l_returnflag", r6("lse").alias("lse"))


@query("""WITH x AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, round(v[CAST(round_even((len(v) - 1) * 0.9, 0) AS INT) + 1], 4) AS p90 FROM x""")
def nearest_rank_percentile(t: Tables) -> DataFrame:
    """Element at the half-even rounded rank, by row numbers instead of gathered lists."""
    w = Window.partitionBy("l_suppkey")
    ranked = t.lineitem.select("l_suppkey", "l_extendedprice", F.row_number().over(w.orderBy("l_extendedprice")).alias("n"), F.count("*").over(w).alias("c"))
    return ranked.where(F.col("n") == F.bround((F.col("c") - 1) * 0.9) + 1).select("l_suppkey", r6("l_extendedprice", 4).alias("p90"))


@query("""SELECT round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS holding_days, count(*) FILTER (l_returnflag = 'R') AS forced FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def holding_days(t: Tables) -> DataFrame:
    both = t.lineitem.select("l_orderkey", "l_shipdate", "l_returnflag").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.agg(r6(F.avg(F.datediff("l_shipdate", "o_orderdate"))).alias("holding_days"), F.count_if(F.col("l_returnflag") == "R").alias("forced"))


@query("""SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS covered, round(count(o_orderkey) * 100.0 / count(*), 2) AS coverage FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def coverage_rate(t: Tables) -> DataFrame:
    has = t.orders.where("o_totalprice > 300000").select("o_custkey").distinct().withColumn("here", F.lit(1))
    out = t.customer.join(has, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("here").alias("covered"))
    return out.withColumn("coverage", r6(F.col("covered") * 100.0 / F.col("n"), 2))


@query("""
    SELECT o_orderkey, round(gap, 4) AS gap, round(size, 2) AS size, round(utility, 6) AS utility FROM (
        SELECT o_orderkey, gap, size, size * (p * (o_totalprice / 1e6 - gap)) - 0.02 * size * size AS utility, p FROM (SELECT *, greatest(0.01, least(0.99, 0.9 / (1 + 1.6 * gap / 0.02))) AS p
        FROM orders, (VALUES (0.002), (0.004), (0.006), (0.010), (0.015), (0.020), (0.030), (0.040), (0.050)) g(gap), (VALUES (0.25), (0.50), (0.75), (1.00), (1.25), (1.50), (2.00)) s(size)))
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY round(utility, 12) DESC, gap, size) = 1""")
def quote_grid_argmax(t: Tables) -> DataFrame:
    """Best of a grid of nine gaps and seven sizes, chosen inside the row."""
    gaps, sizes = [0.002, 0.004, 0.006, 0.010, 0.015, 0.020, 0.030, 0.040, 0.050], [0.25, 0.50, 0.75, 1.00, 1.25, 1.50, 2.00]
    grid = F.array(*(F.struct(F.lit(g).alias("gap"), F.lit(s).alias("size")) for g in gaps for s in sizes))

    def utility(x):
        p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), 0.9 / (1 + 1.6 * x["gap"] / 0.02)))
        return x["size"] * (p * (F.col("o_totalprice") / 1e6 - x["gap"])) - 0.02 * x["size"] * x["size"]

    best = F.array_max(F.transform(grid, lambda x: F.struct(F.round(utility(x), 12).alias("u"), (-x["gap"]).alias("g"), (-x["size"]).alias("s"))))
    return t.orders.withColumn("b", best).select("o_orderkey", r6(-F.col("b.g"), 4).alias("gap"), r6(-F.col("b.s"), 2).alias("size"), r6("b.u").alias("utility"))


@query("""
    WITH x AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT c_custkey, c_acctbal < 0 AS must, coalesce(spend, 0) AS spend, round(0.3 * coalesce(n, 0) + 0.7 * ln(1 + coalesce(spend, 0)), 6) AS score FROM customer LEFT JOIN x ON o_custkey = c_custkey)
    SELECT c_custkey, must, score FROM y ORDER BY must DESC, score DESC, c_custkey LIMIT 40""")
def active_set_score(t: Tables) -> DataFrame:
    """Must-haves first, then by score, up to a cap."""
    x = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count("*").alias("n"))
    out = t.customer.join(x, "c_custkey", "left").fillna(0, ["spend", "n"])
    score = r6(0.3 * F.col("n") + 0.7 * F.log(1 + F.col("spend")))
    return out.select("c_custkey", (F.col("c_acctbal") < 0).alias("must"), score.alias("score")).orderBy(F.desc("must"), F.desc("score"), "c_custkey").limit(40)


@query("""SELECT fee, slip, round(avg(l_discount - (fee + slip) / 10000.0), 8) AS net FROM lineitem, (VALUES (0), (5), (10)) f(fee), (VALUES (0), (3), (8)) s(slip) GROUP BY ALL""")
def cost_sensitivity_grid(t: Tables) -> DataFrame:
    """A grid of costs over one aggregate: the mean is taken once, not once a cell."""
    cells = F.array(*(F.struct(F.lit(f).alias("fee"), F.lit(s).alias("slip")) for f in (0, 5, 10) for s in (0, 3, 8)))
    return t.lineitem.agg(F.avg("l_discount").alias("m")).select("m", F.explode(cells).alias("c")).select("c.fee", "c.slip", r6(F.col("m") - (F.col("c.fee") + F.col("c.slip")) / 10000.0, 8).alias("net"))


@query("""
    WITH d AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM events), f AS (SELECT CAST(i AS INT) AS fold, 12 + i * 5 AS s FROM d, range(0, 20) r(i) WHERE 12 + i * 5 + 5 <= n)
    SELECT fold, CAST(greatest(0, s - 12) AS INT) AS train_from, CAST(s - 2 AS INT) AS train_to, CAST(s AS INT) AS test_from, CAST(s + 5 AS INT) AS test_to FROM f""")
def walk_forward_folds(t: Tables) -> DataFrame:
    n = t.events.select(F.to_date("ts").alias("d")).agg(F.count_distinct("d")).first()[0]
    return t.spark.createDataFrame(A.walk_forward(n, 10, 5, 2), "fold int, train_from int, train_to int, test_from int, test_to int")


#: The normal distribution function as its series of odd powers over double factorials, for arguments of moderate size.
PHI = "0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"


@query(f"""WITH r AS (SELECT l_returnflag, l_discount - 0.0499 AS r FROM lineitem), a AS (SELECT count(r) AS n, avg(r) AS m, var_samp(r) AS v FROM r),
    z AS (SELECT n, m / sqrt(greatest(v, 1e-12) / n) AS z1, m * 0.9 / sqrt(greatest(v + n * pow(m - m * 0.9, 2) / (n - 1), 1e-12) / n) AS z9 FROM a)
    SELECT n, round({PHI.format(z='z1')}, 6) AS psr, round({PHI.format(z='z9')}, 6) AS dsr FROM z""")
def sharpe_probability(t: Tables) -> DataFrame:
    """Probabilistic Sharpe ratio of discounts over about their mean."""
    out = A.sharpe_probability(t.lineitem.select((F.col("l_discount") - 0.0499).alias("r")), "r")
    return out.select("n", r6("psr").alias("psr"), r6("dsr").alias("dsr"))


@query("""SELECT o_orderpriority, round(sum(CASE WHEN up > 0 THEN w * up END) / sum(w), 6) AS up_part, round(sum(CASE WHEN up < 0 THEN w * up END) / sum(w), 6) AS down_part
    FROM (SELECT o_orderpriority, o_totalprice / 1e5 - 1.5 AS up, ln(1 + 10 * (o_orderkey % 7) / 7.0) AS w FROM orders) GROUP BY 1""")
def similarity_weighted_moves(t: Tables) -> DataFrame:
    """Expected upward and downward parts under logarithmic similarity weights."""
    rows = t.orders.select("o_orderpriority", (F.col("o_totalprice") / 1e5 - 1.5).alias("up"), F.log1p(10 * (F.col("o_orderkey") % 7) / 7.0).alias("w"))
    part = lambda c: r6(F.sum(F.when(c, F.col("w") * F.col("up"))) / F.sum("w"))
    return rows.groupBy("o_orderpriority").agg(part(F.col("up") > 0).alias("up_part"), part(F.col("up") < 0).alias("down_part"))


@query("""
    WITH g AS (SELECT o_orderpriority AS preset, o_orderstatus AS axis, avg(o_totalprice) AS m FROM orders GROUP BY ALL), r AS (SELECT m FROM g WHERE preset = '1-URGENT' AND axis = 'F')
    SELECT preset, axis, round(g.m - r.m, 2) AS delta FROM g, r""")
def preset_deltas(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.col("o_orderpriority").alias("preset"), F.col("o_orderstatus").alias("axis")).agg(F.avg("o_totalprice").alias("m"))
    reference = F.max(F.when((F.col("preset") == "1-URGENT") & (F.col("axis") == "F"), F.col("m"))).over(Window.partitionBy(F.lit(1)))  # a row for each preset and axis
    return g.select("preset", "axis", r6(F.col("m") - reference, 2).alias("delta"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders QUALIFY place <= 3""")
def cross_sectional_rank(t: Tables) -> DataFrame:
    return R.top_per(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", "place")
