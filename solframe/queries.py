"""Registered queries over the stand-in tables, each beside its SQL.

Power is events.value, time is events.ts, a long series is the daily mean of orders, studies are customers and parts;
places and weather are simple arithmetic on keys and on lineitem columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import bootstrap, climate, curves, geo, modules, stats, timeseries
from .plans import requests
from .plans.predicates import FilterSpec, exclude, filter_tree, restrict
from .sources import readers, sinks
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(column, digits: int = 4):
    return F.round(column, digits)


def long(column):
    return column.cast("long")


def _holed(t) -> DataFrame:
    """Events whose value is NaN in every thirteenth row."""
    return t("events").withColumn("value", F.when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value")))


HOLED = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events)"


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 5, 8, 13)")
def filter_membership(t):
    spec = FilterSpec(members={"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3, 5, 8, 13]})
    return spec.apply(t("customer")).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_discount <= 0.05")
def filter_ranges(t):
    spec = FilterSpec(ranges={"l_quantity": (10, 20), "l_discount": (None, 0.05)})
    return spec.apply(t("lineitem")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT p_partkey FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS faults, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice * 10 END AS watts FROM part)
WHERE length(faults) > 0 AND (watts BETWEEN 9000 AND 14000 OR watts IS NULL)""")
def filter_reported(t):
    part = t("part").withColumn("faults", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")))
    part = part.withColumn("watts", F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice") * 10))
    return FilterSpec(texts={"faults": (True, False)}, amounts={"watts": (True, True, 9, 14)}).apply(part).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE false")
def filter_empty_selection(t):
    return FilterSpec(members={"c_mktsegment": []}).apply(t("customer")).select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR (c_nationkey != 3 AND c_acctbal <= 100))")
def predicate_tree_and_or(t):
    node = {"logic": "AND", "conditions": [
        {"column": "c_mktsegment", "operator": "==", "value": "BUILDING"},
        {"logic": "OR", "conditions": [
            {"column": "c_acctbal", "operator": ">", "value": 5000},
            {"logic": "AND", "conditions": [{"column": "c_nationkey", "operator": "!=", "value": 3}, {"column": "c_acctbal", "operator": "<=", "value": 100}]},
        ]},
    ]}
    return filter_tree(t("customer"), node).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'st') AND p_size >= 20")
def predicate_contains(t):
    node = {"conditions": [{"column": "p_type", "operator": "contains", "value": "ST"}, {"column": "p_size", "operator": ">=", "value": 20}]}
    return filter_tree(t("part"), node).select("p_partkey", "p_type")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def predicate_unknown_column(t):
    node = {"logic": "AND", "conditions": [
        {"column": "nowhere", "operator": "==", "value": 1}, {"column": "c_name", "operator": "~", "value": 1},
        {"logic": "OR", "conditions": []}, {"column": "c_acctbal", "operator": "<", "value": 0},
    ]}
    return filter_tree(t("customer"), node).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def id_semi_join(t):
    ids = t("customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return restrict(t("orders"), ids, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def id_anti_join(t):
    ids = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return exclude(t("orders"), ids, "o_custkey").select("o_orderkey")


@query("""SELECT s_suppkey, s_name, lat, lon FROM (SELECT s_suppkey, s_name, ((s_suppkey * 29) % 1300 / 10 - 65)::DOUBLE AS lat, ((s_suppkey % 40 * 71) % 3300 / 10 - 165)::DOUBLE AS lon FROM supplier)
WHERE lat = -15.0 AND lon = -71.0 ORDER BY s_suppkey LIMIT 1""")
def point_lookup(t):
    """The first row at an exact place."""
    k = F.col("s_suppkey")
    s = t("supplier").select("s_suppkey", "s_name", ((k * 29) % 1300 / 10 - 65).cast("double").alias("lat"), ((k % 40 * 71) % 3300 / 10 - 165).cast("double").alias("lon"))
    return s.filter((F.col("lat") == -15.0) & (F.col("lon") == -71.0)).orderBy("s_suppkey").limit(1)


@query("SELECT c_custkey FROM customer WHERE c_acctbal / 500 BETWEEN -20 AND 5 AND c_nationkey * 2 BETWEEN 0 AND 50 AND (c_custkey * 700.0 BETWEEN 0 AND 500000 OR c_custkey % 9 = 0) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_defaults(t):
    k = F.col("c_custkey")
    df = t("customer").withColumns({"rate": F.col("c_acctbal") / 500, "years": F.col("c_nationkey") * 2, "watts": F.when(k % 9 != 0, k * 700.0)})
    return FilterSpec.defaults({"c_mktsegment": ["BUILDING", "MACHINERY"]}, "rate", "years", "watts").apply(df).select("c_custkey")


@query("SELECT event_id, value FROM events WHERE event_id % 13 <> 0 AND value >= 50")
def filter_nan_bounds(t):
    return FilterSpec(ranges={"value": (50, None)}).apply(_holed(t)).select("event_id", "value")


@query("SELECT p_partkey FROM (SELECT *, try_cast(CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS DOUBLE) AS x FROM part) WHERE coalesce(x > 20, false) AND coalesce(x <> 33, true) AND p_size < 45")
def predicate_text_and_numbers(t):
    """Text meets a number as a number; a number meets text that is one; a value that never compares passes "!=" only."""
    df = t("part").withColumn("x", F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string")))
    node = {"logic": "AND", "conditions": [
        {"column": "x", "operator": ">", "value": 20}, {"column": "x", "operator": "!=", "value": 33},
        {"column": "p_size", "operator": "<", "value": "45"}, {"column": "p_size", "operator": "!=", "value": "many"},
    ]}
    return filter_tree(df, node).select("p_partkey")


# --- distributions ---------------------------------------------------------------------------------------------------


@query("SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std FROM customer")
def summary_stats(t):
    return stats.summary(t("customer"), "c_acctbal").select("n", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"))


@query("SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std FROM customer GROUP BY 1")
def summary_stats_by_group(t):
    return stats.summary(t("customer"), "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", "n", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"))


@query("SELECT p, round(quantile, 4) AS quantile FROM (SELECT unnest([0.25, 0.75, 0.995, 0.999, 1.0])::DOUBLE AS p, unnest(quantile_cont(l_extendedprice, [0.25, 0.75, 0.995, 0.999, 1.0])) AS quantile FROM lineitem)")
def quantiles_linear(t):
    return stats.quantiles(t("lineitem"), "l_extendedprice", [0.25, 0.75, 0.995, 0.999, 1.0]).select("p", r("quantile").alias("quantile"))


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
SELECT c_mktsegment, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer JOIN q USING (c_mktsegment)
WHERE c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def box_stats(t):
    return stats.box(t("customer"), "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", r("q1").alias("q1"), r("median").alias("median"), r("q3").alias("q3"), "low", "high")


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def histogram_equal_width(t):
    return stats.histogram(t("events"), "value", 50)


@query("""WITH b AS (SELECT max(l_extendedprice) * 0.6 AS lo, max(l_extendedprice) + 1 AS hi FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM lineitem, b WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1)
SELECT g.bin::INT AS bin, round(lo + g.bin * ((hi - lo) / 40), 4) AS "left", coalesce(n, 0)::BIGINT AS n FROM range(40) g(bin), b LEFT JOIN c ON c.bin = g.bin""")
def histogram_edges(t):
    v = F.max("l_extendedprice")
    return stats.histogram_edges(t("lineitem"), "l_extendedprice", v * 0.6, v + 1, 40).select("bin", r("left").alias("left"), "n")


@query("""SELECT 'value' AS series, floor(value)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'half' AS series, floor(value / 2)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 2""")
def histogram_unit(t):
    return stats.histogram_unit(t("events").withColumn("half", F.col("value") / 2), "value", "half")


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) / ((hi - lo) / 25)), 24)::INT AS bin, count(*) AS n, round(count(*) / 18.0 * 0.5, 4)::DOUBLE AS hours_per_year FROM events, b GROUP BY 1""")
def histogram_hours_per_year(t):
    out = stats.hours_per_year(stats.histogram(t("events"), "value", 25), 18.0, 0.5)
    return out.withColumn("hours_per_year", r("hours_per_year"))


@query("""WITH s AS (SELECT count(c_acctbal) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * pow(count(c_acctbal), -0.2) AS h FROM customer),
g AS (SELECT i::INT AS i, lo + i * (hi - lo) / 199 AS x, n, h FROM range(200) r(i), s)
SELECT i, round(x, 4) AS x, round(1e4 * sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) / (n * h * sqrt(2 * pi())), 5) AS density FROM g, customer GROUP BY i, x, n, h""")
def kde_grid(t):
    return stats.density(t("customer"), "c_acctbal", 200).select("i", r("x").alias("x"), r(F.col("density") * 1e4, 5).alias("density"))


@query("SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM customer GROUP BY 1")
def category_share(t):
    return stats.share(t("customer"), "c_mktsegment").withColumn("share", r("share", 6))


@query("""WITH w AS (SELECT p_partkey, pos, list[pos] AS token FROM (SELECT p_partkey, string_split(replace(p_name, 'a', ', '), ',') AS list FROM part), unnest(range(1, len(list) + 1)) u(pos))
SELECT token, count(*) AS n FROM w WHERE lower(trim(token)) NOT IN ('', 'not reported', 'na', 'n/a', 'none') GROUP BY token ORDER BY n DESC, min((p_partkey, pos)) LIMIT 8""")
def topk_tokens(t):
    return stats.top_tokens(t("part"), F.split(F.replace("p_name", F.lit("a"), F.lit(", ")), ","), "p_partkey")


@query("SELECT round(regr_slope(value, epoch(ts) / 86400.0), 6) AS slope, round(regr_intercept(value, epoch(ts) / 86400.0 - 19723), 4) AS intercept FROM events")
def linear_slope(t):
    days = timeseries.seconds(F.col("ts")) / 86400.0
    a = stats.slope(t("events"), F.col("value"), days).select(r("slope", 6).alias("slope"))
    b = stats.slope(t("events"), F.col("value"), days - 19723).select(r("intercept").alias("intercept"))
    return a.crossJoin(F.broadcast(b))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE w IS NULL OR p_name IS NULL) AS rows_with_null, count(*) FILTER (WHERE p_name IS NULL) AS null_p_name, count(*) FILTER (WHERE w IS NULL) AS null_w
FROM (SELECT p_name, CASE WHEN p_size % 7 <> 0 THEN p_size END AS w FROM part)""")
def null_audit(t):
    return stats.null_audit(t("part").select("p_name", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("w")))


@query("SELECT * FROM (VALUES ('events', true), ('numbered', false), ('symbols', false)) v(headers, valid)")
def header_validation(t):
    rows = [("events", t("events").columns), ("numbered", ["0", "1"]), ("symbols", ["-", "12"])]
    events = t("events")
    return events.sparkSession.createDataFrame([(n, stats.valid_headers(h)) for n, h in rows], "headers string, valid boolean")


@query(f"SELECT count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS std FROM {HOLED}")
def summary_stats_nan(t):
    return stats.summary(_holed(t), "value").select("n", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"))


@query(f"""WITH e AS {HOLED}, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)
SELECT CASE WHEN value IS NULL THEN 'NaN' WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'Outlier' ELSE 'Normal' END AS status, count(*) AS n FROM e, q GROUP BY 1""")
def iqr_status_nan(t):
    return timeseries.status_counts(_holed(t), "value")


@query("SELECT i::INT AS i, 2.0::DOUBLE AS x, NULL::DOUBLE AS density FROM range(20) g(i)")
def kde_constant(t):
    return stats.density(t("region").withColumn("v", F.lit(2.0)), "v", 20)


@query("""SELECT g.bin::INT AS bin, 1.5 + g.bin * 0.25::DOUBLE AS "left", CASE WHEN g.bin = 2 THEN (SELECT count(*) FROM region) ELSE 0 END::BIGINT AS n FROM range(4) g(bin)""")
def histogram_edges_constant(t):
    return stats.histogram_edges(t("region").withColumn("v", F.lit(2.0)), "v", F.min("v"), F.max("v"), 4)


BINS = "b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM events, b GROUP BY 1)"


@query(f"WITH {BINS} SELECT max(n) AS max_n FROM c")
def tallest_bin(t):
    return stats.tallest_bin(t("events"), "value", 50)


@query("""WITH s AS (SELECT count(c_acctbal) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * pow(count(c_acctbal), -0.2) AS h FROM customer),
g AS (SELECT i::INT AS i, lo + i * (hi - lo) / 99 AS x, h FROM range(100) r(i), s), d AS (SELECT i, sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) AS density FROM g, customer GROUP BY i),
c AS (SELECT count(*) AS n FROM customer, s GROUP BY least(floor((c_acctbal - lo) / ((hi - lo) / 50)), 49))
SELECT i, round(density / (SELECT max(density) FROM d) * (SELECT max(n) FROM c), 4) AS scaled FROM d""")
def kde_scaled(t):
    return stats.scaled_density(t("customer"), "c_acctbal", 100, 50).select("i", r("scaled").alias("scaled"))


@query("""WITH b AS (SELECT max(l_extendedprice) * 0.6 AS lo, max(l_extendedprice) + 1 AS hi FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM lineitem, b WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1),
h AS (SELECT lo + g.bin * ((hi - lo) / 40) AS l, coalesce(n, 0)::BIGINT AS n FROM range(40) g(bin), b LEFT JOIN c ON c.bin = g.bin),
m AS (SELECT r_name, 60000.0 + r_regionkey * 9000 AS x FROM region)
SELECT r_name, round(arg_min(l, (abs(l - x), l)), 4) AS "left", arg_min(n, (abs(l - x), l)) AS n FROM m, h GROUP BY 1""")
def nearest_bin(t):
    v = F.max("l_extendedprice")
    counts = stats.histogram_edges(t("lineitem"), "l_extendedprice", v * 0.6, v + 1, 40)
    marks = t("region").select("r_name", (60000.0 + F.col("r_regionkey") * 9000).alias("x"))
    return stats.nearest_bin(marks, "r_name", "x", counts).select("r_name", r("left").alias("left"), "n")


@query("""WITH q AS (SELECT quantile_cont(value, 0.999) AS p, min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::INT AS bin, sum(CASE WHEN value > p THEN 100.0 ELSE 1.0 END)::DOUBLE AS w FROM events, q GROUP BY 1""")
def rare_weighted_histogram(t):
    return stats.weighted_histogram(stats.rare_weights(t("events"), "value"), "value", "weight", 20)


@query("""SELECT c_mktsegment, count(c_acctbal) AS count_c_acctbal, round(avg(c_acctbal), 4) AS mean_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer WHERE c_nationkey > 5 GROUP BY 1""")
def analysis_request(t):
    node = {"column": "c_nationkey", "operator": ">", "value": 5}
    out = requests.AnalysisSpec(["count", "mean", "max"], ["c_acctbal"], ["c_mktsegment"], node).apply(t("customer"))
    return out.withColumn("mean_c_acctbal", r("mean_c_acctbal"))


@query("SELECT * FROM (VALUES ('Power', 'AC_Power (W)'), ('Time', 'Timestamp'), ('DC Voltage', 'Vdc'), ('DC Current', 'N/A')) v(metric, variable)")
def column_binding(t):
    return requests.binding_table(t("region").sparkSession, ["Timestamp", "Vdc", "AC_Power (W)", "Module Temperature"])


@query("SELECT * FROM (VALUES ('count', (SELECT count(*)::VARCHAR FROM customer)), ('median', 'N/A')) v(metric, value)")
def required_metrics(t):
    found = t("customer").agg(F.count(F.lit(1)).alias("value")).select(F.lit("count").alias("metric"), "value")
    return requests.fill_required(found, ["count", "median"])


# --- time series -----------------------------------------------------------------------------------------------------

PEAKS = "SELECT ts::DATE::VARCHAR AS day, hour(arg_max(ts, (value, -epoch_us(ts))))::INT AS peak_hour FROM events GROUP BY 1"


@query(PEAKS)
def daily_peak_hour(t):
    return timeseries.daily_peak(t("events"), "ts", "value").withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT round(avg(peak_hour), 6) AS mean_peak, CASE WHEN avg(peak_hour) < 9 THEN '+1 hour' WHEN avg(peak_hour) > 15 THEN '-1 hour' ELSE 'OK' END AS "offset" FROM ({PEAKS})""")
def tz_offset_class(t):
    return timeseries.offset_class(t("events"), "ts", "value").withColumn("mean_peak", r("mean_peak", 6))


@query("SELECT g.h::INT AS hour, count(e.ts) AS n, count(e.ts) = 0 AS missing, count(e.ts) > 420 AS duplicated FROM range(24) g(h) LEFT JOIN events e ON hour(e.ts) = g.h GROUP BY 1")
def hour_presence(t):
    return timeseries.hour_presence(t("events"), "ts", 420)


@query(f"""WITH o AS (SELECT CASE WHEN avg(peak_hour) < 9 THEN 1 WHEN avg(peak_hour) > 15 THEN -1 ELSE 0 END AS s FROM ({PEAKS})),
m AS (SELECT event_id, ts + s * INTERVAL 1 HOUR AS t FROM events, o),
d AS (SELECT CASE WHEN count(*) FILTER (WHERE hour(t) = 2) = 0 THEN 1 WHEN count(*) FILTER (WHERE hour(t) = 2) > 120 THEN -1 ELSE 0 END AS x FROM m)
SELECT event_id, epoch_us(t + x * INTERVAL 1 HOUR) AS fixed_us FROM m, d""")
def tz_shifted_series(t):
    return timeseries.repair_clock(t("events"), "ts", "value").select("event_id", F.unix_micros("fixed_ts").alias("fixed_us"))


IQR = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query(f"SELECT event_id, value FROM events, {IQR} WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def iqr_outliers(t):
    return timeseries.iqr_flags(t("events"), "value").filter("outlier").select("event_id", "value")


@query("""WITH e AS (SELECT CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events), q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)
SELECT CASE WHEN value IS NULL THEN 'NaN' WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'Outlier' ELSE 'Normal' END AS status, count(*) AS n FROM e, q GROUP BY 1""")
def iqr_status_counts(t):
    return timeseries.status_counts(t("events").withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value"))), "value")


@query(f"""WITH f AS (SELECT ts, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS o FROM events, {IQR})
SELECT count(*) AS total, 0::BIGINT AS with_null, count(*) FILTER (WHERE o) AS outliers, count(*) - count(*) FILTER (WHERE o) AS final,
round(epoch(max(ts) - min(ts)) / (365.25 * 86400), 6) AS years, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM f""")
def data_summary(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return timeseries.data_summary(t("events").select("ts", "value"), "ts", "value").select("total", "with_null", "outliers", "final", r("years", 6).alias("years"), us("first"), us("last"))


def _daily(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("series")).agg(F.avg("o_totalprice").alias("value"))


DAILY = "daily AS (SELECT o_orderdate AS ts, o_orderstatus AS series, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


@query(f"""WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS nth, count(*) OVER (PARTITION BY series) AS n FROM daily),
b AS (SELECT series, avg(value) FILTER (WHERE nth <= greatest(1, floor(n * 0.1))) AS baseline, min(ts) AS t0 FROM n GROUP BY 1)
SELECT series, epoch_us(ts) AS ts, round(value, 5) AS value, round(baseline, 5) AS baseline, round(baseline - 0.005 * baseline * epoch(ts - t0) / (365.25 * 86400), 5) AS trend FROM daily JOIN b USING (series)""")
def baseline_trend(t):
    out = timeseries.trend(_daily(t), ["series"], "ts", "value", -0.5)
    return out.select("series", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), r("value", 5).alias("value"), r("baseline", 5).alias("baseline"), r("trend", 5).alias("trend"))


def _yoy(days: int) -> str:
    return f"""WITH {DAILY}, s AS (SELECT series, ts, epoch(ts)::BIGINT AS s, value FROM daily), f AS (SELECT series, min(s) AS s0 FROM s GROUP BY 1),
c AS (SELECT series, quantile_cont(value, 0.5) AS c FROM s JOIN f USING (series) WHERE s < s0 + 364 * 86400 GROUP BY 1),
e AS (SELECT series, s, value / c AS e FROM s JOIN c USING (series)),
p AS (SELECT a.series, a.s, arg_max(b.s, b.s) AS s0, arg_max(b.e, b.s) AS e0, any_value(a.e) AS e FROM e a JOIN e b ON a.series = b.series AND b.s + 31536000 <= a.s AND a.s - b.s - 31536000 <= {days} * 86400 GROUP BY 1, 2)
SELECT series, s AS ts, s0 AS earlier, round(100 * (e - e0) / ((s - s0) / 31536000.0), 4) AS rate FROM p"""


def _rates(t, days: int) -> DataFrame:
    s = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return timeseries.year_on_year(_daily(t), ["series"], "ts", "value", days).select("series", s("ts").alias("ts"), s("earlier_ts").alias("earlier"), r("rate").alias("rate"))


@query(_yoy(0))
def yoy_exact(t):
    return _rates(t, 0)


@query(_yoy(8))
def yoy_asof_tolerance(t):
    return _rates(t, 8)


RATES = _yoy(8).replace("SELECT series, s AS ts, s0 AS earlier, round(100 * (e - e0) / ((s - s0) / 31536000.0), 4) AS rate FROM p", "rates AS (SELECT series, s, s0, 100 * (e - e0) / ((s - s0) / 31536000.0) AS rate FROM p)").rstrip() + ", "
RATES = RATES.replace("\nrates AS", ",\nrates AS")
ENDS = """med AS (SELECT series, r, quantile_cont(rate, 0.5) AS q FROM x GROUP BY 1, 2),
ci AS (SELECT series, quantile_cont(q, 0.159) AS low, quantile_cont(q, 0.841) AS high, quantile_cont(q, 0.05) AS level FROM med GROUP BY 1),
fin AS (SELECT series, quantile_cont(rate, 0.5) AS rate, count(*) AS pairs FROM rates GROUP BY 1)
SELECT fin.series, round(rate, 4) AS rate, pairs, round(low, 4) AS low, round(high, 4) AS high, round(level, 4) AS exceedance_level FROM fin LEFT JOIN ci ON fin.series IS NOT DISTINCT FROM ci.series"""


def _hash(x: str) -> str:
    """The integer mix of `bootstrap.hashed` in SQL."""
    a = f"((({x}) % 2147483648 * 1103515245 + 12345) % 2147483648)"
    b = f"((xor({a}, {a} >> 16) * 1540483477 + 7) % 2147483648)"
    return f"xor({b}, {b} >> 15)"


def _interval(t, method: str) -> DataFrame:
    rates = timeseries.year_on_year(_daily(t), ["series"], "ts", "value", 8)
    return bootstrap.interval(rates, ["series"], method=method).select("series", r("rate").alias("rate"), "pairs", *(r(c).alias(c) for c in ("low", "high", "exceedance_level")))


@query(f"""{RATES}h AS (SELECT series, rate, {_hash('s % 2147483648 + 1000003')} AS h FROM rates), u AS (SELECT series, rate, g.r, {_hash('h + g.r * 7919')} AS u FROM h, range(1, 201) g(r)),
x AS (SELECT series, r, rate FROM (SELECT *, (u >= 790015084)::INT + (u >= 1580030169)::INT + (u >= 1975037711)::INT + (u >= 2106706892)::INT + (u >= 2139624187)::INT + (u >= 2146207646)::INT AS w FROM u), unnest(range(w)) k(i)),
{ENDS}""")
def degradation_rate(t):
    """Median rate, interval and exceedance level from 200 resamples of single pairs."""
    return _interval(t, "simple")


@query(f"""{RATES}span AS (SELECT series, floor(min(s) / 86400)::BIGINT AS f, floor(max(s) / 86400)::BIGINT - floor(min(s) / 86400)::BIGINT + 1 AS d FROM rates GROUP BY 1),
dr AS (SELECT series, d, g.r, b, {_hash(_hash('g.r * 100003 + 1') + ' + b * 7919')} % d AS st FROM span, range(1, 201) g(r), unnest(range(1, ceil(d / 30.0)::BIGINT + 1)) k(b) WHERE d > 90),
w AS (SELECT series, r, (st + z.o) % d AS day, count(*) AS w FROM dr, range(30) z(o) GROUP BY 1, 2, 3),
x AS (SELECT series, r, rate FROM (SELECT rates.series, w.r, rates.rate, w.w FROM rates JOIN span USING (series) JOIN w ON w.series = rates.series AND w.day = floor(s / 86400)::BIGINT - f), unnest(range(w)) k(i)),
{ENDS}""")
def degradation_rate_blocks(t):
    """The same from circular blocks of 30 days."""
    return _interval(t, "circular_block")


@query(f"""{RATES}u AS (SELECT series, s FROM rates UNION ALL SELECT series, s0 FROM rates), used AS (SELECT series, s, count(*) AS n FROM u GROUP BY 1, 2)
SELECT d.series, d.ts::DATE::VARCHAR AS day, coalesce(n, 0) AS usage FROM daily d LEFT JOIN used ON used.series = d.series AND used.s = epoch(d.ts)::BIGINT""")
def usage_of_points(t):
    daily = _daily(t)
    rates = timeseries.year_on_year(daily, ["series"], "ts", "value", 8)
    return bootstrap.usage_of_points(daily, rates, ["series"], "ts").select("series", F.to_date("ts").cast("string").alias("day"), "usage")


def _unnamed(t) -> DataFrame:
    """Daily series of which one has no name, with NaN on every seventh day of the month."""
    value = F.when(F.dayofmonth("ts") % 7 == 0, float("nan")).otherwise(F.col("value"))
    return _daily(t).withColumn("series", F.when(F.col("series") != "O", F.col("series"))).withColumn("value", value)


UNNAMED = "u AS (SELECT ts, nullif(series, 'O') AS series, CASE WHEN day(ts) % 7 <> 0 THEN value END AS value FROM daily)"


@query(f"""WITH {DAILY}, {UNNAMED}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, value) AS nth, count(*) OVER (PARTITION BY series) AS n FROM u WHERE value IS NOT NULL),
b AS (SELECT series, avg(value) FILTER (WHERE nth <= greatest(1, floor(n * 0.1))) AS baseline, min(ts) AS t0 FROM n GROUP BY 1)
SELECT u.series, epoch_us(ts) AS ts, round(baseline, 5) AS baseline, round(baseline - 0.005 * baseline * epoch(ts - t0) / (365.25 * 86400), 5) AS trend FROM u JOIN b ON u.series IS NOT DISTINCT FROM b.series""")
def trend_null_series(t):
    out = timeseries.trend(_unnamed(t), ["series"], "ts", "value", -0.5)
    return out.select("series", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), r("baseline", 5).alias("baseline"), r("trend", 5).alias("trend"))


@query(f"""WITH {DAILY}, {UNNAMED}, s AS (SELECT coalesce(series, '') AS series, epoch(ts)::BIGINT AS s, value FROM u WHERE value IS NOT NULL), f AS (SELECT series, min(s) AS s0 FROM s GROUP BY 1),
c AS (SELECT series, quantile_cont(value, 0.5) AS c FROM s JOIN f USING (series) WHERE s < s0 + 364 * 86400 GROUP BY 1), e AS (SELECT series, s, value / c AS e FROM s JOIN c USING (series)),
p AS (SELECT a.series, a.s, arg_max(b.s, b.s) AS s0, arg_max(b.e, b.s) AS e0, any_value(a.e) AS e FROM e a JOIN e b ON a.series = b.series AND b.s + 31536000 <= a.s AND a.s - b.s - 31536000 <= 8 * 86400 GROUP BY 1, 2)
SELECT nullif(series, '') AS series, s AS ts, s0 AS earlier, round(100 * (e - e0) / ((s - s0) / 31536000.0), 4) AS rate FROM p""")
def yoy_null_series(t):
    s = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return timeseries.year_on_year(_unnamed(t), ["series"], "ts", "value", 8).select("series", s("ts").alias("ts"), s("earlier_ts").alias("earlier"), r("rate").alias("rate"))


@query("""WITH o AS (SELECT nullif(o_orderstatus, 'O') AS status, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS price FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY o_orderdate, o_orderkey) AS p FROM o), m AS (SELECT status, arg_max(p, (price, -p)) AS top FROM n WHERE price IS NOT NULL GROUP BY 1)
SELECT n.status, o_orderkey, p - top AS "offset" FROM n JOIN m ON n.status IS NOT DISTINCT FROM m.status WHERE abs(p - top) <= 10""")
def argmax_null_series(t):
    price = F.when(F.col("o_orderkey") % 13 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    o = t("orders").select(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"), "o_orderdate", "o_orderkey", price.alias("price"))
    return timeseries.around_argmax(o, ["status"], ["o_orderdate", "o_orderkey"], "price", 10).select("status", "o_orderkey", long(F.col("offset")).alias("offset"))


@query("SELECT o_orderstatus, round(avg(least), 4) AS mean_minimum, min(least) AS minimum FROM (SELECT o_orderstatus, year(o_orderdate) AS y, min(o_totalprice) AS least FROM orders GROUP BY 1, 2) GROUP BY 1")
def yearly_min_mean(t):
    return timeseries.yearly_minimum_mean(t("orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"]).withColumn("mean_minimum", r("mean_minimum"))


@query("""WITH p AS (SELECT quantile_cont(o_totalprice, 0.995) AS p FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders, p WHERE o_totalprice > p * 0.9975 AND o_totalprice < p * 1.0025 ORDER BY o_custkey, o_orderkey LIMIT 1""")
def percentile_band_argmin(t):
    return timeseries.band_argmin(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_custkey", "o_orderkey", 99.5, 0.0025)


@query("""WITH n AS (SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
m AS (SELECT o_orderstatus, arg_max(p, (o_totalprice, -p)) AS top FROM n GROUP BY 1)
SELECT o_orderstatus, o_orderkey, o_totalprice, p - top AS "offset" FROM n JOIN m USING (o_orderstatus) WHERE abs(p - top) <= 100""")
def argmax_window(t):
    out = timeseries.around_argmax(t("orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "o_totalprice", 100)
    return out.select("o_orderstatus", "o_orderkey", "o_totalprice", long(F.col("offset")).alias("offset"))


# --- places ----------------------------------------------------------------------------------------------------------

HAVERSINE = "12742 * asin(sqrt(least(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2), 1)))"
NATIONS = "n AS (SELECT n_nationkey, ((n_nationkey * 37) % 120 - 60)::DOUBLE AS lat, ((n_nationkey * 53) % 300 - 150)::DOUBLE AS lon FROM nation)"
SUPPLIERS = "s AS (SELECT s_suppkey, s_nationkey, ((s_suppkey * 29) % 1300 / 10 - 65)::DOUBLE AS lat, ((s_suppkey * 71) % 3300 / 10 - 165)::DOUBLE AS lon FROM supplier)"
KM = HAVERSINE.format(a="n.lat", b="n.lon", c="s.lat", d="s.lon")


def _nations(t) -> DataFrame:
    k = F.col("n_nationkey")
    return t("nation").select("n_nationkey", ((k * 37) % 120 - 60).cast("double").alias("lat"), ((k * 53) % 300 - 150).cast("double").alias("lon"))


def _suppliers(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select("s_suppkey", "s_nationkey", ((k * 29) % 1300 / 10 - 65).cast("double").alias("lat"), ((k * 71) % 3300 / 10 - 165).cast("double").alias("lon"))


@query(f"WITH {NATIONS}, {SUPPLIERS} SELECT s_suppkey, n_nationkey, round({KM}, 4) AS km FROM s, n")
def haversine_matrix(t):
    n = _nations(t).select("n_nationkey", F.col("lat").alias("a"), F.col("lon").alias("b"))
    j = _suppliers(t).crossJoin(F.broadcast(n))  # every place with each of 25
    return j.select("s_suppkey", "n_nationkey", r(geo.haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lon"))).alias("km"))


NEAREST = f"near AS (SELECT n_nationkey, arg_min(s_suppkey, ({KM}, s_suppkey)) AS s_suppkey, min({KM}) AS km FROM n, s GROUP BY 1)"


@query(f"WITH {NATIONS}, {SUPPLIERS}, {NEAREST} SELECT n_nationkey, s_suppkey, round(km, 4) AS km FROM near")
def nearest_point(t):
    return geo.nearest(_nations(t), _suppliers(t), "n_nationkey", "s_suppkey").withColumn("km", r("km"))


@query(f"WITH {NATIONS}, {SUPPLIERS}, {NEAREST} SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM near)")
def nearest_semi_join(t):
    ids = geo.nearest(_nations(t), _suppliers(t), "n_nationkey", "s_suppkey").select(F.col("s_suppkey").alias("l_suppkey"))
    return restrict(t("lineitem"), ids, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query(f"WITH {SUPPLIERS} SELECT s_suppkey, round(km, 4) AS km, km <= 2000 * 1.609344 AS inside FROM (SELECT s_suppkey, {HAVERSINE.format(a='10.0', b='20.0', c='lat', d='lon')} AS km FROM s)")
def radius_split(t):
    return geo.within_radius(_suppliers(t), 10.0, 20.0, 2000).select("s_suppkey", r("km").alias("km"), "inside")


@query(f"WITH {SUPPLIERS} SELECT s_suppkey FROM s WHERE {HAVERSINE.format(a='10.0', b='20.0', c='lat', d='lon')} <= 2000 * 1.609344")
def radius_filter(t):
    return geo.within_radius(geo.bounding_box(_suppliers(t), 10.0, 20.0, 2000), 10.0, 20.0, 2000).filter("inside").select("s_suppkey")


@query(f"WITH {NATIONS}, {SUPPLIERS} SELECT n_nationkey, s_suppkey, round({KM}, 4) AS km FROM n, s WHERE {KM} <= 900 * 1.609344")
def radius_join(t):
    return geo.radius_join(_nations(t), _suppliers(t), "n_nationkey", "s_suppkey", 900).withColumn("km", r("km"))


@query(f"WITH {NATIONS}, {SUPPLIERS} SELECT n_nationkey, arg_min(s_suppkey, (sqrt(pow(n.lat - s.lat, 2) + pow(n.lon - s.lon, 2)), s_suppkey)) AS s_suppkey, round(min(sqrt(pow(n.lat - s.lat, 2) + pow(n.lon - s.lon, 2))), 4) AS degrees FROM n, s GROUP BY 1")
def nearest_in_degrees(t):
    return geo.nearest_in_degrees(_nations(t), _suppliers(t), "n_nationkey", "s_suppkey").withColumn("degrees", r("degrees"))


@query(f"WITH {NATIONS}, {SUPPLIERS}, {NEAREST} SELECT s_suppkey, l_orderkey, l_linenumber FROM lineitem JOIN (SELECT s_suppkey FROM near WHERE n_nationkey = 7) ON l_suppkey = s_suppkey")
def weather_of_nearest(t):
    """Rows of the place nearest to one point: its key is found first, and only its rows are read."""
    near = geo.nearest(_nations(t).filter("n_nationkey = 7"), _suppliers(t), "n_nationkey", "s_suppkey").select("s_suppkey")
    li = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber")
    return li.join(F.broadcast(near), "s_suppkey")


@query("SELECT (i * 8 + j)::BIGINT AS cell, 30 + i * 2.5::DOUBLE AS lat, -100 + j * 5.0::DOUBLE AS lon FROM range(4) a(i), range(8) b(j)")
def latlon_grid(t):
    return geo.grid(t("region").sparkSession, (30, 40, 2.5), (-100, -60, 5))


@query(f"""WITH {NATIONS} SELECT n_nationkey, b::INT AS bearing, round(degrees(asin(sin(radians(lat)) * cos(100 / 6371.0) + cos(radians(lat)) * sin(100 / 6371.0) * cos(radians(b)))), 6) AS circle_lat,
round(lon + degrees(atan2(sin(radians(b)) * sin(100 / 6371.0) * cos(radians(lat)), cos(100 / 6371.0) - sin(radians(lat)) * (sin(radians(lat)) * cos(100 / 6371.0) + cos(radians(lat)) * sin(100 / 6371.0) * cos(radians(b))))), 6) AS circle_lon FROM n, range(0, 361, 30) g(b)""")
def circle_points(t):
    return geo.circle(_nations(t), F.col("lat"), F.col("lon"), 100.0, 30).select("n_nationkey", "bearing", r("circle_lat", 6).alias("circle_lat"), r("circle_lon", 6).alias("circle_lon"))


@query("SELECT p_partkey, round(greatest(1, least(12, 8 - log2(p_size * 0.7 / 10))), 6) AS zoom FROM part")
def zoom_levels(t):
    return t("part").select("p_partkey", r(geo.zoom(F.col("p_size").cast("double")), 6).alias("zoom"))


@query(f"""WITH {NATIONS}, {SUPPLIERS}, {NEAREST}, g AS (SELECT n_nationkey, s_acctbal AS balance, s_suppkey::DOUBLE AS rank FROM near JOIN supplier USING (s_suppkey))
SELECT n_nationkey, parameter, CASE parameter WHEN 'balance' THEN 'Balance, USD' ELSE parameter END AS label, printf('%.2f', number) AS value FROM g UNPIVOT (number FOR parameter IN (balance, rank))""")
def stressor_lookup(t):
    n = _nations(t)
    labels = n.sparkSession.createDataFrame([("balance", "Balance, USD")], "parameter string, label string")
    grid = _suppliers(t).join(t("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance")), "s_suppkey").withColumn("rank", F.col("s_suppkey"))
    return climate.stressor_lookup(n, grid, "n_nationkey", "s_suppkey", ["balance", "rank"], labels)


@query("SELECT 'T_equiv_' || m || '_' || replace(printf('%.1f', e / 10.0), '.', 'p') || 'eV' AS parameter, 'Equivalent temperature, ' || m || ', ' || printf('%.1f', e / 10.0) || ' eV' AS label FROM range(1, 22, 2) r(e), (VALUES ('rack'), ('roof')) v(m)")
def stressor_labels(t):
    return climate.energy_labels(t("region").sparkSession)


# --- details ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, attribute, value FROM (SELECT p_partkey, p_name AS name, p_brand AS brand, p_size || ' units' AS size FROM part) UNPIVOT (value FOR attribute IN (name, brand, size))")
def unpivot_details(t):
    wide = t("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.format_string("%d units", "p_size").alias("size"))
    return wide.unpivot("p_partkey", ["name", "brand", "size"], "attribute", "value")


@query("SELECT c_custkey, k AS key, CASE k WHEN 'a' THEN 'left' WHEN 'b' THEN c_mktsegment ELSE 'right' END AS value FROM customer, (VALUES ('a'), ('b'), ('c')) v(k)")
def merged_parameters(t):
    """Two maps of parameters, the right one first."""
    left, right = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.lit("left")), F.create_map(F.lit("b"), F.col("c_mktsegment"), F.lit("c"), F.lit("right"))
    return t("customer").select("c_custkey", F.explode(scalars.merged(left, right)).alias("key", "value"))


@query("SELECT p_partkey, 'Brand: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Size: ' || p_size ELSE '' END AS text, 'Price: ' || printf('%.2f', p_retailprice) AS label FROM part")
def map_tooltips(t):
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return t("part").select("p_partkey", scalars.tooltip(Brand=F.col("p_brand"), Size=size).alias("text"), F.concat(F.lit("Price: "), F.format_string("%.2f", "p_retailprice")).alias("label"))


@query("SELECT o_orderpriority, list_sum(flatten(list([year(o_orderdate), month(o_orderdate)])))::BIGINT AS total FROM orders GROUP BY 1")
def flattened_lists(t):
    """Lists of lists as one list, whose sum is taken before groups are joined."""
    each = t("orders").select("o_orderpriority", F.flatten(F.array(F.array(F.year("o_orderdate")), F.array(F.month("o_orderdate")))).alias("l"))
    return each.groupBy("o_orderpriority").agg(F.sum(F.aggregate("l", F.lit(0), lambda a, x: a + x)).alias("total"))


@query("SELECT n_nationkey, n_name, n_name AS decoded FROM nation")
def upload_round_trip(t):
    uri = F.concat(F.lit("data:text/csv;base64,"), F.base64(F.col("n_name").cast("binary")))
    return t("nation").select("n_nationkey", "n_name", readers.decoded_upload(uri).alias("decoded"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_rows(t):
    return sinks.json_rows(t("region").select("r_regionkey", "r_name"))


@query("SELECT n_nationkey, n_name, coalesce(r_name, 'N/A') AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def label_lookup(t):
    labels = t("region").filter("r_regionkey < 3")
    return t("nation").join(labels, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("N/A")).alias("label"))


@query("SELECT (row_number() OVER (ORDER BY r_name) - 1)::INT AS ordinal, r_name FROM region")
def ordinal_labels(t):
    names = t("region").agg(F.sort_array(F.collect_set("r_name")).alias("names"))  # a row for each zone, a handful
    return names.select(F.posexplode("names").alias("ordinal", "r_name"))


@query("SELECT n_nationkey, n_name AS name FROM nation UNION ALL SELECT NULL AS n_nationkey, r_name AS name FROM region")
def union_by_name(t):
    return readers.combine([t("nation").select("n_nationkey", F.col("n_name").alias("name")), t("region").select(F.col("r_name").alias("name"))])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
def paged_sorted(t):
    return sinks.page(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 2)


@query("SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, 'https?://[^\"<> ?#]+')) AS link FROM pages")
def link_extraction(t):
    return t("pages").select("page_id", F.explode(scalars.links(F.concat_ws(" ", "url", "html"), 'https?://[^"<> ?#]+')).alias("link"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS price, printf('%.0f', l_quantity) AS quantity FROM lineitem")
def formatted_columns(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.2f", "l_extendedprice").alias("price"), F.format_string("%.0f", "l_quantity").alias("quantity"))


# --- module physics --------------------------------------------------------------------------------------------------

WEATHER = "w AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS ghi, l_quantity / 5 AS wind, l_discount * 500 - 10 AS air, l_tax AS spill FROM lineitem)"
CELL = "(ghi * exp(-3.47 - 0.0594 * wind) + air + ghi / 1000 * 3)"
VOC = f"CASE WHEN ghi > 0 THEN greatest(48.5 + 72 * (1.05 * 1.38066e-23 * ({CELL} + 273.15) / 1.60218e-19) * ln(ghi / 1000) - 0.163 * ({CELL} - 25), 0) WHEN ghi = 0 THEN 0 END"


def _weather(t) -> DataFrame:
    li = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("ghi"), (F.col("l_quantity") / 5).alias("wind"), (F.col("l_discount") * 500 - 10).alias("air"), F.col("l_tax").alias("spill"))
    return li.withColumn("temp_cell", modules.cell_temperature(F.col("ghi"), F.col("wind"), F.col("air")))


def _voc(t) -> DataFrame:
    v = modules.sapm_voc(F.col("ghi"), F.col("temp_cell"), F.lit(48.5), F.lit(-0.163), F.lit(0.0), F.lit(72), F.lit(1.05))
    return _weather(t).withColumn("v_oc", v)


@query(f"WITH {WEATHER} SELECT l_orderkey, l_linenumber, round({CELL}, 4) AS temp_cell FROM w")
def cell_temperature(t):
    return _weather(t).select("l_orderkey", "l_linenumber", r("temp_cell").alias("temp_cell"))


@query(f"WITH {WEATHER} SELECT l_orderkey, l_linenumber, round(0.98 * (ghi * 0.7 * (1 - 0.05 * (1 / (1 - spill) - 1)) + 0.9 * ghi * 0.3), 4) AS e FROM w")
def effective_irradiance(t):
    loss = modules.incidence_loss(1 - F.col("spill"))
    e = modules.effective_irradiance(F.col("ghi") * 0.7, F.col("ghi") * 0.3, loss, F.lit(0.9), F.lit(0.98))
    return _weather(t).select("l_orderkey", "l_linenumber", r(e).alias("e"))


@query(f"WITH {WEATHER} SELECT l_orderkey, l_linenumber, round({VOC}, 4) AS v_oc FROM w")
def sapm_voc(t):
    return _voc(t).select("l_orderkey", "l_linenumber", r("v_oc").alias("v_oc"))


@query(f"WITH {WEATHER} SELECT l_orderkey, l_linenumber, floor(1500 * (1 - 0.023) / ({VOC}))::INT AS modules FROM w")
def string_length(t):
    return _voc(t).select("l_orderkey", "l_linenumber", modules.string_length(F.col("v_oc"), 1500, 0.023).alias("modules"))


@query(f"WITH {WEATHER} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN floor(1500 / nullif({VOC}, 0))::INT END AS modules FROM w")
def string_length_at_night(t):
    """Rows without light have no voltage and no string length."""
    v = F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col("v_oc"))
    return _voc(t).select("l_orderkey", "l_linenumber", modules.string_length(v, 1500).alias("modules"))


@query(f"WITH {WEATHER} SELECT round(max({VOC}) * 1.023, 4) AS plot_v FROM w")
def plot_voltage(t):
    return modules.plot_voltage(_voc(t), "v_oc", 0.023).select(r("plot_v").alias("plot_v"))


@query("""SELECT p_partkey, e, round(greatest(voco + 72 * (1.05 * 1.38066e-23 * 298.15 / 1.60218e-19) * ln(e / 1000), 0), 4) AS v_oc, round(e * (1 + 0.7 * 0.1), 4) AS both_sides
FROM (SELECT p_partkey, 40 + p_size / 5 AS voco FROM part), (VALUES (200.0::DOUBLE), (600.0), (1000.0)) g(e)""")
def parameter_sweep(t):
    """Each module at three irradiances and one temperature, parameters looked up by name."""
    library = t("part").select(F.col("p_name").alias("name"), "p_partkey", (40 + F.col("p_size") / 5).alias("voco"))
    found = modules.with_defaults(modules.lookup(t("part").select("p_partkey"), library, "p_partkey"))
    each = modules.sweep(found, [200, 600, 1000], 25)
    v = modules.sapm_voc(F.col("e"), F.col("temp_cell"), F.col("voco"), F.lit(-0.163), F.col("Mbvoc"), F.lit(72), F.lit(1.05))
    return each.select("p_partkey", "e", r(v).alias("v_oc"), r(modules.bifacial(F.col("e"), F.lit(0.7), F.lit(0.1))).alias("both_sides"))


@query("""WITH v AS (SELECT *, o_totalprice / 10000 AS voc, o_totalprice / 20000 - 10 AS air, o_orderkey % 400 AS ghi, year(o_orderdate) AS y FROM orders),
y AS (SELECT y, min(air) AS low, min(air) FILTER (WHERE ghi > 150) AS day FROM v GROUP BY 1), m AS (SELECT avg(low) AS low, avg(day) AS day FROM y),
q AS (SELECT quantile_cont(voc, 0.995) AS p, max(voc) AS m FROM v),
x AS (SELECT '690.7(A)(3)-P99.5' AS "case", p AS v_oc FROM q UNION ALL SELECT '690.7(A)(3)-P100', m FROM q UNION ALL SELECT '690.7(A)(1)-ASHRAE', 48.5 - 0.163 * (-12.0 - 25)
UNION ALL SELECT '690.7(A)(2)-ASHRAE', 48.5 * 1.16 UNION ALL SELECT '690.7(A)(1)-NSRDB', 48.5 - 0.163 * (low - 25) FROM m UNION ALL SELECT '690.7(A)(3)-DAY', 48.5 - 0.163 * (day - 25) FROM m)
SELECT "case", round(v_oc, 4)::DOUBLE AS v_oc, floor(1500 / v_oc)::INT AS string_length FROM x""")
def design_voltages(t):
    price = F.col("o_totalprice")
    df = t("orders").select("o_orderdate", (price / 10000).alias("voc"), (price / 20000 - 10).alias("air"), (F.col("o_orderkey") % 400).cast("double").alias("ghi"))
    return modules.design_voltages(df, "voc", "air", "ghi", "o_orderdate", -12.0, 48.5, -0.163, 1500).withColumn("v_oc", r("v_oc"))


@query(f"WITH {WEATHER} SELECT l_orderkey, l_linenumber, round({CELL}, 3) AS temp FROM w WHERE {VOC} > 0")
def isotherm(t):
    """The temperature that a voltage belongs to is the one it came from."""
    df = _voc(t).filter("v_oc > 0")
    back = modules.isotherm(F.col("v_oc"), F.col("ghi"), F.lit(48.5), F.lit(-0.163), F.lit(72), F.lit(1.05))
    return df.select("l_orderkey", "l_linenumber", r(back, 3).alias("temp"))


@query(f"""WITH {WEATHER}, v AS (SELECT *, {CELL} AS t, {VOC} AS voc, l_orderkey * 10 + l_linenumber AS k FROM w), p AS (SELECT quantile_cont(voc, 0.995) AS p FROM v),
x AS (SELECT 'P99.5' AS "case", any_value(p) AS v_oc, arg_min(t, (t, k)) AS cell_temperature, arg_min(ghi, (t, k)) AS irradiance FROM v, p WHERE voc > p * 0.9975 AND voc < p * 1.0025
UNION ALL SELECT 'Hist', max(voc), arg_max(t, (voc, -k)), arg_max(ghi, (voc, -k)) FROM v
UNION ALL SELECT 'Trad', 48.5 - 0.163 * (min(air) - 25), NULL, NULL FROM v
UNION ALL SELECT 'Day', 48.5 - 0.163 * (min(CASE WHEN ghi > 150 THEN air END) - 25), NULL, NULL FROM v)
SELECT "case", round(v_oc, 4) AS v_oc, round(cell_temperature, 4) AS cell_temperature, round(irradiance, 4) AS irradiance, floor(1500 / v_oc)::INT AS string_length FROM x""")
def voc_summary(t):
    df = _voc(t).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    trad, day = (48.5 - 0.163 * (F.min(c) - 25) for c in (F.col("air"), F.when(F.col("ghi") > 150, F.col("air"))))
    out = modules.voc_summary(df, "v_oc", "temp_cell", "ghi", "k", 1500, 0.0, trad, day)
    return out.select("case", r("v_oc").alias("v_oc"), r("cell_temperature").alias("cell_temperature"), r("irradiance").alias("irradiance"), "string_length")


@query("""WITH y AS (SELECT o_orderstatus, min(o_totalprice) / 10000 AS least FROM orders GROUP BY o_orderstatus, year(o_orderdate)), m AS (SELECT o_orderstatus, avg(least) AS a, min(least) AS b FROM y GROUP BY 1)
SELECT o_orderstatus, 1.6::DOUBLE AS additional, round(greatest(a - 5, 0) * 0.163 / 48.5 * 100, 6)::DOUBLE AS weather, round((a - b) * 0.163 / 48.5 * 100, 6) AS extreme_cold,
round(round((a - 5) * 0.163 / 48.5 * 100 * (a > 5)::INT + (a - b) * 0.163 / 48.5 * 100 + 1.6, 1), 6)::DOUBLE AS total FROM m""")
def safety_factor(t):
    y = timeseries.yearly_minimum_mean(t("orders").withColumn("temp", F.col("o_totalprice") / 10000), "o_orderdate", "temp", ["o_orderstatus"])
    out = modules.safety_factor(y, F.col("mean_minimum"), F.col("minimum"), F.col("mean_minimum") - 5, -0.163, 48.5)
    return out.select("o_orderstatus", "additional", r("weather", 6).alias("weather"), r("extreme_cold", 6).alias("extreme_cold"), r("total", 6).alias("total"))


@query("""WITH g AS (SELECT event_id, 2 * pi() * (dayofyear(ts) + (hour(ts) + minute(ts) / 60.0 - 12) / 24 - 1) / 365 AS g, radians((hour(ts) * 60 + minute(ts) + 4 * -104.99) / 4 - 180) AS h0, ts FROM events),
d AS (SELECT event_id, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d,
h0 + radians(229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) / 4) AS h FROM g)
SELECT event_id, round(degrees(acos(greatest(-1, least(1, sin(radians(39.74)) * sin(d) + cos(radians(39.74)) * cos(d) * cos(h))))), 4) AS zenith FROM d""")
def solar_zenith(t):
    return t("events").select("event_id", r(modules.solar_position(F.col("ts"), F.lit(39.74), F.lit(-104.99))[0]).alias("zenith"))


@query()
def plane_of_array(t):
    """Sun, tracker, plane irradiance, incidence loss and voltage in one chain of columns."""
    ts, dni, dhi = F.col("ts"), F.col("value"), F.col("value") * 0.2
    zenith, azimuth = modules.solar_position(ts, F.lit(39.74), F.lit(-104.99))
    df = t("events").withColumns({"zenith": zenith, "azimuth": azimuth}).withColumn("turn", modules.tracker_rotation(F.col("zenith"), F.col("azimuth")))
    df = df.filter("turn is not null").withColumns({"tilt": F.abs("turn"), "facing": F.when(F.col("turn") >= 0, 90.0).otherwise(270.0)})
    df = df.withColumn("cosine", modules.incidence_cosine(F.col("tilt"), F.col("facing"), F.col("zenith"), F.col("azimuth")))
    direct, diffuse = modules.plane_irradiance(dni, dni * 0.9, dhi, F.col("tilt"), F.col("cosine"), F.col("zenith"), modules.extraterrestrial(ts))
    df = df.withColumns({"direct": direct, "diffuse": diffuse, "loss": modules.incidence_loss(F.col("cosine"))})
    df = df.withColumn("e", modules.effective_irradiance(F.col("direct"), F.col("diffuse"), F.col("loss"), F.lit(1.0), F.lit(1.0)))
    df = df.withColumn("temp_cell", modules.cell_temperature(F.col("direct") + F.col("diffuse"), F.lit(2.0), F.lit(15.0)))
    return df.select("event_id", "zenith", "turn", "e", "temp_cell", modules.sapm_voc(F.col("e"), F.col("temp_cell"), F.lit(48.5), F.lit(-0.163), F.lit(0.0), F.lit(72), F.lit(1.05)).alias("v_oc"))


@query()
def single_diode_voltage(t):
    p = curves.single_diode_parameters(F.col("ghi"), F.col("temp_cell"), F.lit(0.0021), F.lit(1.98), F.lit(5.18), F.lit(1.15e-9), F.lit(287.1), F.lit(0.317))
    return _weather(t).select("l_orderkey", "l_linenumber", curves.single_diode_voc(p["il"], p["io"], p["rsh"], p["a"]).alias("v_oc"))


# --- text and arrays -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, round(list_avg(list_transform(regexp_extract_all(p_name || ' A: ' || p_size || '.5, B: ' || p_retailprice, '[-+]?\\d*\\.?\\d+'), lambda x: x::DOUBLE)), 4) AS mean FROM part")
def extract_numbers_mean(t):
    text = F.concat("p_name", F.lit(" A: "), F.col("p_size").cast("string"), F.lit(".5, B: "), F.col("p_retailprice").cast("string"))
    return t("part").select("p_partkey", r(scalars.numbers_mean(text)).alias("mean"))


@query("SELECT c_custkey, try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE (c_custkey * 0.5)::VARCHAR END AS DOUBLE) AS number FROM customer")
def try_numeric(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", scalars.to_number(F.when(k % 3 == 0, "n/a").otherwise((k * 0.5).cast("string"))).alias("number"))


WORDS = ("Yes", "no ", "TRUE", "0", "bifacial", "unknown", "N")


@query(f"SELECT c_custkey, CASE WHEN w IN ('true', 'yes', 'y', '1', 'bifacial') THEN true WHEN w IN ('false', 'no', 'n', '0', 'monofacial') THEN false END AS flag FROM (SELECT c_custkey, lower(trim({list(WORDS)!r}[(c_custkey % 7)::INT + 1])) AS w FROM customer)")
def normalize_bool(t):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("c_custkey") % 7 + 1).cast("int"))
    return t("customer").select("c_custkey", scalars.to_boolean(word).alias("flag"))


@query("SELECT p_partkey, i::INT AS pos, l[i + 1] AS item FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), unnest(range(len(l))) u(i)")
def split_list(t):
    text = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    return t("part").select("p_partkey", F.posexplode(scalars.to_list(text)).alias("pos", "item"))


@query("""SELECT vec_id, round(100 * sum((abs(a) + abs(b)) / 2) / sum((x + y) / 2), 4) AS error FROM (
SELECT vec_id, embedding[i]::DOUBLE - 0.9 * abs(embedding[i]::DOUBLE) - 1 + 1 - embedding[i]::DOUBLE AS a, embedding[i + 1]::DOUBLE - 0.9 * abs(embedding[i + 1]::DOUBLE) - embedding[i + 1]::DOUBLE AS b, abs(embedding[i]::DOUBLE) AS x, abs(embedding[i + 1]::DOUBLE) AS y
FROM embeddings, unnest(range(1, len(embedding))) u(i)) GROUP BY 1""")
def array_area_error(t):
    ref = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    df = t("embeddings").select("vec_id", ref.alias("ref"), F.transform("embedding", lambda x: 1.9 * F.abs(x.cast("double"))).alias("i"))
    v = F.transform(F.sequence(F.lit(1), F.size("ref")), lambda k: k.cast("double"))
    return df.select("vec_id", r(curves.area_error(F.col("i"), F.col("ref"), v)).alias("error"))


@query("""SELECT vec_id, round(sum(abs(embedding[i]::DOUBLE) + 5.17 * (1000 / 800.0 - 1) + 0.0021 * -5), 3) AS current,
round(sum(i - 0.3 * (5.17 * 0.25 - 0.0105) - 0.001 * (abs(embedding[i]::DOUBLE) + 5.17 * 0.25 - 0.0105) * -5 - 0.159 * -5), 3) AS voltage FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i) GROUP BY 1""")
def curve_correct_p1(t):
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("i"))
    df = df.withColumn("v", F.transform(F.sequence(F.lit(1), F.size("i")), lambda k: k.cast("double")))
    v, i = curves.correct_p1(F.col("v"), F.col("i"), F.lit(800.0), F.lit(30.0), 1000.0, 25.0, F.lit(5.17), F.lit(0.0021), F.lit(-0.159), F.lit(0.3), F.lit(0.001))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", r(total(i), 3).alias("current"), r(total(v), 3).alias("voltage"))


P2 = "(1 + 0.05 * ln(1000 / {g}) + 0.01 * pow(ln(1000 / {g}), 2))"
P2_SHIFT = f"48.0 * (-0.003 * (-{P2.format(g='800.0')} * 5.0) + 1 / {P2.format(g='1000.0')} - 1 / {P2.format(g='800.0')})"


@query(f"""SELECT vec_id, round(sum(x * s), 3) AS current, round(sum(i - 0.3 * (x * s - x) - 0.001 * x * s * -5 + {P2_SHIFT}), 3) AS voltage
FROM (SELECT vec_id, i, abs(embedding[i]::DOUBLE) AS x, 1000 / 800.0 / (1 + 0.0005 * 5) AS s FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)) GROUP BY 1""")
def curve_correct_p2(t):
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("i"))
    df = df.withColumn("v", F.transform(F.sequence(F.lit(1), F.size("i")), lambda k: k.cast("double")))
    v, i = curves.correct_p2(F.col("v"), F.col("i"), F.lit(800.0), F.lit(30.0), 1000.0, 25.0, *(F.lit(x) for x in (48.0, 0.0005, -0.003, 0.3, 0.001, 0.05, 0.01)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", r(total(i), 3).alias("current"), r(total(v), 3).alias("voltage"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS under, round((embedding[3]::DOUBLE + embedding[4]::DOUBLE) / 2, 5) AS between_points, round(embedding[len(embedding)]::DOUBLE, 5) AS over FROM embeddings""")
def curve_interpolation(t):
    """Currents before the first voltage, between the third and the fourth, and after the last."""
    v = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda k: k.cast("double"))
    at = curves.interpolate(v, F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(0.0), F.lit(3.5), F.lit(1e6)))
    return t("embeddings").select("vec_id", *(r(at[k], 5).alias(n) for k, n in enumerate(("under", "between_points", "over"))))


@query("""SELECT p_partkey, round(0.005 / isc, 8) AS alpha, round(-0.163 / voc, 8) AS beta, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 0.35 ELSE 0.3 END::DOUBLE AS rs, round(isc * 1.1, 6) AS top
FROM (SELECT *, nullif(p_size % 10, 0)::DOUBLE AS isc, p_retailprice / 20 AS voc FROM part)""")
def curve_inputs(t):
    size = F.col("p_size")
    df = t("part").withColumns({"isc": (size % 10).cast("double"), "voc": F.col("p_retailprice") / 20})
    alpha, beta = curves.relative_coefficients(F.lit(0.005), F.col("isc"), F.lit(-0.163), F.col("voc"))
    top = F.when(F.col("isc") > 0, curves.axis_maximum(F.col("isc"), F.array(F.lit(200.0), F.lit(1000.0))))
    return df.select("p_partkey", r(alpha, 8).alias("alpha"), r(beta, 8).alias("beta"), curves.degraded_resistance(F.lit(0.3), F.lit(0.05), size % 2 == 0, size % 3 == 0).alias("rs"), r(top, 6).alias("top"))


@query(f"SELECT user_id, round(avg(value), 4) AS mean_error, count(value) AS n FROM {HOLED} GROUP BY 1")
def mean_of_errors(t):
    return curves.mean_error(_holed(t), "value", ["user_id"]).withColumn("mean_error", r("mean_error"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size + 0.5 END AS g, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 25.0::DOUBLE END AS t, p_size + 2.0::DOUBLE AS total FROM part")
def parsed_inputs(t):
    """Comma lists as pairs (null where the lengths differ) and array literals."""
    size = F.col("p_size").cast("string")
    pairs = curves.parse_pairs(F.concat(size, F.lit(".5")), F.when(F.col("p_size") % 4 == 0, "25, 30").otherwise(" 25"))
    values = curves.parse_array(F.concat(F.lit("["), size, F.lit(", 2]")))
    return t("part").select("p_partkey", pairs[0]["g"].alias("g"), pairs[0]["t"].alias("t"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT event_id, k AS category FROM (SELECT event_id, (json_extract_string(props, '$.k'))::INT AS n FROM events) JOIN (VALUES (0, 'clean'), (1, 'cracked'), (2, 'soiled')) v(i, k)
ON i = CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 THEN 1 ELSE 2 END""")
def json_map_argmax(t):
    n = F.get_json_object("props", "$.k").cast("int") % 3
    text = F.format_string('{"pv_image": true, "probabilities": {"clean": %s, "cracked": %s, "soiled": %s}}', *(F.when(n == i, "0.8").otherwise("0.1") for i in range(3)))
    verdict = F.from_json(text, "pv_image boolean, probabilities map<string, double>")
    return t("events").select("event_id", scalars.map_argmax(verdict["probabilities"]).alias("category"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_window(t):
    out = windows.tumbling(t("events"), "ts", "value", "1 day")
    return out.select(F.unix_micros("start").alias("start"), "n", r("total").alias("total"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::INT AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(t):
    out = windows.sessions(t("events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def flagship(t) -> DataFrame:
    """Filter specification, summary and 50-bin histogram of customers."""
    spec = FilterSpec(members={"c_mktsegment": ["BUILDING", "MACHINERY", "FURNITURE"]}, ranges={"c_acctbal": (0, None)})
    return stats.histogram(spec.apply(t("customer")), "c_acctbal", 50)


query("""WITH f AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_acctbal >= 0), b AS (SELECT min(v) AS lo, max(v) AS hi FROM f)
SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM f, b GROUP BY 1""")(flagship)
