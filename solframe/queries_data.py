"""Registered queries on sources, sinks, layouts, typed filters and curves, each beside its SQL.

Files are written to the session's shared folder and read back, so that a query covers both ways.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scalars
from .operators import climate, curves, geo, ranks, stats, timeseries
from .plans import requests, schemas
from .plans.predicates import FilterSpec, filter_tree, findings
from .plans.scratch import shared_folder
from .queries import KM, NATIONS, SUPPLIERS, WEATHER, _holed, _nations, _suppliers, query, r
from .sources import archives, layout, readers, sections, sinks
from .streaming import windows


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- filters that cannot fail ----------------------------------------------------------------------------------------

CLOCK = """o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderdate::TIMESTAMP AS time, o_totalprice AS price, o_orderkey % 2 = 0 AS even, o_orderpriority AS word,
string_split(o_orderpriority, '-') AS parts FROM orders)"""


def _typed(t) -> DataFrame:
    day = F.col("o_orderdate")
    return t("orders").select(
        F.col("o_orderkey").alias("id"), F.to_date(day).alias("day"), day.cast("timestamp_ntz").alias("time"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 2 == 0).alias("even"),
        F.col("o_orderpriority").alias("word"), F.split("o_orderpriority", "-").alias("parts"),
    )


TREE = {
    "logic": "AND",
    "conditions": [
        {"logic": "OR", "conditions": [{"column": "day", "operator": ">=", "value": "1995-06-01"}, {"column": "time", "operator": "<", "value": "1993-01-01T00:00:00"}]},
        {"column": "even", "operator": "==", "value": 1},
        {"column": "day", "operator": "!=", "value": "soon"},
        {"column": "price", "operator": "!=", "value": "n/a"},
        {"column": "parts", "operator": "!=", "value": ["1", "URGENT"]},
    ],
}


@query(f"WITH {CLOCK} SELECT id FROM o WHERE (day >= DATE '1995-06-01' OR time < TIMESTAMP '1993-01-01') AND even AND parts <> ['1', 'URGENT']")
def predicate_typed_tree(t):
    return filter_tree(_typed(t), TREE).select("id")


@query(f"""WITH {CLOCK} SELECT place, "column", problem, passes FROM (VALUES
('0', 'day', NULL, (SELECT count(*) FROM o WHERE day > DATE '1995-01-01')), ('1', 'day', 'the value never compares with this type', 0),
('2', 'even', NULL, (SELECT count(*) FROM o WHERE even)), ('3', 'even', NULL, (SELECT count(*) FROM o WHERE NOT even)), ('4.0', 'price', 'the value never compares with this type', (SELECT count(*) FROM o)),
('4.1', 'nowhere', 'unknown column', (SELECT count(*) FROM o)), ('5', 'word', 'not a regular expression', (SELECT count(*) FROM o WHERE contains(lower(word), '(5'))),
('6', 'price', 'unknown operator', (SELECT count(*) FROM o)), ('7', 'parts', NULL, (SELECT count(*) FROM o WHERE parts = ['5', 'LOW'])), ('8', 'word', NULL, 0),
('9', 'time', NULL, (SELECT count(*) FROM o WHERE time <= TIMESTAMP '1996-01-01 12:00:00'))) v(place, "column", problem, passes)""")
def predicate_findings(t):
    """What each leaf of a tree does and what is wrong with it; no leaf fails."""
    leaf = lambda c, o, v: {"column": c, "operator": o, "value": v}
    tree = {"logic": "AND", "conditions": [
        leaf("day", ">", "1995-01-01"), leaf("day", ">", 5), leaf("even", "==", "TRUE"), leaf("even", "<", 0.5), {"logic": "OR", "conditions": [leaf("price", "!=", "cheap"), leaf("nowhere", "==", 1)]},
        leaf("word", "contains", "(5"), leaf("price", "~", 1), leaf("parts", "==", ["5", "LOW"]), leaf("word", ">", 7), leaf("time", "<=", "1996-01-01T14:00:00+02:00"),
    ]}
    return findings(_typed(t), tree, regex=True).select("place", "column", "problem", "passes")


@query("""SELECT event_id FROM events WHERE event_id % 13 = 0 OR (value >= 10 AND value <= 60)""")
def filter_nan_amounts(t):
    """NaN is an amount that is not reported."""
    amounts = _holed(t).withColumn("value", F.col("value") * 1000)
    return FilterSpec(amounts={"value": (True, True, 10, 60)}).apply(amounts).select("event_id")


@query("""SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median_c_acctbal, round(quantile_cont(c_acctbal, 0.9), 4) AS p90_c_acctbal, count(c_acctbal) AS count_c_acctbal
FROM customer WHERE c_nationkey <> 5 GROUP BY 1""")
def analysis_quantiles(t):
    spec = requests.AnalysisSpec(["median", "p90", "count"], ["c_acctbal"], ["c_mktsegment"], {"column": "c_nationkey", "operator": "!=", "value": "5"})
    return spec.apply(t("customer")).select("c_mktsegment", r("median_c_acctbal").alias("median_c_acctbal"), r("p90_c_acctbal").alias("p90_c_acctbal"), "count_c_acctbal")


@query("""SELECT p_partkey, v.metric, v.variable FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'AC_Power (W)' ELSE 'kW ' || p_brand END AS pw, CASE WHEN p_size % 3 = 0 THEN 'Timestamp' ELSE 'Local.Date' END AS ti FROM part),
LATERAL (SELECT 'Power' AS metric, pw AS variable UNION ALL SELECT 'Time', ti UNION ALL SELECT 'DC Voltage', 'V' || 'dc' UNION ALL SELECT 'DC Current', CASE WHEN p_size % 5 = 0 THEN 'DC Current' ELSE 'N/A' END) v""")
def column_binding_rows(t):
    """Columns of many tables bound to the required quantities, a row of names each."""
    size = F.col("p_size")
    names = F.array(
        F.lit("Module Temperature"), F.when(size % 3 == 0, "Timestamp").otherwise("Local.Date"), F.lit("Vdc"), F.when(size % 2 == 0, "AC_Power (W)").otherwise(F.concat(F.lit("kW "), "p_brand")),
        F.when(size % 5 == 0, "DC Current").otherwise("Site"),
    )
    return t("part").select("p_partkey", F.inline(requests.binding(names)))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true ELSE false END AS valid FROM part")
def header_rows(t):
    size = F.col("p_size") % 3
    names = F.when(size == 0, F.array("p_name", F.lit("1"))).when(size == 1, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("#"), F.lit("7")))
    return t("part").select("p_partkey", stats.valid_header_row(names).alias("valid"))


@query(f"""WITH {NATIONS} SELECT n_nationkey, (i * m + j)::BIGINT AS cell, round(lat + i * 0.5, 6) AS lat, round(lon + j * 2.0, 6) AS lon FROM (SELECT *, ceil((n_nationkey % 4) / 2.0)::BIGINT AS m FROM n), range(3) a(i), range(2) b(j) WHERE j < m""")
def latlon_cells(t):
    """Cells of a box at each nation's place: 1.5 degrees high, and 0 to 3 degrees wide."""
    lat, lon = F.col("lat"), F.col("lon")
    cells = geo.grid_cells((lat, lat + 1.5, F.lit(0.5)), (lon, lon + F.col("n_nationkey") % 4, F.lit(2.0)))
    found = _nations(t).select("n_nationkey", F.explode(cells).alias("x")).select("n_nationkey", "x.*")
    return found.select("n_nationkey", "cell", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"))


@query("""SELECT s_suppkey, 'T_equiv_' || m || '_' || (e // 10) || 'p' || (e % 10) || 'eV' AS parameter, 'Equivalent temperature, ' || m || ', ' || (e // 10) || '.' || (e % 10) || ' eV' AS label
FROM (SELECT s_suppkey, s_suppkey % 22 AS e, CASE WHEN s_nationkey % 2 = 0 THEN 'rack' ELSE 'roof' END AS m FROM supplier)""")
def stressor_names(t):
    e, mount = F.col("s_suppkey") % 22, F.when(F.col("s_nationkey") % 2 == 0, "rack").otherwise("roof")
    return t("supplier").select("s_suppkey", climate.energy_parameter(e, mount).alias("parameter"), climate.energy_label(e, mount).alias("label"))


@query(f"""WITH {NATIONS}, {SUPPLIERS}, near AS (SELECT n_nationkey, arg_min(s_suppkey, ({KM}, s_suppkey)) AS k FROM n, s GROUP BY 1), g AS (SELECT n_nationkey, s_acctbal, s_name, s_nationkey FROM near JOIN supplier ON s_suppkey = k)
SELECT n_nationkey, parameter, label, value FROM (SELECT n_nationkey, 'GHI_mean' AS parameter, 'GHI' AS label, printf('%.2f', s_acctbal) AS value FROM g
UNION ALL SELECT n_nationkey, 'T_ambient_min', 'T_ambient_min', printf('%.2f', s_nationkey / 7.0) FROM g UNION ALL SELECT n_nationkey, 'pvcz_labeled', 'pvcz_labeled', s_name FROM g)""")
def stressor_table(t):
    """A point's first table: numbers with two decimals, text as it is, parameters that the grid lacks left out."""
    grid = _suppliers(t).join(t("supplier").select("s_suppkey", F.col("s_acctbal").alias("GHI_mean"), (F.col("s_nationkey") / 7.0).alias("T_ambient_min"), F.col("s_name").alias("pvcz_labeled")), "s_suppkey")
    n = _nations(t)
    labels = n.sparkSession.createDataFrame([("GHI_mean", "GHI")], "parameter string, label string")
    keys = [k for k in climate.FIRST if k not in ("lat", "lon")]
    return climate.stressor_lookup(n, grid, "n_nationkey", "s_suppkey", keys, labels, dict.fromkeys(climate.ROUNDED, 2))


# --- places ----------------------------------------------------------------------------------------------------------


def _customers(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", ((k * 37) % 1700 / 10 - 85).cast("double").alias("lat"), ((k * 101) % 3500 / 10 - 175).cast("double").alias("lon"))


CUSTOMERS = "c AS (SELECT c_custkey, ((c_custkey * 37) % 1700 / 10.0 - 85)::DOUBLE AS lat, ((c_custkey * 101) % 3500 / 10.0 - 175)::DOUBLE AS lon FROM customer)"
APART = "sqrt(pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2))"


@query(f"WITH {CUSTOMERS}, {SUPPLIERS} SELECT c_custkey, arg_min(s_suppkey, ({APART}, s_suppkey)) AS s_suppkey, round(min({APART}), 4) AS degrees FROM c, s GROUP BY 1")
def nearest_in_degrees_many(t):
    """Points that are not broadcast: they descend a tree of cells."""
    return geo.nearest_in_degrees(_customers(t), _suppliers(t), "c_custkey", "s_suppkey", few=0).withColumn("degrees", r("degrees"))


@query(f"""WITH {NATIONS}, {SUPPLIERS}, near AS (SELECT n_nationkey, arg_min(s_suppkey, ({KM}, s_suppkey)) AS s_suppkey FROM n, s WHERE n_nationkey IN (3, 7) GROUP BY 1)
SELECT l_suppkey AS s_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM near)""")
def weather_layout_fetch(t):
    """A layout by place is written; then only the folders of two points' nearest places are read."""
    weather = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber", "l_extendedprice")
    path = _folder(weather, "layout")
    layout.write_by_place(weather, path, "s_suppkey", ["l_orderkey", "l_linenumber"], 16)
    near = geo.nearest(_nations(t).filter("n_nationkey in (3, 7)"), _suppliers(t), "n_nationkey", "s_suppkey").select("s_suppkey").distinct()
    return layout.at_places(weather.sparkSession, path, near, "s_suppkey", 16)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_id FROM orders")
def global_row_ids(t):
    return ranks.row_ids(t("orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"]).select("o_orderkey", "row_id")


# --- sources and sinks, written and read back --------------------------------------------------------------------------


@query("""SELECT 0 AS section, c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'a "quoted", ' || c_mktsegment WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 5 = 2 THEN NULL ELSE ' ' || c_mktsegment || ' ' END AS text, c_acctbal AS number FROM customer
UNION ALL SELECT 1, n_nationkey, n_name, NULL FROM nation""")
def sections_round_trip(t):
    """Two sections with quotes, commas, blanks, empty texts and nulls, written as text and read back."""
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(F.lit('a "quoted", '), "c_mktsegment")).when(k == 1, "").when(k == 2, F.lit(None)).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    people = t("customer").select(F.col("c_custkey").alias("id"), text.alias("text"), F.col("c_acctbal").alias("number"))
    places = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    path = _folder(people, "sections")
    sections.write_sections([sections.Section("People, all", people, ["id"]), sections.Section("Places", places, ["id"], header=False)], path)
    read = sections.read_sections(people.sparkSession, path)
    first = sections.section(read, "People, all", "id bigint, text string, number double").select(F.lit(0).alias("section"), F.col("id").cast("long").alias("id"), "text", "number")
    second = sections.section(read, "Places", "id bigint, text string", header=False)
    return first.unionByName(second.select(F.lit(1).alias("section"), F.col("id").cast("long").alias("id"), "text", F.lit(None).cast("double").alias("number")))


@query("""SELECT vec_id, pos, number, whole, size FROM (SELECT vec_id, p - 1 AS pos, CASE WHEN p <= len(embedding) THEN embedding[p]::DOUBLE END AS number, CASE WHEN p <= 1 + vec_id % 4 THEN vec_id * 10 + p END AS whole, 1 + vec_id % 4 AS size
FROM embeddings, unnest(range(1, len(embedding) + 1)) u(p))""")
def archive_round_trip(t):
    """Archives of a text, a whole number and two vectors of different lengths, packed and read as typed rows."""
    wholes = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("vec_id") % 4), lambda p: F.col("vec_id") * 10 + p)
    made = t("embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("number"), wholes.alias("whole"), (1 + F.col("vec_id") % 4).alias("size"), F.concat(F.lit("v"), "vec_id").alias("title"))
    found = archives.entries(made.select("path", archives.packed("number", "whole", "size", "title").alias("content")))
    facts = archives.scalars_of(found).select("path", F.try_element_at("whole", F.lit("size")).alias("size"), F.try_element_at("text", F.lit("title")).alias("title"))
    rows = archives.vectors_of(found, {"number": "double", "whole": "bigint"}).join(facts, "path")
    return rows.select(F.substring("title", 2, 20).cast("long").alias("vec_id"), F.col("pos").cast("long").alias("pos"), "number", "whole", "size")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderdate::DATE::VARCHAR AS day,
CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN '{"price":"about ten","note":"x"}' WHEN o_orderkey % 7 = 0 THEN '{"price":"about ten"}' WHEN o_orderkey % 2 = 0 THEN '{"note":"x"}' END AS _rescued, NULL::BOOLEAN AS grid FROM orders""")
def declared_read(t):
    """A CSV file read by a declared schema: what doesn't fit is kept beside the row."""
    key = F.col("o_orderkey")
    made = t("orders").select(key.alias("ID"), F.when(key % 7 == 0, "about ten").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.to_date("o_orderdate").alias("day"), F.when(key % 2 == 0, "x").alias("note"))
    path = _folder(made, "declared")
    sinks.csv(made, path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType()), T.StructField("grid", T.BooleanType())])
    return readers.declared(made.sparkSession, path, schema).select("id", "price", F.col("day").cast("string").alias("day"), schemas.RESCUED, "grid")


@query("""SELECT * FROM (VALUES ('price', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0)), ('note', (SELECT count(*) FROM orders)), (NULL, (SELECT count(*) FROM orders))) v("column", rows)""")
def rescue_counts(t):
    """Rescued values by column; a null column counts the rows."""
    key = F.col("o_orderkey")
    made = t("orders").select(key.alias("paper id"), F.when(key % 7 == 0, "ten").otherwise("10").alias("price"), F.lit("x").alias("note"))
    declared = schemas.from_dictionary({"paper id": {"type": "integer", "description": "its number"}, "price": {"type": "float"}, "bifacial": {"type": "boolean"}})
    return schemas.rescue_counts(schemas.conform(made, declared))


@query("""SELECT n_nationkey AS location_id, p::BIGINT AS pos, (p * 7 + n_nationkey)::DOUBLE AS ghi, epoch(TIMESTAMP '1998-01-01' + p * INTERVAL 1 MINUTE * (CASE WHEN n_nationkey % 2 = 0 THEN 30 ELSE 60 END))::BIGINT AS ts,
(epoch(TIMESTAMP '1998-01-01' + p * INTERVAL 1 MINUTE * (CASE WHEN n_nationkey % 2 = 0 THEN 30 ELSE 60 END)) + 3600 * (n_nationkey % 12))::BIGINT AS utc, row_number() OVER (PARTITION BY p ORDER BY n_nationkey) - 1 AS file_no FROM nation, range(48) g(p)""")
def weather_files_round_trip(t):
    """A weather file for each nation, with two headers, written by place and read back as a sequence."""
    k, p = F.col("n_nationkey"), F.col("p")
    step = F.when(k % 2 == 0, 30).otherwise(60)
    rows = t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("p"))
    line = F.concat_ws(",", F.lit("1998"), F.lit("1"), F.lit("1"), F.floor(p * step / 60).cast("string"), (p * step % 60).cast("string"), (p * 7 + k).cast("string"))
    head = F.concat(F.lit("Source,Time Zone,Location ID\nNSRDB,-"), (k % 12).cast("string"), F.lit(","), k.cast("string"), F.lit("\nYear,Month,Day,Hour,Minute,GHI\n"))
    whole = rows.groupBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))  # 48 rows a file
    path = _folder(rows, "weather")
    whole.select(F.concat(head, "body").alias("value"), F.format_string("%02d", k).alias("place")).repartition("place").write.partitionBy("place").text(path)
    table = readers.weather_csv(rows.sparkSession, f"{path}/*/*.txt")
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    key = F.try_element_at("metadata", F.lit("Location ID")).cast("int")
    files = ranks.row_ids(table.select(key.alias("location_id")).distinct(), ["location_id"], "file_no")
    return table.select(key.alias("location_id"), F.col("pos").cast("long").alias("pos"), "ghi", at("ts").alias("ts"), at("utc_ts").alias("utc")).join(files, "location_id")


# --- values without a place --------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events), b AS (SELECT min(v) AS lo, max(v) AS hi FROM e)
SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM e, b WHERE v IS NOT NULL GROUP BY 1""")
def histogram_infinite(t):
    """Infinities have no bin."""
    value = F.when(F.col("event_id") % 17 == 0, F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("value"))
    return stats.histogram(t("events").select(value.alias("value")), "value", 20)


@query("""SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN round((1000.0 / (100 * (p_size % 10))) * (1 + 0.04 * 0) / (1 + 0.04 * (p_size - 25)), 6) END AS scale FROM (SELECT * FROM part WHERE p_size <> 0) WHERE p_size % 10 <> 0
UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 10 = 0""")
def curve_zero_divisors(t):
    """Corrections without irradiance, or at the temperature where the coefficient cancels the current, are null."""
    g, t1 = F.col("p_size") % 10 * 100.0, F.col("p_size").cast("double")
    zero = F.lit(0.0)
    _, i = curves.correct_p2(F.array(F.lit(1.0)), F.array(F.lit(1.0)), g, t1, 1000.0, 25.0, F.lit(48.0), F.lit(0.04), zero, zero, zero, zero, zero)
    return t("part").select("p_partkey", r(i[0], 6).alias("scale"))


@query("""WITH p AS (SELECT vec_id, k::DOUBLE AS v, abs(embedding[k]::DOUBLE) AS a, NULL::DOUBLE AS b FROM embeddings, unnest(range(1, 21)) u(k) UNION ALL SELECT vec_id, k * 1.5 + 0.25, NULL, abs(embedding[k + 30]::DOUBLE) FROM embeddings, unnest(range(1, 16)) u(k)),
m AS (SELECT vec_id, v, max(a) AS a, max(b) AS b FROM p GROUP BY 1, 2),
f AS (SELECT vec_id, v, a, b, last_value(CASE WHEN a IS NOT NULL THEN v END IGNORE NULLS) OVER x AS av0, last_value(a IGNORE NULLS) OVER x AS a0, first_value(CASE WHEN a IS NOT NULL THEN v END IGNORE NULLS) OVER y AS av1, first_value(a IGNORE NULLS) OVER y AS a1,
last_value(CASE WHEN b IS NOT NULL THEN v END IGNORE NULLS) OVER x AS bv0, last_value(b IGNORE NULLS) OVER x AS b0, first_value(CASE WHEN b IS NOT NULL THEN v END IGNORE NULLS) OVER y AS bv1, first_value(b IGNORE NULLS) OVER y AS b1
FROM m WINDOW x AS (PARTITION BY vec_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), y AS (PARTITION BY vec_id ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT vec_id, v, coalesce(a, CASE WHEN a0 IS NULL THEN a1 WHEN a1 IS NULL THEN a0 ELSE a0 + (v - av0) / (av1 - av0) * (a1 - a0) END) AS a, coalesce(b, CASE WHEN b0 IS NULL THEN b1 WHEN b1 IS NULL THEN b0 ELSE b0 + (v - bv0) / (bv1 - bv0) * (b1 - b0) END) AS b FROM f),
s AS (SELECT vec_id, a - b AS d, b, lead(v) OVER w - v AS w, lead(a - b) OVER w AS d1, lead(b) OVER w AS b1 FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY v)),
c AS (SELECT vec_id, sum(w * CASE WHEN d * d1 < 0 THEN (d * d + d1 * d1) / (2 * abs(d1 - d)) ELSE (abs(d) + abs(d1)) / 2 END) AS between_, sum(w * (b + b1) / 2) AS reference FROM s GROUP BY 1)
SELECT vec_id, round(between_, 5) AS "between", round(reference, 5) AS reference, round(100 * between_ / reference, 3) AS error FROM c""")
def curve_area_own_grids(t):
    """Curves with voltages of their own that cross between points."""
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    steps = lambda n, f: F.transform(F.sequence(F.lit(1), F.lit(n)), f)
    made = t("embeddings").select("vec_id", F.reverse(steps(20, lambda k: k.cast("double"))).alias("v"), F.reverse(F.slice(e, 1, 20)).alias("i"), steps(15, lambda k: k * 1.5 + 0.25).alias("ref_v"), F.slice(e, 32 - 1, 15).alias("ref_i"))
    return curves.area_between(made, ["vec_id"]).select("vec_id", r("between", 5).alias("between"), r("reference", 5).alias("reference"), r("error", 3).alias("error"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS rounded FROM lineitem")
def half_even(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", scalars.half_even(F.col("l_quantity") / 2).alias("rounded"))


@query("""WITH p AS (SELECT ts::DATE AS day, hour(arg_max(ts, (value, -epoch_us(ts)))) AS h FROM events GROUP BY 1), s AS (SELECT CASE WHEN avg(h) < 9 THEN 1 WHEN avg(h) > 15 THEN -1 ELSE 0 END AS s FROM p),
n AS (SELECT count(*) FILTER (WHERE hour(ts + s * INTERVAL 1 HOUR) = 2) AS n, any_value(s) AS s FROM events, s)
SELECT concat_ws(chr(10), (SELECT 'times without zone: taken as UTC' FROM n WHERE (SELECT typeof(ts) FROM events LIMIT 1) = 'TIMESTAMP'), CASE s WHEN 1 THEN 'days peak early: one hour added' WHEN -1 THEN 'days peak late: one hour taken off' ELSE 'days peak as expected' END,
CASE WHEN n = 0 THEN 'hour 2 is missing: one hour added' END, CASE WHEN n > 400 THEN 'hour 2 is doubled: one hour taken off' END, 'moved to America/Denver') AS message FROM n""")
def clock_report(t):
    return timeseries.clock_report(t("events"), "ts", "value", "America/Denver", 400)


@query("SELECT event_id, strftime(timezone('America/Denver', timezone('UTC', ts::TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS local FROM events")
def zone_walls(t):
    """The wall clock of a zone, where no repair is due: peaks as expected, hour 2 neither missing nor doubled."""
    calm = t("events").select("event_id", "ts", F.when(F.hour("ts") == 12, 1e9).otherwise(F.col("value")).alias("value"))
    return timeseries.repair_clock(calm, "ts", "value", "America/Denver", 1 << 40).select("event_id", F.date_format("fixed_ts", "yyyy-MM-dd HH:mm:ss").alias("local"))


# --- files and streams ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    """A CSV sink read back with a declared schema, by the reader that goes by the extension, from the first path there is."""
    made = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = _folder(made, "table") + ".csv"
    sinks.csv(made, path)
    return readers.first_found(made.sparkSession, [path + ".local.csv", path], lambda spark, p: readers.table(spark, p, made.schema))


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def parquet_round_trip(t):
    """A Parquet sink in folders by nation read back: NaN comes back as null; a path without a table adds no rows."""
    value = F.when(F.col("s_suppkey") % 5 == 0, float("nan")).otherwise(F.col("s_acctbal"))
    made = t("supplier").select("s_suppkey", "s_nationkey", value.alias("s_acctbal"))
    path = _folder(made, "table") + ".parquet"
    sinks.parquet(made, path, ["s_nationkey"])
    spark = made.sparkSession
    none = readers.parquet_or_empty(spark, _folder(made, "none"), made.schema)
    return readers.combine([readers.table(spark, path).select(*made.columns), none])


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_round_trip(t):
    made = t("part").select("p_partkey", "p_name", "p_size")
    path = _folder(made, "table") + ".json"
    sinks.json_rows(made).write.text(path)
    return readers.table(made.sparkSession, path, made.schema)


@query(f"WITH {SUPPLIERS} SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_suppkey::BIGINT AS location_id, round(lat, 1) AS lat, round(lon, 1) AS lon FROM s")
def folder_catalogue(t):
    """Files whose folders tell place and coordinates, numbered by place; no content is read."""
    made = _suppliers(t).select(F.format_string("%d_%.1f_%.1f", "s_suppkey", "lat", "lon").alias("place"), F.lit("x").alias("value"))
    path = _folder(made, "catalogue")
    sinks.text_by_folder(made, path, "place")
    found = readers.catalogue(made.sparkSession, path, r"place=(\d+)_(-?[\d.]+)_(-?[\d.]+)/[^/]+\.txt$", ["location_id", "lat", "lon"], "*.txt")
    return found.select("row_id", "location_id", "lat", "lon")


@query("""WITH e AS (SELECT event_id, value - 30 AS v FROM events), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM e)
SELECT event_id FROM e, q WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) OR v < 0""")
def iqr_or_negative(t):
    moved = t("events").select("event_id", (F.col("value") - 30).alias("v"))
    return timeseries.iqr_flags(moved, "v", negatives=True).filter("outlier").select("event_id")


@query("""SELECT epoch_us(s) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1""")
def stream_sliding_window(t):
    """Events as a stream in windows of a day, every twelve hours, run to its end."""
    events = t("events").select("ts", "value")
    path = _folder(events, "events")
    sinks.parquet(events, path)
    stream = windows.event_stream(events.sparkSession, path, events.schema, "ts", "2 hours")
    found = windows.settle_stream(windows.tumbling(stream, "ts", "value", "1 day", "12 hours"), _folder(events, "windows"), _folder(events, "stream"))
    return found.select(F.unix_micros("start").alias("start"), "n", r("total").alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS ghi, l_extendedprice AS temp_air, l_shipdate::DATE::VARCHAR AS day FROM lineitem")
def renamed_weather(t):
    raw = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("GHI"), F.col("l_extendedprice").alias("Temperature"), F.to_date("l_shipdate").cast("string").alias("day"))
    return readers.rename_weather(raw)
