"""Edge cases and closed forms of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from solframe.functions import scalars
from solframe.operators import bootstrap, curves, geo, modules, stats, timeseries
from solframe.plans.predicates import FilterSpec, filter_tree, restrict
from solframe.sources import readers, sinks
from solframe.streaming import windows


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Glass front", 1.0), (2, None, 5.0), (3, "steel", None), (4, "GLASS", float("nan"))], "id int, `note (raw)` string, x double")


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_nan_becomes_null(people):
    assert ids(scalars.clean_floats(people).filter("x is null")) == [3, 4]


def test_tree_nulls_and_names(people):
    contains = {"column": "note (raw)", "operator": "contains", "value": "glass"}
    assert ids(filter_tree(people, contains)) == [1, 4]
    assert ids(filter_tree(people, {"column": "note (raw)", "operator": "!=", "value": "steel"})) == [1, 2, 4]
    assert ids(filter_tree(people, {"logic": "XOR", "conditions": [contains, {"column": "id", "operator": "==", "value": 2}]})) == [1, 4]
    assert ids(filter_tree(people, None)) == [1, 2, 3, 4]


def test_tree_obeys_de_morgan(people):
    p, q = {"column": "id", "operator": ">", "value": 1}, {"column": "id", "operator": "<", "value": 4}
    both = set(ids(filter_tree(people, {"logic": "AND", "conditions": [p, q]})))
    either = set(ids(filter_tree(people, {"logic": "OR", "conditions": [{"column": "id", "operator": "<=", "value": 1}, {"column": "id", "operator": ">=", "value": 4}]})))
    assert both | either == {1, 2, 3, 4} and not both & either


def test_filters_reach_the_scan(spark, sf):
    df = FilterSpec(members={"c_mktsegment": ["BUILDING"]}, ranges={"c_acctbal": (0, None)}).apply(spark.read.parquet(f"{sf}/customer.parquet"))
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(c_acctbal" in plan


def test_restrict_with_nothing(spark, people):
    none = spark.createDataFrame([], "id int")
    assert ids(restrict(people, none, "id")) == [] and ids(restrict(people, none, "id", empty_means_all=True)) == [1, 2, 3, 4]


@pytest.mark.parametrize(("text", "mean"), [("A: 295.0, B: 300.0", 297.5), ("n/a", None), (None, None), ("-3 and .5", -1.25)])
def test_numbers_mean(spark, text, mean):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.numbers_mean(F.col("t"))).first()[0] == mean


@pytest.mark.parametrize(("text", "items"), [("a, b", ["a", "b"]), ("['a','b']", ["a", "b"]), ('["a"]', ["a"]), ("", None), (None, None)])
def test_to_list(spark, text, items):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.to_list(F.col("t"))).first()[0] == items


def test_map_argmax_ties_and_empty(spark):
    df = spark.sql("select map('b', 1.0D, 'a', 1.0D, 'c', 0.5D) m union all select map_from_arrays(array(), array()) m")
    assert [r[0] for r in df.select(scalars.map_argmax(F.col("m"))).collect()] == ["a", None]


def test_histogram_of_a_constant_and_of_nothing(spark):
    one = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in stats.histogram(one, "v", 4).collect()] == [(2, 2)]
    assert stats.histogram(one.limit(0), "v", 4).count() == 0


def test_histogram_sums_to_n_and_density_to_one(spark):
    df = spark.range(500).select((F.sin("id") * 3).alias("v"))
    assert stats.histogram(df, "v", 7).agg(F.sum("n")).first()[0] == 500
    d = sorted((r["x"], r["density"]) for r in stats.density(df, "v", 200).collect())
    assert 0.75 < np.trapezoid([y for _, y in d], [x for x, _ in d]) < 1.01


def test_headers():
    assert stats.valid_headers(["time", "1"]) and not stats.valid_headers(["0", "1"]) and not stats.valid_headers(["#", "7"])


def test_haversine_is_symmetric_and_bounded(spark):
    row = spark.sql("select 10D a, 20D b, -30D c, 170D d")
    x, y, far = row.select(geo.haversine(*map(F.col, "abcd")), geo.haversine(*map(F.col, "cdab")), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()
    assert x == pytest.approx(y) and far == pytest.approx(6371 * math.pi)


def test_nearest_by_cells_equals_broadcast(spark, monkeypatch):
    p = spark.range(40).select("id", ((F.col("id") * 37) % 120 - 60).cast("double").alias("lat"), ((F.col("id") * 53) % 360 - 180).cast("double").alias("lon"))
    g = spark.range(900).select(F.col("id").alias("gid"), ((F.col("id") * 29) % 1300 / 10 - 65).alias("lat"), ((F.col("id") * 71) % 3600 / 10 - 180).alias("lon"))
    want = {tuple(r) for r in geo.nearest(p, g, "id", "gid", within_km=900).collect()}
    monkeypatch.setattr(geo, "FEW", 5)
    assert {tuple(r) for r in geo.nearest(p, g, "id", "gid", within_km=900).collect()} == want
    in_rings = {tuple(r) for r in geo.nearest(p, g, "id", "gid").collect()}
    monkeypatch.setattr(geo, "FEW", 10_000)
    assert in_rings == {tuple(r) for r in geo.nearest(p, g, "id", "gid").collect()} and len(in_rings) == 40


def test_bounding_box_loses_nothing(spark):
    g = spark.range(3000).select("id", ((F.col("id") * 29) % 1700 / 10 - 85).alias("lat"), ((F.col("id") * 71) % 3600 / 10 - 180).alias("lon"))
    for lat, lon in ((0, 0), (60, 179), (88, 10)):
        inside = geo.within_radius(g, lat, lon, 800).filter("inside").count()
        assert geo.within_radius(geo.bounding_box(g, lat, lon, 800), lat, lon, 800).filter("inside").count() == inside


def test_voltage_closed_forms(spark):
    v = lambda e, t: spark.range(1).select(modules.sapm_voc(F.lit(e), F.lit(t), F.lit(48.5), F.lit(-0.163), F.lit(0.0), F.lit(72), F.lit(1.05))).first()[0]
    assert v(1000.0, 25.0) == pytest.approx(48.5) and v(0.0, 25.0) == 0 and v(-1.0, 25.0) is None and v(float("nan"), 25.0) is None
    assert v(200.0, 25.0) < v(400.0, 25.0) < v(1100.0, 25.0)
    back = spark.range(1).select(modules.isotherm(F.lit(v(300.0, 10.0)), F.lit(300.0), F.lit(48.5), F.lit(-0.163), F.lit(72), F.lit(1.05))).first()[0]
    assert back == pytest.approx(10.0)


def test_single_diode_voltage_solves_its_equation(spark):
    row = spark.range(1).select(curves.single_diode_voc(F.lit(5.18), F.lit(1.15e-9), F.lit(287.1), F.lit(1.98)).alias("v"), curves.single_diode_curve(50)(F.lit(5.18), F.lit(1.15e-9), F.lit(0.317), F.lit(287.1), F.lit(1.98)).alias("c")).first()
    assert 5.18 - 1.15e-9 * math.expm1(row["v"] / 1.98) - row["v"] / 287.1 == pytest.approx(0, abs=1e-8)
    assert row["c"]["i"][-1] == pytest.approx(0, abs=1e-6) and row["c"]["i"][0] == pytest.approx(5.18 / (1 + 0.317 / 287.1), rel=1e-4)


def test_curve_corrections_without_change(spark):
    df = spark.sql("select array(0D, 10D, 20D) v, array(5D, 4D, 0D) i")
    p1 = curves.correct_p1(F.col("v"), F.col("i"), F.lit(1000.0), F.lit(25.0), 1000.0, 25.0, *(F.lit(x) for x in (5.0, 0.002, -0.1, 0.3, 0.001)))
    p2 = curves.correct_p2(F.col("v"), F.col("i"), F.lit(1000.0), F.lit(25.0), 1000.0, 25.0, *(F.lit(x) for x in (20.0, 0.0005, -0.003, 0.3, 0.001, 0.05, 0.01)))
    r = df.select(*p1, *p2, curves.area_error(F.col("i"), F.col("i"), F.col("v")), curves.interpolate(F.col("v"), F.col("i"), F.array(F.lit(5.0), F.lit(25.0)))).first()
    assert r[0] == r[2] == [0, 10, 20] and r[1] == r[3] == [5, 4, 0] and r[4] == 0 and r[5] == [4.5, 0]


def test_year_on_year_recovers_a_rate(spark):
    days = spark.range(0, 1500, 14).select(F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") * 86400).alias("ts"), (1 - 0.01 * F.col("id") / 365).alias("v"))
    rates = timeseries.year_on_year(days, [], "ts", "v", 15, 30)
    found = bootstrap.interval(rates, resamples=20).first()
    assert found["rate"] == pytest.approx(-1.0, abs=0.02) and found["low"] <= found["rate"] <= found["high"]


def test_series_shorter_than_a_year_has_no_pairs(spark):
    days = spark.range(100).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(1.0).alias("v"))
    assert timeseries.year_on_year(days, [], "ts", "v").count() == 0


def test_nulls_are_no_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,), (500.0,), (-3.0,)], "v double")
    assert timeseries.iqr_flags(df, "v").filter("outlier").count() == 1
    assert timeseries.iqr_flags(df, "v", negatives=True).filter("outlier").count() == 2


def test_weather_csv(spark, tmp_path):
    head = "Source,Latitude,Time Zone\nX,39.7,-7\nYear,Month,Day,Hour,Minute,DNI,GHI,DHI,Temperature,Wind Speed\n"
    (tmp_path / "1_39.7_-104.9_2000.csv").write_text(head + "2000,1,1,0,0,1,2,3,4,5\n2000,1,1,0,30,1,2,3,-4.5,5\n")
    rows = readers.weather_csv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["temp_air"], r["interval_min"], str(r["ts"])) for r in rows] == [(4.0, 30, "2000-01-01 00:00:00"), (-4.5, 30, "2000-01-01 00:30:00")]
    assert rows[0]["metadata"]["Latitude"] == "39.7"
    (tmp_path / "skip.csv").write_text("x")
    assert [(r["location_id"], r["lat"], r["lon"], r["year"]) for r in readers.weather_catalogue(spark, str(tmp_path)).collect()] == [(1, 39.7, -104.9, 2000)]


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "7_1.5_-2.5.npz", ghi=[1, 2], dni=[3.5, 4.5])
    assert [(r["pos"], r["ghi"], r["dni"]) for r in readers.archives(spark, str(tmp_path / "*.npz"), ["ghi", "dni"]).orderBy("pos").collect()] == [(0, 1, 3.5), (1, 2, 4.5)]
    assert readers.archive_catalogue(spark, str(tmp_path)).select("location_id", "lat", "lon").first() == (7, 1.5, -2.5)


def test_missing_table_is_empty_with_schema(spark, tmp_path, people):
    assert readers.parquet_or_empty(spark, str(tmp_path / "none"), people.schema).columns == people.columns
    with pytest.raises(ValueError):
        readers.table(spark, "model.pkl")


def test_stacked_sections(spark, tmp_path):
    sinks.stacked(spark.createDataFrame([(1, "a")], "k int, n string"), spark.createDataFrame([(2.5, 2), (1.5, 1)], "v double, o int"), str(tmp_path / "out"), ["o"])
    text = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert text == ["k,n", "1,a", "v,o", "1.5,1", "2.5,2"]


def test_stream_equals_batch(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), events.schema, delay="1 day")
    q = windows.tumbling(stream, "ts", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["n"]) for r in spark.table("daily").collect()}
    assert got == {(r["start"], r["n"]) for r in windows.tumbling(events, "ts", "value", "1 day").collect()}


@pytest.mark.parametrize("kind", ["few", "ties", "skewed", "wide"])
def test_exact_quantiles_equal_percentile(spark, monkeypatch, kind):
    from solframe.operators import ranks

    monkeypatch.setattr(ranks, "ACCURACY", 200)
    monkeypatch.setattr(ranks, "REACH", 0.015)
    n = {"few": 7, "ties": 3000, "skewed": 5000, "wide": 20_000}[kind]
    x = {"few": F.col("id"), "ties": F.col("id") % 5, "skewed": F.exp(F.pmod(F.xxhash64("id"), F.lit(997)) / 50.0), "wide": F.xxhash64("id") / 1e10}[kind]
    df = spark.range(n).select(x.cast("double").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    at = [0.0, 0.001, 0.25, 0.5, 0.995, 1.0]
    for by in ([], ["g"]):
        want = {(*r[:-1],): r["q"] for r in df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect()}
        got = {(*r[: len(by)],): r["q"] for r in ranks.exact_quantiles(df, "v", at, by).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert [r["n"] for r in ranks.exact_quantiles(df.limit(0), "v", at).collect()] in ([], [None])


def test_zero_and_constant_inputs_give_nulls(spark):
    one = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    assert one.select(modules.string_length(F.col("v"), 1500)).first()[0] is None
    assert {r["density"] for r in stats.density(one, "v", 5).collect()} == {None}
    assert stats.histogram_edges(one, "v", F.min("v"), F.max("v"), 2).agg(F.sum("n")).first()[0] == 2
    v, i = curves.correct_p1(F.array(F.lit(1.0)), F.array(F.lit(1.0)), F.col("v"), F.lit(25.0), 1000.0, 25.0, *(F.lit(x) for x in (5.0, 0.002, -0.1, 0.3, 0.001)))
    assert one.select(v, i).first() == ([None], [None])
    days = spark.range(800).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(0.0).alias("v"))
    assert timeseries.year_on_year(days, [], "ts", "v").count() == 0


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),), (500.0,)], "v double")
    assert timeseries.iqr_flags(df, "v").filter("outlier").count() == 1
    assert FilterSpec(ranges={"v": (10, None)}).apply(df).count() == 11
    assert filter_tree(df, {"column": "v", "operator": ">", "value": 10}).count() == 10


def test_column_binding():
    from solframe.plans.requests import bind_columns, missing_essentials

    assert bind_columns(["t", "x"]) == dict.fromkeys(("Power", "Time", "DC Voltage", "DC Current"), "N/A")
    assert bind_columns(["Date", "DC_Power", "dc voltage (V)", "DC Current"]) == {"Power": "DC_Power", "Time": "Date", "DC Voltage": "dc voltage (V)", "DC Current": "DC Current"}
    assert missing_essentials(bind_columns(["power"])) == ["Time"]
