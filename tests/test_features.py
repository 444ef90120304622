"""Bootstrap, places, curves, densities, typed filters, declared reads, layouts and files against brute force."""

import datetime as dt
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solframe.functions import scalars
from solframe.operators import bootstrap, climate, curves, geo, modules, ranks, stats, timeseries
from solframe.plans import requests, schemas, scratch
from solframe.plans.predicates import FilterSpec, filter_tree, findings, problem_of
from solframe.sources import archives, layout, readers, sections, sinks

# bootstrap


def mixed(x):
    x = (x % 2**31 * 1103515245 + 12345) % 2**31
    x = ((x ^ x >> 16) * 1540483477 + 7) % 2**31
    return x ^ x >> 15


@pytest.fixture(scope="module")
def rates(spark):
    rng = np.random.default_rng(0)
    rows = [(None if s else "a", int(i * 86400 + 1_500_000_000), float(rng.normal(-1 - s, 2)), i) for s in (0, 1) for i in range(400)]
    return spark.createDataFrame(rows + [("a", 1_500_000_500, None, 0), ("b", 1_500_000_000, -3.0, 0)], "series string, s long, rate double, day int").withColumn("ts", F.timestamp_seconds("s"))


def pairs_of(rates):
    out = {}
    for r in rates.collect():
        if r["rate"] is not None:
            out.setdefault(r["series"], []).append((r["s"], r["rate"]))
    return out


def brute_interval(medians, confidence=68.2, exceedance=95):
    return [np.percentile(medians, q) for q in (50 - confidence / 2, 50 + confidence / 2, 100 - exceedance)]


def test_simple_bootstrap_equals_brute_force(rates):
    got = {r["series"]: r for r in bootstrap.interval(rates, ["series"], resamples=60).collect()}
    assert set(got) == {"a", None, "b"}
    for series, pairs in pairs_of(rates).items():
        medians = []
        for k in range(1, 61):
            weights = [sum(mixed(mixed(s % 2**31 + 1000003) + k * 7919) >= t for t in bootstrap.POISSON) for s, _ in pairs]
            drawn = [v for (_, v), w in zip(pairs, weights) for _ in range(w)]
            medians += [np.median(drawn)] if drawn else []
        r = got[series]
        assert r["pairs"] == len(pairs) and r["rate"] == pytest.approx(np.median([v for _, v in pairs]))
        assert [r["low"], r["high"], r["exceedance_level"]] == pytest.approx(brute_interval(medians))


def test_block_bootstrap_equals_brute_force(rates):
    got = {r["series"]: r for r in bootstrap.interval(rates, ["series"], method="circular_block", resamples=40, block_days=25).collect()}
    for series, pairs in pairs_of(rates).items():
        first = min(s for s, _ in pairs) // 86400
        days = max(s for s, _ in pairs) // 86400 - first + 1
        r = got[series]
        if days <= 75:
            assert (r["low"], r["high"], r["exceedance_level"]) == (None, None, None) and r["rate"] == -3.0
            continue
        medians = []
        for k in range(1, 41):
            starts = [mixed(mixed(k * 100003 + 1) + b * 7919) % days for b in range(1, math.ceil(days / 25) + 1)]
            drawn = [v for s, v in pairs for a in starts if (s // 86400 - first - a) % days < 25]
            medians.append(np.median(drawn))
        assert [r["low"], r["high"], r["exceedance_level"]] == pytest.approx(brute_interval(medians))


def test_bootstrap_covers_the_spread_of_a_median(rates):
    r = next(x for x in bootstrap.interval(rates, ["series"], confidence=95).collect() if x["series"] == "a")
    half = 1.96 * 1.2533 * 2 / 20
    assert 0.6 * half < (r["high"] - r["low"]) / 2 < 1.5 * half and r["exceedance_level"] < r["rate"]
    assert "low" not in bootstrap.interval(rates, ["series"], method=None).columns


def test_replicates_outside_the_window_get_a_second_round(rates, monkeypatch):
    want = sorted(map(tuple, bootstrap.interval(rates, ["series"], resamples=30).collect()), key=repr)
    monkeypatch.setattr(bootstrap, "DEVIATIONS", 0.0)
    assert sorted(map(tuple, bootstrap.interval(rates, ["series"], resamples=30).collect()), key=repr) == want


def test_usage_and_given_normalisation(spark):
    points = spark.range(0, 800).select(F.lit(None).cast("string").alias("s"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), (2 - 0.02 * F.col("id") / 365).alias("v"))
    r = timeseries.year_on_year(points, ["s"], "ts", "v", 0, recentre_days=None)
    used = {x["usage"]: x["n"] for x in bootstrap.usage_of_points(points, r, ["s"], "ts").groupBy("usage").agg(F.count("*").alias("n")).collect()}
    assert used == {1: 2 * 365 + 0, 2: 800 - 2 * 365} and r.count() == 435
    assert r.agg(F.avg("rate")).first()[0] == pytest.approx(-2.0)


# ranks


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, f"w{i % 11}", i) for i in range(500)], "k int, w string, i int")
    a, b = ({r["i"]: r["row_id"] for r in ranks.row_ids(d, ["k", "w"]).collect()} for d in (df, df.orderBy(F.desc("i")).repartition(9)))
    assert a == b and sorted(a.values()) == list(range(500))
    order = [r for r in sorted(df.collect(), key=lambda r: (r["k"] is not None, r["k"] or 0, r["w"], r["i"]))]
    assert [a[r["i"]] for r in order] == list(range(500))
    hot = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert ranks.row_ids(hot, ["k"]).filter("row_id <> id").count() == 0 and ranks.row_ids(df.limit(0), ["k"]).count() == 0


# places


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(1)
    clustered = [(int(i), float(rng.normal(30, 0.01)), float(rng.normal(-100, 0.01))) for i in range(700)]
    grid = clustered + [(int(i), float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(700, 900)] + [(900, 10.0, 10.0), (901, 10.0, 10.0), (902, None, 1.0), (903, float("nan"), 1.0)]
    points = [(int(i), float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(200)] + [(300, 30.0, -100.0), (301, 10.0, 10.0), (302, 89.0, 179.0), (303, None, 0.0), (304, float("nan"), 0.0)]
    schema = "{} int, lat double, lon double"
    return spark.createDataFrame(points, schema.format("p")), spark.createDataFrame(grid, schema.format("g")), points, grid


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("crowded", [4, 256])
def test_nearest_in_degrees_on_both_sides_of_the_limit(places, few, crowded, monkeypatch):
    p, g, points, grid = places
    monkeypatch.setattr(geo, "CROWDED", crowded)
    got = {r["p"]: (r["g"], r["degrees"]) for r in geo.nearest_in_degrees(p, g, "p", "g", few).collect()}
    sound = lambda rows: [(i, a, o) for i, a, o in rows if a is not None and a == a]
    assert set(got) == {i for i, _, _ in sound(points)}
    for i, a, o in sound(points):
        d, k = min((math.sqrt((a - b) ** 2 + (o - q) ** 2), j) for j, b, q in sound(grid))
        assert got[i][0] == k and got[i][1] == pytest.approx(d)


def test_nearest_of_many_points_by_rings(places, monkeypatch):
    p, g, points, grid = places
    p, g = p.filter("lat between -80 and 80"), g.filter("lat is not null and not isnan(lat)")
    want = {(r["p"], r["g"], round(r["km"], 6)) for r in geo.nearest(p, g, "p", "g").collect()}
    monkeypatch.setattr(geo, "FEW", 0)
    assert {(r["p"], r["g"], round(r["km"], 6)) for r in geo.nearest(p, g, "p", "g").collect()} == want


def test_a_layout_opens_only_the_folders_it_needs(spark, tmp_path):
    table = spark.range(20_000).select((F.col("id") % 100).alias("place"), F.col("id").alias("hour"), (F.col("id") * 0.5).alias("ghi"))
    layout.write_by_place(table, str(tmp_path / "w"), "place", ["hour"], 16)
    wanted = spark.createDataFrame([(3,), (77,), (None,)], "place long")
    got = layout.at_places(spark, str(tmp_path / "w"), wanted, "place", 16)
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruning" in plan.lower()
    assert sorted(r["hour"] for r in got.collect()) == [i for i in range(20_000) if i % 100 in (3, 77)] and set(got.columns) == {"place", "hour", "ghi"}
    scan = [x for x in _leaves(got._jdf.queryExecution().executedPlan()) if "FileSourceScan" in x.getClass().getSimpleName()]
    read = sum(x.metrics().apply("numFiles").value() for x in scan)
    everything = spark.read.parquet(str(tmp_path / "w"))
    parts = {r[0] for r in wanted.filter("place is not null").select(layout.place_part(F.col("place"), 16)).collect()}
    files = {r["path"] for r in layout.files_of(everything.filter(F.col(layout.PART).isin(*parts))).collect()}
    assert read == len(files) < len(everything.inputFiles())
    assert layout.files_of(everything).agg(F.sum("rows")).first()[0] == 20_000


def _leaves(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _leaves(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _leaves(plan.plan())
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    return [x for c in children for x in _leaves(c)] if children else [plan]


# curves and densities


def brute_area(v, i, rv, ri):
    grid = np.unique(np.concatenate([v, rv]))
    fine = np.unique(np.concatenate([np.linspace(a, b, 4001) for a, b in zip(grid, grid[1:])]))
    at = lambda x, y: np.interp(fine, np.sort(x), np.asarray(y)[np.argsort(x)])
    return np.trapezoid(np.abs(at(v, i) - at(rv, ri)), fine), np.trapezoid(at(rv, ri), fine)


def test_area_between_curves_of_their_own_grids(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        v, rv = rng.permutation(np.round(rng.uniform(0, 40, 9), 3)), np.sort(np.round(rng.uniform(0, 42, 7), 3))
        rows.append((k, v.tolist(), rng.uniform(0, 5, 9).tolist(), rv.tolist(), rng.uniform(0, 5, 7).tolist()))
    odd = [(100, [0.0, 10.0], [1.0, 0.0], [0.0, 10.0], [0.0, 1.0]), (101, [0.0, 1.0], [1.0, 1.0], [], []), (102, None, None, [0.0], [1.0]), (103, [0.0, None, 10.0, 10.0], [2.0, 9.0, 1.0, 3.0], [0.0, 10.0], [2.0, 2.0]), (104, [0.0, 1.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "id int, v array<double>, i array<double>, ref_v array<double>, ref_i array<double>")
    got = {r["id"]: r for r in curves.area_between(df, ["id"]).collect()}
    for k, *arrays in rows:
        between, reference = brute_area(*map(np.array, arrays))
        assert got[k]["between"] == pytest.approx(between, rel=1e-5) and got[k]["reference"] == pytest.approx(reference, rel=1e-6)
        assert got[k]["error"] == pytest.approx(100 * between / reference, rel=1e-5)
    assert got[100]["between"] == pytest.approx(5.0) and got[100]["error"] == pytest.approx(100.0)
    assert all(got[k]["between"] is None and got[k]["error"] is None for k in (101, 102))
    assert got[103]["between"] == 0 and got[104]["error"] is None


def test_density_is_within_its_bound(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(5, 2, 4000), np.concatenate([rng.normal(0, 1, 500), [1e6, -1e6]]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
        got = {r["i"]: r for r in stats.density(df, "v", 50).collect()}
        h, x = values.std(ddof=1) * len(values) ** -0.2, np.linspace(values.min(), values.max(), 50)
        want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1)
        for i in range(50):
            assert abs(got[i]["density"] * len(values) * h * math.sqrt(2 * math.pi) - want[i]) <= 1e-12 * len(values) + 1e-9 * want[i]
    plan = stats.density(df, "v", 50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "").replace("BroadcastNestedLoopJoin BuildRight, Inner", "")


def test_values_without_a_place(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double").withColumn("w", F.lit(2.0))
    assert sorted(map(tuple, stats.histogram(df, "v", 3).collect())) == [(0, 3), (1, 3), (2, 4)]
    assert sorted(map(tuple, stats.weighted_histogram(df, "v", "w", 3).collect())) == [(0, 6.0), (1, 6.0), (2, 8.0)]
    flat = df.filter("v = 4")
    assert stats.histogram(flat, "v", 4).first()["bin"] == stats.weighted_histogram(flat, "v", "w", 4).first()["bin"] == 2
    r = spark.range(1).select(modules.isotherm(F.lit(1.0), F.lit(1000.0), F.lit(48.5), F.lit(0.0), F.lit(72), F.lit(1.05)).alias("t"), scalars.half_even(F.lit(2.5)).alias("e"), scalars.rounded_label("x", F.lit(1.005), 1).alias("l")).first()
    assert r["t"] is None and float(r["e"]) == 2.0 and r["l"] == "x: 1.0"


# typed filters


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(1, True, dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3), dt.datetime(2020, 1, 2, 3), 1.5, "7", ["a", "b"], {"k": 1}), (2, False, dt.date(2021, 5, 6), dt.datetime(2021, 5, 6), dt.datetime(2021, 5, 6), float("nan"), "x", [], {}), (3, *[None] * 8)]
    return spark.createDataFrame(rows, "id int, flag boolean, day date, ts timestamp, ntz timestamp_ntz, x double, word string, list array<string>, m map<string,int>")


@pytest.mark.parametrize(("column", "operator", "value", "ids", "problem"), [
    ("flag", "==", 1, {1}, None), ("flag", "==", "false", {2}, None), ("flag", ">", 0.5, {1}, None), ("flag", "!=", "maybe", {1, 2, 3}, "never"), ("flag", "==", 2, set(), None), ("flag", "<", float("nan"), set(), "never"),
    ("day", ">", "2020-06-01", {2}, None), ("day", "==", dt.date(2020, 1, 2), {1}, None), ("day", "<", "yesterday", set(), "never"), ("day", "==", 5, set(), "never"), ("day", "!=", "soon", {1, 2, 3}, "never"),
    ("day", "<", "2020-01-02T12:00:00", {1}, None), ("ts", "<=", "2020-01-02T04:00:00+01:00", {1}, None), ("ts", "<", "2020-01-02T03:00:00+01:00", set(), None), ("ntz", ">=", "2020-01-02 03:00", {1, 2}, None), ("ts", "==", True, set(), "never"),
    ("x", ">", "1", {1}, None), ("x", "==", 10**400, set(), "never"), ("x", "<", 10**30, {1}, None), ("x", "!=", 1.5, {2, 3}, None), ("x", "==", None, {2, 3}, None), ("x", ">", True, {1}, None), ("id", "==", 10**25, set(), None), ("id", ">", -(10**25), {1, 2, 3}, None),
    ("word", "==", 7, {1}, None), ("word", "<", "y", {1, 2}, None), ("word", "==", True, set(), "never"), ("word", "==", ["7"], set(), "never"), ("word", "==", None, {3}, None),
    ("list", "==", ["a", "b"], {1}, None), ("list", "!=", ["a", "b"], {2, 3}, None), ("list", "==", ["a", 1], set(), "never"), ("list", "==", "a", set(), "never"), ("list", "contains", "A", {1}, None),
    ("m", "==", 1, set(), "never"), ("m", "contains", "k", {1}, None), ("word", "~", 1, {1, 2, 3}, "operator"), ("gone", "==", 1, {1, 2, 3}, "column"),
])
def test_no_leaf_fails(typed, column, operator, value, ids, problem):
    node = {"column": column, "operator": operator, "value": value}
    assert {r["id"] for r in filter_tree(typed, node).select("id").collect()} == ids
    found = problem_of(typed, node)
    assert (found is None) == (problem is None) and (problem or "") in (found or "")


def test_patterns_and_findings(typed):
    leaf = {"column": "word", "operator": "contains", "value": "(x"}
    assert filter_tree(typed, leaf, regex=True).count() == 0 and problem_of(typed, leaf, regex=True) and problem_of(typed, leaf) is None
    tree = {"conditions": [{"conditions": [leaf, {"column": "x", "operator": ">", "value": "?"}]}, {"column": "id", "operator": ">", "value": 1}]}
    rows = findings(typed, tree).orderBy("place").collect()
    assert [(r["place"], r["passes"], r["problem"] is None, r["type"]) for r in rows] == [("0.0", 0, True, "string"), ("0.1", 0, False, "double"), ("1", 2, True, "int")]
    assert findings(typed, None).count() == 0


def test_nan_amounts_are_not_reported(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 5000.0), (4, 5e6)], "id int, w double")
    keep = lambda yes, no: {r["id"] for r in FilterSpec(amounts={"w": (yes, no, 1, 100)}).apply(df).collect()}
    assert keep(True, True) == {1, 2, 3} and keep(False, True) == {1, 2} and keep(True, False) == {3}


def test_requests(spark):
    names = ["Timestamp", "Vdc", "AC_Power (W)", "Module Temperature"]
    df = spark.createDataFrame([(names,), ([],), (["power", "Power 2", "date"],)], "n array<string>")
    got = [{x["metric"]: x["variable"] for x in r[0]} for r in df.select(requests.binding(F.col("n"))).collect()]
    assert got == [requests.bind_columns(n) for n in (names, [], ["power", "Power 2", "date"])]
    data = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 4.0), (None, 9.0)], "g string, x double")
    rows = {r["g"]: (r["median_x"], r["p100_x"], r["count_x"]) for r in requests.AnalysisSpec(["median", "p100", "count"], ["x"], ["g"]).apply(data).collect()}
    assert rows == {"a": (2.5, 4.0, 2), None: (9.0, 9.0, 1)}
    with pytest.raises(ValueError, match="p101"):
        requests.AnalysisSpec(["p101"], ["x"]).apply(data)


def test_bound_columns_cost_a_step_each(spark):
    """Bindings to all quantities don't repeat those of earlier ones: a name is made plain in one place of the plan."""
    lists = [["Power", "power", None, "Power"], ["N/A", "imp", "I_mp", "V mp", "kW", "ts"], [None], None, ["Voltage", "dc voltage", "DC-Voltage"], ["date time", "DATE", "current", "DC Current", "p"], ["time power voltage current"] * 2]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lists)], "i int, n array<string>")
    got = {r["i"]: {x["metric"]: x["variable"] for x in r["b"]} for r in df.select("i", requests.binding(F.col("n")).alias("b")).collect()}
    assert [got[i] for i in range(len(lists))] == [requests.bind_columns([x for x in n or [] if x is not None]) for n in lists]
    plan = df.select(requests.binding(F.col("n")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_replace") == 1


def test_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FOLDERS", 10, raising=False)
    table = spark.range(100).select(F.format_string("%03d_%.1f_%.1f", "id", F.col("id") / 2, -F.col("id") / 4).alias("place"), F.lit("x").alias("value"))
    sinks.text_by_folder(table, str(tmp_path / "t"), "place")
    files = sorted((tmp_path / "t").glob("place=*/*.txt"))
    assert len(files) == 100 and len({f.name for f in files}) > 5  # a file is named by its task
    found = readers.catalogue(spark, str(tmp_path / "t"), r"place=(\d+)_(-?[\d.]+)_(-?[\d.]+)/[^/]+\.txt$", ["location_id", "lat", "lon"], "*.txt").collect()
    assert [(r["row_id"], r["location_id"], r["lat"], r["lon"]) for r in found] == [(i, i, i / 2, round(-i / 4, 1) if i % 2 == 0 else r["lon"]) for i, r in enumerate(found)]


# declared reads


def test_rows_that_do_not_fit_are_kept(spark, tmp_path):
    schema = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("b", T.BooleanType()), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("d", T.DateType())])
    raw = spark.createDataFrame([("1", "true", "[1, 2]", "x"), ("one", "maybe", None, None), (None, None, "[", None)], "a string, b string, c string, extra string")
    rows = schemas.conform(raw, schema).collect()
    assert [tuple(r)[:4] for r in rows] == [(1, True, [1.0, 2.0], None), (None, None, None, None), (None, None, None, None)]
    assert [r[schemas.RESCUED] for r in rows] == ['{"extra":"x"}', '{"A":"one","b":"maybe"}', '{"c":"["}']
    counts = {r["column"]: r["rows"] for r in schemas.rescue_counts(schemas.conform(raw, schema)).collect()}
    assert counts == {"extra": 1, "A": 1, "b": 1, "c": 1, None: 3}
    assert schemas.conform(raw.limit(0), schema).count() == 0 and schemas.rescue_counts(schemas.conform(raw.limit(0), schema)).count() == 0
    raw.write.json(str(tmp_path / "t.json"))
    assert sorted(r["A"] or 0 for r in readers.declared(spark, str(tmp_path / "t.json"), schema).collect()) == [0, 0, 1]
    raw.write.parquet(str(tmp_path / "t.parquet"))
    assert readers.declared(spark, str(tmp_path / "t.parquet"), schema).filter(F.col(schemas.RESCUED).isNotNull()).count() == 3
    assert schemas.conform(spark.createDataFrame([(1, True, [1.0], None)], schema), schema).first()[schemas.RESCUED] is None
    with pytest.raises(ValueError, match="colour"):
        schemas.from_dictionary({"x": {"type": "colour"}})
    assert {f.dataType for f in schemas.from_dictionary({"x": {"type": "float"}, "n": {"type": "integer"}}).fields} == {T.DoubleType(), T.LongType()}


# files


def weather_file(folder, name, minutes, zone="-7", year=2001, rows=4):
    body = "\n".join(f"{year},1,1,{i * minutes // 60},{i * minutes % 60},{i}" for i in range(rows))
    (folder / name).write_text(f"Source,Time Zone,Location ID\nNSRDB,{zone},{name[0]}\nYear,Month,Day,Hour,Minute,GHI\n{body}\n")


def test_weather_sequence(spark, tmp_path):
    with pytest.raises(ValueError, match="no CSV files"):
        layout.weather_sequence(spark, str(tmp_path))
    weather_file(tmp_path, "2_b.csv", 60, zone="-5", year=2002, rows=30)
    weather_file(tmp_path, "1_a.csv", 30, rows=50)
    table, info = layout.weather_sequence(spark, str(tmp_path))
    rows = table.orderBy("file_no", "pos").collect()
    assert [r["file_no"] for r in rows] == [0] * 50 + [1] * 30 and rows[0]["path"].endswith("1_a.csv")
    assert rows[1]["ts"] == dt.datetime(2001, 1, 1, 0, 30) and rows[1]["utc_ts"] == dt.datetime(2001, 1, 1, 7, 30) and rows[0]["problem"] is None
    last = info.first()
    assert last["metadata"]["Time Zone"] == "-5" and last["interval_hours"] == 1.0 and last["timedelta_in_years"] == pytest.approx(366 / 365)


def test_the_first_path_there_is(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    assert readers.first_found(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_found(spark, [str(tmp_path / "a.parquet")])


def test_weather_files_with_problems(spark, tmp_path):
    weather_file(tmp_path, "a.csv", 15)
    weather_file(tmp_path, "b.csv", 60, zone="west")
    got = {r["path"][-5:]: (r["problem"], r["ts"] is None, r["utc_ts"] is None) for r in readers.weather_csv(spark, f"{tmp_path}/*.csv").filter("pos = 1").collect()}
    assert got == {"a.csv": ("interval not understood", True, True), "b.csv": ("no time zone", False, True)}


def test_sections(spark, tmp_path):
    a = spark.createDataFrame([(2, 'say "x", y', 1.5), (1, "", None), (3, None, float("nan")), (4, " b\n c ", 0.0)], "id int, `na,me` string, v double")
    b = spark.createDataFrame([("k", "1")], "name string, value string")
    sections.write_sections([sections.Section("A", a, ["id"]), sections.Section("B", b, ["name"], header=False), sections.Section("A", a.limit(0), ["id"])], str(tmp_path / "t"))
    read = sections.read_sections(spark, str(tmp_path / "t"))
    assert {(r["section"], r["title"]) for r in read.collect()} == {(0, "A"), (1, "B"), (2, "A")}
    assert read.filter("place = 0").orderBy("section").first()["line"] == 'id,"na,me",v'
    back = sections.section(read.filter("section = 0"), "A", "id int, name string, v double").orderBy("place").collect()
    assert [(r["id"], r["name"]) for r in back] == [(1, ""), (2, 'say "x", y'), (3, None), (4, " b  c ")] and back[0]["v"] is None and back[1]["v"] == 1.5
    assert sections.section(read, "B", "name string, value int", header=False).first()["value"] == 1
    sinks.stacked(spark.createDataFrame([("a,b", 1)], "k string, n int"), spark.createDataFrame([(2.5, 2), (1.5, 1)], "v double, o int"), str(tmp_path / "s"), ["o"])
    lines = [r[0] for r in sorted(spark.read.text(str(tmp_path / "s")).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect(), key=lambda r: (r["f"], r["i"]))]
    assert lines == ["k,n", '"a,b",1', "v,o", "1.5,1", "2.5,2"] or [x for x in lines if x] == ["k,n", '"a,b",1', "v,o", "1.5,1", "2.5,2"]


def test_simulation_sections(spark, tmp_path):
    weather = spark.createDataFrame([("Time Zone", "-7"), ("Latitude", "39.7"), ("Location ID", "5"), ("Zenith", "1")], "name string, value string")
    module = spark.createDataFrame([("Voco", 48.5)], "name string, value double")
    volts = spark.createDataFrame([("P99.5", 50.0)], "case string, v_oc double")
    bars = spark.createDataFrame([(1.0, 2.0), (0.5, 3.0)], "voc double, hours_per_year double")
    sections.write_sections(sections.simulation_sections(weather, module, module, module, 1500, "1", modules.with_notes(volts), bars, "2026-01-01"), str(tmp_path / "t"))
    read = sections.read_sections(spark, str(tmp_path / "t"))
    told = sections.section(read, "Weather data", "place int, name string, value string", header=False).orderBy("place").collect()
    assert [r["name"] for r in told] == list(sections.WEATHER_KEYS) and {r["name"]: r["value"] for r in told if r["value"]} == {"local_time_zone": "-7", "Latitude": "39.7", "Location_ID": "5"}
    assert sections.section(read, "Voc Histogram", "voc double, h double").orderBy("place").first()["voc"] == 0.5
    assert sections.section(read, "Key Voc Values", "c string, v double, note string").first()["note"] == modules.CASE_NOTES["P99.5"]


def archive(**entries):
    out = io.BytesIO()
    np.savez(out, **entries)
    return out.getvalue()


def test_archives_of_mixed_contents(spark):
    made = archive(
        city=np.array("Golden"), zone=np.array(-7), lat=np.array(39.7), ok=np.array(True), year=np.arange(3), big=np.array([2**63], np.uint64), ghi=np.array([1.5, np.nan]), name=np.array(["a", "bc", "d", "e"]),
        grid=np.arange(6).reshape(2, 3), bad=np.array([{"x": 1}], object), when=np.array(["2020-01-01", "NaT"], "datetime64[D]"), none=np.zeros(0), odd=np.array([1 + 2j]),
    )
    table = spark.createDataFrame([("one", bytearray(made)), ("two", bytearray(b"no archive")), ("three", None), ("four", bytearray(archive(zone=np.array(2.5), local_time_zone=np.array(2.5), year=np.array([2001]), month=np.array([2]), day=np.array([3]), hour=np.array([4]), minute=np.array([30]))))], "path string, content binary")
    found = archives.entries(table)
    rows = {(r["path"], r["name"]): r for r in found.collect()}
    kind = lambda n: rows["one", n]["kind"]
    assert [kind(n) for n in ("city", "zone", "lat", "ok", "ghi", "bad", "odd", "big")] == ["text", "whole", "number", "flag", "number", "object", "object", "number"]
    assert rows["two", None]["kind"] == "unreadable" and rows["one", "bad"]["texts"] is None and rows["one", "grid"]["shape"] == [2, 3] and rows["one", "ghi"]["numbers"] == [1.5, None]
    assert rows["one", "when"]["texts"] == ["2020-01-01", None] and not any(p == "three" for p, _ in rows)
    facts = {r["path"]: r for r in archives.scalars_of(found).collect()}
    assert facts["one"]["text"] == {"city": "Golden"} and facts["one"]["whole"] == {"zone": -7, "ok": 1} and facts["one"]["number"] == {"lat": 39.7} and facts["two"]["text"] is None
    wide = {(r["path"], r["pos"]): r for r in archives.vectors_of(found, {"year": "int", "ghi": "double", "name": "string", "grid": "bigint", "absent": "int"}).collect()}
    assert len([k for k in wide if k[0] == "one"]) == 6 and wide["one", 1]["ghi"] is None and wide["one", 3]["name"] == "e" and wide["one", 3]["year"] is None and wide["one", 5]["grid"] == 5
    w = archives.weather(found).filter("path = 'four'").first()
    assert w["ts"] == dt.datetime(2001, 2, 3, 4, 30) and w["utc_ts"] == dt.datetime(2001, 2, 3, 2, 0)


def test_clock(spark):
    rows = lambda shift: spark.range(48).select(F.timestamp_seconds(F.col("id") * 3600 + 3600 * shift).alias("ts"), F.when(F.col("id") % 24 == 12, 9.0).otherwise(1.0).alias("v"))
    assert "days peak as expected" in timeseries.clock_report(rows(0), "ts", "v").first()[0]
    late = rows(5).filter("ts >= timestamp '1970-01-02' and ts < timestamp '1970-01-03'")
    assert "days peak late" in timeseries.clock_report(late, "ts", "v").first()[0]
    moved = timeseries.repair_clock(late, "ts", "v").first()
    assert moved["fixed_ts"] == moved["ts"] - dt.timedelta(hours=1)
    gap = rows(0).filter("hour(ts) <> 2")
    assert "hour 2 is missing" in timeseries.clock_report(gap, "ts", "v", "America/Denver").first()[0]
    assert "hour 2 is doubled" in timeseries.clock_report(rows(0), "ts", "v", many=1).first()[0]


def test_tables_of_stressors():
    assert len(climate.FIRST) == 18 and len(climate.DETAIL) == 26 and climate.DETAIL[0] == "T_equiv_rack_0p1eV" and climate.DETAIL[21] == "T_equiv_roof_2p1eV"


def test_small_sides(spark, monkeypatch):
    df = spark.range(10)
    assert "broadcast" in scratch.held(df)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(scratch, "FEW", 5)
    for kept in (scratch.held(df), scratch.small(df)):
        assert "broadcast" not in kept._jdf.queryExecution().logical().toString().lower() and kept.count() == 10
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    assert sorted(r["y"] for r in scratch.beside(left, left.select("k", F.col("x").alias("y")), ["k"]).collect()) == [1, 2]
