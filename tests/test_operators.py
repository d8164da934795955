"""Small inputs with results worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colscope.functions import types
from colscope.functions.quantiles import quantiles
from colscope.operators import binning, charts, clean, encode, impact, report, univariate
from colscope.operators.profile import profile, profile_record

NUMBERS = [1.0, 2.0, 3.0, 4.0, 10.0, None]
KINDS = [(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "c")]


@pytest.fixture
def doubles(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "x double")


@pytest.fixture
def kinds(spark):
    return spark.createDataFrame(KINDS, "i int, k string")


def test_numeric(doubles):
    s = univariate.univariate_numeric(doubles(*NUMBERS), "x").first()
    assert (
        s["count"], s.null_count, s["mean"], s.median, s["min"], s["max"], s["range"], s.variance
    ) == (5, 1, 4.0, 3.0, 1.0, 10.0, 9.0, 12.5)
    assert s["std"] == pytest.approx(3.5355339059)
    assert s["skewness"] == pytest.approx(1.1384199577)
    assert (
        s.q1, s.q3, s.iqr, s.lower_bound, s.upper_bound, s.outlier_count, s.skew_class
    ) == (2.0, 4.0, 2.0, -1.0, 7.0, 1, "right-skewed")


def test_quartile_rules(doubles):
    df = doubles(1.0, 2.0, 3.0, 4.0, None)
    near, line = (univariate.quartiles(df, "x", rule).first() for rule in ("nearest", "linear"))
    assert (near.q1, near.q3, line.q1, line.q3) == (2.0, 3.0, 1.75, 3.25)


@pytest.mark.parametrize("values", [[7.0, 7.0, 7.0, None], [5.0, None], [None], []])
def test_degenerate(doubles, values):
    s = univariate.univariate_numeric(doubles(*values), "x").first()
    known = [v for v in values if v is not None]
    assert s["skewness"] is None and s.skew_class == "undetermined" and s.outlier_count == 0
    assert (s["count"], s.q1, s.q3) == (len(known), known[0] if known else None, known[0] if known else None)
    assert "undetermined" in report.numeric_report(doubles(*values), "x")


def test_skew_class(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, -0.5, 0.49, float("nan"), None, -3.0)], "s double")
    assert [r[0] for r in df.select(univariate.skew_class(F.col("s"))).collect()] == [
        "right-skewed", "left-skewed", "approximately symmetric", "undetermined", "undetermined", "left-skewed"
    ]


def test_categorical(kinds):
    s = univariate.univariate_categorical(kinds, "k").first()
    assert (s.modes, s.n_modes, s.n_unique, s.valid_count, s.null_count, s.total_count) == (["a", "b"], 2, 3, 5, 1, 6)
    table = [
        (r.Column_value, r.Value_count, round(r.Frequency, 6))
        for r in univariate.sorted_frequency_table(kinds, "k").collect()
    ]
    assert table == [("a", 2, 0.333333), ("b", 2, 0.333333), ("c", 1, 0.166667), (None, 1, 0.166667)]
    assert "most frequent: a, b" in report.categorical_report(kinds, "k")
    empty = kinds.filter("i < 0")
    assert "No valid data found." in report.categorical_report(empty, "k") and univariate.frequency_table(empty, "k").count() == 0


def test_all_modes_are_listed(spark):
    df = spark.range(1500).selectExpr("lpad(id, 4, '0') AS s")
    s = univariate.univariate_categorical(df, "s").first()
    assert (s.modes, s.n_modes) == ([f"{i:04}" for i in range(1500)], 1500)
    assert univariate.univariate_categorical(df, "s", most_modes=2).first().modes == ["0000", "0001"]


def test_profile(spark, kinds):
    assert {
        r["column"]: (r.dtype, r.nulls, r.nunique, r.n_rows) for r in profile(kinds).collect()
    } == {"i": ("int", 0, 6, 6), "k": ("string", 1, 4, 6)}
    found = profile_record(kinds.filter("i < 0"))
    assert found["n_rows"] == 0 and found["stats"] == {"i_nulls": 0, "i_nunique": 0, "k_nulls": 0, "k_nunique": 0}
    odd = spark.createDataFrame([(1, {"a": 1})], "`a.b` int, m map<string,int>")
    assert [r.nunique for r in profile(odd).collect()] == [1, None]
    assert [r.nunique for r in profile(kinds, approximate=True).collect()] == [6, 4]


def test_encodings(kinds):
    def codes(df):
        return [r.k_encoded for r in df.orderBy("i").collect()]

    assert codes(encode.encode(kinds, "k", "label", "i")) == [0, 1, 0, None, 1, 2]
    assert codes(encode.encode(kinds, "k", "ordinal")) == [1, 0, 1, None, 0, 2]
    assert codes(encode.encode(kinds, "k", "frequency")) == pytest.approx([2 / 6, 2 / 6, 2 / 6, 1 / 6, 2 / 6, 1 / 6])
    assert codes(
        encode.encode(kinds, "k", "frequency", "i", scope="preview", length=3)
    ) == pytest.approx([2 / 3, 1 / 3, 2 / 3])
    hot = encode.encode(kinds, "k", "one_hot")
    assert hot.columns == ["i", "k_a", "k_b", "k_c", "k_null"]
    assert all(sum(r[1:]) == 1 for r in hot.collect())
    with pytest.raises(encode.TooManyValues):
        encode.encode_one_hot(kinds, "k", most=2)
    with pytest.raises(ValueError):
        encode.encode(kinds, "k", "label")
    with pytest.raises(ValueError):
        encode.encode(kinds, "k", "target")


def test_many_categories(spark):
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5003).alias("i"), F.concat(F.lit("v"), F.col("id") % 1500).alias("k")
    )
    values = [(r.i, r.k) for r in df.collect()]
    first = {}
    for i, k in sorted(values):
        first.setdefault(k, len(first))
    order = {k: n for n, k in enumerate(sorted(first))}
    for kind, codes in (("label_encoding", first), ("ordinal_encoding", order)):
        found = encode.encode(df, "k", kind, "i")
        assert found.dtypes[-1] == ("k_encoded", "bigint")
        assert {(r.i, r.k_encoded) for r in found.collect()} == {(i, codes[k]) for i, k in values}


def test_whole_numbers_stay_whole(spark):
    big = 2**53
    s = univariate.univariate_numeric(spark.createDataFrame([(big + 1,), (big + 3,), (None,)], "x long"), "x").first()
    assert (s["min"], s["max"], s["range"]) == (big + 1, big + 3, 2)
    widest = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "x long")
    assert univariate.moments(widest, "x").first()["range"] is None


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(30).selectExpr("concat('v', id) AS s")
    text = report.categorical_report(df, "s", rows=10)
    assert "and 20 more" in text and "20 more values are left out" in text and "left out" not in report.categorical_report(df, "s")
    assert len(report.categorical_report(df, "s").split("\n")) == 2 + 31 + 1


def test_hot_groups_meet_in_parts(spark, monkeypatch):
    from colscope.functions import quantiles as q

    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plain = sorted(map(tuple, quantiles(rows, "x", [("m", 0.5, "linear")], ["g"]).collect()), key=repr)
    monkeypatch.setattr(q, "GROUPS", 0)
    assert sorted(map(tuple, quantiles(rows, "x", [("m", 0.5, "linear")], ["g"]).collect()), key=repr) == plain


def test_bins(doubles):
    df = doubles(1.0, 2.0, 4.0, 5.0, 7.0, 10.0, None)
    assert [r.x_binned for r in binning.bin_equal_width(df, "x", 3).collect()] == [0, 0, 0, 1, 1, 2, None]
    assert binning.quantile_breaks(doubles(1.0, 1.0, 1.0, 1.0, 2.0, 3.0), "x", 4).first()[0] == [1.0, 1.75]
    assert {r.x_binned for r in binning.bin_equal_width(doubles(7.0, 7.0), "x", 5).collect()} == {0}
    assert [r.x_binned for r in binning.bin_quantile(doubles(None, 3.0), "x", 1).collect()] == [None, 0]
    with pytest.raises(binning.NotApplicable):
        binning.spread(doubles(7.0, 7.0), "x")
    z = binning.standardize(df, "x").agg(F.mean("x_std"), F.stddev("x_std")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)


def test_cleaning(spark, doubles, kinds):
    df = doubles(*NUMBERS)
    found = {
        a: sorted(r.x for r in clean.clean(df, "x", a).collect())
        for a in ("drop_rows", "impute_mean", "impute_median", "impute_mode")
    }
    known = [v for v in NUMBERS if v is not None]
    assert found == {
        "drop_rows": known,
        "impute_mean": sorted([*known, 4.0]),
        "impute_median": sorted([*known, 3.0]),
        "impute_mode": sorted([*known, 1.0]),
    }
    assert [
        r.k for r in clean.clean(kinds, "k", "impute_mode").orderBy("i").collect()
    ] == ["b", "a", "b", "a", "a", "c"]
    assert clean.clean(kinds, "k", "drop_column").columns == ["i"]
    assert clean.clean(kinds, "i", "cast_dtype", "Float64").dtypes[0] == ("i", "double")
    assert clean.clean(kinds, "k", "cast_dtype", "Int32", strict=False).filter("k IS NULL").count() == 6
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.clean(kinds, "k", "cast_dtype", "Int32").collect()
    for wrong in (
        lambda: clean.clean(kinds, "k", "cast_dtype"),
        lambda: clean.clean(kinds, "i", "cast_dtype", "int"),
        lambda: clean.clean(kinds, "i", "polish"),
        lambda: clean.clean(kinds, "z", "drop_rows"),
    ):
        with pytest.raises(ValueError):
            wrong()
    assert clean.clean(doubles(None, None), "x", "impute_median").filter("x IS NULL").count() == 2


def test_gates(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1.5 AS d, 'a' AS s, true AS b, date '2024-01-01' AS t, array(1) AS a, CAST(1 AS DOUBLE) AS f"
    )
    assert [c for c in df.columns if types.is_numeric(df, c)] == ["i", "f"]
    assert [c for c in df.columns if types.is_categorical(df, c)] == ["s"]
    with pytest.raises(types.WrongType):
        univariate.univariate_numeric(df, "d")
    with pytest.raises(types.ColumnMissing):
        univariate.univariate_categorical(df, "zz")


def test_charts(spark):
    df = spark.createDataFrame(
        [("a", float(i), i) for i in range(10)] + [("b", 100.0, 1), ("a", 50.0, 2), (None, 1.0, 1)],
        "c string, x double, n int",
    )
    kind, box = charts.chart_data(df, ["x", "c"])
    assert kind == "box"
    a = box.filter("category = 'a'").first()
    assert (a.n, a.q1, a.median, a.q3, a.whisker_low, a.whisker_high, a.fliers) == (11, 2.5, 5.0, 7.5, 0.0, 9.0, 1)
    bins = charts.histogram(df, "x").collect()
    assert sum(r["count"] for r in bins) == 13
    assert [(r.bin, r["count"]) for r in charts.histogram(df.filter("n = 1 AND c = 'b'"), "x").collect()] == [(0, 1)]
    assert charts.histogram(df.filter("false"), "x").count() == 0
    assert charts.chart_data(df, ["x", "n", "c"])[0] == "scatter_hue"
    grid = charts.density(df, "x").orderBy("x").collect()
    step = grid[1].x - grid[0].x
    assert sum(r.density for r in grid) * step == pytest.approx(1, abs=0.02)
    for none in (["c", "c"], [], ["x", "n", "c", "c"]):
        with pytest.raises(ValueError):
            charts.chart_data(df, none)


def test_impact(kinds):
    p = profile_record(kinds)
    assert impact.impact(p, "k", "drop_rows") == (1, 1 / 6)
    assert impact.impact(p, "k", "drop_column") == (6, 1.0)
    assert impact.impact(p, "k", "impute_mode") == (0, 0.0)
    assert impact.impact({"stats": {}, "n_rows": 0}, "k", "drop_column") == (0, 0.0)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)),
        ),
        max_size=60,
    )
)
def test_quantiles_by_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double")
    found = {
        r.g: r for r in quantiles(df, "x", [("near", 0.25, "nearest"), ("line", 0.9, "linear")], ["g"]).collect()
    }
    assert set(found) == {g for g, _ in rows}
    for g, r in found.items():
        xs = sorted(x for k, x in rows if k == g and x is not None)
        if not xs:
            assert r.near is None and r.line is None
            continue
        at = (len(xs) - 1) * 0.9
        low = int(at)
        assert r.near == xs[int((len(xs) - 1) * 0.25 + 0.5)]
        assert r.line == pytest.approx(xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low), abs=1e-6)


def test_large_quantiles(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    xs = sorted(r.x for r in df.collect())
    r = quantiles(df, "x", [("a", 0.01, "nearest"), ("b", 0.5, "linear"), ("c", 0.999, "nearest")]).first()
    assert (r.a, r.b, r.c) == (
        xs[int(199_999 * 0.01 + 0.5)], (xs[99_999] + xs[100_000]) / 2, xs[int(199_999 * 0.999 + 0.5)]
    )


def test_quantiles_of_extremes(spark):
    inf, nan = float("inf"), float("nan")
    for xs in ([inf, -inf, 0.0, 1.0, nan], [nan, nan, 1.0], [-inf] * 3 + [2.0], [1e308, -1e308, 0.0, 5.0, 5.0]):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        ordered = sorted(xs, key=lambda v: (v != v, v))
        wanted = [(f"q{i}", i / 4, "nearest") for i in range(5)]
        got = quantiles(df, "x", wanted).first()
        assert [repr(v) for v in got] == [repr(ordered[int((len(xs) - 1) * i / 4 + 0.5)]) for i in range(5)]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_plans_stay_in_the_engine(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = final_plan(univariate.quartiles(df, "l_extendedprice"))
    assert "Python" not in plan and "ReadSchema: struct<l_extendedprice:double>" in plan
    assert plan.count("FileScan") == 1  # and one for the sketch before it
    assert final_plan(univariate.univariate_numeric(df, "l_extendedprice")).count("FileScan") == 1
    box = final_plan(charts.boxes(df, "l_returnflag", "l_extendedprice"))
    assert box.count("FileScan") == 1 and "BroadcastHashJoin" in box


def test_curve_of_a_histogram(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 501).cast("double").alias("x"))
    curve = charts.histogram_curve(df, "x").orderBy("x").collect()
    bins = charts.histogram(df, "x").collect()
    assert (curve[0].x, curve[-1].x) == (0.0, 500.0)
    inner = [r["count"] for r in curve if 100 < r.x < 400]
    assert sum(inner) / len(inner) == pytest.approx(2000 / len(bins), rel=0.05)
