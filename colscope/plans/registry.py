"""All queries of the library by name, with the SQL that each is checked against.

The driver's tables have no nulls, so some are derived, by the same rule on both sides. Results in floating point
are rounded, as sums depend on their order. The SQL is written by hand and shares nothing with the operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types
from ..operators import binning, charts, clean, encode, impact, report, univariate
from ..operators.profile import profile, profile_wide
from ..sources.files import SHEET, extract_columns, scan, schema_table, sink
from ..sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", "parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with nulls in `kind` and `v`."""
    kind = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_type"))
    v = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"), v.alias("v"))


EVENTS = """(SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Sources and sinks

NATION = "n_nationkey int, n_name string, n_regionkey int"


def written_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "nation")
    sink(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return path


def written_json(spark: SparkSession, sf_dir: str) -> str:
    """One document: an array of five objects."""
    path = scratch(spark, "region")
    one = table(spark, sf_dir, "region").agg(
        F.concat(
            F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("r_regionkey", "r_name"))), ","), F.lit("]")
        ).alias("value")
    )
    one.write.text(path)
    return path


@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/region.parquet", "parquet")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, written_csv(spark, sf_dir), "csv", NATION)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, written_csv(spark, sf_dir), "csv")


@query("SELECT r_regionkey, r_name FROM region")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, written_json(spark, sf_dir), "json", "r_regionkey int, r_name string")


def written_workbook(spark: SparkSession, sf_dir: str) -> str:
    """A workbook of one sheet with the 25 nations: names as texts in the cells, keys as numbers."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()

    def cell(v) -> str:
        return f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    lines = ["".join(map(cell, r)) for r in [["n_nationkey", "n_name", "n_regionkey"], *rows]]
    data = "".join(f"<row>{line}</row>" for line in lines)
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{data}</sheetData></worksheet>')
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'nation')}.xlsx")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content.getvalue()))
    out.close()
    return path.toString()


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, written_workbook(spark, sf_dir), "xlsx")


@query(
    "SELECT 'csv' AS format, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'json', CAST(count(*) AS BIGINT) FROM region UNION ALL SELECT 'parquet', CAST(count(*) AS BIGINT) FROM part"
)
def scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {
        "csv": written_csv(spark, sf_dir), "json": written_json(spark, sf_dir), "parquet": f"{sf_dir}/part.parquet"
    }
    counts = [scan(spark, path, kind).agg(F.lit(kind).alias("format"), F.count(F.lit(1)).alias("n")) for kind, path in paths.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 25 GROUP BY p_brand")
def scan_file_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(
        spark, f"{sf_dir}/part.parquet", "parquet"
    ).filter("p_size > 25").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT * FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int')) AS t(position, \"column\", dtype)"
)
def schema_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_table(table(spark, sf_dir, "nation"))


@query(
    "SELECT * FROM (VALUES (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) AS t(position, \"column\")",
    "extract_columns",
)
def columns_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_columns(
        spark, written_csv(spark, sf_dir), "csv"
    ) + extract_columns(spark, f"{sf_dir}/no-such-file", "csv")
    return spark.createDataFrame(list(enumerate(found)), "position int, column string")


@query("SELECT p_partkey, p_brand, p_size FROM part")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "part")
    sink(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), path)
    return scan(spark, path, "csv", "p_partkey bigint, p_brand string, p_size int")


# Profiles

PROFILE_PARTS = [("event_id", "bigint"), ("user_id", "bigint"), ("kind", "string"), ("v", "double")]
PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS nulls, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS nunique, count(*) AS n_rows FROM e" for c, t in PROFILE_PARTS)


@query(f"WITH e AS {EVENTS} {PROFILE_SQL}")
def profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(events(spark, sf_dir))


@query(
    f"SELECT count(*) FILTER (WHERE event_id IS NULL) AS event_id_nulls, count(*) FILTER (WHERE user_id IS NULL) AS user_id_nulls, count(*) FILTER (WHERE kind IS NULL) AS kind_nulls, count(*) FILTER (WHERE v IS NULL) AS v_nulls FROM {EVENTS} AS e"
)
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_wide(events(spark, sf_dir)).select("event_id_nulls", "user_id_nulls", "kind_nulls", "v_nulls")


@query(
    f"SELECT (SELECT count(*) FROM (SELECT DISTINCT kind FROM {EVENTS} AS a) AS x) AS kind_nunique, (SELECT count(*) FROM (SELECT DISTINCT v FROM {EVENTS} AS b) AS y) AS v_nunique"
)
def profile_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_wide(events(spark, sf_dir).select("kind", "v")).select("kind_nunique", "v_nunique")


@query("SELECT count(*) AS n_rows FROM lineitem")
def profile_nrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_wide(table(spark, sf_dir, "lineitem")).select("n_rows")


@query(
    "SELECT * FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment')) AS t(position, \"column\")"
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_table(table(spark, sf_dir, "customer")).select("position", "column")


@query(
    "SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) AS t(\"column\", dtype)"
)
def profile_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_table(table(spark, sf_dir, "customer")).select("column", "dtype")


# One numeric column

RANKED = "SELECT {x} AS x, row_number() OVER (ORDER BY {x}) - 1 AS i, count(*) OVER () AS n FROM {t} AS t WHERE {x} IS NOT NULL"


def nearest(x: str, t: str, q: float) -> str:
    return f"(SELECT max(x) FROM ({RANKED.format(x=x, t=t)}) AS r WHERE i = floor((n - 1) * {q} + 0.5))"


BOUNDS = f"SELECT {nearest('v', EVENTS, 0.25)} AS q1, {nearest('v', EVENTS, 0.75)} AS q3"
SKEW = f"(SELECT avg(power(v - m, 3)) / power(any_value(s), 1.5) FROM {EVENTS} AS a CROSS JOIN (SELECT avg(v) AS m, var_pop(v) AS s FROM {EVENTS} AS b) AS c)"

NUMERIC_SQL = {
    "num_mean": ("mean", f"SELECT round(avg(v), 6) AS mean FROM {EVENTS} AS e"),
    "num_median": ("median", f"SELECT round(quantile_cont(v, 0.5), 6) AS median FROM {EVENTS} AS e"),
    "num_min": ("min", f"SELECT round(min(v), 6) AS min FROM {EVENTS} AS e"),
    "num_max": ("max", f"SELECT round(max(v), 6) AS max FROM {EVENTS} AS e"),
    "num_variance": ("variance", f"SELECT round(var_samp(v), 6) AS variance FROM {EVENTS} AS e"),
    "num_std": ("std", f"SELECT round(stddev_samp(v), 6) AS std FROM {EVENTS} AS e"),
    "num_skewness": ("skewness", f"SELECT round({SKEW}, 6) AS skewness"),
    "num_q1": ("q1", f"SELECT round(q1, 6) AS q1 FROM ({BOUNDS}) AS b"),
    "num_q3": ("q3", f"SELECT round(q3, 6) AS q3 FROM ({BOUNDS}) AS b"),
    "num_null_count": ("null_count", f"SELECT count(*) - count(v) AS null_count FROM {EVENTS} AS e"),
    "num_count": ("count", f"SELECT count(v) AS count FROM {EVENTS} AS e"),
    "num_iqr": ("iqr", f"SELECT round(q3 - q1, 6) AS iqr FROM ({BOUNDS}) AS b"),
    "num_bounds": (("lower_bound", "upper_bound"), f"SELECT round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound FROM ({BOUNDS}) AS b"),
    "num_outlier_count": ("outlier_count", f"SELECT count(*) AS outlier_count FROM {EVENTS} AS e CROSS JOIN ({BOUNDS}) AS b WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)"),
    "num_range": ("range", f"SELECT round(max(v) - min(v), 6) AS range FROM {EVENTS} AS e"),
    "num_skew_class": ("skew_class", f"SELECT CASE WHEN s IS NULL THEN 'undetermined' WHEN abs(s) < 0.5 THEN 'approximately symmetric' WHEN s > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS skew_class FROM (SELECT {SKEW} AS s) AS x"),
}

MOMENTS = ("mean", "min", "max", "variance", "std", "skewness", "null_count", "count", "range")


def _numeric(names: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir)
        if names[0] in MOMENTS:
            return rounded(univariate.moments(df, "v").select(*names))
        if names[0] == "skew_class":
            return univariate.moments(df, "v").select(univariate.skew_class(F.col("skewness")).alias("skew_class"))
        if names[0] == "outlier_count":
            return univariate.outliers(df, "v").agg(F.count(F.lit(1)).alias("outlier_count"))
        return rounded(univariate.quartiles(df, "v").select(*names))

    return run


for _name, (_columns, _sql) in NUMERIC_SQL.items():
    query(_sql, _name)(_numeric((_columns,) if isinstance(_columns, str) else _columns))


@query("""SELECT count(x) AS count, count(*) - count(x) AS null_count, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, round(var_samp(x), 6) AS variance,
  round(stddev_samp(x), 6) AS std, max(x) - min(x) AS range, any_value(q1) AS q1, round(quantile_cont(x, 0.5), 6) AS median, any_value(q3) AS q3, any_value(q3 - q1) AS iqr,
  any_value(q1 - 1.5 * (q3 - q1)) AS lower_bound, any_value(q3 + 1.5 * (q3 - q1)) AS upper_bound,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count, round(avg(power(x - m, 3)) / power(any_value(s), 1.5), 6) + 0.0 AS skewness,
  CASE WHEN abs(avg(power(x - m, 3)) / power(any_value(s), 1.5)) < 0.5 THEN 'approximately symmetric' WHEN avg(power(x - m, 3)) > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS skew_class
FROM (SELECT nullif(l_quantity, 50.0) AS x FROM lineitem) AS t
CROSS JOIN (SELECT avg(nullif(l_quantity, 50.0)) AS m, var_pop(nullif(l_quantity, 50.0)) AS s FROM lineitem) AS y CROSS JOIN (SELECT """ + nearest("nullif(l_quantity, 50.0)", "lineitem", 0.25) + " AS q1, " + nearest("nullif(l_quantity, 50.0)", "lineitem", 0.75) + " AS q3) AS z")
def num_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.nullif("l_quantity", F.lit(50.0)).alias("x"))
    return rounded(univariate.univariate_numeric(df, "x")).withColumn("skewness", F.col("skewness") + F.lit(0.0))


@query(
    """SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem"""
)
def num_quartiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        univariate.quartiles(
            table(spark, sf_dir, "lineitem"), "l_extendedprice", "linear"
        ).select("q1", "median", "q3")
    )


@query(
    "SELECT "
    + nearest("l_extendedprice", "lineitem", 0.25)
    + " AS q1, "
    + nearest("l_extendedprice", "lineitem", 0.75)
    + " AS q3"
)
def num_quartiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return univariate.quartiles(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("q1", "q3")


def _gate(check) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "events")

        def passes(column: str) -> bool:
            try:
                check(df, column)
            except (types.ColumnMissing, types.WrongType):
                return False
            return True

        return spark.createDataFrame(
            [(c, passes(c)) for c in [*df.columns, "no_such"]], "column string, passes boolean"
        )

    return run


GATES = {
    "gate_column_exists": (types.require_column, "ttttttf"),
    "gate_numeric": (types.require_numeric, "tftftff"),
    "gate_categorical": (types.require_categorical, "ffftftf"),
}
for _name, (_check, _passes) in GATES.items():
    _rows = ", ".join(f"('{c}', {str(p == 't').lower()})" for c, p in zip(("event_id", "ts", "user_id", "event_type", "value", "props", "no_such"), _passes, strict=True))
    query(f'SELECT * FROM (VALUES {_rows}) AS t("column", passes)', _name)(_gate(_check))


# One categorical column

FREQUENCIES = f"SELECT kind AS \"Column_value\", count(*) AS \"Value_count\", round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events), 9) AS \"Frequency\", round(100 * (count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events)), 9) AS \"Percentage\" FROM {EVENTS} AS e GROUP BY kind"


@query(
    "SELECT list(p_size_text ORDER BY p_size_text) AS modes FROM (SELECT CAST(p_size AS VARCHAR) AS p_size_text, rank() OVER (ORDER BY count(*) DESC) AS r FROM part GROUP BY 1) AS x WHERE r = 1"
)
def cat_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("s"))
    return univariate.univariate_categorical(df, "s").select("modes")


def _categorical(name: str) -> Query:
    return lambda spark, sf_dir: univariate.univariate_categorical(events(spark, sf_dir), "kind").select(name)


query(f"SELECT count(DISTINCT kind) AS n_unique FROM {EVENTS} AS e", "cat_n_unique")(_categorical("n_unique"))
query(f"SELECT count(kind) AS valid_count FROM {EVENTS} AS e", "cat_valid_count")(_categorical("valid_count"))
query(f"SELECT count(*) - count(kind) AS null_count FROM {EVENTS} AS e", "cat_null_count")(_categorical("null_count"))
query("SELECT count(*) AS total_count FROM events", "cat_total_count")(_categorical("total_count"))


@query(FREQUENCIES)
def cat_freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(univariate.frequency_table(events(spark, sf_dir), "kind"), 9)


@query(f'SELECT "Column_value", "Frequency" FROM ({FREQUENCIES}) AS f')
def cat_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(univariate.frequency_table(events(spark, sf_dir), "kind"), 9).select("Column_value", "Frequency")


@query(f'SELECT "Column_value", "Percentage" FROM ({FREQUENCIES}) AS f')
def cat_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(univariate.frequency_table(events(spark, sf_dir), "kind"), 9).select("Column_value", "Percentage")


@query(
    f'SELECT "Column_value", "Value_count" FROM ({FREQUENCIES}) AS f ORDER BY "Value_count" DESC, "Column_value" ASC NULLS LAST'
)
def cat_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return univariate.sorted_frequency_table(events(spark, sf_dir), "kind").select("Column_value", "Value_count")


@query('SELECT DISTINCT p_brand AS "Column_value" FROM part')
def cat_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return univariate.frequency_table(table(spark, sf_dir, "part"), "p_brand").select("Column_value")


@query(f'SELECT * FROM ({FREQUENCIES}) AS f WHERE "Column_value" IS NOT NULL')
def cat_freq_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(univariate.frequency_valid(events(spark, sf_dir), "kind"), 9)


@query(f'SELECT * FROM ({FREQUENCIES}) AS f WHERE "Column_value" IS NULL')
def cat_freq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(univariate.frequency_missing(events(spark, sf_dir), "kind"), 9)


@query("""SELECT list(v ORDER BY v) FILTER (WHERE r = 1) AS modes, count(*) FILTER (WHERE r = 1) AS n_modes, count(*) AS n_unique, CAST(sum(n) AS BIGINT) AS valid_count, CAST(0 AS BIGINT) AS null_count, CAST(sum(n) AS BIGINT) AS total_count
FROM (SELECT o_orderpriority AS v, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_orderpriority) AS x""")
def cat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return univariate.univariate_categorical(table(spark, sf_dir, "orders"), "o_orderpriority")


# Chart data


def hist_sql(x: str, t: str, least: str) -> str:
    return f"""
WITH v AS (SELECT CAST({x} AS DOUBLE) AS x FROM {t} AS t WHERE {x} IS NOT NULL),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v),
w AS (SELECT *, greatest(least(greatest(2 * iqr * power(n, -1.0 / 3), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1)), {least}) AS w FROM s),
b AS (SELECT *, CAST(CASE WHEN hi > lo THEN ceil((hi - lo) / w) ELSE 1 END AS BIGINT) AS bins FROM w),
c AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM v CROSS JOIN b GROUP BY 1),
e AS (SELECT unnest(range(0, bins)) AS bin, lo, (hi - lo) / bins AS step FROM b)
SELECT e.bin, round(lo + e.bin * step, 6) AS lower, round(lo + (e.bin + 1) * step, 6) AS upper, coalesce(c.n, 0) AS count FROM e LEFT JOIN c ON c.bin = e.bin"""


@query(f"SELECT kind AS value, count(*) AS count FROM {EVENTS} AS e WHERE kind IS NOT NULL GROUP BY kind")
def chart_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.count_chart(events(spark, sf_dir), "kind")


@query(hist_sql("v", EVENTS, "0"))
def chart_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(charts.histogram(events(spark, sf_dir), "v"))


@query(hist_sql("p_size", "part", "1"))
def chart_hist_whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(charts.histogram(table(spark, sf_dir, "part"), "p_size"))


@query(f"""
WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) * power(count(*), -0.2) AS h FROM orders),
c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 2048)), 2047) AS cell, count(*) AS c FROM orders CROSS JOIN s GROUP BY 1),
g AS (SELECT unnest(range(200)) AS i),
x AS (SELECT i, lo + (hi - lo) * i / 199 AS x, n, h, lo, hi FROM g CROSS JOIN s),
w AS (SELECT count(*) AS bins FROM ({hist_sql("o_totalprice", "orders", "0")}) AS b)
SELECT round(any_value(x), 4) AS x, round(any_value((hi - lo) / bins) * sum(c * exp(-power((x - (lo + (cell + 0.5) * ((hi - lo) / 2048))) / h, 2) / 2) / (h * sqrt(2 * pi()))), 6) AS count
FROM x CROSS JOIN c CROSS JOIN w GROUP BY i""")
def chart_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = charts.histogram_curve(table(spark, sf_dir, "orders"), "o_totalprice")
    return found.select(F.round("x", 4).alias("x"), F.round("count", 6).alias("count"))


@query(f"SELECT CAST(user_id AS BIGINT) AS user_id, v FROM {EVENTS} AS e WHERE v IS NOT NULL AND user_id IS NOT NULL")
def chart_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.chart_data(events(spark, sf_dir), ["user_id", "v"])[1]


@query(f"""
WITH v AS (SELECT kind AS category, v AS x FROM {EVENTS} AS e WHERE kind IS NOT NULL AND v IS NOT NULL),
q AS (SELECT category, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY category)
SELECT v.category, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, count(*) AS n,
  min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
FROM v JOIN q ON q.category = v.category GROUP BY v.category""")
def chart_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(charts.chart_data(events(spark, sf_dir), ["v", "kind"])[1])


@query(
    f"SELECT CAST(user_id AS BIGINT) AS user_id, v, kind FROM {EVENTS} AS e WHERE v IS NOT NULL AND user_id IS NOT NULL AND kind IS NOT NULL"
)
def chart_scatter_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.chart_data(events(spark, sf_dir), ["user_id", "kind", "v"])[1]


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def chart_bubble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.chart_data(table(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"])[1]


@query(
    "SELECT * FROM (VALUES ('kind', 'count'), ('v', 'hist'), ('kind,v', 'box'), ('user_id,v', 'scatter'), ('kind,kind', NULL), ('kind,kind,v', NULL), ('', NULL)) AS t(\"columns\", chart)"
)
def chart_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)

    def kind(columns: list[str]) -> str | None:
        try:
            return charts.chart_kind(df, columns)
        except ValueError:
            return None

    shapes = [["kind"], ["v"], ["kind", "v"], ["user_id", "v"], ["kind", "kind"], ["kind", "kind", "v"], []]
    return spark.createDataFrame([(",".join(s), kind(s)) for s in shapes], "columns string, chart string")


# Encodings

FIRST_20 = f"(SELECT event_id, kind FROM {EVENTS} AS e ORDER BY event_id LIMIT 20)"


@query(f"SELECT event_id, kind FROM {FIRST_20} AS f")
def preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.head(events(spark, sf_dir).select("event_id", "kind"), "event_id")


def _encoded(kind: str, scope: str = "full") -> Query:
    return lambda spark, sf_dir: rounded(
        encode.encode(events(spark, sf_dir).select("event_id", "kind"), "kind", kind, "event_id", scope), 9
    )


def frequency_sql(t: str) -> str:
    return f"SELECT event_id, kind, round(CAST(count(*) OVER (PARTITION BY kind) AS DOUBLE) / count(*) OVER (), 9) AS kind_encoded FROM {t} AS t"


def label_sql(t: str) -> str:
    return f"SELECT t.event_id, t.kind, CAST(c.code AS BIGINT) AS kind_encoded FROM {t} AS t LEFT JOIN (SELECT kind, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM {t} AS u WHERE kind IS NOT NULL GROUP BY kind) AS c ON c.kind = t.kind"


def ordinal_sql(t: str) -> str:
    return f"SELECT event_id, kind, CAST(CASE WHEN kind IS NOT NULL THEN dense_rank() OVER (ORDER BY kind ASC NULLS LAST) - 1 END AS BIGINT) AS kind_encoded FROM {t} AS t"


query(frequency_sql(EVENTS), "enc_frequency")(_encoded("frequency"))
query(label_sql(EVENTS), "enc_label")(_encoded("label"))
query(ordinal_sql(EVENTS), "enc_ordinal")(_encoded("ordinal"))
query(frequency_sql(FIRST_20), "enc_preview_frequency")(_encoded("frequency", "preview"))
query(label_sql(FIRST_20), "enc_preview_label")(_encoded("label", "preview"))
query(ordinal_sql(FIRST_20), "enc_preview_ordinal")(_encoded("ordinal", "preview"))


@query(
    f"SELECT event_id, CAST(kind IS NOT DISTINCT FROM 'click' AS INTEGER) AS kind_click, CAST(kind IS NULL AS INTEGER) AS kind_null FROM {FIRST_20} AS f"
)
def enc_preview_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = encode.head(events(spark, sf_dir).select("event_id", "kind"), "event_id")
    return encode.encode_one_hot(first, "kind", ["click", None])


@query(
    'SELECT o_orderkey, CAST(o_orderstatus IS NOT DISTINCT FROM \'F\' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus IS NOT DISTINCT FROM \'O\' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus IS NULL AS INTEGER) AS o_orderstatus_null FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> \'P\' THEN o_orderstatus END AS o_orderstatus FROM orders) AS o'
)
def enc_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus")
    )
    return encode.encode(df, "o_orderstatus", "one_hot")


@query(
    "SELECT name || ending AS asked, name AS kind FROM (VALUES ('label'), ('ordinal'), ('frequency'), ('one_hot')) AS t(name) CROSS JOIN (VALUES (''), ('_encoding')) AS e(ending)"
)
def enc_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{k.value}{ending}" for k in encode.Encoding for ending in ("", "_encoding")]
    return spark.createDataFrame([(n, encode.Encoding(n).value) for n in names], "asked string, kind string")


@query(f"SELECT count(*) AS rows, count(kind_encoded) AS encoded FROM ({label_sql(EVENTS)}) AS x")
def enc_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_label(events(spark, sf_dir), "kind", "event_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("kind_encoded").alias("encoded")
    )


# Standardising and binning


@query("SELECT * FROM (VALUES ('equal_width'), ('quantile'), ('standardize')) AS t(kind)")
def bin_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k.value,) for k in binning.Binning], "kind string")


@query(
    f"SELECT event_id, v, round((v - (SELECT avg(v) FROM {EVENTS} AS a)) / (SELECT stddev_samp(v) FROM {EVENTS} AS b), 6) AS v_std FROM {EVENTS} AS e"
)
def std_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.transform(
        events(spark, sf_dir).select("event_id", "v"), "v", "standardize"
    ).withColumn("v_std", F.round("v_std", 6))


@query("SELECT count(*) AS rows, count(CAST(NULL AS DOUBLE)) AS standardized FROM part")
def std_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    constant = table(spark, sf_dir, "part").select(F.lit(7.0).alias("x"))
    return binning.standardize(constant, "x").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x_std").alias("standardized")
    )


def bins_sql(key: str, x: str, t: str, breaks: str) -> str:
    return f"""WITH b AS ({breaks}), n AS (SELECT {key}, {x}, breaks, CASE WHEN {x} IS NOT NULL THEN CAST(len(list_filter(breaks, lambda b: b < {x})) AS INTEGER) END AS bin FROM {t} AS t CROSS JOIN b)
SELECT {key}, {x}, bin AS {x}_binned, CASE WHEN bin > 0 THEN round(breaks[bin], 6) END AS {x}_lower, CASE WHEN bin < len(breaks) THEN round(breaks[bin + 1], 6) END AS {x}_upper FROM n"""


def _bounds_rounded(df: DataFrame, x: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in (f"{x}_lower", f"{x}_upper")})


EQUAL_BREAKS = f"SELECT list_transform(range(1, 10), lambda i: lo + i * ((hi - lo) / 10)) AS breaks FROM (SELECT min(v) AS lo, max(v) AS hi FROM {EVENTS} AS e) AS s"


@query(bins_sql("event_id", "v", EVENTS, EQUAL_BREAKS))
def bin_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_rounded(binning.transform(events(spark, sf_dir).select("event_id", "v"), "v", "equal_width"), "v")


QUANTILE_BREAKS = "SELECT list_sort(list_distinct(quantile_cont(CAST(p_size AS DOUBLE), [0.25, 0.5, 0.75]))) AS breaks FROM part"


@query(bins_sql("p_partkey", "p_size", "part", QUANTILE_BREAKS))
def bin_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_rounded(
        binning.transform(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "quantile", 4),
        "p_size",
    )


@query(
    "SELECT * FROM (VALUES (1.0, '(-inf, 4.0]'), (2.0, '(-inf, 4.0]'), (4.0, '(-inf, 4.0]'), (5.0, '(4.0, 7.0]'), (7.0, '(4.0, 7.0]'), (10.0, '(7.0, inf]'), (NULL, NULL)) AS t(x, x_label)"
)
def bin_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 5.0, 7.0, 10.0, None)], "x double")
    return binning.bin_label(binning.bin_equal_width(df, "x", 3), "x").select(
        F.col("x").cast("decimal(3,1)").alias("x"), "x_label"
    )


PREVIEW_STD = f"(SELECT event_id, v FROM {EVENTS} AS e ORDER BY event_id LIMIT 20)"


@query(
    f"SELECT event_id, v, round((v - (SELECT avg(v) FROM {PREVIEW_STD} AS a)) / (SELECT stddev_samp(v) FROM {PREVIEW_STD} AS b), 6) AS v_std FROM {PREVIEW_STD} AS f"
)
def std_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.transform(
        events(spark, sf_dir).select("event_id", "v"), "v", "standardize", order_key="event_id", scope="preview"
    ).withColumn("v_std", F.round("v_std", 6))


PREVIEW_EQUAL = f"SELECT list_transform(range(1, 4), lambda i: lo + i * ((hi - lo) / 4)) AS breaks FROM (SELECT min(v) AS lo, max(v) AS hi FROM {PREVIEW_STD} AS e) AS s"
PREVIEW_QUANTILE = f"SELECT list_sort(list_distinct(quantile_cont(v, [0.25, 0.5, 0.75]))) AS breaks FROM {PREVIEW_STD} AS e"


@query(bins_sql("event_id", "v", PREVIEW_STD, PREVIEW_EQUAL))
def bin_preview_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_rounded(
        binning.transform(events(spark, sf_dir).select("event_id", "v"), "v", "equal_width", 4, "event_id", "preview"),
        "v",
    )


@query(bins_sql("event_id", "v", PREVIEW_STD, PREVIEW_QUANTILE))
def bin_preview_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_rounded(
        binning.transform(events(spark, sf_dir).select("event_id", "v"), "v", "quantile", 4, "event_id", "preview"),
        "v",
    )


# Cleaning

QUANTITY = "(SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50.0) AS q FROM lineitem)"


def quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(50.0)).alias("q")
    )


def _cleaned(action: str) -> Query:
    return lambda spark, sf_dir: rounded(clean.clean(quantity(spark, sf_dir), "q", action))


query(f"SELECT * FROM {QUANTITY} AS t WHERE q IS NOT NULL", "clean_drop_rows")(_cleaned("drop_rows"))
query(
    f"SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT quantile_cont(q, 0.5) FROM {QUANTITY} AS m)), 6) AS q FROM {QUANTITY} AS t",
    "clean_impute_median",
)(_cleaned("impute_median"))
query(
    f"SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM {QUANTITY} AS m)), 6) AS q FROM {QUANTITY} AS t",
    "clean_impute_mean",
)(_cleaned("impute_mean"))
query(
    f"SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT q FROM {QUANTITY} AS m WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) AS q FROM {QUANTITY} AS t",
    "clean_impute_mode",
)(_cleaned("impute_mode"))
query("SELECT l_orderkey, l_linenumber FROM lineitem", "clean_drop_column")(_cleaned("drop_column"))


@query(
    f"SELECT event_id, coalesce(kind, (SELECT kind FROM {EVENTS} AS m WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {EVENTS} AS e"
)
def clean_impute_mode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(events(spark, sf_dir).select("event_id", "kind"), "kind", "impute_mode")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def clean_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "cast_dtype", "Float64")


@query(
    "SELECT p_partkey, TRY_CAST(substr(p_brand, length(p_brand), 1) || CASE WHEN p_size > 25 THEN 'x' ELSE '' END AS INTEGER) AS b FROM part"
)
def clean_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.substring("p_brand", -1, 1), F.when(F.col("p_size") > 25, "x").otherwise(""))
    return clean.clean(
        table(spark, sf_dir, "part").select("p_partkey", text.alias("b")), "b", "cast_dtype", "Int32", strict=False
    )


@query(
    "SELECT * FROM (VALUES ('Int32', true), ('Float64', true), ('Nothing', false), ('', false)) AS t(target, accepted)"
)
def clean_validate_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .actions import CleaningAction

    def accepted(target: str) -> bool:
        try:
            CleaningAction("a.csv", "csv", "out", "why", "c", action="cast_dtype", target_dtype=target)
        except ValueError:
            return False
        return True

    return spark.createDataFrame(
        [(t, accepted(t)) for t in ("Int32", "Float64", "Nothing", "")], "target string, accepted boolean"
    )


@query("SELECT n_nationkey, n_name FROM nation")
def clean_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action carried out from file to file."""
    from .actions import CleaningAction
    from .api import carry_out

    out = scratch(spark, "cleaned")
    carry_out(
        spark,
        CleaningAction(f"{sf_dir}/nation.parquet", "parquet", out, "not needed", "n_regionkey", action="drop_column"),
        confirm=lambda action: True,
    )
    return scan(spark, out, "csv", "n_nationkey int, n_name string")


@query("SELECT * FROM (VALUES ('no', false, 0), ('yes', true, 25)) AS t(answer, written, n)")
def clean_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whoever is asked decides whether anything is written."""
    from .actions import CleaningAction
    from .api import carry_out

    found = []
    for answer in ("no", "yes"):
        action = CleaningAction(
            f"{sf_dir}/nation.parquet", "parquet", scratch(spark, answer), "test", "n_regionkey", action="drop_rows"
        )
        out = carry_out(spark, action, confirm=lambda asked, answer=answer: answer == "yes")
        found.append((answer, out is not None, len(extract_columns(spark, action.output_path, "csv")) and out.count()))
    return spark.createDataFrame(found, "answer string, written boolean, n int")


# Reports


def _lines(spark: SparkSession, text: str) -> DataFrame:
    """The lines of a report with their numbers, single spaces between cells."""
    return spark.createDataFrame(
        [(i, " ".join(line.split())) for i, line in enumerate(text.split("\n"))], "line int, text string"
    )


def report_sql(title: str, names: str, rows: str, cells: str) -> str:
    return f"""SELECT CAST(0 AS INTEGER) AS line, '{title}' AS text UNION ALL SELECT 1, '{names}'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY event_id) + 1 AS INTEGER), {cells} FROM ({rows}) AS r"""


@query(
    report_sql(
        "First 20 rows, label",
        "event_id kind kind_encoded",
        label_sql(FIRST_20),
        "event_id || ' ' || coalesce(kind, 'null') || ' ' || coalesce(CAST(kind_encoded AS VARCHAR), 'null')",
    )
)
def enc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "kind")
    first = encode.encode(rows, "kind", "label", "event_id", "preview").orderBy("event_id")
    return _lines(spark, report.preview_report(first, "First 20 rows, label"))


@query(
    report_sql(
        "First 20 rows, standardize",
        "event_id v v_std",
        f"SELECT event_id, v, (v - (SELECT avg(v) FROM {PREVIEW_STD} AS a)) / (SELECT stddev_samp(v) FROM {PREVIEW_STD} AS b) AS v_std FROM {PREVIEW_STD} AS f",
        "event_id || ' ' || coalesce(printf('%.4f', v), 'null') || ' ' || coalesce(printf('%.4f', v_std), 'null')",
    )
)
def bin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "v")
    first = binning.transform(rows, "v", "standardize", order_key="event_id", scope="preview").orderBy("event_id")
    return _lines(spark, report.preview_report(first, "First 20 rows, standardize"))


# Impact

IMPACT = f"""
WITH e AS {EVENTS}, p AS ({PROFILE_SQL})
SELECT "column", action, CASE action WHEN 'drop_rows' THEN nulls WHEN 'drop_column' THEN n_rows ELSE 0 END AS rows_affected,
  round(CASE action WHEN 'drop_rows' THEN nulls WHEN 'drop_column' THEN n_rows ELSE 0 END / CAST(n_rows AS DOUBLE), 9) AS rows_affected_pct
FROM p CROSS JOIN (VALUES ('drop_rows'), ('impute_median'), ('impute_mean'), ('impute_mode'), ('cast_dtype'), ('drop_column')) AS a(action)"""


@query(IMPACT)
def compute_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impact.impacts(profile(events(spark, sf_dir))), 9)


def _impact(condition: str, *columns: str) -> tuple[str, Query]:
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT {names} FROM ({IMPACT}) AS i WHERE {condition}", lambda spark, sf_dir: compute_impact(
        spark, sf_dir
    ).filter(condition).select(*columns)


for _name, _parts in {
    "impact_drop_rows": ("action = 'drop_rows'", "column", "rows_affected"),
    "impact_drop_column": ("action = 'drop_column'", "column", "rows_affected"),
    "impact_other": ("action NOT IN ('drop_rows', 'drop_column')", "column", "action", "rows_affected"),
    "impact_pct": ("action = 'drop_rows'", "column", "rows_affected_pct"),
}.items():
    _sql, _run = _impact(*_parts)
    query(_sql, _name)(_run)


@query(
    "SELECT * FROM (VALUES ('cleaning', 'compute_impact'), ('feature', 'compute_impact'), ('insight', 'validator')) AS t(proposed, next)"
)
def route_after_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .actions import CleaningAction, EngineeringAction, Insight, next_step

    proposed = {
        "cleaning": CleaningAction("a", "csv", "b", "why", "c"),
        "feature": EngineeringAction("a", "csv", "b", "why", "c"),
        "insight": Insight("mean", 1.0, 1),
    }
    return spark.createDataFrame([(k, next_step(v)) for k, v in proposed.items()], "proposed string, next string")
