"""Sources, sinks, actions from file to file, and streams."""

import pytest

from colscope.plans.actions import CleaningAction, EngineeringAction, Insight, Worker, next_step
from colscope.plans.api import Dataset, carry_out
from colscope.plans.session import Session
from colscope.sources.files import extract_columns, scan, sink
from colscope.streaming.running import running_numeric, windowed_frequencies

ROWS = "i,d,t,s\n1,2024-01-01,2024-01-01 10:00:00,a\n2,,,\n3,2024-01-03,2024-01-03 10:00:00,c\n"


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "a.csv").write_text(ROWS)
    return str(tmp_path / "a.csv")


def test_csv(spark, csv, tmp_path):
    df = scan(spark, csv, "csv")
    assert dict(df.dtypes) == {"i": "int", "d": "string", "t": "string", "s": "string"}
    assert [r.d for r in df.orderBy("i").collect()] == ["2024-01-01", None, "2024-01-03"]
    assert dict(scan(spark, csv, "csv", dates_as_strings=False).dtypes)["d"] == "date"
    assert extract_columns(spark, csv, "csv") == ["i", "d", "t", "s"]
    assert extract_columns(spark, str(tmp_path / "none.csv"), "csv") == []
    sink(df, str(tmp_path / "out"))
    assert scan(spark, str(tmp_path / "out"), "csv", df.schema).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sink(df, str(tmp_path / "out"))


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert [
        (r.a, r.b) for r in scan(spark, str(tmp_path / "a.json"), "json").orderBy("a").collect()
    ] == [(1, "x"), (2, None)]
    for kind in ("parquet", "orc"):
        sink(spark.range(3), str(tmp_path / kind), kind)
        assert scan(spark, str(tmp_path / kind), kind).count() == 3
    with pytest.raises(ValueError):
        scan(spark, "x", "xml")
    with pytest.raises(ValueError):
        sink(spark.range(1), str(tmp_path / "x"), "xml")


def test_excel(spark, tmp_path):
    import zipfile

    head = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c><c r="D1" t="inlineStr"><is><t>d</t></is></c>'
    one = '<c r="A2"><v>1</v></c><c r="C2"><v>2.5</v></c><c r="D2" t="b"><v>1</v></c>'
    two = '<c r="A3"><v>2</v></c><c r="B3" t="s"><v>2</v></c><c r="C3"><v>3</v></c>'
    name = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{name}"><si><t>a</t></si><si><r><t>b</t></r></si><si><r><t>x</t></r><r><t>&amp;y</t></r></si></sst>')
        rows = "".join(f"<row>{r}</row>" for r in (head, one, two))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{name}"><sheetData>{rows}</sheetData></worksheet>')
    df = scan(spark, str(tmp_path / "a.xlsx"), "xlsx")
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double"), ("d", "boolean")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, None, 2.5, True), (2, "x&y", 3.0, None)]
    assert extract_columns(spark, str(tmp_path / "a.xlsx"), "xlsx") == ["a", "b", "c", "d"]
    assert extract_columns(spark, str(tmp_path / "none.xlsx"), "xlsx") == []


def test_actions(spark, csv, tmp_path):
    action = CleaningAction(csv, "csv", str(tmp_path / "clean"), "gaps", "d", action="drop_rows")
    assert carry_out(spark, action, confirm=lambda a: False) is None
    assert not (tmp_path / "clean").exists()
    assert carry_out(spark, action, confirm=lambda a: True).count() == 2
    assert scan(spark, str(tmp_path / "clean"), "csv").count() == 2
    data = Dataset.open(spark, csv, "csv")
    told = action.with_impact(data.profile_record())
    assert (told.rows_affected, told.rows_affected_pct) == (1, 1 / 3)
    for kind in ("label", "ordinal", "frequency"):
        assert "s_encoded" in carry_out(
            spark, EngineeringAction(csv, "csv", str(tmp_path / kind), "", "s", action=kind, order_key="i")
        ).columns
    assert "i_binned" in carry_out(
        spark, EngineeringAction(csv, "csv", str(tmp_path / "bins"), "", "i", action="equal_width", n_bin=2)
    ).columns
    assert EngineeringAction("a", "csv", "b", "", "c").n_bin == 10
    assert next_step(told) == "compute_impact" and next_step(Insight("mean", 1.0, 3)) == "validator"
    for wrong in (dict(action="cast_dtype"), dict(action="nothing"), dict(risk_level="huge")):
        with pytest.raises(ValueError):
            CleaningAction("a", "csv", "b", "", "c", **wrong)
    with pytest.raises(ValueError):
        EngineeringAction("a", "csv", "b", "", "c", action="nothing")


def test_facade(spark, csv):
    data = Dataset.open(spark, csv, "csv")
    assert data.profile().count() == 4
    assert "3 values, 0 null" in data.report("i") and "2 different" in data.report("s")
    assert data.chart("s")[0] == "count" and data.numeric("i").first().median == 2.0
    assert data.encode("s", "label", "i", "preview", 2).count() == 2 and data.bin("i", "quantile", 2).count() == 3


def test_session(spark, csv, tmp_path):
    s = Session(spark, csv, "csv")
    assert s.column_names == ["i", "d", "t", "s"] and s.apply() is None
    assert s.run("profile").count() == 4 and s.run("chart", "s")[0] == "count" and s.run(
        "encode", "s", "ordinal"
    ).count() == 3
    assert s.worker("bin") is Worker.FEATURES and s.worker("") is Worker.FINISH
    with pytest.raises(KeyError):
        s.run("polish")
    s.propose(Insight("mean", 2.0, 3))
    told = s.propose(CleaningAction(csv, "csv", str(tmp_path / "done"), "gaps", "s", action="drop_rows"))
    assert (told.rows_affected, len(s.insights)) == (1, 1)
    assert s.apply(lambda a: False) is None and s.pending is told
    assert s.apply(lambda a: True).count() == 2 and s.pending is None
    assert s.completed_steps == ["profile", "chart", "encode", "drop_rows"]


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = running_numeric(
        stream, "value"
    ).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").first()["count"] == 50
    timed = stream.withColumn("at", stream["ts"].cast("timestamp"))
    q = windowed_frequencies(
        timed, "event_type", "at", "1 hour", "1 hour"
    ).writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").groupBy().sum("Value_count").first()[0] == 50
