"""Imports: names, times, INI counters and upserts, on rows and files written by hand."""

from wayfold.sources import counters

INI = "[20240101]\r\nLbCount=5\r\nmove=1.5\r\n65=3\r\n66=0\r\n67=bad\r\n; note\r\n[other]\r\n[20240104]\r\nlbcount=2\r\n65=1\r\nwheel=x\r\n"


def test_counters(spark, tmp_path):
    (tmp_path / "a.ini").write_bytes(INI.encode("utf-16"))
    found = counters.counters(spark, str(tmp_path / "*.ini"))
    days = {str(r["date"]): r.asDict() for r in counters.mouse_days(found).collect()}
    assert days["2024-01-01"]["lbcount"] == 5 and days["2024-01-01"]["move"] == 1.5 and days["2024-01-04"]["lbcount"] == 2 and days["2024-01-04"]["wheel"] == 0
    coded = counters.scan_codes(found)
    assert sorted((str(r["date"]), r["scan_code"], r["count"]) for r in coded.collect()) == [("2024-01-01", 65, 3), ("2024-01-04", 65, 1)]
    wide = [(r["date"], r["lbcount"], r["65"]) for r in counters.daily_matrix(found, ["lbcount", "65"]).orderBy("date").collect()]
    assert wide == [("2024-01-01", 5, 3), ("2024-01-02", 0, 0), ("2024-01-03", 0, 0), ("2024-01-04", 2, 1), ("total", 7, 4)]
    assert [str(r["date"]) for r in counters.orphans(coded, counters.mouse_days(found).where("date < '2024-01-03'")).collect()] == ["2024-01-04"]


def test_names_times_and_upserts(spark):
    df = counters.clean_names(spark.createDataFrame([(1_700_000_000, 0), (None, 1)], "`data time` long, `step-Type!` int"))
    assert df.columns == ["data_time", "step_Type"]
    assert [r["time"] for r in counters.with_time_columns(df).collect()] == ["20231114221320", None]
    fixes = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, stepType int")
    assert [r["id"] for r in counters.kept_fixes(fixes, ["id"]).collect()] == [1, 3]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, counters.replaced(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert counters.daily_matrix(spark.createDataFrame([], "date date, name string, value double"), ["x"]).count() == 0


def test_loads_have_dense_ids_by_time_and_are_replaced_whole(spark, tmp_path):
    raw = spark.createDataFrame([(30, 2.0, 0, "x"), (10, 1.0, 0, "y"), (10, 0.5, 0, "z"), (None, 9.0, 0, "n"), (20, 3.0, 1, "walked"), (10, 1.0, None, "y")], "`data time` long, `speed!` double, stepType int, `other col` string")
    folder = f"file://{tmp_path}/fixes"
    want = [(1, None, 9.0, None), (2, 10, 0.5, "19700101000010"), (3, 10, 1.0, "19700101000010"), (4, 10, 1.0, "19700101000010"), (5, 30, 2.0, "19700101000030")]
    for _ in range(2):
        rows = counters.load_fixes(raw.repartition(3), folder, ["data_time", "speed"])
        assert sorted((r["id"], r["data_time"], r["speed"], r["time"]) for r in rows.collect()) == want
    counters.load_fixes(raw.limit(0), folder, ["data_time", "speed"])
    assert counters.tables.read(spark, folder).count() == 0 and counters.tables.manifest(folder).version == 3
