import pytest
from pyspark.sql import functions as F

from farpoint import Attr, OutlierParams, WindowSpec
from farpoint.operators import clean
from farpoint.plans.sensor import clean_all, sensor_outliers, write_report
from farpoint.sources import points as ps
from farpoint.sources import sensor


def export(date, times, first=0.0):
    head = ["a", "b", "c", "d", "e", f"Start Time: {date} 10:00:00 Offset:-05", "Time,Z,Y,X,Battery,Celsius,EDA,Event", "------"]
    return "\n".join(head + [f"{t}, {first + i},1,2,-1,36.5,{i + 1},0" for i, t in enumerate(times)]) + "\n"


@pytest.fixture
def exports(tmp_path):
    files = {
        "00007CompletedCSVfiles/1_a.csv": export("2014-01-10", ["23:59:59.0", "00:00:00.5"]),
        "00007CompletedCSVfiles/2_b.csv": export("2014-01-11", ["08:00:00.0", "08:00:01.0", "08:59:00.0"], 10.0),
        "00007CompletedCSVfiles/notes.csv": export("2014-01-11", ["08:00:00.0"]),
        "misc/1_c.csv": export("2014-01-12", ["08:00:00.0"]),
        "00012x/3_d.csv": export("2014-02-01", ["12:30:00.25"]),
    }
    for name, text in files.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


@pytest.mark.parametrize("split_bytes", ["128m", "90"])
def test_raw_exports(spark, exports, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = sensor.read_raw_exports(spark, str(exports / "raw" / "*")).orderBy("patient_id", "file", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [(r.patient_id, r.year, r.month, r.day, r.hour, r.minute, r.seconds, r["Z-axis"]) for r in rows]
    assert got == [
        (7, 2014, 1, 10, 23, 59, 59.0, 0.0),
        (7, 2014, 1, 10, 0, 0, 0.5, 1.0),  # the date of the file stays, also past midnight
        (7, 2014, 1, 11, 8, 0, 0.0, 10.0),
        (7, 2014, 1, 11, 8, 0, 1.0, 11.0),
        (7, 2014, 1, 11, 8, 59, 0.0, 12.0),
        (12, 2014, 2, 1, 12, 30, 0.25, 0.0),
    ]


def test_clean_files_end_to_end(spark, exports):
    raw = sensor.read_raw_exports(spark, str(exports / "raw" / "*"))
    sensor.write_cleaned(raw, str(exports / "cleaned"))
    (exports / "cleaned" / "ReadMe.csv").write_text("not,a,table\n1,2,3\n")
    table = sensor.read_cleaned_files(spark, str(exports / "cleaned"))
    assert {r.patient_id: r["count"] for r in table.groupBy("patient_id").count().collect()} == {7: 5, 12: 1}
    clean_all(spark, str(exports / "cleaned"), str(exports / "out"), 1, "hour")
    means = spark.read.option("header", True).option("inferSchema", True).csv(str(exports / "out" / "1hour"))
    hours = {(r.patient_id, r.day, r.hour): (r.Z_axis, r.EDA) for r in means.collect()}
    assert hours == {(7, 10, 23): (0.0, 1.0), (7, 10, 0): (1.0, 2.0), (7, 11, 8): (11.0, 2.0), (12, 1, 12): (0.0, 1.0)}
    assert "avg(Battery)" in means.columns and "avg(Event)" in means.columns


def test_bounds_are_strict_and_buckets_truncate(spark):
    rows = [(30.0, 1.0, 0.0, 59.9), (30.1, 0.0, 0.0, 1.0), (44.9, 499.9, -9.9, 29.9), (31.0, 500.0, 0.0, 2.0), (31.0, 2.0, -10.0, 3.0), (45.0, 1.0, 1.0, 4.0), (31.0, 2.0, 1.0, 30.0)]
    df = spark.createDataFrame(rows, "Celsius double, EDA double, `Z-axis` double, seconds double")
    kept = clean.plausible(clean.rename_axes(df))
    assert sorted(r.seconds for r in kept.collect()) == [29.9, 30.0]
    from farpoint.functions.timeparts import bucket_time

    assert sorted(r.second for r in bucket_time(kept, 30, "second").collect()) == [0, 1]


def test_hourly_means_in_order(spark):
    rows = [(2014, 1, d, h, 36.0 + d, 1.0, 2.0, 3.0, float(h)) for d in (2, 1) for h in (5, 4, 4)]
    df = spark.createDataFrame(rows, "year int, month int, day int, hour int, Celsius double, `Z-axis` double, `Y-axis` double, `X-axis` double, EDA double")
    got = clean.hourly_means(df, ordered=True).collect()
    assert [(r.day, r.hour, r["avg(Celsius)"], r["avg(EDA)"]) for r in got] == [(1, 4, 37.0, 4.0), (1, 5, 37.0, 5.0), (2, 4, 38.0, 4.0), (2, 5, 38.0, 5.0)]


@pytest.mark.parametrize("block_rows", [3, 65_536])
def test_first_difference_across_blocks(spark, block_rows):
    rows = [(k, i, float(i * i % 17), float(7 * i % 5), 36.0 + i) for k, n in ((1, 20), (2, 1), (3, 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, at int, Z_axis double, EDA double, Celsius double").repartition(4)
    got = clean.first_difference(df, ["at"], ["Z_axis"], ["EDA"], ["k"], block_rows).collect()
    value = {(k, i): (z, e) for k, i, z, e, _ in rows}
    expected = {(k, i, value[k, i][0] - value[k, i - 1][0], abs(value[k, i][1] - value[k, i - 1][1]), 36.0 + i) for k, i in value if i}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_from_readings_to_report(spark, tmp_path):
    rows = [(1, 2014, 1, 1 + i // 24, i % 24, 0, 0.0, 0.1 * (i % 4), 0.0, 0.0, -1.0, 36.0, 1.0 + (i % 9 == 5) * 50, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "patient_id int, year int, month int, day int, hour int, minute int, seconds double, Z_axis double, Y_axis double, X_axis double, Battery double, Celsius double, EDA double, Event double")
    report = sensor_outliers(df, 1, "hour", WindowSpec(12, 3), OutlierParams(5.0, 4))
    write_report(report, str(tmp_path / "report"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "report"))
    assert back.count() == (59 // 3 - 3) * 12 and {"hour", "status", "n_neighbors"} <= set(back.columns)
    outliers = {(r.day - 1) * 24 + r.hour for r in back.where("status = 'Outlier'").collect()}
    assert outliers and all(i % 9 in (5, 6) for i in outliers)


def test_points_with_bad_cells_are_set_aside(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a, b,c\n1,2.5,x\n3,NaN,y\n,1,z\nfour,1,w\n5000000000, 6,v\n")
    raw = ps.read_points(spark, str(tmp_path / "p.csv"))
    good, bad = ps.to_points(raw, ["a", "b"])
    assert [(r.a, r.b, r.c) for r in good.collect()] == [(1.0, 2.5, "x"), (5e9, 6.0, "v")]
    assert {r.c for r in bad.collect()} == {"y", "z", "w"}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a|b\n1|x\n")
    (tmp_path / "t.txt").write_text("1|2|3\n4|5\n")
    assert sensor.read_delimited(spark, str(tmp_path / "t.csv"), "|").first().asDict() == {"a": 1, "b": "x"}
    assert [r.cells for r in sensor.read_delimited(spark, str(tmp_path / "t.txt"), "|").collect()] == [["1", "2", "3"], ["4", "5"]]


def test_sorted_and_single_file_output(spark, tmp_path):
    df = spark.range(50).select((F.col("id") * 17 % 50).alias("x"))
    sensor.write_csv(df, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    sensor.write_sorted(df, str(tmp_path / "sorted"), ["x"], "csv")
    files = sorted((tmp_path / "sorted").glob("*.csv"))
    assert [int(v) for f in files for v in f.read_text().split()[1:]] == list(range(50))
