"""File readers, sinks, reuse of streamed totals, and user extension points."""

import pytest
from pyspark.sql import functions as F

from landtally.functions import specs
from landtally.operators import checks
from landtally.sources import series, tables
from landtally.streaming import totals


def test_sensor_file(spark, tmp_path):
    (tmp_path / "a.stm").write_text('"NET" "S" 45\n2020/01/01 06:00  0.21 G M\n2020/01/01 07:00 0.22 D01 M\nbroken\n2020/01/01 06:00 0.3 G M\n')
    df = series.parse_sensor_lines(series.read_sensor_text(spark, str(tmp_path)))
    rows = df.orderBy("t_s", "value").collect()
    assert [r.value for r in rows] == [0.21, 0.3, 0.22] and [r.good for r in rows] == [True, True, False]
    assert series.repeated_times(df, ["file"]).count() == 1


def test_flux_file(spark, tmp_path):
    (tmp_path / "x_HH_.csv").write_text("TIMESTAMP_START,TIMESTAMP_END,LE_F_MDS,OTHER\n202001010000,202001010030,12.5,1\n202001010030,202001010100,-9999,1\n")
    df = series.flux_intervals(series.read_flux_csv(spark, str(tmp_path)), F.lit(1.5), ["LE_F_MDS"])
    rows = df.orderBy("start_s").collect()
    assert rows[0].start_s == 1577836800 - 5400 and rows[0].LE_F_MDS == 12.5 and rows[1].LE_F_MDS is None


def test_manifest_contract(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "m"), 42)


def test_label_specs_refuse_redefinition():
    with pytest.raises(ValueError):
        specs.resolve({"et": dict(units="x", low=0, high=1)})


def test_table_fingerprint_ignores_partitioning(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 3).alias("v"))
    a = checks.table_fingerprint(df.repartition(3), "id", ["id", "v"]).collect()
    b = checks.table_fingerprint(df.repartition(7), "id", ["id", "v"]).collect()
    c = checks.table_fingerprint(df.withColumn("v", F.col("v") + 1), "id", ["id", "v"]).collect()
    assert a == b != c


def test_streamed_totals_equal_batch(spark, tmp_path):
    from landtally.operators import metrics

    data = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("y"), (F.col("id") * 1.1).alias("x"))
    data.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(totals.fold(str(tmp_path / "out"), ["k"], "x", "y")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.k: r for r in totals.totals(spark, str(tmp_path / "out"), ["k"]).collect()}
    want = {r.k: r for r in metrics.regression_metrics(metrics.regression_sums(data, ["k"], "x", "y")).collect()}
    for k in want:
        assert abs(got[k].rmse - want[k].rmse) < 1e-9 and got[k]["count"] == want[k]["count"]
