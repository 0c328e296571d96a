from partloom.sinks import files as sinks
from pyspark.sql import functions as F


def test_csv_written_is_read_back_without_formulas(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", ["R1", "R2"], -5), (2, None, None, None)], "id int, note string, refs array<string>, n int")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).fillna("")
    assert rows.columns == ["id", "note", "refs", "n"]
    assert sorted(map(tuple, rows.collect())) == [("1", "'=1+1", "R1, R2", "-5"), ("2", "", "", "")]
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where(F.col("id") == 1).first().refs == ["R1", "R2"]
