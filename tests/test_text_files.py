import pytest
from pyspark.sql import functions as F

from specloom.sources.text_files import write_text_files


def names(path):
    return sorted(p.name for p in path.iterdir())


def test_one_file_per_requirement(spark, tmp_path):
    out = tmp_path / "texts"
    rows = [("a/1", "x é\n"), ("b 2", None), ("c", "old"), ("c", "p"), (None, "n")]
    write_text_files(spark.createDataFrame(rows, "req_id string, rimay string").repartition(3), str(out))
    assert names(out) == ["a_1.txt", "b_2.txt", "c.txt"] and (out / "a_1.txt").read_text() == "x é\n" and (out / "b_2.txt").read_text() == "" and (out / "c.txt").read_text() == "p"
    write_text_files(spark.createDataFrame([("d", "y")], "req_id string, rimay string"), f"file://{out}")
    assert names(out) == ["d.txt"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "texts"
    write_text_files(spark.createDataFrame([("kept", "y")], "req_id string, rimay string"), str(out))
    bad = spark.range(40).select(F.col("id").cast("string").alias("req_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("z")).alias("rimay"))
    with pytest.raises(Exception, match="broken"):
        write_text_files(bad, str(out))
    assert names(out) == ["kept.txt"]
