"""Files that hold mostly field names and nulls are written compressed, and read back whole."""

from pyspark.sql import functions as F

from roomfold import schemas
from roomfold.sources import tables


def test_result_files_are_small_and_whole(spark, tmp_path):
    capture = F.struct(F.concat(F.lit("c"), "id").alias("capture_id"), F.lit("lidar").alias("tier"))
    target = schemas.result_schema()
    from roomfold.operators.documents import conform
    have = spark.range(500).select(capture.alias("capture"))
    docs = have.select(*[conform(F.col(f.name), have.schema[f.name].dataType, f.dataType).alias(f.name) if f.name in have.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields]).coalesce(1)
    tables.write_results(docs, str(tmp_path / "out"), check=False)
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("part-*"))
    again = tables.read_result_lines(spark, str(tmp_path / "out"))
    assert {r[0] for r in again.select("capture.capture_id").collect()} == {f"c{i}" for i in range(500)}
    assert size * 5 < tables.to_sorted_json(docs).agg(F.sum(F.octet_length("json"))).first()[0]


def test_measurement_files_are_small_and_whole(spark, tmp_path):
    rows = spark.range(2000).select(*[F.concat(F.lit(f"{c}:"), "id").alias(c) if c == "measurement_id" else F.lit(None).cast("string").alias(c)
                                      for c in schemas.MEASUREMENT_COLUMNS]).coalesce(1)
    tables.write_measurements(rows, str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("part-*"))
    again = tables.read_measurements(spark, str(tmp_path / "out"))
    assert again.columns == list(schemas.MEASUREMENT_COLUMNS) and again.select("measurement_id").distinct().count() == 2000
    assert size * 3 < 2000 * len("measurement_id:1000,,,,,,,,,,")
