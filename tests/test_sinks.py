"""Sinks, versioned tables, detectors and annotation logs."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.operators import annotations, export, ingest
from matchgrid.sources import detectors as D
from matchgrid.sources.adapters import oracle


def test_read_or_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("name", T.StringType())])
    assert ingest.read_or_empty(spark, str(tmp_path / "none.csv"), schema).count() == 0
    export.write_csv(spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "frame int, name string, x double"), ["frame", "name"], str(tmp_path / "t"))
    assert sorted(map(tuple, ingest.read_or_empty(spark, str(tmp_path / "t"), schema).collect()), key=repr) == [(1, "a"), (2, None)]


def test_versions_keep_older_tables(spark, tmp_path):
    assert export.versions(spark, str(tmp_path), "t") == []
    first = export.versioned(spark.range(3).toDF("i"), str(tmp_path), "t")
    export.versioned(spark.read.parquet(first).filter("i > 0"), str(tmp_path), "t")
    found = export.versions(spark, str(tmp_path), "t")
    assert [spark.read.parquet(p).count() for p in found] == [3, 2]


def test_segments_are_pruned(spark, tmp_path):
    export.write_segments(spark.createDataFrame([("a", 1), ("b", 2)], "segment string, frame int"), str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s")).filter("segment = 'b'")
    assert [r.frame for r in df.collect()] == [2]
    assert "PartitionFilters: [isnotnull(segment" in df._jdf.queryExecution().toString()


def test_json_lines(spark, tmp_path):
    export.write_json_lines(spark.range(2).select("id", F.struct("id").alias("metrics")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).filter("metrics.id = id").count() == 2


def test_dashboard_escapes(spark):
    page = export.dashboard({"a<b": 1}, {"T": spark.createDataFrame([("<script>", None)], "x string, y string")})
    assert "&lt;script&gt;" in page and "a&lt;b" in page and "<script>" not in page


def test_detected_drops_small_boxes(spark):
    class Thin:
        def __call__(self, frame, content):
            return [(0, 0, 1.9, 50, 0.9), (0, 0, 2, 2, 0.8), (frame, 0, frame + 10, 10, 0.7)]

    frames = spark.createDataFrame([(1, b"x"), (5, None)], "frame int, content binary")
    rows = sorted(map(tuple, D.detected(frames, Thin).collect()))
    assert [(r[0], r[1], r[6]) for r in rows] == [(1, 0, 0.8), (1, 1, 0.7), (5, 0, 0.8), (5, 1, 0.7)]
    assert D.detected(frames.limit(0), Thin).count() == 0


def test_upsert_and_assignments(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(1, "x", False, 1), (1, "y", False, 2), (2, None, True, 3), (9, "n", False, 4)], "k int, v string, cleared boolean, seq int")
    assert sorted(map(tuple, annotations.upserted(base, log, "k", "seq").collect())) == [(1, "y"), (3, "c"), (9, "n")]
    log = spark.createDataFrame([(1, 7, "a", 5, "override"), (2, 7, "b", 0, "base"), (3, 7, "c", 9, "override"), (4, 8, "d", 0, "base"), (5, 8, None, 0, "unassign")], "seq int, tid int, name string, frame int, kind string")
    assert sorted((r.tid, r.name, r.kind, r.frame) for r in annotations.assigned(log).collect()) == [(7, "b", "base", -1), (7, "c", "override", 9)]


def test_swap_needs_two_named_tracks(spark):
    names = spark.createDataFrame([(1, "a"), (2, "__reject__"), (3, "c")], "tid int, name string")
    assert annotations.swapped_from(names, 1, 2, 5, 10).count() == 0
    assert sorted((r.tid, r.name) for r in annotations.swapped_from(names, 1, 3, 5, 10).collect()) == [(1, "c"), (3, "a")]


def test_oracle_text_puts_views_first():
    text = oracle("WITH RECURSIVE x AS (SELECT 1) SELECT * FROM x", "track")
    assert text.startswith("WITH RECURSIVE det AS (") and text.index("pos AS") < text.index("track AS") < text.index("x AS")
