"""Files with damaged lines, and the label sink."""

import pytest
from pyspark.sql import functions as F

from matchgrid.sources import labels, tables

TYPES = {"frame": "int", "x": "double", "name": "string", "extra": "long"}
LINES = ["name,x,frame", "a,1.5,1", "b,oops,2", "c,2.5", "d,3.5,4,5", ",,5", "e, ,6", '"f,g",4.5,7', "h,1e400,8", "i,1.0,x9"]


@pytest.fixture
def path(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.csv").write_text("\n".join(LINES) + "\n")
    return str(tmp_path / "t")


def test_columns_are_found_by_name_and_damage_is_kept(spark, path):
    rows, rejects = tables.scan_csv(spark, path, TYPES, required=("x",))
    assert sorted((r.frame, r.x, r.name, r.extra) for r in rows.collect()) == [(1, 1.5, "a", None), (7, 4.5, "f,g", None), (8, float("inf"), "h", None)]
    found = {(r.reason, r.line) for r in rejects.collect()}
    assert {("malformed", x) for x in ("c,2.5", "d,3.5,4,5")} <= found
    assert {r for r, _ in found} == {"malformed", "blank"} and len(found) == 6
    assert rejects.filter(F.col("file").endswith("one.csv")).count() == 6


def test_rejects_do_not_depend_on_the_columns_that_are_read(spark, path):
    rows, rejects = tables.scan_csv(spark, path, TYPES)
    assert rows.count() == 5 and rows.select("name").count() == 5 and len(rows.select("name").collect()) == 5
    assert rejects.count() == 4 and len(rejects.select("reason").collect()) == 4


def test_missing_and_empty_files(spark, path, tmp_path):
    for where in (str(tmp_path / "none"), f"{tmp_path}/none/*.csv"):
        rows, rejects = tables.scan_csv(spark, where, TYPES)
        assert rows.columns == list(TYPES) and rows.count() == 0 and rejects.count() == 0
    assert tables.scan_csv(spark, path, TYPES, limit=2)[0].count() == 2
    (tmp_path / "head").mkdir()
    (tmp_path / "head" / "h.csv").write_text("frame,x\n")
    assert tables.scan_csv(spark, str(tmp_path / "head"), TYPES)[0].count() == 0


BOXES = "frame int, detection_id int, x1 double, y1 double, x2 double, y2 double"


def test_label_files_equal_the_table(spark, tmp_path):
    boxes = [(f, i, 10.0 * i, 5.0, 10.0 * i + 8, 50.0 + f) for f in range(0, 40, 2) for i in range(1 + f % 3)]
    labels.write_dataset(spark.createDataFrame(boxes[::-1], BOXES), f"{tmp_path}/set", 100.0, 100.0)
    files = {p.relative_to(tmp_path / "set").as_posix(): p.read_text() for p in (tmp_path / "set").rglob("*.txt")}
    want = {}
    for f, _, x1, y1, x2, y2 in boxes:
        split = "val" if f >= 34 else "train"  # the last 3 of 20 frames
        b, e = min(x2, 100), min(y2, 100)
        want.setdefault(f"labels/{split}/frame_{f + 1:06d}.txt", []).append(f"0 {(x1 + b) / 200:.6f} {(y1 + e) / 200:.6f} {(b - x1) / 100:.6f} {(e - y1) / 100:.6f}")
    assert files == {k: "\n".join(v) + "\n" for k, v in want.items()}
    assert (tmp_path / "set" / "data.yaml").read_text().startswith("train: images/train")
    assert not list((tmp_path / "set").glob("_staging*"))
    with pytest.raises(ValueError, match="exists"):
        labels.write_dataset(spark.createDataFrame(boxes, BOXES), f"{tmp_path}/set")


def test_a_job_that_fails_leaves_no_labels(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], BOXES)
    broken = boxes.withColumn("x1", F.when(F.col("frame") == 2, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x1")))
    with pytest.raises(Exception, match="broken"):
        labels.write_dataset(broken, f"{tmp_path}/set")
    assert not list(tmp_path.rglob("*.txt")) and not list(tmp_path.rglob("_staging*"))


def test_the_driver_neither_moves_nor_lists_label_files(spark, tmp_path):
    boxes = spark.createDataFrame([(f, 1, 0.0, 0.0, 1.0, 1.0) for f in range(30)], BOXES)
    writer = labels.LabelWriter(f"file:{tmp_path}/direct")
    rows = spark.createDataFrame([(f, "val" if f > 25 else "train", "0 1") for f in range(30)], labels.SCHEMA).toArrow().to_batches()
    first, again = writer.write(iter(rows)), writer.write(iter(rows))  # an attempt that is lost, and the one that counts
    assert len(str(first)) < 200 and first.files == again.files == 30
    writer.commit([again, None])
    assert len(list((tmp_path / "direct" / "labels").rglob("*.txt"))) == 30 and not list((tmp_path / "direct").glob("_staging*"))
    labels.write_dataset(boxes, f"{tmp_path}/set")
    for folder in ("direct", "set"):
        found = labels.read_dataset(spark, f"{tmp_path}/{folder}")
        sent = {f"{r.split}/{r.file}": r.value for r in found.collect()}
        assert sent == {p.relative_to(tmp_path / folder / "labels").as_posix(): p.read_text() for p in (tmp_path / folder / "labels").rglob("*.txt")} and len(sent) == 30
        assert found.rdd.getNumPartitions() <= 8
