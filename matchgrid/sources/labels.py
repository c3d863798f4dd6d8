"""A sink for detector training sets: one label file a frame under train or val, committed at the job's end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from matchgrid.functions import text as X
from matchgrid.operators import series
from matchgrid.sources.tables import exists

SCHEMA = "frame int, split string, line string"


def store_of(uri: str):
    """The file system of a qualified path and the path in it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder, which holds the list of its files, and their number."""

    folder: str
    files: int
    boxes: int


def moved(store, source: str, target: str) -> None:
    """Move a file; one that an earlier attempt has left in its place is the same and is replaced."""
    try:
        store.move(source, target)
    except OSError:
        store.delete_file(target)
        store.move(source, target)


def moved_folder(store, source: str, target: str) -> None:
    """Move a folder in one step, or file by file where the store has no such step."""
    from pyarrow import fs

    try:
        store.move(source, target)
    except NotImplementedError:
        store.create_dir(target, recursive=True)
        for f in store.get_file_info(fs.FileSelector(source, recursive=True)):
            if f.type == fs.FileType.File:
                place = f"{target}/{f.path[len(source) + 1 :]}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                store.move(f.path, place)


class LabelWriter(DataSourceArrowWriter):
    """Tasks write to folders of their own and then move their files to the staged set, which the commit moves to its place as a whole.

    A frame's file has one content whichever attempt writes it. Each successful attempt leaves a list of its files under ``index``.
    """

    def __init__(self, uri: str):
        self.uri, self.staging = uri, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        store, root = store_of(self.uri)
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        for place in (folder, *(f"{self.staging}/labels/{split}" for split in ("train", "val"))):
            store.create_dir(f"{root}/{place}", recursive=True)
        files, boxes, frame, lines = [], 0, None, []

        def flush() -> None:
            nonlocal boxes
            if lines:
                split, stem = frame[1], f"frame_{frame[0] + 1:06d}"
                with store.open_output_stream(f"{root}/{folder}/{split}-{stem}.txt") as out:
                    out.write(("\n".join(lines) + "\n").encode())
                files.append((split, stem))
                boxes += len(lines)

        for batch in iterator:
            for number, split, line in zip(*(batch.column(c).to_pylist() for c in ("frame", "split", "line")), strict=True):
                if (number, split) != frame:
                    flush()
                    frame, lines = (number, split), []
                lines.append(line)
        flush()
        for split, stem in files:
            moved(store, f"{root}/{folder}/{split}-{stem}.txt", f"{root}/{self.staging}/labels/{split}/{stem}.txt")
        with store.open_output_stream(f"{root}/{folder}/index") as out:
            out.write("".join(f"{split},{stem}.txt\n" for split, stem in files).encode())
        return Staged(folder, len(files), boxes)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.uri)
        for place in ("index", *(f"{self.staging}/labels/{split}" for split in ("train", "val"))):
            store.create_dir(f"{root}/{place}", recursive=True)
        for m in messages:
            if m is not None:
                store.move(f"{root}/{m.folder}/index", f"{root}/index/{m.folder.rpartition('/')[2]}.csv")
        moved_folder(store, f"{root}/{self.staging}/labels", f"{root}/labels")
        with store.open_output_stream(f"{root}/data.yaml") as out:
            out.write(b"train: images/train\nval: images/val\nnames:\n  0: player\n")
        store.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.uri)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class LabelFiles(DataSource):
    """``df.write.format("label_files")``: rows (frame, split, line), all of a frame in one task and in order."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def write_dataset(boxes: DataFrame, path: str, width: float = 1920.0, height: float = 1080.0, val_share: float = 0.18) -> None:
    """Write the labels of boxes (frame, detection_id, x1..y2): files of the last frames under labels/val, of the others under labels/train.

    A path that exists is an error. Frames are numbered from 1 in the file names. Lines are in the order of detection_id.
    """
    spark = boxes.sparkSession
    if exists(spark, path):
        raise ValueError(f"{path} exists")
    uri = qualified(spark, path)
    spark.dataSource.register(LabelFiles)
    split = series.tail_split(boxes.select("frame").distinct(), "frame", val_share)
    rows = boxes.join(split, "frame").withColumn("line", X.yolo_label(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), width, height))
    ordered = rows.repartition("frame").sortWithinPartitions("frame", "detection_id")
    ordered.select("frame", "split", "line").write.format("label_files").mode("append").option("path", uri).save()


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, value): the whole text of every label file that write_dataset() has left.

    The tasks find their files in the set's index: the driver lists no folder and plans no file, of which there is one a frame.
    """
    uri = qualified(spark, path)

    def run(batches):
        store, root = store_of(uri)
        for batch in batches:
            texts = []
            for split, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{root}/labels/{split}/{file}") as f:
                    texts.append(f.read().decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["split", "file", "value"])

    return spark.read.schema("split string, file string").csv(f"{path}/index").mapInArrow(run, "split string, file string, value string")
