"""Files written by tasks: each is put under another name first and renamed when whole, so that no part of one is ever seen."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.operators.components import written
from netframe.sources.ranges import rows_of


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (path, content) under folder; returns (path, length). A file of a task that runs again is the same file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for row in rows_of(batches):
            content = row["content"] or b""
            place, own = f"{root}/{row['path']}", f"{root}/_{row['path']}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own, compression=None) as out:
                out.write(content)
            store.move(own, place)
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([len(content)], pa.int64())], ["path", "length"])

    return written(files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "path string, length long"), "files")
