"""What the operators of this subpackage share: input, shared folders, Arrow helpers and the memory of Python workers."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.operators.components import shared_folder, written

#: Rows of an Arrow batch that are made Python objects at once.
SLICE_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whole text of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut and survives lost executors."""
    return written(df, name)


def stored(folder: str, name: str, value: Any) -> str:
    """Writes value to a file of the shared folder, from the task that has made it; a task that runs again writes the same. Returns what loaded() takes."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        pickle.dump(value, out, protocol=pickle.HIGHEST_PROTOCOL)
    return f"{folder}\t{root}/{name}"


def loaded(place: str) -> Any:
    """What stored() has written."""
    folder, path = place.split("\t")
    with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as source:
        return pickle.load(source)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def str_texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Strings of a string column; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that only these are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under fixed names: other columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_kept: list[Any] = [None, None]


def of_worker(key: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker, which outlives tasks, keeps between them: made once for a key, and only for the last one. What an
    earlier operator has kept is let go first, so stages that follow each other don't add up."""
    if _kept[0] is not key and _kept[0] != key:
        _kept[:] = None, None
        _kept[:] = key, make()
    return _kept[1]


class Remembered(dict):
    """Values made for keys, in two generations of at most so many bytes: what is looked up again moves to the younger one."""

    def __init__(self, make: Callable[[Any], Any], max_bytes: int, entry_bytes: int = 160):
        super().__init__()
        self.make, self.max_bytes, self.entry_bytes, self.older, self.held = make, max_bytes // 2, entry_bytes, {}, 0

    def __missing__(self, key: Any) -> Any:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        self.held += self.entry_bytes + len(key)
        if self.held > self.max_bytes:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = made
        return made
