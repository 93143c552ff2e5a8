"""Documents that many tasks write and one commit publishes.

A document is a list of sections: an opening, rows with a separator between them, a closing. Its rows (section, key, text) are dealt by ranges, so
that each task writes a part of its own, and no row has to know whether it is the first of its section. What stands between two parts is a file as
well, written by the commit, which knows where parts begin and end; so are the opening of the document and its end. The files one after
the other, in the order of their names, are the document.

Parts are written to a folder beside the target, under a name that readers skip. The commit checks that parts are in order, deletes what
failed or repeated attempts have left, adds a list of the files with their lengths, and renames the folder to the target: a document is there as a
whole or not at all. A job that fails removes its folder. Where a store copies to rename, whole() tells whether all of a document has come.

Empty tables give a document of openings and closings. Rows with a null section, key or text are errors. Rows of one section with the same key
are in any order."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from netframe.operators.components import dealt_by_range

FORMAT = "sectioned_document"
LISTED = "_files.json"


@dataclass(frozen=True)
class Section:
    opening: str = ""
    separator: str = ""
    closing: str = ""


def _between(sections: list[Section], last: int, first: int) -> str:
    """What stands behind a row of section last (-1: the document's begin) and before one of section first (beyond all sections: its end)."""
    if last == first:
        return sections[last].separator
    empty = "".join(s.opening + s.closing for s in sections[last + 1 : first])
    return (sections[last].closing if last >= 0 else "") + empty + (sections[first].opening if first < len(sections) else "")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: the first and the last row's (section, key), and the file, none where the task had no rows."""

    index: int
    name: str | None = None
    length: int = 0
    rows: int = 0
    first: tuple[int, str] | None = None
    last: tuple[int, str] | None = None


def _pieces(batches: Iterator[pa.RecordBatch], sections: list[Section], part: Part) -> Iterator[str]:
    """The text of a task's rows, a run of one section at a time; notes in part what they are."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if any(c.null_count for c in rows.columns):
            raise ValueError("a row of a document without section, key or text")
        numbers, keys, texts = (rows[c].to_pylist() for c in ("section", "key", "text"))
        at = 0
        while at < len(numbers):
            section, end = numbers[at], at + 1
            while end < len(numbers) and numbers[end] == section:
                end += 1
            if not 0 <= section < len(sections):
                raise ValueError(f"no section {section} in this document")
            own = keys[at:end]
            if (part.last is not None and part.last > (section, own[0])) or any(a > b for a, b in zip(own, own[1:])):
                raise ValueError("rows of a document out of order")
            if part.last is None:
                part.first = section, own[0]
            else:
                yield _between(sections, part.last[0], section)
            yield sections[section].separator.join(texts[at:end])
            part.last, part.rows, at = (section, own[-1]), part.rows + end - at, end


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sections: list[Section], overwrite: bool):
        parent, _, name = path.rstrip("/").rpartition("/")
        self.target, self.sections, self.overwrite = f"{parent}/{name}", sections, overwrite
        self.staging = f"{parent}/_{name}-{uuid.uuid4().hex}"
        store, root = fs.FileSystem.from_uri(self.target)
        if not overwrite and store.get_file_info(root).type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} is there already")

    def _staging(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        return self.written(iterator, task.partitionId(), task.taskAttemptId())

    def written(self, batches: Iterator[pa.RecordBatch], index: int, attempt: int) -> Part:
        part, out = Part(index), None
        store, root = self._staging()
        try:
            for text in _pieces(batches, self.sections, part):
                if out is None:
                    part.name = f"part-{index:07d}-1-{attempt}"
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{part.name}", compression=None)
                data = text.encode()
                part.length += len(data)
                out.write(data)
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.name is not None), key=lambda p: p.index)
        for a, b in zip(parts, parts[1:]):
            if a.last > b.first:
                self.abort(messages)
                raise ValueError("parts of a document out of order")
        store, root = self._staging()
        store.create_dir(root, recursive=True)
        files, last = {}, -1
        for part in [*parts, None]:
            first, index = (part.first[0], part.index) if part else (len(self.sections), parts[-1].index + 1 if parts else 0)
            if text := _between(self.sections, last, first).encode():
                name = f"part-{index:07d}-0"
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(text)
                files[name] = len(text)
            if part:
                files[part.name], last = part.length, part.last[0]
        for found in store.get_file_info(fs.FileSelector(root)):
            if found.base_name not in files:
                store.delete_file(found.path)
        with store.open_output_stream(f"{root}/{LISTED}", compression=None) as out:
            out.write(json.dumps({"rows": sum(p.rows for p in parts), "files": files}).encode())
        _, target = fs.FileSystem.from_uri(self.target)
        replaced = None
        if self.overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            replaced = f"{root}-replaced"
            store.move(target, replaced)
        store.move(root, target)
        if replaced:
            store.delete_dir(replaced)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = self._staging()
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class DocumentSink(DataSource):
    """df.write.format("sectioned_document"): rows (section int, key string, text string) in order; option sections: a JSON list of openings, separators and closings."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "section int, key string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], [Section(**s) for s in json.loads(self.options["sections"])], overwrite)


def write_document(rows: DataFrame, sections: list[Section], path: str, overwrite: bool = False) -> None:
    """Writes rows (section, key, text) as the document at path, a folder; an error where it is there already, unless overwrite."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSink)
    ordered = rows.select(F.col("section").cast("int").alias("section"), "key", "text")
    ordered = dealt_by_range(ordered, "section", "key").sortWithinPartitions("section", "key")
    ordered.write.format(FORMAT).option("sections", json.dumps([asdict(s) for s in sections])).mode("overwrite" if overwrite else "append").save(path)


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes lines (part, key, text), parts from 0 to 9, as the document at path."""
    write_document(lines.select(F.col("part").alias("section"), "key", F.concat("text", F.lit("\n")).alias("text")), [Section()] * 10, path, overwrite)


def whole(path: str) -> dict[str, int]:
    """Files of the document at path and their lengths, in order; an error where one of them is missing or short. A document has a few files for each task."""
    store, root = fs.FileSystem.from_uri(path.rstrip("/"))
    with store.open_input_stream(f"{root}/{LISTED}", compression=None) as made:
        files = json.loads(made.read())["files"]
    found = {f.base_name: f.size for f in store.get_file_info(fs.FileSelector(root)) if f.base_name != LISTED}
    if found != files:
        raise ValueError(f"{path} isn't a whole document")
    return dict(sorted(files.items()))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of the document at path, each where it is. A line that several parts share is several rows."""
    whole(path)
    return spark.read.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines of the document at path that write_lines() made, from 0 in its order. A part is a row of text while its lines are told apart."""
    order = spark.createDataFrame([(at, name) for at, name in enumerate(whole(path))], "at long, file string")  # a row for each part
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.regexp_replace("value", "\n$", ""), "\n").alias("lines"))
    sizes = parts.select("file", F.size("lines").alias("size")).join(order, "file")
    starts = sizes.select("file", (F.sum("size").over(Window.orderBy("at")) - F.col("size")).alias("start"))
    each = parts.join(F.broadcast(starts), "file").select("start", F.posexplode("lines").alias("at", "value"))
    return each.select((F.col("start") + F.col("at")).alias("n"), "value")
