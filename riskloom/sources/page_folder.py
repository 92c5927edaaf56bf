"""Class folders of page files as a data source, read and written.

    spark.dataSource.register(PageFolder)
    spark.read.format("page_folder").load(root)                       # ordinal, path, label, html
    rows.write.format("page_folder").mode("append").save(root)        # name, label, html
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of files that a task reads, and that a batch holds, about; what a file counts at least.
TASK_BYTES, BATCH_BYTES, OPENING = 32 << 20, 4 << 20, 64 << 10
SCHEMA = "ordinal long, path string, label int, html string"
#: Class folders that written pages go to, by label.
FOLDERS = {1: "Phish", 0: "NotPhish"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^file:/(?!/)", "file:///", path)
    disk, inside = fs.FileSystem.from_uri(uri if ":" in uri else os.path.abspath(uri))
    return disk, inside.rstrip("/")


def decoded(data: bytes) -> str:
    """A page's text: UTF-8, or else Latin-1; line ends become \\n."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Files(InputPartition):
    """Neighbouring files of the sorted list: (ordinal, path, label) of each."""

    files: list[tuple[int, str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        """All page files below the class folders, sorted by folder and path, packed by their bytes. The list of names is the driver's, as with every file source; files stay where they are until a task opens them."""
        disk, root = _place(self.root)
        found = disk.get_file_info(fs.FileSelector(root, recursive=True))
        below = [(x.path[len(root) + 1 :].split("/"), x) for x in found if x.type == fs.FileType.File and x.path.endswith((".html", ".htm"))]
        out, size = [Files([])], 0
        for i, (parts, x) in enumerate(sorted(((p, x) for p, x in below if len(p) > 1), key=lambda f: f[0])):
            weight = max(x.size or 0, OPENING)
            if out[-1].files and size + weight > self.size:
                out.append(Files([]))
                size = 0
            out[-1].files.append((i, x.path, int(parts[0].lower().startswith("phish"))))
            size += weight
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        disk, _ = _place(self.root)
        rows, size = [], 0
        for ordinal, path, label in partition.files:
            with disk.open_input_stream(path) as f:
                html = decoded(f.read())
            rows.append((ordinal, path, label, html))
            size += len(html)
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["ordinal", "path", "label", "html"])


class _Writer(DataSourceArrowWriter):
    """A file a row. A task that runs again writes the same files anew."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        disk, root = _place(self.root)
        for name in FOLDERS.values():
            disk.create_dir(f"{root}/{name}", recursive=True)
        for batch in iterator:
            for name, label, html in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "label", "html")), strict=True):
                with disk.open_output_stream(f"{root}/{FOLDERS[int(label == 1)]}/{re.sub(r'[^\w.-]', '_', str(name))}.html") as out:
                    out.write((html or "").encode("utf-8", "surrogatepass"))
        return WriterCommitMessage()


class PageFolder(DataSource):
    """Data source "page_folder": labelled pages in class folders; label 1 for folders whose name begins with "phish" in any case. Files directly in the root are left out; a missing root fails."""

    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read(spark: SparkSession, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(ordinal, path, label, html) of a root's page files; ordinals number the sorted files from 0."""
    spark.dataSource.register(PageFolder)
    return spark.read.format("page_folder").option("taskBytes", task_bytes).load(root)


def write(pages: DataFrame, root: str, name_col: str, label_col: str, html_col: str) -> None:
    """A file for each page in its class's folder, named by name_col; of equal names the last one written stays. Null html is an empty file."""
    pages.sparkSession.dataSource.register(PageFolder)
    rows = pages.select(F.col(name_col).cast("string").alias("name"), F.col(label_col).cast("int").alias("label"), F.col(html_col).alias("html"))
    rows.write.format("page_folder").mode("append").save(root)
