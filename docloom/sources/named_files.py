"""Files under names of their own, by a Python data source.

Spark's own writers name part files themselves.  ``NamedFiles`` writes rows
``(file, value)`` into files of exactly the names given: each task streams its
rows into a staging folder of its attempt, and only the commit of the whole
write renames the staged files to their places.  So a failed task, attempt or
write leaves no file, a retried or speculative attempt leaves one, and a reader
never sees half a file.  Rows of one file must be in one task, one after the
other (``write_named_json`` sees to it); a task holds one batch of rows.

A file is replaced whole when its name is written again.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# the writer runs in Python workers; see hooks.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Spark's readers skip folders whose names start so.
STAGING = "_staging"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task attempt wrote."""
    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    """Values of a file's rows, joined by ``between``, after ``head`` and before ``tail``."""

    def __init__(self, path: str, head: str, between: str, tail: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.head, self.between, self.tail = (x.encode() for x in (head, between, tail))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = file_system(self.path)
        folder = f"{STAGING}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        name, out, seen = None, None, set()
        try:
            for batch in iterator:
                files = batch.column(0).to_pylist()
                values = batch.column(1).cast(pa.binary()).to_pylist()
                at = 0
                while at < len(files):
                    stop = at
                    while stop < len(files) and files[stop] == files[at]:
                        stop += 1
                    if files[at] != name:
                        self._close(out)
                        name = files[at]
                        if not name or "/" in name or name in seen:
                            raise ValueError(f"no name for a file, or rows of it in two places: {name!r}")
                        seen.add(name)
                        out = fs.open_output_stream(f"{base}/{folder}/{name}")
                        out.write(self.head)
                    else:
                        out.write(self.between)
                    out.write(self.between.join(values[at:stop]))
                    at = stop
            self._close(out)
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        return Staged(folder)

    def _close(self, out) -> None:
        if out is not None:
            out.write(self.tail)
            out.close()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        places: dict[str, str] = {}
        for m in messages:
            if m is None:
                continue
            for info in fs.get_file_info(pafs.FileSelector(f"{base}/{m.folder}")):
                if info.base_name in places:
                    raise ValueError(f"rows of a file in two tasks: {info.base_name}")
                places[info.base_name] = info.path
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(base)):
                if info.type == pafs.FileType.File and info.base_name not in places:
                    fs.delete_file(info.path)
        for file, staged in places.items():
            fs.move(staged, f"{base}/{file}")
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, base = file_system(self.path)
        if fs.get_file_info(f"{base}/{STAGING}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{STAGING}/{self.job}")


class NamedFiles(DataSource):
    """``df.write.format("named_files")`` with the options path, head, between and tail."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        o = self.options
        return NamedFilesWriter(o["path"], o.get("head", ""), o.get("between", "\n"), o.get("tail", "\n"), overwrite)


def write_named_json(df: DataFrame, path: str, file: Column, order: list[str], root: str | None = None, mode: str = "append",
                     drop: Sequence[str] = ()) -> None:
    """The rows of ``df`` as JSON arrays in files of the names ``file``, each
    sorted by ``order``; with ``root`` as ``{"<root>": [...]}``; columns
    of ``drop`` aren't written.  A name must be neither null nor empty.  The rows of one file go to one task, which streams
    them: a file may be larger than its memory."""
    df.sparkSession.dataSource.register(NamedFiles)
    row = F.to_json(F.struct(*[c for c in df.columns if c not in drop]), {"ignoreNullFields": "false"})
    keyed = df.select(F.coalesce(F.nullif(file, F.lit("")), F.raise_error(F.lit("a row has no file name")).cast("string")).alias("file"),
                      row.alias("value"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    # the whole row breaks ties, so a file is the same however often it is written
    rows = keyed.repartition("file").sortWithinPartitions("file", *[f"_{i}" for i in range(len(order))], "value").select("file", "value")
    head, tail = (f'{{"{root}": [', "]}") if root else ("[", "]")
    (rows.write.format("named_files").mode(mode).option("head", head).option("between", ",\n").option("tail", tail).save(path))


def write_named_text(df: DataFrame, path: str, file: Column, text: str, mode: str = "append") -> None:
    """Each row's ``text`` as it is (null: nothing), in the file of its name; of
    rows of one name the texts stand on lines in their own order."""
    df.sparkSession.dataSource.register(NamedFiles)
    keyed = df.select(F.coalesce(F.nullif(file, F.lit("")), F.raise_error(F.lit("a row has no file name")).cast("string")).alias("file"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("value"))
    rows = keyed.repartition("file").sortWithinPartitions("file", "value")
    rows.write.format("named_files").mode(mode).option("tail", "").save(path)
