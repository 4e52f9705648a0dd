"""One output file per input file, written by a Python Data Source with commit and abort.

Rows (name, position, content) of a file are written one after the other; a file is never held.
A task writes into a folder of its own below `_staged`; only the commit of the whole job moves
the files to their names, so a task that is lost or runs twice leaves no half file and none twice.
Any file system that pyarrow knows will do.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGED = "_staged"


def file_system(path: str):
    """(file system, path in it) of a folder that Spark or pyarrow names."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _safe(name: str) -> str:
    """A name below the folder, whatever the input calls itself."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    if not parts:
        raise ValueError(f"no file name: {name!r}")
    return posixpath.join(*parts)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder and the names in it."""

    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, root = file_system(self.path)
        folder = posixpath.join(root, STAGED, self.job, uuid.uuid4().hex)
        names, out = [], None
        try:
            for row in rows:
                name = _safe(row["name"])
                if not names or name != names[-1]:
                    if out:
                        out.close()
                    if name in names:
                        raise ValueError(f"rows of {name} are not together")
                    target = posixpath.join(folder, name)
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                    out = fs.open_output_stream(target)
                    names.append(name)
                if row["content"]:
                    out.write(bytes(row["content"]))
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for name in m.names if m else []:
                target = posixpath.join(root, name)
                fs.create_dir(posixpath.dirname(target), recursive=True)
                fs.move(posixpath.join(m.folder, name), target)
        self._clean(fs, root)

    def abort(self, messages: list) -> None:
        self._clean(*file_system(self.path))

    def _clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        staged = posixpath.join(root, STAGED, self.job)
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)


class FileSink(DataSource):
    """`df.write.format("files_as_they_came").mode("append").save(path)`."""

    @classmethod
    def name(cls) -> str:
        return "files_as_they_came"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_files(df: DataFrame, path: str) -> None:
    """Write (name, position, content): one file per name, its rows in order of position. A file
    is one stream of one task; files are dealt over tasks. Existing files are replaced."""
    df.sparkSession.dataSource.register(FileSink)
    rows = df.select(F.col("name").cast("string"), "position", F.col("content").cast("binary"))
    dealt = rows.repartition("name").sortWithinPartitions("name", "position")
    dealt.write.format(FileSink.name()).mode("append").save(path)
