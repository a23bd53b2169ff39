"""A sink of one text file per row: ``<id>.txt`` in one folder, all of a write or none.

Tasks write below a folder of the write's own; its files move to their place when every task has ended well, and go if
one has not, so that a failed or repeated task leaves nothing. Of rows of one id the text that sorts last stays. Paths are
those of pyarrow's file systems (local and mounted folders, HDFS, S3), written where the tasks run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from specloom.functions.text import safe_id

FORMAT = "requirement_texts"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class TextFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_writing-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows) -> Written:
        system, root = self._open()
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        names = []
        for r in rows:
            with system.open_output_stream(f"{folder}/{r['id']}.txt") as out:
                out.write((r["value"] or "").encode("utf-8", "replace"))
            names.append(r["id"])
        return Written(folder, names)

    def commit(self, messages) -> None:
        system, root = self._open()
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.base_name.endswith(".txt"):
                    system.delete_file(old.path)
        for m in messages:
            for name in m.names if m is not None else ():
                system.move(f"{m.folder}/{name}.txt", f"{root}/{name}.txt")
        system.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages) -> None:
        system, root = self._open()
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class TextFiles(DataSource):
    """Format of :func:`write_text_files`; rows are (id, value)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(self.options["path"], overwrite)


def write_text_files(df: DataFrame, path: str) -> None:
    """One file ``<safe id>.txt`` for each req_id of ``df`` (req_id, rimay), in place of those that stand there; null ids are left out."""
    df.sparkSession.dataSource.register(TextFiles)
    rows = df.where("req_id IS NOT NULL").groupBy(safe_id(F.col("req_id")).alias("id")).agg(F.max("rimay").alias("value"))
    rows.write.format(FORMAT).mode("overwrite").save(path)
