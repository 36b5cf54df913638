"""Statistics documents as a Spark data source: a file <kind>_stats_<tolerance>.json for each row.

    StatsFiles.register(spark)
    documents.write.format("stats_files").mode("append").save(folder)       # kind, name, doc
    spark.read.format("stats_files").option("kind", "rank").load(folder)    # kind, tolerance, doc

Tasks write drafts under names of their own beside the files. When all have succeeded, each draft replaces the file of
its name by one rename, so that an old file is never gone before the new one is there, and a task that is lost and run
again, or a job that fails, leaves the folder as it was. Files are reached through pyarrow.fs: local and mounted
folders, HDFS and object stores; load_stats of results.py reads any folder that Spark reads.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pfs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes and files of a partition at most, as far as they go together.
BYTES, FILES = 8 << 20, 256
NAME = re.compile(r"([a-z_]+)_stats_([^/]*)\.json$")


def opened(folder: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a folder, which is a URI or an absolute path, and its path there."""
    uri = re.sub(r"^file:/+", "file:///", folder)
    return pfs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri))


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str, float]]


@dataclass
class Drafts(WriterCommitMessage):
    names: dict[str, str]


class StatsReader(DataSourceReader):
    def __init__(self, folder: str, kind: str | None):
        self.folder, self.kind = folder, kind

    def partitions(self) -> list[Files]:
        """Files of the kind (or of any), put together by bytes; names without a number are left out."""
        files, path = opened(self.folder)
        out, size = [[]], 0
        for f in sorted(files.get_file_info(pfs.FileSelector(path, allow_not_found=False)), key=lambda f: f.path):
            m = NAME.match(f.base_name)
            if not f.is_file or not m or self.kind not in (None, m[1]):
                continue
            try:
                tolerance = float(m[2])
            except ValueError:
                continue
            if out[-1] and (size + f.size > BYTES or len(out[-1]) == FILES):
                out.append([])
                size = 0
            out[-1].append((f.path, m[1], tolerance))
            size += f.size
        return [Files(p) for p in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = opened(self.folder)
        for path, kind, tolerance in partition.paths:
            with files.open_input_file(path) as f:
                yield kind, tolerance, f.read().decode()


class StatsWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Drafts:
        files, path = opened(self.folder)
        files.create_dir(path, recursive=True)
        names = {}
        for row in rows:
            name = f"{row['name']}.json"
            if not NAME.match(name) or "/" in name:
                raise ValueError(f"{name!r} is no name of a document")
            if name in names:
                raise ValueError(f"two documents named {name}")
            names[name] = f"{path}/_draft-{uuid.uuid4().hex}"
            with files.open_output_stream(names[name]) as out:
                out.write((row["doc"] or "").encode())
        return Drafts(names)

    def commit(self, messages: list[Drafts | None]) -> None:
        files, path = opened(self.folder)
        names = [(name, draft) for m in messages if m for name, draft in m.names.items()]
        if len({n for n, _ in names}) < len(names):
            self.abort(messages)
            raise ValueError("two documents of one name")
        with ThreadPoolExecutor(16) as pool:  # a rename over the old file for each
            list(pool.map(lambda x: files.move(x[1], f"{path}/{x[0]}"), names))

    def abort(self, messages: list[Drafts | None]) -> None:
        files, _ = opened(self.folder)
        for m in messages:
            for draft in m.names.values() if m else ():
                files.delete_file(draft)


class StatsFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stats_files"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        """Makes the source known to the session."""
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return "kind string, tolerance double, doc string"

    def reader(self, schema) -> StatsReader:
        return StatsReader(self.options["path"], self.options.get("kind"))

    def writer(self, schema, overwrite: bool) -> StatsWriter:
        if overwrite:
            raise ValueError("documents replace those of their name; use mode append")
        return StatsWriter(self.options["path"])
