"""Media folders: one row per file, with its hash; unreadable files are rows with a problem."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import extension, media_kind, stem
from ..session import ship

#: Folders that hold no photographs.
IGNORED = frozenset({"system volume information", "$recycle.bin", "misc", "private", "canonmsc"})


def ignored(name: str, is_folder: bool = True) -> bool:
    return name.startswith(".") or (is_folder and name.lower() in IGNORED)


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI that pyarrow reads, and the path in it."""
    local = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return FileSystem.from_uri(local if ":/" in local else f"file://{os.path.abspath(local)}")


def entries(root: str, rel: str = "") -> tuple[list[str], list[str]]:
    """(folders, files) of one folder, as sorted paths relative to root; neither ignored entries nor links. root is a path or a URI that pyarrow reads."""
    fs, base = file_system(root)
    folders, files = [], []
    for e in fs.get_file_info(FileSelector(f"{base}/{rel}" if rel else base)):
        is_folder = e.type == FileType.Directory
        if ignored(e.base_name, is_folder) or (fs.type_name == "local" and os.path.islink(e.path)):
            continue
        (folders if is_folder else files).append(f"{rel}/{e.base_name}" if rel else e.base_name)
    return sorted(folders), sorted(files)


def walk(root: str, rel: str = "") -> Iterator[str]:
    """Paths of all files below a folder."""
    waiting = [rel]
    while waiting:
        folders, files = entries(root, waiting.pop())
        yield from files
        waiting += reversed(folders)


class _Part(InputPartition):
    """A folder to be walked, or files of one folder."""

    def __init__(self, folder: str | None, files: list[str]):
        super().__init__((folder, files))
        self.folder, self.files = folder, files


class _Reader(DataSourceReader):
    """The driver lists `levels` of folders; tasks walk what is below, and read."""

    def __init__(self, root: str, per_task: int, levels: int = 2):
        self.root, self.per_task, self.levels = root, per_task, levels

    def partitions(self) -> list[InputPartition]:
        level, out = [""], []
        for _ in range(self.levels):
            below: list[str] = []
            for rel in level:
                folders, files = entries(self.root, rel)
                below += folders
                out += [_Part(None, files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]
            level = below
        return out + [_Part(rel, []) for rel in level] or [_Part(None, [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        fs, base = file_system(self.root)
        for rel in partition.files if partition.folder is None else walk(self.root, partition.folder):
            try:
                digest, size = hashlib.sha256(), 0
                with fs.open_input_stream(f"{base}/{rel}") as f:
                    while chunk := f.read(1 << 20):
                        digest.update(chunk)
                        size += len(chunk)
                yield (rel, size, digest.hexdigest(), None)
            except OSError as e:
                yield (rel, None, None, str(e))


class MediaFolder(DataSource):
    """spark.read.format("media_folder").load(root): names that Spark's own readers hide, such as those with a leading `_`, are here too."""

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return "rel_path string, bytes long, sha256 string, problem string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options["path"], int(self.options.get("files_per_task", "256")))


def scan_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(assets, problems) of the files below root, a folder that all executors see."""
    ship(spark)
    spark.dataSource.register(MediaFolder)
    rows = spark.read.format("media_folder").load(root)
    path = F.col("rel_path")
    named = rows.withColumns({"kind": media_kind(path), "stem": stem(path), "ext": extension(path)})
    return named.where("problem is null").drop("problem"), named.where("problem is not null").select("rel_path", "problem")


def accept(rows: DataFrame, extensions: list[str]) -> DataFrame:
    """rows (rel_path) once each, with reason: null for accepted extensions."""
    ext = extension(F.col("rel_path"))
    return rows.dropDuplicates(["rel_path"]).withColumn("reason", F.when(~ext.isin(extensions), F.concat(F.lit("not accepted: ."), ext)))
