"""A sink that writes documents: many rows one after another make one file, and a commit makes all of them visible at once.

Rows come sorted, so a task holds one open file, however long a document is. Each
task attempt writes into a folder of its own. The driver's commit writes one small
entry that names the folders of the attempts that count; a reader follows the
entries. A job that fails, or an attempt that is repeated, leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from ..session import ship
from .media import file_system


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    documents: int


class _Writer:
    """Both writers' work; `jobs` are folders below the path, entries are in `_commits`."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.overwrite = overwrite
        self.job = f"job-{uuid.uuid4().hex}"
        self.header, self.footer = options.get("header", ""), options.get("footer", "")

    def _job(self, batch: int | str | None) -> str:
        """The folder of a batch of a stream, or of the job."""
        return self.job if batch is None else f"{self.job}-{batch}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        folder = f"{self._job(context.getLocalProperty('streaming.sql.batchId'))}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, base = file_system(self.path)
        now, out, n = None, None, 0
        try:
            for batch in iterator:
                for document, text in zip(batch.column("document").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if document is None:
                        raise ValueError("a document needs a name")
                    if out is None or document != now:
                        if out is not None:
                            out.write(self.footer.encode())
                            out.close()
                        if n == 0:
                            fs.create_dir(f"{base}/{folder}")
                        at = f"{base}/{folder}/{quote(document, safe=' ')}{self.suffix}"
                        if fs.get_file_info(at).type != FileType.NotFound:
                            raise ValueError(f"rows of {document!r} are not together")
                        out, now, n = fs.open_output_stream(at), document, n + 1
                        out.write(self.header.encode())
                    out.write((text or "").encode())
            if out is not None:
                out.write(self.footer.encode())
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            if n:
                fs.delete_dir(f"{base}/{folder}")
            raise
        return _Written(folder, n)

    def _commit(self, messages: list[_Written | None], name: str, job: str) -> None:
        fs, base = file_system(self.path)
        folders = sorted(m.folder for m in messages if m is not None and m.documents)
        fs.create_dir(f"{base}/_commits")
        entry = {"suffix": self.suffix, "overwrite": self.overwrite, "folders": folders}
        with fs.open_output_stream(f"{base}/_commits/.{name}") as f:
            f.write(json.dumps(entry).encode())
        fs.move(f"{base}/_commits/.{name}", f"{base}/_commits/{name}.json")  # the commit
        kept = {f.rsplit("/", 1)[1] for f in folders}
        for e in fs.get_file_info(FileSelector(f"{base}/{job}", allow_not_found=True)):
            if e.base_name not in kept:  # an attempt that does not count
                fs.delete_dir(e.path)

    def _delete(self, job: str) -> None:
        fs, base = file_system(self.path)
        if fs.get_file_info(f"{base}/{job}").type == FileType.Directory:
            fs.delete_dir(f"{base}/{job}")


def _entries(path: str) -> list[tuple[str, dict]]:
    fs, base = file_system(path)
    found = sorted(e.base_name for e in fs.get_file_info(FileSelector(f"{base}/_commits", allow_not_found=True)) if e.base_name.endswith(".json") and not e.base_name.startswith("."))
    out = []
    for name in found:
        with fs.open_input_stream(f"{base}/_commits/{name}") as f:
            entry = json.loads(f.read())
        out = [] if entry["overwrite"] else out
        out.append((name, entry))
    return out


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        fs, base = file_system(self.path)
        held = fs.get_file_info(FileSelector(f"{base}/_commits", allow_not_found=True))
        number = 1 + max((int(e.base_name[:12]) for e in held if e.base_name[:12].isdigit()), default=-1)
        before = [f for _, entry in _entries(self.path) for f in entry["folders"]] if self.overwrite else []
        self._commit(messages, f"{number:012d}-{self.job}", self.job)
        for job in {f.split("/")[0] for f in before}:
            self._delete(job)

    def abort(self, messages: list) -> None:  # noqa: ARG002
        self._delete(self.job)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A batch has one entry, named by its number: a batch that comes again after a restart replaces it."""

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        name = f"{batchId:012d}"
        before = [f for n, entry in _entries(self.path) if n == f"{name}.json" for f in entry["folders"]]
        self._commit(messages, name, self._job(batchId))
        for job in {f.split("/")[0] for f in before} - {self._job(batchId)}:
            self._delete(job)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: ARG002, N803
        self._delete(self._job(batchId))


class _Folder(InputPartition):
    def __init__(self, folder: str | None, suffix: str):
        super().__init__((folder, suffix))
        self.folder, self.suffix = folder, suffix


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f, e["suffix"]) for _, e in _entries(self.path) for f in e["folders"]] or [_Folder(None, "")]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if partition.folder is None:
            return
        fs, base = file_system(self.path)
        for e in sorted(fs.get_file_info(FileSelector(f"{base}/{partition.folder}")), key=lambda e: e.base_name):
            with fs.open_input_stream(e.path) as f:
                yield (unquote(e.base_name.removesuffix(partition.suffix)), f.read().decode())


class Documents(DataSource):
    """Format "documents": rows (document, text); consecutive rows of a document are written one after another.

    Options: suffix of file names, header and footer of every document. Reading
    gives the committed documents whole.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "document string, text string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        _expect(schema)
        return _BatchWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        _expect(schema)
        return _StreamWriter(self.options, overwrite)


def _expect(schema) -> None:
    if [f.name for f in schema.fields] != ["document", "text"]:
        raise ValueError("rows to write have the columns document and text")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Documents)


def write_documents(rows: DataFrame, path: str, *, document: str, order: list[str], text: str, mode: str = "append", **options: str) -> None:
    """Write each document's `text` rows in their order: documents are dealt out by name and sorted, never gathered.

    Either all of the write becomes visible or nothing. Rows without a name are
    an error; null texts are empty. mode "overwrite" replaces what was committed.
    """
    register(rows.sparkSession)
    named = rows.select(F.col(document).cast("string").alias("document"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(order)))
    sorted_rows = named.repartition("document").sortWithinPartitions("document", *(f"__{i}" for i in range(len(order))))
    sorted_rows.select("document", "text").write.format("documents").options(**options).mode(mode).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """document, text of what has been committed."""
    register(spark)
    return spark.read.format("documents").load(path)


GPX_HEADER = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'
GPX_FOOTER = "</trkseg></trk></gpx>"


def gpx_point(at: Column, lat: Column, lon: Column, ele: Column) -> Column:
    """A point of a GPX document; a null elevation is left out."""
    from ..functions.dates import rfc3339

    height = F.when(ele.isNull(), "").otherwise(F.concat(F.lit("<ele>"), F.format_string("%.2f", ele), F.lit("</ele>")))
    return F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', lat, lon), height, F.lit("<time>"), rfc3339(at), F.lit("</time></trkpt>"))


def write_tracks(points: DataFrame, path: str, *, key: str, mode: str = "append") -> None:
    """A GPX document for each key, streamed from sorted points (at, lat, lon, ele); the same points give the same bytes."""
    line = gpx_point(F.col("at"), F.col("lat"), F.col("lon"), F.col("ele"))
    rows = points.select(F.col(key).alias("__key"), "at", line.alias("__line"))
    write_documents(rows, path, document="__key", order=["at", "__line"], text="__line", mode=mode, suffix=".gpx", header=GPX_HEADER, footer=GPX_FOOTER)


def write_presets(presets: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Writes each preset (name, body) as a document of its own; gives those whose name may not be used, with their problem. All are written or none."""
    from ..functions.text import name_problem

    rows = presets.withColumn("problem", name_problem(F.col("name")))
    good = rows.where("problem is null").select(F.trim("name").alias("name"), "body")
    write_documents(good, path, document="name", order=[], text="body", mode=mode, suffix=".json")
    return rows.where("problem is not null").select("name", "problem")
