"""Files of a run, all or none: a sink that commits, and a manifest to read by.

Tasks write below a draft folder.  Only when all of them are done, the files of
each run are moved to their place as one folder and the run's manifest after
them; a job that fails leaves nothing, as tasks that still run then find no
draft folder to write to.  A run that is exported again replaces
its files.  Who reads goes by the manifest: a run without one is not there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from inkveil.plans.layout import dealt, with_small_batches
from inkveil.sources.files import TEXT_SUFFIXES, decode_text

MANIFEST = "run_id string, output string, size bigint"


@dataclass
class Written(WriterCommitMessage):
    """The runs of which a task has written files."""

    runs: list[str]


class RunFilesWriter(DataSourceArrowWriter):
    """Writes ``(run_id, output, markdown)`` as ``files/<run_id>/<output>`` below a folder."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        store, base = fs.FileSystem.from_uri(self.folder)
        return store, base, f"{base}/_drafts/{self.job}"

    def begin(self) -> RunFilesWriter:
        """The draft folder is made once, before the tasks, and by none of them."""
        store, _, draft = self._store()
        for kind in ("files", "manifest"):
            store.create_dir(f"{draft}/{kind}", recursive=True)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, draft = self._store()
        listed: dict[str, list[dict]] = {}
        for batch in iterator:
            for run, output, markdown in zip(*((v.as_py() for v in batch.column(c)) for c in ("run_id", "output", "markdown")), strict=True):
                if any(p is None or p in ("", ".", "..") or "/" in p for p in (run, output)):
                    raise ValueError(f"Unsafe output path {[run, output]}")
                if run not in listed:
                    store.create_dir(f"{draft}/files/{run}", recursive=False)  # fails once the job is aborted
                    listed[run] = []
                raw = (markdown or "").encode()
                with store.open_output_stream(f"{draft}/files/{run}/{output}") as stream:
                    stream.write(raw)
                listed[run].append({"run_id": run, "output": output, "size": len(raw)})
        part = TaskContext.get().partitionId()
        for run, lines in listed.items():
            store.create_dir(f"{draft}/manifest/{run}", recursive=False)
            with store.open_output_stream(f"{draft}/manifest/{run}/{part}.json") as stream:
                stream.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        return Written(list(listed))

    def commit(self, messages: list[Written | None]) -> None:
        """One move of a folder for the files of each run, and one for its manifest; none for a file."""
        store, base, draft = self._store()
        for run in sorted({run for m in messages if m for run in m.runs}):
            for kind in ("manifest", "files"):  # first of all the run is no longer listed
                if store.get_file_info(f"{base}/{kind}/{run}").type == fs.FileType.Directory:
                    store.delete_dir(f"{base}/{kind}/{run}")
            for kind in ("files", "manifest"):
                store.create_dir(f"{base}/{kind}", recursive=True)
                store.move(f"{draft}/{kind}/{run}", f"{base}/{kind}/{run}")
        self._clear(store, draft)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, draft = self._store()
        self._clear(store, draft)

    @staticmethod
    def _clear(store: fs.FileSystem, draft: str) -> None:
        for pause in (0.1, 0.3, 1.0, 3.0, None):
            try:
                if store.get_file_info(draft).type == fs.FileType.Directory:
                    store.delete_dir(draft)
                return
            except OSError:  # a task that is being ended wrote in between
                if pause is None:
                    raise
                time.sleep(pause)


class RunFiles(DataSource):
    """``df.write.format("run_files").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def writer(self, schema: StructType, overwrite: bool) -> RunFilesWriter:
        return RunFilesWriter(self.options["path"]).begin()


def export_runs(outputs: DataFrame, folder: str) -> None:
    """Write one UTF-8 file per output of ``(run_id, output, markdown)``, of all runs or of none.

    ``folder`` is a URI every executor and the driver can reach.  Rows without
    an output (files that failed) are left out; names that are no plain file
    names fail the job.  Each run among the rows is replaced as a whole.
    """
    spark = outputs.sparkSession
    spark.dataSource.register(RunFiles)
    rows = outputs.filter(F.col("output") != "").select(F.col("run_id").cast("string").alias("run_id"), "output", "markdown")
    with_small_batches(rows).write.format("run_files").mode("append").save(folder)


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """``(run_id, output, size)`` of all exported files, by the manifests."""
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest/*")


def exported_bundle(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """``(output, size)`` of one run's files, sorted by name."""
    return exported(spark, folder).filter(F.col("run_id") == F.lit(run_id)).select("output", "size").orderBy("output")


_TEXTS = pa.schema([("run_id", pa.string()), ("output", pa.string()), ("content", pa.binary())])
MOST_BYTES = 8 << 20


def exported_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(run_id, output, text)`` of the text and Markdown files that the manifests list.

    The lines of the manifests are dealt to the tasks, which open the files one
    by one: no folder is listed, and a task holds the files of a few megabytes.
    A listed file that is gone, or of another kind, has a NULL text.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)

        def content(run_id: str, output: str, size: int) -> bytes | None:
            if size == 0:
                return b""
            if not output.lower().endswith(TEXT_SUFFIXES):
                return None
            try:
                with store.open_input_stream(f"{base}/files/{run_id}/{output}", compression=None) as stream:
                    return stream.read()
            except FileNotFoundError:
                return None

        for part in parts:
            rows, held = [], 0
            for run_id, output, size in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows.append((run_id, output, content(run_id, output, size)))
                held += len(rows[-1][2] or b"")
                if held > MOST_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TEXTS, strict=True)], schema=_TEXTS)

    listed = with_small_batches(dealt(exported(spark, folder), "run_id", "output"))
    found = listed.mapInArrow(run, "run_id string, output string, content binary")
    return found.select("run_id", "output", decode_text(F.col("content")).alias("text"))
