"""Continuous media ingestion: a stream over the media folders that copies new files into the
archive and keeps a ledger of them.

The ledger is the table ``media_mirror`` of the store. A batch appends its rows as a folder
of its own, so it costs what it holds; the commit carries the stream's query id and batch
number, so a batch that is offered again after a failure changes nothing, and a new
checkpoint, which is a new query, starts over and loses nothing. A file that is read again
that way stands in the ledger twice until ``ledger`` or a compaction takes its last row.
``once`` takes what is there and ends (the snapshot pass); otherwise the stream goes on."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators import merge
from parley.sources.files import copy_one
from parley.sources.store import CommitConflict, Files, Store
from parley.sources.text import media_files

FILE = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "media_mirror"
#: Folders of the ledger after which it is rewritten as one.
MOST_PARTS = 32


def mirrored(files: DataFrame, media_root: str, archive_root: str, now: Column) -> DataFrame:
    """Ledger rows of a binaryFile read: source and archive path, size, hash and times."""
    rows = media_files(files)
    rest = F.substring_index("source_path", f"{media_root.rstrip('/')}/", -1)
    return rows.withColumn("archive_path", F.concat(F.lit(archive_root.rstrip("/") + "/"), rest)).withColumn("mirrored_at", now)


def copied(rows: DataFrame) -> DataFrame:
    """Copy the files of ledger rows in tasks; rows of files that are gone by then are left out.

    A task that runs again copies again, over its own copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column("source_path").to_pylist(), batch.column("archive_path").to_pylist())
            yield batch.filter(pa.array([copy_one(a, b) is not None for a, b in places], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each source path."""
    return merge.last_wins(rows, ["source_path"], ["source_modified_ts", "mirrored_at"])


def ledger(store: Store) -> DataFrame | None:
    """Every mirrored file once, None before the first."""
    have = store.open().get(LEDGER)
    return None if have is None else latest(have)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def files_of(spark: SparkSession, media_root: str) -> DataFrame:
    """A stream of all files below the root."""
    files = None
    # Spark's listing skips folders whose names start with a dot, so the statuses have a stream of their own
    for folder in (media_root, f"{media_root.rstrip('/')}/.Statuses"):
        if _exists(spark, folder):
            more = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(folder)
            files = more if files is None else files.unionByName(more)
    if files is None:
        raise ValueError(f"no folder {media_root}")
    return files


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity Spark gives a query with its checkpoint."""
    return json.loads(Files(spark, checkpoint.rstrip("/")).read("metadata"))["id"]


def watch(spark: SparkSession, store: Store, media_root: str, archive_root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream; read the result with ``ledger``. Both roots must be where all executors see them."""

    def add(batch: DataFrame, number: int) -> None:
        key = f"media_batch:{query_id(spark, checkpoint)}"
        if int(store.state().get(key, -1)) >= number:
            return  # committed before a failure; the stream offers it again
        rows = copied(mirrored(batch, media_root, archive_root, F.current_timestamp()))
        store.append(LEDGER, rows, {key: str(number)})
        if store.parts(LEDGER) > MOST_PARTS:
            with suppress(CommitConflict):  # another stream added to it: the next batch tries again
                store.compact(LEDGER, latest)

    writer = files_of(spark, media_root).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
