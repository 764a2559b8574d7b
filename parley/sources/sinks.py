"""Sinks: JSON Lines, CSV, tables, and the folder export of a chat."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as fx
from parley.plans import digest
from parley.plans.names import Archive
from parley.plans.queries import export_media
from parley.sources.files import copy_one
from parley.sources.text import contact_starter


def with_iso_times(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text in UTC."""
    times = (T.TimestampType, T.TimestampNTZType)
    return df.select(*(fx.iso_utc(f.name).alias(f.name) if isinstance(f.dataType, times) else F.col(f.name) for f in df.schema))


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: a JSON object for each row, with nulls and non-ASCII text kept."""
    return with_iso_times(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def table_rows(df: DataFrame) -> DataFrame:
    """Every column as text for display: times cut to seconds, nulls empty."""
    times = (T.TimestampType, T.TimestampNTZType)
    show = lambda f: fx.trimmed_ts(f.name) if isinstance(f.dataType, times) else F.col(f.name).cast("string")
    return df.select(*(F.coalesce(show(f), F.lit("")).alias(f.name) for f in df.schema))


def write_contact_starter(phones: DataFrame, path: str) -> None:
    """A CSV with a header, to be filled with names and read back as pins."""
    contact_starter(phones).write.mode("overwrite").option("header", True).csv(path)


COPIED = "relative string, status string, bytes long"


def copy_media(files: DataFrame, media_root: str, target: str, partitions: int | None = None) -> DataFrame:
    """Copy files (path, relative) in tasks; (relative, status, bytes) with ``copied`` or ``missing``.

    A path that is not absolute lies below ``media_root``. A file that several rows name is
    copied once; a task that runs again writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, relative in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = path if path.startswith("/") or ":" in path.partition("/")[0] else f"{media_root.rstrip('/')}/{path}"
                done.append(copy_one(whole, f"{target.rstrip('/')}/{relative}"))
            status = ["missing" if n is None else "copied" for n in done]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(status, pa.string()), pa.array(done, pa.int64())], ["relative", "status", "bytes"])

    once = files.where("path is not null").groupBy("relative").agg(F.min("path").alias("path")).select("path", "relative")
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return once.repartition(n, "relative").mapInArrow(run, COPIED)


def export_chat(arch: Archive, chat: str, path: str, last: int = 999_999, media: bool = True, media_root: str | None = None) -> DataFrame | None:
    """A folder with the digest, its JSON Lines and the media files of a chat.

    With ``media_root`` the files are copied into ``media_files``; what became of each is
    written to ``media`` and returned. Without it ``media`` lists the files to copy."""
    lines = digest.markdown(arch, chat, last).orderBy("idx")
    lines.select("line").coalesce(1).write.mode("overwrite").text(f"{path}/digest.md")
    rows = digest.jsonl(arch, chat, last).orderBy("idx")
    rows.select("json").coalesce(1).write.mode("overwrite").text(f"{path}/digest.jsonl")
    if not media:
        return None
    files = export_media(arch, chat, last)
    if media_root is None:
        write_json_lines(files, f"{path}/media")
        return None
    # written first, so that looking at the result copies nothing again
    copy_media(files.select("path", "relative"), media_root, f"{path}/media_files").write.mode("overwrite").json(f"{path}/media")
    return lines.sparkSession.read.schema(COPIED).json(f"{path}/media")
