"""One extraction run over a stored archive, its summary, and runs that follow a source."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators import extract, merge
from parley.operators.counts import Counts
from parley.plans import contacts
from parley.plans.names import Archive
from parley.plans.queries import resolution_stats
from parley.sources import sqlite
from parley.sources.sidecars import Sidecars
from parley.sources.store import WRITERS, CommitConflict, Store
from parley.streaming import media

#: Row ids before the last stored one whose extension rows are read again.
LOOK_BACK = 100_000
#: Folders of a table after which it is rewritten as one.
MOST_PARTS = 32
#: The table whose rows an extractor counts, where it is not named like the extractor.
MAIN_TABLE = {"group_members": "chat_members", "newsletter": "newsletter_metadata", "transcriptions": "message_audio", "vcards": "message_vcards", "templates": "template_messages", "received_statuses": "status_archive"}
SUMMARY = "name string, read long, attempts long, inserts long, skipped long, rows long, note string"


def resolution_percent(arch: Archive) -> DataFrame:
    """total, resolved and the share of senders that contacts name, in percent (null without senders)."""
    share = F.round(100.0 * F.col("resolved") / F.nullif("total", F.lit(0)), 1)
    return resolution_stats(arch).withColumn("percent", share)


def additions(stored: Archive, deltas: dict[str, extract.Delta], folder: str) -> dict[str, DataFrame | None]:
    """Tables that need not be written anew, since none of their new rows replaces one: the
    rows to add, or None where there are none. The new rows are written to ``folder`` first."""

    def look(item: tuple[str, extract.Delta]) -> tuple[str, DataFrame | None, bool]:
        name, delta = item
        have = stored[name]
        same = [(F.col(f.name) if f.name in delta.rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.schema]
        delta.rows.select(same).write.parquet(f"{folder}/_new/{name}")
        rows = have.sparkSession.read.schema(have.schema).parquet(f"{folder}/_new/{name}")
        if rows.isEmpty():
            return name, None, True
        return name, rows, rows.select(delta.keys).join(have.select(delta.keys), delta.keys, "left_semi").isEmpty()

    with ThreadPoolExecutor(WRITERS) as pool:
        found = pool.map(look, [(name, d) for name, d in deltas.items() if name in stored])
        return {name: rows for name, rows, free in found if free}


def compact(store: Store, names: set[str]) -> None:
    """Rewrite tables that have come to lie in many folders, unless another writer is at them."""
    for name in names:
        if store.parts(name) > MOST_PARTS:
            with suppress(CommitConflict):
                store.compact(name)


def run(
    store: Store,
    source: extract.Source,
    at: datetime | None = None,
    backup: extract.Source | None = None,
    pins: DataFrame | None = None,
    look_back: int | None = LOOK_BACK,
    extractors: Sequence[extract.Extractor] | None = None,
    media_root: str | None = None,
    archive_root: str = "",
    checkpoint: str | None = None,
    sidecars: Sidecars | None = None,
) -> int:
    """Extract a source into the next version, then mirror new media; returns the version's number.

    Every source table is read once, into copies that go when the run ends. Messages are read
    beyond the row id that the last version stored, their extension rows from ``look_back``
    ids before it on; a table of theirs whose new rows replace nothing only gets these rows
    added. Names pinned by hand (``pins``, or those of ``sidecars``) are put back
    first, also into an archive that lost its contacts. All tables, counts and the state become visible together, or not at
    all; another writer that changed them meanwhile makes this run fail. Media are mirrored
    after that as a stream that ends; its checkpoint lies in the archive if none is named."""
    at = at or datetime.now(UTC).replace(tzinfo=None)
    base = store.version()
    stored, before = store.open(), store.rows()
    current = dict(stored)
    after = int(store.state().get("last_message_rowid", 0))
    run_ts = F.lit(at).cast("timestamp")
    if sidecars:
        pins = sidecars.pinned()
    if pins is not None:
        current["contacts"] = merge.restore_pins(contacts.table_of(store, "contacts", contacts.CONTACTS), pins, run_ts)
    counts, folder = Counts(), f"staging/{uuid.uuid4().hex}"
    try:
        copy = extract.staged(replace(source, counts=counts, deltas={}), f"{store.root}/{folder}", extractors)
        backup = replace(backup, counts=counts) if backup else None
        tables = extract.extract_all(copy, current, run_ts, after, backup, look_back, extractors)
        newest = copy.messages().agg(F.max("rowid")).first()[0]
        state = {"last_run_ts": at.isoformat(), "last_message_rowid": str(max(after, newest or 0))}
        tables = {name: t for name, t in tables.items() if t is not stored.get(name)}
        added = additions(stored, copy.deltas, f"{store.root}/{folder}")
        tables = {name: t for name, t in tables.items() if name not in added}
        added = {name: rows for name, rows in added.items() if rows is not None}
        number = store.commit(tables, state, base, lambda: {"counts": counts.values(), "before": before}, added)
        compact(store, set(added))
    finally:
        store.files.delete(folder)
    if media_root is not None:
        media.watch(store.spark, store, media_root, archive_root, checkpoint or f"{store.root}/media-checkpoint").awaitTermination()
    return number


def summary(store: Store, version: int | None = None) -> DataFrame:
    """What a run did, from the counts its commit noted: a row for each extractor (rows read,
    attempts, rows new to its table, rows skipped; reasons and orphans in the note), for each
    other table, for mirrored media since, and for the share of senders that contacts name.

    Attempts are rows offered to the table: several can share a key or be there already."""
    spark = store.spark
    version = next((v for v in reversed(store.versions()) if "counts" in store.note(v)), 0) if version is None else version
    note, rows = store.note(version), store.rows(version)
    lines, told = [], set()
    for name, c in note.get("counts", {}).items():
        table = MAIN_TABLE.get(name, name)
        told.add(table)
        why = [f"{r}: {n}" for r, n in sorted(c["skipped"].items())] + ([f"without chat: {c['orphans']}"] if c["orphans"] else [])
        inserts = rows[table] - note["before"].get(table, 0) if table in rows else None
        lines.append((name, c["read"], c["attempts"], inserts, sum(c["skipped"].values()), rows.get(table), "; ".join(why) or None))
    lines += [(name, None, None, n - note.get("before", {}).get(name, 0), None, n, None) for name, n in sorted(rows.items()) if name not in told]
    files = store.rows().get(media.LEDGER, 0) - rows.get(media.LEDGER, 0)
    if files:
        lines.append(("media snapshot", None, None, files, None, store.rows()[media.LEDGER], "new files mirrored"))
    arch = store.open(version) if version else {}
    if {"messages", "identity_links", "contacts"} <= set(arch):
        r = resolution_percent(arch).first()
        lines.append(("sender resolution", r.total, None, None, None, r.resolved, None if r.percent is None else f"{r.percent} %"))
    return spark.createDataFrame(lines, SUMMARY)


def follow(spark: SparkSession, store: Store, path: str, checkpoint: str, once: bool = True, **options: object) -> StreamingQuery:
    """Runs that follow a SQLite file: whenever its messages have grown, one run takes what is
    new. Spark's checkpoint keeps the row id reached; a batch offered again after a failure
    runs once more and changes nothing. ``options`` go to ``run``."""

    def extract_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            run(store, sqlite.read_source(spark, path), **options)

    grown = sqlite.follow(spark, path, "message", ["_id"]).writeStream.foreachBatch(extract_batch)
    grown = grown.option("checkpointLocation", checkpoint)
    return (grown.trigger(availableNow=True) if once else grown).start()
