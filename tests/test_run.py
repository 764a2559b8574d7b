"""Whole runs over a stored archive: all extractors, counts, late rows, and runs that follow a source."""

import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import extract as ex
from parley.operators.counts import Counts
from parley.plans.run import follow, run, summary
from parley.sources.sqlite import read_source
from parley.sources.store import CommitConflict, Store
from parley.streaming.media import ledger
from tests.test_extract import ADA, TABLES, keep, ts

MOVING = {"identities": "last_seen_ts", "identity_links": "last_observed_ts", "identity_display_names": "observed_at", "chats": "last_seen_ts", "newsletter_metadata": "observed_at"}


def content(store, but=()):
    """Rows of every table, without the columns that tell when something was last seen."""
    return {n: sorted(map(tuple, t.select(*(c for c in t.columns if c != MOVING.get(n))).collect()), key=repr) for n, t in store.open().items() if n not in but}


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "source.db")
    kinds = {"long": "INTEGER", "string": "TEXT", "double": "REAL", "binary": "BLOB"}
    with sqlite3.connect(path) as db:
        for name, (ddl, rows) in TABLES.items():
            columns = [(d.split()[0], kinds[d.split()[1]]) for d in ddl.split(", ")]
            first = " PRIMARY KEY" if columns[0][0] == "_id" else ""
            db.execute(f"CREATE TABLE {name} ({', '.join(c + ' ' + k + (first if i == 0 else '') for i, (c, k) in enumerate(columns))})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
    return path


@pytest.fixture(scope="module")
def archive(spark, database, tmp_path_factory):
    """Two runs of all extractors with a backup and media; the store, and what it held after the first."""
    root = tmp_path_factory.mktemp("archive")
    photos = root / "Media" / "WhatsApp Images"
    photos.mkdir(parents=True)
    (photos / "x.jpg").write_bytes(b"x")
    backup = ex.Source(spark, {"status": spark.createDataFrame([(1, "u", ADA, 0, 1000)], "row_id long, uuid string, sender_user_jid string, type long, timestamp long")})
    store = Store(spark, str(root / "a"))
    go = lambda day: run(store, read_source(spark, database), datetime(2025, 1, day), backup, media_root=str(root / "Media"), archive_root=str(root / "mirror"))
    go(1)
    first, at = content(store), store.version()
    go(2)
    return store, first, at


def test_second_run_changes_nothing(archive):
    store, first, _ = archive
    assert content(store) == first and len(first) > 40
    assert not store.files.names("staging")
    copy = ledger(store).collect()
    assert len(copy) == 1 and open(copy[0].archive_path, "rb").read() == b"x"
    assert store.state()["last_run_ts"].startswith("2025-01-02") and store.state()["last_message_rowid"] == "12"


def test_a_stored_run_is_the_plain_extraction(spark, archive):
    _, first, _ = archive
    source = ex.Source(spark, keep({name: spark.createDataFrame(rows, ddl) for name, (ddl, rows) in TABLES.items()}))
    plain = ex.extract_all(source, {}, ts("2025-01-01"))
    for name, t in plain.items():
        if name not in ("status_archive", "status_archive_media"):  # the run has a backup
            assert sorted(map(tuple, t.select(*(c for c in t.columns if c != MOVING.get(name))).collect()), key=repr) == first[name], name


def test_counts(archive):
    store, first, at = archive
    lines = {r.name: r for r in summary(store, at - 1).collect()}
    m = lines["messages"]
    assert (m.read, m.attempts, m.inserts, m.skipped) == (12, 7, 6, 5) and m.note == "no chat: 1; no key: 1; no time: 1; no type: 1; skipped type: 1"
    got = {n: (r.read, r.attempts, r.inserts) for n, r in lines.items()}
    assert got["identities"] == (7, 6, 6) and got["chats"] == (5, 4, 4) and got["group_members"] == (2, 2, 2)
    assert got["reactions"] == (2, 1, 1) and lines["reactions"].note == "no message: 1"
    assert got["edits"] == (2, 1, 1) and lines["edits"].note == "no time: 1" and got["calls"] == (3, 2, 1)
    assert got["system_events"] == (2, 2, 2) and lines["system_events"].note == "without chat: 1"
    assert got["poll_votes"][:2] == (2, 2) and got["status_archive"][:2] == (2, 1) and lines["status_archive"].rows == 2
    assert got["received_statuses"][:2] == (1, 1) and got["message_media"] == (None, None, 2)
    assert set(lines) >= {"polls", "status_posts", "newsletter", "transcriptions", "vcards", "bot_messages", "templates", "communities"}
    # the second run reads everything but messages again and adds nothing
    again = {r.name: r for r in summary(store).collect()}
    assert again["messages"].read == 0 and again["reactions"].attempts == 1
    assert all(r.inserts == 0 for n, r in again.items() if r.inserts is not None), [r for r in again.values() if r.inserts]


def test_counts_whichever_job_ends_first(spark):
    """A job whose rows meet an empty table is cut short: the counts are not lost with it."""
    source = ex.Source(spark, {n: spark.createDataFrame(TABLES[n][1], TABLES[n][0]) for n in ("jid", "chat", "message")}, Counts())
    out = ex.messages(source, {}, ts("2025-01-01"))
    counts = Counts()
    some = counts.rows("some", spark.range(10), {"odd": F.col("id") % 2 == 1})
    for rows in (out["message_media"], out["messages"], some.join(spark.createDataFrame([], "id long"), "id"), some):
        rows.write.format("noop").mode("overwrite").save()
    skipped = {"no chat": 1, "no key": 1, "no time": 1, "no type": 1, "skipped type": 1}
    assert counts.values() == {"some": {"read": 10, "attempts": 5, "orphans": 0, "skipped": {"odd": 5}}}
    assert source.counts.values() == {"messages": {"read": 12, "attempts": 7, "orphans": 0, "skipped": skipped}}


def test_every_source_table_is_read_once(spark, tmp_path):
    opened = []

    class Watched(ex.Source):
        def _table(self, name, columns):
            opened.append(name)
            return super()._table(name, columns)

    source = Watched(spark, {n: spark.createDataFrame(rows, ddl) for n, (ddl, rows) in TABLES.items()})
    copy = ex.staged(source, str(tmp_path / "s"))
    assert sorted(opened) == sorted(set(opened)) and set(copy.tables) == set(TABLES)
    before = list(opened)
    ex.extract_all(copy, {}, ts("2025-01-01"))
    assert opened == before
    assert set(copy.tables["message_media"].columns) == {"message_row_id", "file_path", "mime_type"}


def test_late_extension_rows(spark, tmp_path):
    tables = {n: spark.createDataFrame(rows, ddl) for n, (ddl, rows) in TABLES.items()}
    store = Store(spark, str(tmp_path / "a"))
    some = [ex.messages]
    run(store, ex.Source(spark, tables), datetime(2025, 1, 1), extractors=some)
    late = tables | {
        "message_media": spark.createDataFrame([(2, "Media/x.jpg", "image/png"), (4, "Media/late.jpg", "image/jpeg"), (10, "Media/s.jpg", "image/jpeg")], TABLES["message_media"][0]),
        "message_revoked": spark.createDataFrame([(3, "z", 1, 0), (9, "y", None, 5000)], TABLES["message_revoked"][0]),
        "message_mentions": spark.createDataFrame([(3, 1, "Ada"), (3, 2, "Bo"), (3, 3, "Lid"), (4, 1, "Ada")], TABLES["message_mentions"][0]),
        "message_quoted": spark.createDataFrame([], TABLES["message_quoted"][0]),
    }
    messages = store.open()["messages"].count()
    run(store, ex.Source(spark, late), datetime(2025, 1, 2), extractors=some, look_back=0)
    assert store.open()["message_media"].count() == 2 and store.open()["message_revoked"].count() == 1  # without looking back they are lost
    run(store, ex.Source(spark, late), datetime(2025, 1, 3), extractors=some, look_back=9)
    got = {r.message_id: r.mime for r in store.open()["message_media"].collect()}
    assert got == {f"{ADA}:1:b": "image/jpeg", "5@g.us:0:d": "image/jpeg", "status@broadcast:1:s": "image/jpeg"}  # row 2 lies before the bound
    run(store, ex.Source(spark, late), datetime(2025, 1, 3), extractors=some, look_back=None)
    got = {r.message_id: r.mime for r in store.open()["message_media"].collect()}
    assert got[f"{ADA}:1:b"] == "image/png" and len(got) == 3
    assert {r.message_id for r in store.open()["message_revoked"].collect()} == {"5@g.us:0:c", f"{ADA}:0:a"}
    assert sorted((r.message_id, r.display_name) for r in store.open()["message_mentions"].collect()) == [("5@g.us:0:c", "Ada"), ("5@g.us:0:c", "Bo"), ("5@g.us:0:c", "Lid"), ("5@g.us:0:d", "Ada")]
    assert store.open()["message_quoted"].count() == 1 and store.open()["messages"].count() == messages  # what is gone from the source stays
    state = content(store)
    run(store, ex.Source(spark, late), datetime(2025, 1, 4), extractors=some, look_back=None)
    assert content(store) == state


def test_new_rows_are_added_and_replacing_ones_rewrite(spark, tmp_path, monkeypatch):
    ddl, rows = TABLES["message"]
    tables = {n: spark.createDataFrame(r, d) for n, (d, r) in TABLES.items()}
    upto = lambda n, more=(): tables | {"message": spark.createDataFrame([r for r in rows if r[0] <= n] + list(more), ddl)}
    some = [ex.messages, ex.system_events]
    store, whole = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    go = lambda day, t, **kw: run(store, ex.Source(spark, t), datetime(2025, 1, day), extractors=some, **kw)
    go(1, upto(3))
    assert store.parts("messages") == 1 and store.rows()["messages"] == 3
    go(2, upto(4))  # one new message
    assert store.parts("messages") == 2 and store.parts("message_media") == 1 and store.rows()["messages"] == 4
    before = store._commit(store.version())["tables"]
    go(3, upto(4))  # nothing new: the tables of messages are not touched
    after = store._commit(store.version())["tables"]
    assert {n for n in before if before[n] != after[n]} == {"system_events"}
    go(4, tables)  # row 9 sends the message of row 1 again
    assert store.parts("messages") == 1
    run(whole, ex.Source(spark, tables), datetime(2025, 1, 4), extractors=some)
    assert content(store) == content(whole) and store.rows()["messages"] == store.open()["messages"].count()
    import parley.plans.run as plan

    monkeypatch.setattr(plan, "MOST_PARTS", 1)
    go(5, tables | {"message": spark.createDataFrame([*rows, (13, 1, 0, "z", None, 9000, 0, 0, "last", 0)], ddl)})
    assert store.parts("messages") == 1 and store.rows()["messages"] == store.open()["messages"].count() == 7
    assert summary(store, store.versions()[-2]).where("name = 'messages'").first().inserts == 1


def test_following_a_file_equals_one_run(spark, tmp_path):
    path = str(tmp_path / "s.db")
    some = [ex.identities, ex.chats, ex.messages, ex.reactions]

    def insert(ids):
        with sqlite3.connect(path) as db:
            db.executemany("INSERT INTO message VALUES (?, 1, 0, ?, ?, 0)", [(i, f"k{i}", 1000 * i) for i in ids])
            db.executemany("INSERT INTO message_media VALUES (?, ?)", [(i, f"f{i}") for i in ids if i % 2])

    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE jid (_id INTEGER PRIMARY KEY, raw_string TEXT)")
        db.execute("INSERT INTO jid VALUES (1, ?)", (ADA,))
        db.execute("CREATE TABLE chat (_id INTEGER PRIMARY KEY, jid_row_id INTEGER)")
        db.execute("INSERT INTO chat VALUES (1, 1)")
        db.execute("CREATE TABLE message (_id INTEGER PRIMARY KEY, chat_row_id INTEGER, from_me INTEGER, key_id TEXT, timestamp INTEGER, message_type INTEGER)")
        db.execute("CREATE TABLE message_media (message_row_id INTEGER PRIMARY KEY, file_path TEXT)")
    store, whole = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    go = lambda: follow(spark, store, path, str(tmp_path / "cp"), extractors=some).awaitTermination()
    insert([1, 2, 3])
    go()
    assert store.version() == 1 and store.open()["messages"].count() == 3
    go()
    assert store.version() == 1  # nothing new, no run
    insert([4, 10**9])
    go()
    assert store.version() == 2 and store.state()["last_message_rowid"] == str(10**9)
    run(whole, read_source(spark, path), extractors=some)
    drop = {"identities", "chats_history", "chats"}  # times of the runs differ
    assert content(store, drop) == content(whole, drop) and len(content(store, drop)["messages"]) == 5


def test_a_run_beside_another_writer_fails_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    tables = {n: spark.createDataFrame(rows, ddl) for n, (ddl, rows) in TABLES.items()}

    class Slow(ex.Source):
        def _table(self, name, columns):
            if name == "message" and store.version() == 0:
                Store(spark, store.root).commit({"messages": spark.range(1)}, {})
            return super()._table(name, columns)

    with pytest.raises(CommitConflict, match="messages"):
        run(store, Slow(spark, tables), extractors=[ex.messages])
    assert store.version() == 1 and store.open()["messages"].columns == ["id"] and store.open()["messages"].select(F.max("id")).first()[0] == 0
    assert not store.files.names("staging")
