"""The stored archive over two runs, the SQLite source, sinks and the media stream."""

import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import extract as ex
from parley.operators import merge
from parley.plans.run import follow, run, summary
from parley.sources import sinks, sqlite
from parley.sources.sqlite import read_source
from parley.sources.store import CommitConflict, Store
from parley.streaming import media
from parley.streaming.media import ledger, watch

P = "@s.whatsapp.net"


def test_versions_are_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "archive"))
    assert store.open() == {} and store.version() == 0 and store.state() == {}
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert store.commit({"t": one, "u": one}, {"x": "1"}) == 1
    bad = one.withColumn("v", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        store.commit({"t": bad}, {"x": "2"})
    assert store.version() == 1 and store.state()["x"] == "1" and store.open()["t"].collect() == one.collect()
    store.commit({"t": store.open()["t"].unionByName(one)}, {"y": "3"})
    assert {n: t.count() for n, t in store.open().items()} == {"t": 2, "u": 1} and store.open(1)["t"].count() == 1
    store.set_state(x="9")
    assert store.state()["x"] == "9" and store.state()["y"] == "3"


def test_a_losing_writer_leaves_the_winner_alone(spark, tmp_path):
    row = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    one, two = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "a"))
    one.commit({"t": row("start"), "u": row("u")}, {"x": "1"})
    base = two.version()
    one.commit({"t": row("winner")}, {"x": "2"})
    with pytest.raises(CommitConflict, match="t, x"):
        two.commit({"t": row("loser")}, {"x": "3"}, base)
    assert two.open()["t"].first().v == "winner" and two.version() == 2 and two.state()["x"] == "2"
    # other tables and keys go behind what was committed meanwhile
    assert two.commit({"u": row("later")}, {"y": "4"}, base) == 3
    assert {n: t.first().v for n, t in one.open().items()} == {"t": "winner", "u": "later"} and one.state()["x"] == "2"
    # nothing of the loser is left
    assert len(list((tmp_path / "a" / "data").iterdir())) == 3


def test_a_number_is_published_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    assert store.files.publish("commits/1.json", "{}") and not store.files.publish("commits/1.json", "[]")
    assert store.files.read("commits/1.json") == "{}" and [n for n in store.files.names("commits") if not n.startswith(".")] == ["1.json"]

    class Elsewhere:  # a file system that is not local publishes by a rename that replaces nothing
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "other"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    store.files.fs = Elsewhere(store.files.fs)
    assert store.files.publish("commits/2.json", "{}") and not store.files.publish("commits/2.json", "[]") and store.files.read("commits/2.json") == "{}"


def test_archives_move_and_shed_old_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    for k in range(4):
        store.commit({"t": spark.range(k + 1)}, {})
    store.append("t", spark.range(10), {})
    assert store.open()["t"].count() == 14 and store.parts("t") == 2 and store.rows()["t"] == 14
    assert store.vacuum(keep=2) == [] and store.versions() == [4, 5]  # younger than the grace
    assert len(store.vacuum(keep=2, grace=-1)) == 3 and store.open(4)["t"].count() == 4
    store.compact("t", lambda t: t.distinct())
    assert store.parts("t") == 1 and store.open()["t"].count() == 10
    (tmp_path / "a").rename(tmp_path / "b")
    assert Store(spark, str(tmp_path / "b")).open()["t"].count() == 10


def test_migrations_bring_old_versions_up(spark, tmp_path):
    old = Store(spark, str(tmp_path / "a"), {1: lambda t: t})
    old.commit({"contacts": spark.createDataFrame([("1", "A")], "phone_jid string, name string")}, {})
    assert old.schema_version() == 1
    new = Store(spark, str(tmp_path / "a"))
    assert new.open()["contacts"].columns == ["phone_jid", "name", "source"]
    new.commit(new.open(), {})
    assert new.schema_version() == 2 and new.open()["contacts"].first().source == "address_book"


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "msgstore.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE jid (_id INTEGER PRIMARY KEY, user TEXT, server TEXT, raw_string TEXT)")
        db.executemany("INSERT INTO jid VALUES (?, ?, ?, ?)", [(1, "41790000001", "s.whatsapp.net", "41790000001" + P), (2, "5", "g.us", "5@g.us")])
        db.execute("CREATE TABLE chat (_id INTEGER PRIMARY KEY, jid_row_id INTEGER, subject TEXT)")
        db.executemany("INSERT INTO chat VALUES (?, ?, ?)", [(1, 1, None), (2, 2, "Team")])
        db.execute("CREATE TABLE message (_id INTEGER PRIMARY KEY, chat_row_id INTEGER, from_me INTEGER, key_id TEXT, sender_jid_row_id INTEGER, timestamp INTEGER, message_type INTEGER, text_data TEXT, blob BLOB, score REAL)")
        db.executemany("INSERT INTO message VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", [(1, 1, 0, "a", None, 1000, 0, "hello", b"\x00", 1.5), (2, 2, 1, "b", 1, 2000, 0, "ünï", None, None)])
        db.execute("CREATE TABLE empty (_id INTEGER PRIMARY KEY)")
    return path


def test_sqlite_source(spark, database):
    source = read_source(spark, database)
    assert set(source.tables) == {"jid", "chat", "message", "empty"} and source.tables["empty"].count() == 0
    m = source.tables["message"]
    assert dict(m.dtypes)["blob"] == "binary" and dict(m.dtypes)["score"] == "double"
    assert [(r._id, r.text_data, r.score) for r in m.orderBy("_id").collect()] == [(1, "hello", 1.5), (2, "ünï", None)]
    assert [r.key_id for r in ex.new_messages(source).orderBy("key_id").collect()] == ["a", "b"]


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "odd.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sparse (_id INTEGER PRIMARY KEY, n INTEGER, t TEXT)")
        db.executemany("INSERT INTO sparse VALUES (?, ?, ?)", [(i, k, f"t{k}") for k, i in enumerate([-5, 1, 2, 10**9, 10**15, 2**62])])
        db.execute("INSERT INTO sparse VALUES (77, 'no number', x'ff41')")
        db.execute("CREATE TABLE keyed (a INTEGER, b TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?, ?)", [(1, "x"), (1, "y"), (10**12, "z")])
        db.execute("CREATE TABLE named (name TEXT PRIMARY KEY, v REAL) WITHOUT ROWID")
        db.execute("INSERT INTO named VALUES ('a', 1.5)")
        db.execute("CREATE TABLE plain (v ANY)")
        db.executemany("INSERT INTO plain VALUES (?)", [(1,), ("1",), (None,)])
    return path


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_sqlite_pushes_filters_and_columns(spark, odd_tables):
    t = sqlite.load(spark, odd_tables, "sparse")
    assert t.rdd.getNumPartitions() <= 7 and t.count() == 7
    for where, ids in {"_id > 2": [77, 10**9, 10**15, 2**62], "_id >= 2 and _id < 1000000000": [2, 77], "_id = 1": [1], "_id in (1, 5, 77)": [1, 77], "_id <= -5": [-5], "_id is null": [], "_id > 9223372036854775807": [], "_id > 5 and _id < 5": []}.items():
        df = t.where(where)
        assert sorted(r._id for r in df.collect()) == ids, where
        if "null" not in where:
            assert "PushedFilters: [" in plan_of(df) and "Condition" not in plan_of(df), where
    df = t.where("_id > 2")
    assert "GreaterThan(_id,2)" in plan_of(df) or "_id > 2" in plan_of(df)
    assert df.rdd.getNumPartitions() == 4  # one for each id that is far from the next
    # other columns: any type can be in them, so Spark looks again
    assert [r._id for r in t.where("n > 3").orderBy("_id").collect()] == [10**15, 2**62] and [r._id for r in t.where("t = 't1'").collect()] == [1]
    assert {r._id: (r.n, r.t) for r in t.where("_id = 77").collect()} == {77: (None, "\ufffdA")} and t.where("n is null").count() == 1
    few = sqlite.load(spark, odd_tables, "sparse", ["t"])
    assert few.columns == ["t"] and few.count() == 7


def test_sqlite_reads_only_what_is_asked_for(spark, odd_tables, monkeypatch):
    """The statements a reader sends: the key range and the columns."""
    with sqlite.connect(odd_tables) as db:
        reader = sqlite.SqliteReader(odd_tables, sqlite.Table.of(db, "sparse"), ["t"])
    left = list(reader.pushFilters([sqlite.GreaterThan(("_id",), 2), sqlite.EqualTo(("t",), "t3"), sqlite.IsNotNull(("_id",))]))
    assert left == [sqlite.EqualTo(("t",), "t3")]
    assert [(p.low, p.high) for p in reader.partitions()][0] == (77, 77 + sqlite.ROWS - 1)
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[{"t": "\ufffdA"}], [{"t": "t3"}]]
    monkeypatch.setattr(sqlite, "MOST_RANGES", 2)
    assert len(reader.partitions()) == 2  # neighbours are joined


def test_sqlite_tables_without_row_ids(spark, odd_tables):
    keyed = sqlite.load(spark, odd_tables, "keyed")
    assert sorted(map(tuple, keyed.collect())) == [(1, "x"), (1, "y"), (10**12, "z")] and keyed.rdd.getNumPartitions() == 2
    assert [r.b for r in keyed.where("a > 1").collect()] == ["z"]
    assert sqlite.load(spark, odd_tables, "named").collect()[0].v == 1.5
    assert sorted(str(r.v) for r in sqlite.load(spark, odd_tables, "plain").collect()) == ["1", "1", "None"]
    with pytest.raises(Exception, match="no numeric key"):
        sqlite.follow(spark, odd_tables, "named").writeStream.format("noop").start().processAllAvailable()


def test_two_runs(spark, database, tmp_path, monkeypatch):
    monkeypatch.setattr(ex, "EXTRACTORS", [ex.identities, ex.chats, ex.messages])
    monkeypatch.setattr(ex, "EXTENSIONS", {})
    store = Store(spark, str(tmp_path / "archive"))
    source = read_source(spark, database, ["jid", "chat", "message"])
    assert run(store, source, datetime(2025, 1, 1)) == 1
    assert store.state()["last_message_rowid"] == "2" and store.state()["last_run_ts"].startswith("2025-01-01")
    with sqlite3.connect(database) as db:
        db.execute("INSERT INTO message VALUES (3, 2, 0, 'c', 1, 3000, 0, 'new', NULL, NULL)")
    source = read_source(spark, database, ["jid", "chat", "message"])  # a plan keeps the row ranges it saw first
    assert run(store, source, datetime(2025, 1, 2)) == 2
    rows = {r.key_id: r.text for r in store.open()["messages"].collect()}
    assert rows == {"a": "hello", "b": "ünï", "c": "new"}
    assert {str(r.first_seen_ts)[:10] for r in store.open()["identities"].collect()} == {"2025-01-01"}
    assert {r.name: r.rows for r in summary(store).collect()}["messages"] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü", None, datetime(2024, 1, 1, 0, 0, 1))], "a int, b string, c string, t timestamp")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": 1, "b": "ü", "c": None, "t": "2024-01-01T00:00:01+00:00"}
    assert sinks.table_rows(df).first().asDict() == {"a": "1", "b": "ü", "c": "", "t": "2024-01-01T00:00:01"}
    sinks.write_contact_starter(spark.createDataFrame([("41790000001" + P,)], "phone_jid string"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().asDict() == {"phone": "+41 79 000 00 01", "name": None}


def test_media_stream_keeps_each_file_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "Media"
    for name, data in {"WhatsApp Images/a.jpg": b"x", ".Statuses/b.jpg": b"y", "Other/c.jpg": b"z", "WhatsApp Images/d.tmp": b"t"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    store = Store(spark, str(tmp_path / "archive"))
    go = lambda cp="cp": watch(spark, store, str(root), str(tmp_path / "mirror"), str(tmp_path / cp)).awaitTermination()
    assert ledger(store) is None
    go()
    rows = {r.archive_path: (r.file_size, r.is_status) for r in ledger(store).collect()}
    mirror = tmp_path / "mirror"
    assert rows == {f"{mirror}/WhatsApp Images/a.jpg": (1, 0), f"{mirror}/.Statuses/b.jpg": (1, 1)}
    assert (mirror / ".Statuses" / "b.jpg").read_bytes() == b"y" and not (mirror / "Other").exists()
    version = store.version()
    go()
    assert store.version() == version  # nothing new, nothing written
    (root / "WhatsApp Images/e.jpg").write_bytes(b"ee")
    go()
    assert ledger(store).count() == 3 and store.parts(media.LEDGER) == 2  # the batch is a folder of its own
    # a new checkpoint is a new query: it reads all again, and the file added before it is there
    (root / "WhatsApp Images/f.jpg").write_bytes(b"fff")
    go("cp2")
    assert ledger(store).count() == 4 and store.rows()[media.LEDGER] == 7
    # a batch that is offered again after its commit changes nothing
    last = max((tmp_path / "cp2" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    version = store.version()
    go("cp2")
    assert store.version() == version and ledger(store).count() == 4
    monkeypatch.setattr(media, "MOST_PARTS", 2)
    (root / "WhatsApp Images/g.jpg").write_bytes(b"gggg")
    go("cp2")
    assert store.parts(media.LEDGER) == 1 and store.open()[media.LEDGER].count() == 5


def test_pinned_numbers_and_order(spark):
    cur = spark.createDataFrame([("1", "A", "address_book", "x"), ("2", "M", "manual", "x")], "phone_jid string, name string, source string, updated_at string")
    inc = spark.createDataFrame([("2", "Z", 1), ("3", "Second", 2), ("3", "First", 1)], "phone_jid string, name string, o int")
    state, log = merge.contact_changes(cur, inc, F.lit("now"), order=["o"])
    assert {(r.phone_jid, r.name, r.op) for r in log.collect()} == {("1", None, "remove"), ("3", "First", "set")}
    assert {(r.phone_jid, r.name) for r in state.collect()} == {("2", "M"), ("3", "First")}
    back = merge.restore_pins(state, spark.createDataFrame([("9", "Pinned"), (None, "x")], "phone_jid string, name string"), F.lit("now"))
    assert {r.phone_jid: r.name for r in merge.effective_contacts(back).collect()} == {"2": "M", "3": "First", "9": "Pinned"}
