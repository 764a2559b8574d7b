"""Scalar functions, merge policies, names and queries on small own fixtures."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators import merge
from parley.plans import names
from parley.plans import queries as q
from parley.sources.text import parse_vcards, read_pins

P = "@s.whatsapp.net"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize("raw,want", [("+41 79 123 45 67", "41791234567"), ("079 123 45 67", "41791234567"), ("0041791234567", "41791234567"), ("12", None), ("1234567890123456", None), ("12a4567", None), (None, None)])
def test_normalize_number(spark, raw, want):
    assert one(spark, raw, fx.normalize_number("x")) == want


@pytest.mark.parametrize("jid,want", [("41790000001" + P, "+41 79 000 00 01"), ("4930123456" + P, "+49 301 23456"), ("12125550100" + P, "+1 212 555 0100"), ("35312345678" + P, "+353 12 345 678"), ("79991234567" + P, "+7 9 991 234 567"), ("abc" + P, "+abc"), (None, "?")])
def test_pretty_phone(spark, jid, want):
    assert one(spark, jid, fx.pretty_phone("x")) == want


@pytest.mark.parametrize("jid,want", [("1@g.us", "group"), ("1" + P, "user"), ("1@lid", "lid"), ("status@broadcast", "broadcast"), ("", "unknown"), (None, "unknown"), ("x", "other")])
def test_kind(spark, jid, want):
    assert one(spark, jid, fx.jid_kind("x")) == want


def test_zero_time_is_unknown_and_labels(spark):
    assert one(spark, 0, fx.ms_to_ts("x"), "long") is None
    assert one(spark, 1500, fx.iso_utc(fx.ms_to_ts("x")), "long") == "1970-01-01T00:00:01.500000+00:00"
    assert one(spark, 42, fx.type_label("x"), "int") == "text"
    assert one(spark, 999, fx.type_label("x"), "int") == "unknown_999"
    assert one(spark, None, fx.system_kind("x"), "int") == "unknown_system"


def test_policies(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, first int")
    inc = spark.createDataFrame([(2, None, 9, 1), (3, "c", 3, 1), (3, "d", 4, 2)], "k int, v string, first int, o int")
    rows = lambda df: sorted((r.k, r.v, r.first) for r in df.select("k", "v", "first").collect())
    assert rows(merge.replace(cur, inc, ["k"], ["o"])) == [(1, "a", 1), (2, None, 9), (3, "d", 4)]
    assert rows(merge.upsert(cur, inc, ["k"], keep=["first"], order=["o"])) == [(1, "a", 1), (2, None, 2), (3, "d", 4)]
    assert rows(merge.insert_ignore(cur, inc.where("o = 1"), ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    once = merge.replace(cur, inc, ["k"], ["o"])
    assert rows(merge.replace(once, inc, ["k"], ["o"])) == rows(once)


def test_membership_and_contacts(spark):
    kind = "chat_jid string, member_jid string, rank int, joined_ts string"
    cur = spark.createDataFrame([("c", "a", 0, "t0"), ("c", "b", 0, "t0"), ("c", "n", None, "t0")], kind)
    inc = spark.createDataFrame([("c", "b", 1, "t1"), ("c", "d", 0, "t1"), ("c", "n", None, "t1")], kind)
    state, history = merge.membership_changes(cur, inc, F.lit("now"))
    assert {(r.member_jid, r.op) for r in history.collect()} == {("a", "leave"), ("b", "role_change"), ("d", "join")}
    assert {(r.member_jid, r.joined_ts) for r in state.collect()} == {("b", "t0"), ("d", "t1"), ("n", "t0")}
    c = spark.createDataFrame([("1", "A", "address_book", "x"), ("2", "M", "manual", "x")], "phone_jid string, name string, source string, updated_at string")
    s, h = merge.contact_changes(c, spark.createDataFrame([("2", "Z"), ("3", "N")], "phone_jid string, name string"), F.lit("now"))
    assert {(r.phone_jid, r.op) for r in h.collect()} == {("1", "remove"), ("3", "set")}
    assert {r.phone_jid: r.name for r in merge.effective_contacts(s).collect()} == {"2": "M", "3": "N"}


@pytest.fixture(scope="module")
def arch(spark):
    day = lambda n: datetime(2024, 1, n)
    msgs = [(f"41790000001{P}:{n % 2}:k{n}", n, "41790000001" + P, n % 2, day(n), f"text {n} Über", "text", f"k{n}", "41790000001" + P if n % 2 == 0 else None) for n in range(1, 6)]
    return {
        "messages": spark.createDataFrame(msgs, "id string, source_rowid long, chat_jid string, from_me int, ts timestamp, text string, type string, key_id string, sender_jid string"),
        "contacts": spark.createDataFrame([("41790000001" + P, "Ada", "manual"), ("41790000002" + P, "Ada", "manual")], "phone_jid string, name string, source string"),
        "identity_links": spark.createDataFrame([("7@lid", "41790000002" + P), ("8@lid", "41790000009" + P)], "lid_jid string, phone_jid string"),
        "identity_display_names": spark.createDataFrame([("9@lid", "+41 •• 7"), ("8@lid", "Shown")], "jid string, display_name string"),
        "chats": spark.createDataFrame([("41790000001" + P, "user", None), ("5@g.us", "group", "Team")], "jid string, kind string, subject string"),
        "newsletter_metadata": spark.createDataFrame([], "chat_jid string, name string"),
        "message_media": spark.createDataFrame([], "message_id string, file_path string, mirrored_path string, caption string, mime string"),
    }


def test_names(spark, arch):
    ids = ["41790000001" + P, "7@lid", "8@lid", "9@lid", "41790000003" + P, "5@g.us", "6@g.us", "x@newsletter", "status@broadcast"]
    got = {r.jid: r.name for r in names.resolved(arch, spark.createDataFrame([(i,) for i in ids], "jid string")).collect()}
    assert list(map(got.get, ids)) == ["Ada", "Ada", "Shown", "lid:9", "+41 79 000 00 03", "Team", "<group 6>", "<newsletter>", "<broadcast>"]


def test_queries(arch):
    chat = "41790000001" + P
    assert [q.chat_message_at(arch, chat, n)[-2:] for n in (1, 5, -1, -5)] == ["k1", "k5", "k5", "k1"]
    with pytest.raises(ValueError):
        q.chat_message_at(arch, chat, 0)
    with pytest.raises(LookupError):
        q.chat_message_at(arch, chat, 6)
    assert q.search_messages(arch, "ÜBER", limit=2).count() == 2
    assert q.timeline_for_member(arch, "Ada").count() == 2 and q.timeline_for_member(arch, "Nobody").count() == 0
    assert q.resolve_chat(arch, "team") == "5@g.us" and q.resolve_chat(arch, "Ada") == chat
    assert q.resolve_chat(arch, "x", {"x": "5@g.us"}) == "5@g.us" and q.resolve_chat({**arch, "contacts": arch["contacts"].limit(0)}, "079 000 00 01") == chat
    for nobody in ("41790000077", "zzz", "3"):  # a number without a chat or messages is none
        with pytest.raises(LookupError):
            q.resolve_chat(arch, nobody)
    assert q.resolve_message(arch, "Ada:-2").endswith("k4") and q.resolve_message(arch, f"{chat}:1:k") == f"{chat}:1:k"
    assert [r.phone_jid[:11] for r in q.forgotten_contacts(arch, date(2024, 2, 1), 7).collect()] == ["41790000002", "41790000001"]
    assert q.list_chats(arch).first().display_name == "Ada"
    assert {r.role for r in q.members_for(arch, chat).collect()} == {"peer"}
    assert q.explain_member({**arch, "chat_members": arch["chats"].selectExpr("jid chat_jid", "jid member_jid", "1 rank")}, "5@g.us", "7@lid")[0] == "Ada"


def test_text_sources(spark, tmp_path):
    card = "BEGIN:VCARD\r\nN:Lee;Bo\r\nTEL:1\r\n 23\r\nTEL;X=1:456\r\nEND:VCARD\r\nbegin:vcard\nFN:No Phone\nend:vcard\n"
    assert [(r.name, r.number) for r in parse_vcards(spark.createDataFrame([(card,)], "value string")).collect()] == [("Bo Lee", "123"), ("Bo Lee", "456")]
    f = tmp_path / "pins.csv"
    f.write_text('﻿Number,Display Name,extra\n079 000 00 01,"Bo ""B"", Jr",1\n\n,Al,2\n12,Cy,3\n', encoding="utf-8")
    good, bad = read_pins(spark, str(f))
    assert [tuple(r) for r in good.collect()] == [("41790000001" + P, 'Bo "B", Jr')]
    assert [(r.line, r.value, r.reason) for r in bad.orderBy("line").collect()] == [(4, None, "empty phone"), (5, "12", "not a phone number")]


def test_pins_of_a_large_file(spark, tmp_path):
    """Lines are numbered through all blocks of a file, whatever ends them; every file has its header."""
    ends = ["\n", "\r\n", "\r", "\n\n"]
    lines, at, want, wrong = ["\n  \nPhone,Name\n"], 3, [], []
    for i in range(3000):
        at += 1
        usable = i % 5 > 0
        (want if usable else wrong).append((f"4179{i:07d}{P}", f"N{i}") if usable else (at, "x", f"N{i}"))
        lines.append(f"{f'079 {i:07d}' if usable else 'x'},N{i}{ends[i % 4]}")
        at += i % 4 == 3
    (tmp_path / "a.csv").write_bytes("".join(lines).encode())
    (tmp_path / "b.csv").write_bytes(b"Phone,Name\ny,Bo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        good, bad = read_pins(spark, str(tmp_path))
        assert good.rdd.getNumPartitions() > 10  # no task holds all of a file
        assert sorted(map(tuple, good.collect())) == want
        assert sorted(tuple(r)[:3] for r in bad.collect()) == sorted([*wrong, (2, "y", "Bo")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
