"""State beside an archive, contact changes as commits, card order, and the copy of media."""

import os
from datetime import datetime

import pytest

from parley.operators import extract as ex
from parley.operators import merge
from parley.plans import contacts
from parley.plans.run import run
from parley.sources import sinks
from parley.sources.sidecars import PINS, Sidecars
from parley.sources.store import CommitConflict, Store
from parley.sources.text import card_contacts, parse_vcards, read_vcards

P = "@s.whatsapp.net"
ONE, TWO = "41790000001" + P, "41790000002" + P


def effective(store):
    return {r.phone_jid: (r.name, r.source) for r in merge.effective_contacts(store.open()["contacts"]).collect()}


def test_pins_outlive_the_archive(spark, tmp_path):
    side, store = Sidecars(spark, str(tmp_path / "config")), Store(spark, str(tmp_path / "a"))
    assert side.pins() == {} and side.aliases() == {} and side.last_list() == []
    contacts.pin(store, side, ONE, "Ada", datetime(2025, 1, 1))
    contacts.pin(store, side, TWO, "Bo", datetime(2025, 1, 1))
    contacts.pin(store, side, ONE, "Ada L", datetime(2025, 1, 2))
    assert side.pins() == {ONE: "Ada L", TWO: "Bo"} and effective(store) == {ONE: ("Ada L", "manual"), TWO: ("Bo", "manual")}
    assert [(r.name, r.op) for r in store.open()["contacts_history"].where(f"phone_jid = '{ONE}'").orderBy("observed_at").collect()] == [("Ada", "set"), ("Ada L", "set")]
    assert os.stat(tmp_path / "config" / PINS).st_mode & 0o777 == 0o600
    contacts.unpin(store, side, TWO)
    assert side.pins() == {ONE: "Ada L"} and effective(store) == {ONE: ("Ada L", "manual")}
    # the archive is lost: the next run puts the pins back
    lost = Store(spark, str(tmp_path / "b"))
    run(lost, ex.Source(spark), datetime(2025, 1, 3), sidecars=side, extractors=[ex.identities])
    assert effective(lost) == {ONE: ("Ada L", "manual")} and "contacts_history" not in lost.open()


def test_broken_sidecars_read_as_empty(spark, tmp_path):
    side = Sidecars(spark, str(tmp_path))
    for text in ("{", "[1]", '{"a": 1, "b": "x"}'):
        (tmp_path / PINS).write_text(text)
        assert side.pins() == ({"b": "x"} if "b" in text else {})
    side.pin("c", "ü")
    assert side.pins() == {"b": "x", "c": "ü"} and not [f for f in os.listdir(tmp_path) if f.startswith(".") and "crc" not in f]


def test_list_numbers_and_aliases(spark, tmp_path):
    side = Sidecars(spark, str(tmp_path))
    arch = {
        "messages": spark.createDataFrame([("5@g.us", datetime(2024, 1, 1)), ("6@g.us", datetime(2024, 1, 3)), (ONE, datetime(2024, 1, 2))], "chat_jid string, ts timestamp"),
        "chats": spark.createDataFrame([("5@g.us", "group", "Team"), ("6@g.us", "group", "Tea"), (ONE, "user", None)], "jid string, kind string, subject string"),
        "contacts": spark.createDataFrame([], "phone_jid string, name string, source string"),
        "identity_links": spark.createDataFrame([], "lid_jid string, phone_jid string"),
    }
    with pytest.raises(LookupError, match="list the chats first"):
        contacts.resolve_chat(arch, side, "3")
    contacts.list_chats(arch, side, names=False)
    assert side.last_list() == ["6@g.us", ONE, "5@g.us"] and contacts.resolve_chat(arch, side, " 3 ") == "5@g.us"
    with pytest.raises(LookupError, match="no chat number 4"):
        contacts.resolve_chat(arch, side, "4")
    side.alias("3", "7@g.us")  # an alias comes first
    assert contacts.resolve_chat(arch, side, "3") == "7@g.us"
    side.alias("3", None)
    assert contacts.resolve_chat(arch, side, "3") == "5@g.us" and contacts.resolve_chat(arch, side, "team") == "5@g.us"
    with pytest.raises(LookupError, match=r"Tea \[6@g.us\], Team \[5@g.us\]"):
        contacts.resolve_chat(arch, side, "tea")
    assert contacts.resolve_chat(arch, side, "079 000 00 01") == ONE


def card(name, *numbers):
    return f"BEGIN:VCARD\r\nFN:{name}\r\n" + "".join(f"TEL:{n}\r\n" for n in numbers) + "END:VCARD\r\n"


def test_the_last_card_of_a_number_counts(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "b.vcf").write_text(card("Second", "079 000 00 01") + card("Third", "0790000001", "079 000 00 02"))
    (tmp_path / "v" / "a.vcf").write_text(card("First", "079 000 00 01") + card("Other", "079 000 00 02", "x"))
    (tmp_path / "v" / "sub" / "0.vcf").write_text(card("Deep", "079 000 00 02"))
    (tmp_path / "v" / "no.txt").write_text(card("No", "079 000 00 01"))
    cards = read_vcards(spark, str(tmp_path / "v"))
    assert [(r.path.rpartition("/")[2], r.card, r.line, r.name) for r in cards.orderBy("path", "card", "line").collect()] == [("a.vcf", 0, 0, "First"), ("a.vcf", 1, 0, "Other"), ("a.vcf", 1, 1, "Other"), ("b.vcf", 0, 0, "Second"), ("b.vcf", 1, 0, "Third"), ("b.vcf", 1, 1, "Third"), ("0.vcf", 0, 0, "Deep")]
    store = Store(spark, str(tmp_path / "a"))
    contacts.import_vcards(store, str(tmp_path / "v"))
    assert effective(store) == {ONE: ("Third", "vcard"), TWO: ("Deep", "vcard")}
    contacts.import_vcards(store, str(tmp_path / "v" / "a.vcf"))
    assert effective(store) == {ONE: ("First", "vcard"), TWO: ("Other", "vcard")} and store.open()["contacts_history"].count() == 4
    version = store.rows()["contacts_history"]
    contacts.import_vcards(store, str(tmp_path / "v" / "a.vcf"))  # names that are there already change nothing
    assert store.rows()["contacts_history"] == version
    no_path = parse_vcards(spark.createDataFrame([(card("A", "0790000001") + card("B", "0790000001"),)], "value string"))
    assert [r.name for r in card_contacts(no_path).orderBy("place").collect()] == ["A", "B"]


def test_contact_changes_of_two_writers(spark, tmp_path):
    store, side = Store(spark, str(tmp_path / "a")), Sidecars(spark, str(tmp_path / "c"))

    def meanwhile(have, now):
        contacts.pin(Store(spark, store.root), side, ONE, "Ada")
        return merge.add_contacts(have, spark.createDataFrame([(TWO, "Bo")], "phone_jid string, name string"), now, "vcard")

    with pytest.raises(CommitConflict, match="contacts"):
        contacts.change(store, meanwhile)
    assert effective(store) == {ONE: ("Ada", "manual")}


def test_media_are_copied_and_missing_ones_counted(spark, tmp_path):
    root = tmp_path / "store"
    for name, data in {"Media/x/a.jpg": b"a" * 10, "Media/b.jpg": b"", "else where/c 50%.jpg": b"ccc"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = [("Media/x/a.jpg", "x/a.jpg"), ("Media/x/a.jpg", "x/a.jpg"), ("Media/b.jpg", "b.jpg"), (f"file:{root}/else where/c 50%.jpg", "c.jpg"), ("Media/gone.jpg", "gone.jpg"), (None, None)]
    files = spark.createDataFrame(rows, "path string, relative string")
    got = sorted((r.relative, r.status, r.bytes) for r in sinks.copy_media(files, str(root), str(tmp_path / "out")).collect())
    assert got == [("b.jpg", "copied", 0), ("c.jpg", "copied", 3), ("gone.jpg", "missing", None), ("x/a.jpg", "copied", 10)]
    assert (tmp_path / "out" / "x" / "a.jpg").read_bytes() == b"a" * 10 and sorted(os.listdir(tmp_path / "out")) == ["b.jpg", "c.jpg", "x"]


def test_export_folder(spark, tmp_path):
    (tmp_path / "m" / "Media").mkdir(parents=True)
    (tmp_path / "m" / "Media" / "a.jpg").write_bytes(b"abc")
    none = lambda ddl: spark.createDataFrame([], ddl)
    arch = {
        "messages": spark.createDataFrame([("i1", 1, ONE, 0, datetime(2024, 1, 1), "hi", "image", "k", ONE), ("i2", 2, ONE, 0, datetime(2024, 1, 2), "yo", "text", "l", ONE)], "id string, source_rowid long, chat_jid string, from_me int, ts timestamp, text string, type string, key_id string, sender_jid string"),
        "message_media": spark.createDataFrame([("i1", "Media/a.jpg", None, "image/jpeg", None), ("i2", "Media/b.jpg", None, "image/jpeg", None)], "message_id string, file_path string, mirrored_path string, mime string, caption string"),
        "contacts": none("phone_jid string, name string, source string"), "identity_links": none("lid_jid string, phone_jid string"), "identity_display_names": none("jid string, display_name string"),
        "chats": none("jid string, kind string, subject string"), "newsletter_metadata": none("chat_jid string, name string"), "message_quoted": none("message_id string, quoted_key_id string, quoted_text string, quoted_sender_jid string"),
        "message_link_previews": none("message_id string, url string, title string"), "edits": none("message_id string"), "reactions": none("parent_chat_jid string, parent_key_id string, emoji string, sender_jid string, sender_from_me int"),
    }
    out = sinks.export_chat(arch, ONE, str(tmp_path / "e"), media_root=str(tmp_path / "m"))
    assert sorted((r.relative, r.status) for r in out.collect()) == [("a.jpg", "copied"), ("b.jpg", "missing")]
    assert (tmp_path / "e" / "media_files" / "a.jpg").read_bytes() == b"abc"
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "e" / "digest.md")).collect())
    # the chat has no row among the chats: the head names it all the same
    assert "# Digest: +41 79 000 00 01" in text and "- chat kind: user" in text and "_[media: image/jpeg file=Media/a.jpg]_" in text
    assert spark.read.text(str(tmp_path / "e" / "digest.jsonl")).count() == 2
