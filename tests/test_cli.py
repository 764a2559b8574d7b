"""Every command over an archive that a run has made: the named queries on real tables."""

import io
import json
import sqlite3

import pytest

from parley import cli
from tests.test_extract import ADA, BO, TABLES


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    kinds = {"long": "INTEGER", "string": "TEXT", "double": "REAL", "binary": "BLOB"}
    with sqlite3.connect(root / "source.db") as db:
        for name, (ddl, rows) in TABLES.items():
            if name == "message_media":
                rows = [(2, "Media/WhatsApp Images/x.jpg", "image/jpeg"), (10, "Media/s.jpg", "image/jpeg")]
            columns = [d.split() for d in ddl.split(", ")]
            db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
        db.execute("ALTER TABLE receipt_user ADD COLUMN played_timestamp INTEGER")
    (root / "Media" / "WhatsApp Images").mkdir(parents=True)
    (root / "Media" / "WhatsApp Images" / "x.jpg").write_bytes(b"xyz")
    (root / "list.json").write_text(json.dumps([{"name": "Bo", "number": "079 000 00 02"}]))
    (root / "pins.csv").write_text("phone,name\n079 000 00 03,Cy\nabc,No\n")
    (root / "cards.vcf").write_text("BEGIN:VCARD\r\nFN:Di\r\nTEL:079 000 00 04\r\nEND:VCARD\r\n")

    def call(*argv, form="json"):
        out = io.StringIO()
        code = cli.main([str(root), "--format", form, *argv], spark, out)
        return code, out.getvalue()

    call("contact-pin", "079 000 00 01", "Ada L")
    first = call("run", "--source", str(root / "source.db"), "--media-root", str(root / "Media"))
    return root, call, first


def lines(result):
    assert result[0] == 0
    return [json.loads(x) for x in result[1].splitlines()]


def test_run_and_summary(home):
    root, call, first = home
    got = {r["name"]: r for r in lines(first)}
    assert got["messages"]["inserts"] == 6 and got["media snapshot"]["inserts"] == 1 and got["sender resolution"]["read"] == 2
    assert {r["table"]: r["rows"] for r in lines(call("stats"))}["messages"] == 6
    assert call("summary", form="table")[1].splitlines()[0].split() == ["name", "read", "attempts", "inserts", "skipped", "rows", "note"]


def test_contacts(home):
    root, call, _ = home
    call("contact-sync", str(root / "list.json"))
    assert [r["reason"] for r in lines(call("contact-import-csv", str(root / "pins.csv")))] == ["not a phone number"]
    call("contact-import-vcard", str(root / "cards.vcf"))
    assert [(r["name"], r["source"]) for r in lines(call("contact-list"))] == [("Ada L", "manual"), ("Bo", "address_book"), ("Cy", "manual"), ("Di", "vcard")]
    call("contact-unpin", "079 000 00 03")
    assert [r["name"] for r in lines(call("contact-list", "--source", "manual"))] == ["Ada L"]
    assert lines(call("contact-resolution"))[0]["percent"] == 100.0 and lines(call("contact-unresolved")) == []
    assert call("contact-pin", "5@g.us", "No")[0] == 1


def test_chats_and_messages(home):
    root, call, _ = home
    chats = [r["jid"] for r in lines(call("chat-list"))]
    assert set(chats) == {ADA, "5@g.us", "n@newsletter", "status@broadcast"}
    at = str(chats.index("5@g.us") + 1)
    assert lines(call("chat-alias", "team", at)) == [{"word": "team", "chat": "5@g.us"}]
    assert {r["jid"] for r in lines(call("chat-members", "team", "--history"))} == {ADA, BO, "7@lid"}
    assert lines(call("chat-info", "Team"))[0]["message_count"] == 2
    assert call("chat-why", "team", "7@lid")[1].splitlines()[0] in ("Bo", "Bo L")
    assert [r["text"] for r in lines(call("search", "AGAIN"))] == ["hello again"] and lines(call("search", "x", "--chat", "team")) == []
    assert [(r["text"], r["file_path"]) for r in lines(call("timeline", "ada"))][0][0] == "hello again"
    assert [r["url"] for r in lines(call("links"))] == ["https://x.org"]
    assert call("chat-info", "nobody at all")[0] == 1
    assert [r["n"] for r in lines(call("most-reacted"))] == [1] and lines(call("unengaged")) and lines(call("forgotten"))
    assert [r["transcript"] for r in lines(call("transcripts", "bo"))] == ["hello Bo"]
    assert lines(call("receipts", "status@broadcast:1:s", "--source", str(root / "source.db")))[0]["status"] == "read"


def test_digest_and_export(home):
    root, call, _ = home
    text = call("chat-digest", "079 000 00 01", form="table")[1]
    # the mirrored copy of a file is what a digest names
    assert "# Digest: Ada L" in text and f"file={root}/media/WhatsApp Images/x.jpg" in text and '↪ replying to Ada L: "hello Bo"' in text
    assert "P1" in call("chat-digest", "team", "--pseudonyms")[1] and json.loads(call("chat-digest", "team", "--jsonl")[1].splitlines()[0])["idx"] == 1
    out = lines(call("chat-export", "079 000 00 01", "-o", str(root / "e"), "--media-root", str(root)))
    assert [(r["status"], r["bytes"]) for r in out] == [("copied", 3)]
    assert (root / "e" / "digest.md").exists() and len(list((root / "e" / "media_files").rglob("x.jpg"))) == 1


def test_statuses(home):
    root, call, _ = home
    assert [r["id"] for r in lines(call("status-list"))] == ["status@broadcast:1:s"]
    assert [(r["view_count"], r["reaction_count"]) for r in lines(call("status-summary", "--sort", "views"))] == [(1, 0)]
    assert [r["viewer_jid"] for r in lines(call("status-views"))] == [ADA] and lines(call("status-reactions", "top")) == []
    assert [r["file_path"] for r in lines(call("status-media", "1"))] == ["Media/s.jpg"]
    assert call("status-views", "9")[0] == 1
    assert call("vacuum")[1] == "0 folders removed\n"
