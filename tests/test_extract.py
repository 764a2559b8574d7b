"""Extractors on a small own source: one conversation, one group, one newsletter."""

import json

import pytest
from pyspark.sql import functions as F

from parley.operators import extract as ex
from parley.operators import merge

P = "@s.whatsapp.net"
ADA, BO, LID = "41790000001" + P, "41790000002" + P, "7@lid"
TABLES = {
    "jid": ("_id long, user string, server string, raw_string string", [(1, "41790000001", "s.whatsapp.net", ADA), (2, "41790000002", "s.whatsapp.net", BO), (3, "7", "lid", LID), (4, "5", "g.us", "5@g.us"), (5, "status", "broadcast", ex.STATUS_CHAT), (6, "n", "newsletter", "n@newsletter"), (7, None, None, None)]),
    "jid_map": ("lid_row_id long, jid_row_id long, sort_id long", [(3, 2, 1), (1, 2, 2)]),
    "jid_user_metadata": ("jid_row_id long, country_code string", [(1, "CH")]),
    "lid_display_name": ("lid_row_id long, display_name string, username string", [(3, "Bo L", None)]),
    "chat": ("_id long, jid_row_id long, subject string, created_timestamp long, archived long", [(1, 1, None, 5000, None), (2, 4, "Team", 0, 1), (3, 5, None, 1, 0), (4, 6, None, 1, 0), (5, 99, None, 1, 0)]),
    "group_participant_user": ("_id long, group_jid_row_id long, user_jid_row_id long, rank long, add_timestamp long", [(1, 4, 1, 1, 1000), (2, 4, 3, None, 0)]),
    "group_past_participant_user": ("group_jid_row_id long, user_jid_row_id long, is_leave long, timestamp long", [(4, 2, 1, 9000)]),
    "message": (
        "_id long, chat_row_id long, from_me long, key_id string, sender_jid_row_id long, timestamp long, received_timestamp long, message_type long, text_data string, starred long",
        [
            (1, 1, 0, "a", None, 1000, 0, 0, "hello Bo", None), (2, 1, 1, "b", None, 2000, 2500, 1, None, 1), (3, 2, 0, "c", 3, 3000, 0, 36, None, 0),
            (4, 2, 0, "d", None, 4000, 0, 7, None, 0), (5, 1, 0, "e", None, 0, 0, 0, "no time", 0), (6, 1, 0, None, None, 9, 0, 0, "no key", 0), (7, 9, 0, "g", None, 9, 0, 0, "no chat", 0),
            (8, 1, 0, "h", None, 9, 0, 90, "stub", 0), (9, 1, 0, "a", None, 1000, 0, 0, "hello again", 0), (10, 3, 1, "s", None, 8000, 0, 0, "my status", 0), (11, 4, 0, "n", None, 9000, 0, 0, "news", 0), (12, 1, 0, "i", None, 9, 0, None, "no type", 0),
        ],
    ),
    "message_media": ("message_row_id long, file_path string, mime_type string", [(2, "Media/x.jpg", "image/jpeg"), (10, "Media/s.jpg", "image/jpeg"), (6, "lost", None)]),
    "message_quoted": ("message_row_id long, key_id string, text_data string, sender_jid_row_id long", [(2, "a", "hello Bo", 1)]),
    "message_text": ("message_row_id long, url string, page_title string", [(1, "https://x.org", "X"), (2, "", "none")]),
    "message_mentions": ("message_row_id long, jid_row_id long, display_name string", [(3, 1, "Ada"), (3, 2, "Bo"), (3, 99, "?")]),
    "message_revoked": ("message_row_id long, revoked_key_id string, admin_jid_row_id long, revoke_timestamp long", [(3, "z", 1, 0)]),
    "message_system": ("message_row_id long, action_type long", [(4, 12), (7, 6)]),
    "message_system_chat_participant": ("message_row_id long, user_jid_row_id long", [(4, 3), (4, 1), (4, 99)]),
    "message_system_value_change": ("message_row_id long, old_data string", [(7, "Old"), (4, "unused")]),
    "message_add_on": ("_id long, parent_message_row_id long, sender_jid_row_id long, key_id string, from_me long", [(1, 1, 1, "r1", 0), (2, 3, 1, "v1", 0), (3, 3, 2, "v2", 0), (4, 99, 1, "lost", 0)]),
    "message_add_on_reaction": ("message_add_on_row_id long, reaction string, sender_timestamp long", [(1, "+", 1500), (4, "-", 1)]),
    "message_edit_info": ("message_row_id long, edited_timestamp long, original_key_id string", [(1, 1700, "a"), (2, 0, "b")]),
    "call_log": ("_id long, call_id string, jid_row_id long, timestamp long, video_call long", [(1, "c1", 1, 100, 0), (2, None, 1, 1, 0), (3, "c1", 2, 300, 1)]),
    "call_log_participant_v2": ("call_log_row_id long, jid_row_id long, call_result long", [(1, 2, 5), (2, 2, 5)]),
    "message_poll": ("message_row_id long, selectable_options_count long", [(3, 1)]),
    "message_poll_option": ("_id long, message_row_id long, option_name string, vote_total long", [(12, 3, "no", 1), (11, 3, "yes", 2), (13, 99, "lost", 0)]),
    "message_add_on_poll_vote": ("message_add_on_row_id long, sender_timestamp long", [(2, 10), (3, 0)]),
    "message_add_on_poll_vote_selected_option": ("message_add_on_row_id long, message_poll_option_id long", [(2, 12), (2, 11), (2, 77)]),
    "status_message_info": ("message_row_id long, audience_type long", [(10, 2), (1, 0)]),
    "receipt_user": ("_id long, message_row_id long, receipt_user_jid_row_id long, receipt_timestamp long, read_timestamp long", [(1, 10, 1, 8100, 8200), (2, 1, 1, 1, 1)]),
    "newsletter": ("chat_row_id long, name string", [(4, "News")]),
    "newsletter_message_reaction": ("_id long, message_row_id long, reaction string, reaction_count long", [(1, 11, "+", None), (2, 11, "", 3)]),
    "audio_data": ("message_row_id long, waveform binary", [(1, b"x"), (2, None)]),
    "transcription_segment": ("_id long, message_row_id long, substring_start long, substring_length long", [(2, 1, 6, 2), (1, 1, 0, 5), (3, 1, -1, 2)]),
    "message_vcard": ("_id long, message_row_id long, vcard string", [(1, 1, "BEGIN:VCARD")]),
    "message_vcard_jid": ("vcard_row_id long, vcard_jid_row_id long", [(1, 2)]),
    "bot_message_info": ("message_row_id long, target_id string", [(1, "t")]),
    "ai_rich_response_message_core_info": ("message_row_id long, ai_rich_response_message_type long", [(1, 3), (2, 4)]),
    "ai_thread_info": ("thread_id_row_id long, title string, creation_ts long", [(1, "T", 1000)]),
    "message_template": ("message_row_id long, content_text_data string", [(1, "hi"), (2, None)]),
    "message_template_button": ("_id long, message_row_id long, text_data string", [(2, 1, "B"), (1, 1, "A")]),
    "community_chat": ("chat_row_id long, closed long", [(2, 0)]),
    "parent_group_participants": ("parent_group_jid_row_id long, user_jid_row_id long", [(4, 2), (4, 1)]),
}


def ts(text):
    return F.lit(text).cast("timestamp")


def keep(tables):
    """Cut the plans between versions, as a stored version does."""
    return {k: t.sparkSession.createDataFrame(t.toArrow(), t.schema) for k, t in tables.items()}


@pytest.fixture(scope="module")
def source(spark):
    return ex.Source(spark, keep({name: spark.createDataFrame(rows, ddl) for name, (ddl, rows) in TABLES.items()}))


@pytest.fixture(scope="module")
def first(source):
    return keep(ex.extract_all(source, {}, ts("2025-01-01")))


def rows(tables, name, *columns):
    return sorted(map(tuple, tables[name].select(*columns).collect()), key=repr)


def test_messages_and_extensions(first, source):
    ids = {r.id: r for r in first["messages"].collect()}
    assert set(ids) == {f"{ADA}:0:a", f"{ADA}:1:b", "5@g.us:0:c", "5@g.us:0:d", "status@broadcast:1:s", "n@newsletter:0:n"}
    a = ids[f"{ADA}:0:a"]
    assert (a.sender_jid, a.text, a.source_rowid, a.ts_received, a.starred) == (ADA, "hello again", 9, None, 0)
    assert ids["5@g.us:0:d"].type == "system" and ids[f"{ADA}:1:b"].sender_jid is None
    assert rows(first, "message_media", "message_id", "mime") == [(f"{ADA}:1:b", "image/jpeg"), ("status@broadcast:1:s", "image/jpeg")]
    assert rows(first, "message_quoted", "quoted_key_id", "quoted_sender_jid") == [("a", ADA)]
    assert rows(first, "message_link_previews", "url", "title") == [("https://x.org", "X")]
    assert rows(first, "message_mentions", "mentioned_jid") == [(ADA,), (BO,)]
    assert rows(first, "message_revoked", "admin_jid", "revoke_ts") == [(ADA, None)]
    assert dict(ex.skipped(source).collect()) == {"no time": 1, "no key": 1, "no chat": 1, "skipped type": 1, "no type": 1}
    assert rows(ex.messages(source, {}, ts("2025-01-01"), after=9), "messages", "key_id") == [("n",), ("s",)]


def test_people_and_chats(first):
    assert rows(first, "identity_links", "lid_jid", "phone_jid") == [(LID, BO)] and first["identity_links_history"].count() == 1
    assert {r.jid: (r.kind, r.country_code) for r in first["identities"].collect()}[ADA] == ("user", "CH")
    assert rows(first, "identity_display_names", "jid", "display_name") == [(LID, "Bo L")]
    assert rows(first, "chats", "jid", "archived") == [(ADA, 0), ("5@g.us", 1), ("n@newsletter", 0), ("status@broadcast", 0)]
    assert rows(first, "chat_members", "member_jid", "rank") == [(ADA, 1), (LID, None)]
    assert rows(first, "chat_members_history", "member_jid", "op", "source") == [(ADA, "join", "snapshot"), (BO, "leave", "past_participant"), (LID, "join", "snapshot")]


def test_events_reactions_and_polls(first):
    got = {r.message_id: r for r in first["system_events"].collect()}
    added = got["5@g.us:0:d"]
    assert (added.body, added.actor_jid, added.affected_jids, added.old_value) == (f"Added {ADA}, {LID}", ADA, [ADA, LID], None)
    assert got["unknown:0:g"].body == "Subject changed: Old → ?"
    assert rows(first, "reactions", "parent_message_id", "emoji", "sender_jid") == [(f"{ADA}:?:a", "+", ADA)]
    assert rows(first, "edits", "message_id", "original_key_id") == [(f"{ADA}:0:a", "a")]
    assert rows(first, "calls", "call_id", "peer_jid", "video") == [("c1", BO, 1)] and rows(first, "call_participants", "call_id", "participant_jid") == [("c1", BO)]
    assert rows(first, "poll_options", "option_index", "option_name") == [(0, "yes"), (1, "no")]
    assert rows(first, "poll_votes", "voter_jid", "selected_indexes") == [(ADA, [0, 1]), (BO, [])]


def test_statuses_and_payloads(first):
    assert rows(first, "status_posts", "message_id", "audience_type") == [(f"{ADA}:0:a", 0), ("status@broadcast:1:s", 2)]
    assert rows(first, "status_archive", "id", "kind", "uuid") == [("status@broadcast:1:s", "own", None)]
    assert rows(first, "status_archive_media", "file_path") == [("Media/s.jpg",)] and rows(first, "status_archive_views", "viewer_jid", "played_ts") == [(ADA, None)]
    assert rows(first, "newsletter_metadata", "chat_jid", "name") == [("n@newsletter", "News")] and rows(first, "newsletter_message_reactions", "emoji", "count") == [("+", 0)]
    assert rows(first, "message_audio", "message_id", "has_waveform") == [(f"{ADA}:0:a", 1), (f"{ADA}:1:b", 0)]
    assert rows(first, "message_transcription_segments", "seq", "text") == [(0, "hello"), (1, "Bo"), (2, None)]
    assert rows(first, "message_vcards", "contact_jid") == [(BO,)]
    bots = {k: json.loads(v) for k, v in rows(first, "bot_messages", "message_id", "raw_json")}
    assert bots[f"{ADA}:0:a"]["target_id"] == "t" and bots[f"{ADA}:0:a"]["rich_response"]["type"] == 3 and list(bots[f"{ADA}:1:b"]) == ["rich_response"]
    assert json.loads(rows(first, "ai_threads", "raw_json")[0][0])["creation_ts"] == "1970-01-01T00:00:01+00:00"
    made = {k: json.loads(v) for k, v in rows(first, "template_messages", "message_id", "raw_json")}
    assert [b["text"] for b in made[f"{ADA}:0:a"]["buttons"]] == ["A", "B"] and made[f"{ADA}:1:b"]["buttons"] == [] and made[f"{ADA}:1:b"]["content"] is None
    assert json.loads(rows(first, "communities", "raw_json")[0][0])["participants"] == [ADA, BO]


def test_rich_response_joins_the_stored_bot_row(spark, first, source):
    gone = ex.Source(spark, {**source.tables, "bot_message_info": source.tables["bot_message_info"].where("message_row_id <> 1")})
    before = {k: json.loads(v) for k, v in rows(first, "bot_messages", "message_id", "raw_json")}
    after = {k: json.loads(v) for k, v in rows(ex.bot_messages(gone, first, ts("2025-01-02")), "bot_messages", "message_id", "raw_json")}
    assert after == before and after[f"{ADA}:0:a"]["target_id"] == "t"


def test_second_run_changes_nothing_but_sightings(first, source):
    again = keep(ex.extract_all(source, first, ts("2025-01-02")))
    moving = {"identities": "last_seen_ts", "identity_links": "last_observed_ts", "identity_display_names": "observed_at", "chats": "last_seen_ts", "newsletter_metadata": "observed_at"}
    assert set(again) == set(first)
    for name in first:
        columns = [c for c in first[name].columns if c != moving.get(name)]
        assert rows(again, name, *columns) == rows(first, name, *columns), name


def test_empty_source_and_backup(spark, first):
    assert all(t.count() == 0 for t in ex.extract_all(ex.Source(spark), {}, ts("2025-01-01")).values())
    tables = {
        "status": spark.createDataFrame([(1, "u", ADA, 0, 1000, 1), (2, None, None, 1, 0, 1)], "row_id long, uuid string, sender_user_jid string, type long, timestamp long, status_info_row_id long"),
        "status_info": spark.createDataFrame([(1, "status@broadcast")], "row_id long, chat_jid string"),
        "status_media_link": spark.createDataFrame([(1, 5)], "status_row_id long, media_content_row_id long"),
        "media_content": spark.createDataFrame([(5, "video/mp4", "https://m")], "row_id long, mime_type string, media_url string"),
        "status_thumbnail": spark.createDataFrame([(1, b"t")], "status_row_id long, thumbnail binary"),
    }
    got = ex.received_statuses(ex.Source(spark, tables), first, ts("2025-01-01"))
    assert rows(got, "status_archive", "id", "kind", "chat_jid") == [("status@broadcast:1:s", "own", "status@broadcast"), (f"status_recv:{ADA}:u", "received", "status@broadcast"), ("status_recv:?:?", "received", "status@broadcast")]
    assert (f"status_recv:{ADA}:u", "https://m") in rows(got, "status_archive_media", "status_id", "media_url") and got["status_archive_thumbnails"].count() == 1


def test_pins_and_card_imports(spark):
    cur = spark.createDataFrame([("1", "A", "address_book", "x"), ("2", "M", "manual", "x")], "phone_jid string, name string, source string, updated_at string")
    inc = spark.createDataFrame([("1", "V", 1), ("1", "W", 2), ("2", "Z", 1), ("3", " ", 1)], "phone_jid string, name string, o int")
    state, log = merge.add_contacts(cur, inc, F.lit("now"), "vcard", ["o"])
    assert [(r.phone_jid, r.name) for r in log.collect()] == [("1", "W")]
    assert {r.phone_jid: r.name for r in merge.effective_contacts(state).collect()} == {"1": "W", "2": "M"}
    assert merge.add_contacts(state, inc, F.lit("later"), "vcard", ["o"])[1].count() == 0
    state, log = merge.add_contacts(state, spark.createDataFrame([("1", "P")], "phone_jid string, name string"), F.lit("now"), "manual")
    assert {r.phone_jid: r.name for r in merge.effective_contacts(state).collect()} == {"1": "P", "2": "M"}
    state, log = merge.unpin(state, spark.createDataFrame([("1",), ("9",)], "phone_jid string"), F.lit("now"))
    assert [(r.phone_jid, r.op) for r in log.collect()] == [("1", "remove")]
    assert {r.phone_jid: r.name for r in merge.effective_contacts(state).collect()} == {"1": "W", "2": "M"}


def test_links_of_users_beyond_two_hundred(spark, tmp_path):
    """The query links every user to the phone of the user 100 below, where that one has events."""
    from parley.extract_queries import QUERIES

    users = [5, 105, 105, 205, 305, 150, 450, 1_000_305]
    ev = spark.createDataFrame([(e, u, "click", "p") for e, u in enumerate(users)], "event_id long, user_id long, event_type string, props string")
    ev.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, QUERIES["extract_identity_links"](spark, str(tmp_path)).collect()))
    assert got == [(f"{u}@lid", f"4179{u - 100:07d}{P}") for u in (105, 205, 305)]
