"""Extractors: normalised source tables to archive tables, one pure function each.

An extractor takes (source, current, run_ts) and returns the new state of the archive
tables it owns: a dict of lazy DataFrames. ``current`` holds the tables of the last
version; absent ones count as empty. Identifiers are resolved by joins with the small
``chat`` and ``jid`` tables, which adaptive execution broadcasts when their size allows.
Children find their message by one join on the row id.

Rows without a key, and messages without a chat, type or time, are left out; a source with
``counts`` counts them by reason as the tables are written. Native arrays replace JSON lists.

Extension rows can reach the source after their message: ``messages`` looks back over the
row ids of old messages too and takes what is new or differs from the archive."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators import merge
from parley.operators.counts import Counts, first_reason

Tables = dict[str, DataFrame]

# Message types that are no messages of their own, and the chat of statuses.
SKIPPED_TYPES = (90,)
STATUS_CHAT = "status@broadcast"
#: Source tables that are copied at the same time.
READERS = 4
#: Columns of a message beside its identity.
MESSAGE_COLUMNS = "timestamp long, received_timestamp long, message_type long, text_data string, status long, origin long, starred long"


@dataclass
class Delta:
    """Rows that a merge gives a table, and the keys of what they replace there."""

    rows: DataFrame
    keys: list[str]


@dataclass
class Source:
    """Source tables by name; absent tables are empty and absent columns are null."""

    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    counts: Counts | None = None
    #: Filled by extractors that read beyond a row id: what their tables get, by name.
    deltas: dict[str, Delta] | None = None

    def _table(self, name: str, columns: Sequence[str]) -> DataFrame | None:
        """A table with at least those of ``columns`` that it has."""
        return self.tables.get(name)

    def read(self, name: str, ddl: str) -> DataFrame:
        empty = self.spark.createDataFrame([], ddl)
        have = self._table(name, empty.columns)
        if have is None:
            return empty
        return have.select(*((F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))

    def jid_of(self, df: DataFrame, row_id: str, out: str, how: str = "left") -> DataFrame:
        """``df`` with the identifier that ``row_id`` refers to as ``out`` in its place."""
        jids = self.read("jid", "_id long, raw_string string").select(F.col("_id").alias(row_id), F.col("raw_string").alias(out))
        return df.join(jids, row_id, how).drop(row_id)

    def chats(self) -> DataFrame:
        return self.jid_of(self.read("chat", "_id long, jid_row_id long"), "jid_row_id", "chat_jid").withColumnRenamed("_id", "chat_row_id")

    def counted(self, name: str, rows: DataFrame, reasons: dict[str, Column], orphan: Column | None = None) -> DataFrame:
        """Rows that no reason leaves out."""
        if self.counts:
            return self.counts.rows(name, rows, reasons, orphan)
        return rows.where(first_reason(reasons).isNull())

    def messages(self, extra: str = "") -> DataFrame:
        """Messages with chat, sender and stable id; the id is null without a key."""
        ddl = "_id long, chat_row_id long, from_me long, key_id string, sender_jid_row_id long" + (f", {extra}" if extra else "")
        rows = self.jid_of(self.read("message", ddl).join(self.chats(), "chat_row_id", "left"), "sender_jid_row_id", "sender_jid")
        key = F.nullif(F.col("key_id"), F.lit(""))
        return rows.withColumnsRenamed({"_id": "rowid"}).withColumns({"from_me": (F.coalesce("from_me", F.lit(0)) != 0).cast("int"), "key_id": key, "message_id": fx.message_id("chat_jid", "from_me", key)})

    def of_messages(self, name: str, ddl: str, extra: str = "", counted: str | None = None, reasons: dict[str, Column] | None = None) -> DataFrame:
        """Rows of a table that belong to a message with a key, with that message's columns.

        With a name the rows are counted under it, those of no message too."""
        rows = self.read(name, f"message_row_id long, {ddl}").withColumnRenamed("message_row_id", "rowid")
        if not counted:
            return rows.join(self.messages(extra).where("key_id is not null"), "rowid")
        both = rows.join(self.messages(extra).withColumn("_found", F.lit(True)), "rowid", "left")
        why = {"no message": F.col("_found").isNull(), "no key": F.col("key_id").isNull(), **(reasons or {})}
        return self.counted(counted, both, why, F.coalesce("chat_jid", F.lit("")) == "").drop("_found")


def now(current: Tables, name: str, like: DataFrame) -> DataFrame:
    have = current.get(name)
    return like.sparkSession.createDataFrame([], like.schema) if have is None else have


def _replaced(current: Tables, name: str, new: DataFrame, keys: list[str], order: list[str]) -> Tables:
    base = now(current, name, new.drop(*order))
    return {name: merge.replace(base, new, keys, order)}


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _iso(ms: str) -> Column:
    return fx.iso_utc(fx.ms_to_ts(ms)).alias(ms)


def identities(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Every identifier, cumulative links with their history, and shown names."""
    jids = source.read("jid", "_id long, user string, server string, raw_string string")
    jids = source.counted("identities", jids, {"no identifier": F.col("raw_string").isNull()})
    codes = source.read("jid_user_metadata", "jid_row_id long, country_code string").withColumnRenamed("jid_row_id", "_id")
    seen = jids.join(codes, "_id", "left").select(F.col("raw_string").alias("jid"), fx.jid_kind("raw_string").alias("kind"), F.col("user").alias("user_part"), F.col("server").alias("server_part"), "country_code", run_ts.alias("first_seen_ts"), run_ts.alias("last_seen_ts"), F.col("_id").alias("_o"))
    base = now(current, "identities", seen.drop("_o"))
    known = base.select("jid", F.col("country_code").alias("_cc"))
    seen = seen.join(known, "jid", "left").withColumn("country_code", F.coalesce("country_code", "_cc")).drop("_cc")
    pairs = source.jid_of(source.jid_of(source.read("jid_map", "lid_row_id long, jid_row_id long, sort_id long"), "lid_row_id", "lid_jid", "inner"), "jid_row_id", "phone_jid", "inner")
    pairs = merge.last_wins(pairs.where(F.col("lid_jid").endswith("@lid") & F.col("phone_jid").endswith(fx.PHONE_SERVER)), ["lid_jid"], ["sort_id", "phone_jid"])
    links = now(current, "identity_links", pairs.select("lid_jid", "phone_jid", run_ts.alias("first_observed_ts"), run_ts.alias("last_observed_ts")))
    links, changed = merge.link_changes(links, pairs, run_ts)
    shown = source.jid_of(source.read("lid_display_name", "lid_row_id long, display_name string, username string"), "lid_row_id", "jid", "inner").select("jid", "display_name", "username", run_ts.alias("observed_at"))
    return {
        "identities": merge.upsert(base, seen, ["jid"], keep=["first_seen_ts"], order=["_o"]),
        "identity_links": links,
        "identity_links_history": now(current, "identity_links_history", changed).unionByName(changed),
        **_replaced(current, "identity_display_names", shown, ["jid"], []),
    }


# The chat columns whose change is history.
CHAT_COMPARED = ["subject", "archived", "hidden", "locked", "ephemeral_seconds", "group_type", "group_member_count", "is_contact"]


def chats(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Chats; ``created_ts``, ``pinned`` and ``muted_until_ts`` stay as first seen."""
    raw = source.read("chat", "_id long, jid_row_id long, subject string, created_timestamp long, archived long, hidden long, chat_lock long, ephemeral_expiration long, group_type long, group_member_count long, is_contact long, sort_timestamp long")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    new = source.counted("chats", source.jid_of(raw, "jid_row_id", "jid"), {"no identifier": _blank("jid")}).select(
        "jid", fx.jid_kind("jid").alias("kind"), "subject", fx.ms_to_ts("created_timestamp").alias("created_ts"), flag("archived").alias("archived"), flag("hidden").alias("hidden"), flag("chat_lock").alias("locked"),
        F.col("ephemeral_expiration").alias("ephemeral_seconds"), "group_type", "group_member_count", "is_contact", fx.ms_to_ts("sort_timestamp").alias("last_message_ts"), run_ts.alias("last_seen_ts"), F.lit(0).alias("pinned"), F.lit(None).cast("timestamp").alias("muted_until_ts"), F.col("_id").alias("_o"),
    )
    new = merge.last_wins(new, ["jid"], ["_o"]).drop("_o")
    base = now(current, "chats", new)
    # what a known chat has stays even where it is null
    known = base.select("jid", F.lit(True).alias("_old"))
    first = new.join(known, "jid", "left")
    kept = {c: F.when(F.col("_old"), F.lit(None)).otherwise(F.col(c)) for c in ("created_ts", "pinned", "muted_until_ts")}
    history = merge.snapshot_changes(base, new, "jid", CHAT_COMPARED, run_ts)
    return {"chats": merge.upsert(base, first.withColumns(kept).drop("_old"), ["jid"], keep=list(kept)), "chats_history": now(current, "chats_history", history).unionByName(history)}


def group_members(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Membership by snapshot difference; past participants enter the history once."""
    raw = source.read("group_participant_user", "_id long, group_jid_row_id long, user_jid_row_id long, rank long, pending long, add_timestamp long, join_method long, label string")
    rows = source.jid_of(source.jid_of(raw, "group_jid_row_id", "chat_jid"), "user_jid_row_id", "member_jid")
    rows = source.counted("group_members", rows, {"no chat": _blank("chat_jid"), "no member": _blank("member_jid")})
    new = merge.last_wins(rows, ["chat_jid", "member_jid"], ["_id"]).select("chat_jid", "member_jid", "rank", F.coalesce("pending", F.lit(0)).cast("int").alias("pending"), fx.ms_to_ts("add_timestamp").alias("joined_ts"), "join_method", "label")
    state, history = merge.membership_changes(now(current, "chat_members", new), new, run_ts)
    past = source.read("group_past_participant_user", "group_jid_row_id long, user_jid_row_id long, is_leave long, timestamp long")
    past = source.jid_of(source.jid_of(past, "group_jid_row_id", "chat_jid", "inner"), "user_jid_row_id", "member_jid", "inner").where("chat_jid <> '' and member_jid <> ''")
    past = past.select("chat_jid", "member_jid", F.when(F.coalesce("is_leave", F.lit(0)) != 0, "leave").otherwise("join").alias("op"), fx.ms_to_ts("timestamp").alias("observed_at"), F.lit("past_participant").alias("source"))
    log = now(current, "chat_members_history", history).unionByName(history)
    return {"chat_members": state, "chat_members_history": merge.append_new(log, past, ["chat_jid", "member_jid", "op", "observed_at", "source"])}


# Archive table: source table, source columns in DDL, archive name of those that are renamed,
# columns that refer to an identifier, and times in milliseconds.
EXTENSIONS = {
    "message_media": ("message_media", "file_path string, file_size long, mime_type string, file_hash string, media_caption string, media_duration long, width long, height long, media_name string", {"mime_type": "mime", "media_caption": "caption", "media_duration": "duration_s", "media_name": "name"}, {}, ()),
    "message_quoted": ("message_quoted", "key_id string, text_data string, message_type long, sender_jid_row_id long", {"key_id": "quoted_key_id", "text_data": "quoted_text", "message_type": "quoted_message_type"}, {"sender_jid_row_id": "quoted_sender_jid"}, ()),
    "message_link_previews": ("message_text", "url string, page_title string, description string", {"page_title": "title"}, {}, ()),
    "message_forwarded": ("message_forwarded", "forward_score long, forward_origin long", {}, {}, ()),
    "message_revoked": ("message_revoked", "revoked_key_id string, admin_jid_row_id long, revoke_timestamp long", {"revoke_timestamp": "revoke_ts"}, {"admin_jid_row_id": "admin_jid"}, ("revoke_ts",)),
    "message_albums": ("message_album", "image_count long, video_count long, expected_image_count long, expected_video_count long", {}, {}, ()),
    "message_view_once": ("message_view_once_media", "state long", {}, {}, ()),
    "message_ephemeral": ("message_ephemeral", "duration long, expire_timestamp long", {"duration": "expire_seconds", "expire_timestamp": "ephemeral_setting_ts"}, {}, ("ephemeral_setting_ts",)),
    "message_locations": ("message_location", "latitude double, longitude double, place_name string, place_address string, url string, live_location_share_duration long, live_location_final_latitude double, live_location_final_longitude double, live_location_final_timestamp long", {"live_location_share_duration": "live_share_duration_s", "live_location_final_latitude": "live_final_lat", "live_location_final_longitude": "live_final_lng", "live_location_final_timestamp": "live_final_ts"}, {}, ("live_final_ts",)),
}
#: What the archive needs of an extension row.
NEEDED = {"message_link_previews": "url <> ''", "message_revoked": "revoked_key_id is not null", "message_view_once": "state is not null"}


def _message_reasons() -> dict[str, Column]:
    """Why a message is left out."""
    return {
        "no type": F.col("message_type").isNull(), "skipped type": F.col("message_type").isin(*SKIPPED_TYPES), "no key": F.col("key_id").isNull(),
        "no chat": _blank("chat_jid"), "no time": F.coalesce("timestamp", F.lit(0)) == 0,
    }


def new_messages(source: Source, after: int = 0, counted: str = "messages") -> DataFrame:
    """Usable messages beyond a row id (the bound reaches the scan)."""
    rows = source.messages(MESSAGE_COLUMNS).where(F.col("rowid") > after)
    peer = F.when((F.col("from_me") == 0) & F.col("chat_jid").endswith(fx.PHONE_SERVER), F.col("chat_jid"))
    return source.counted(counted, rows, _message_reasons()).select(
        F.col("message_id").alias("id"), F.col("rowid").alias("source_rowid"), "chat_jid", F.coalesce("sender_jid", peer).alias("sender_jid"), "from_me", fx.ms_to_ts("timestamp").alias("ts"), fx.ms_to_ts("received_timestamp").alias("ts_received"),
        fx.type_label("message_type").alias("type"), F.col("message_type").alias("type_raw"), F.col("text_data").alias("text"), "key_id", "status", "origin", F.coalesce("starred", F.lit(0)).cast("int").alias("starred"),
    )


def _changed(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that ``base`` does not hold as they are."""
    columns = [c for c in base.columns if c in rows.columns]
    held = base.select(F.struct(*columns).alias("_held")).distinct()
    return rows.withColumn("_held", F.struct(*columns)).join(held, "_held", "left_anti").drop("_held")


def messages(source: Source, current: Tables, run_ts: Column, after: int = 0, look_back: int | None = 0) -> Tables:
    """Messages beyond a row id and what hangs on them: nine tables of one row, and mentions.

    The extension tables are read from ``look_back`` row ids before that on (all of them if
    it is None): rows that came late replace what is stored where they differ from it.
    Mentions of a message are replaced together when any of them is new. An extension row
    that is gone from the source stays in the archive."""
    new = new_messages(source, after)
    out = _replaced(current, "messages", new.withColumn("_o", F.col("source_rowid")), ["id"], ["_o"])
    deltas = {"messages": Delta(merge.last_wins(new, ["id"], ["source_rowid"]), ["id"])}
    since = 0 if look_back is None else max(0, after - look_back)
    # the messages that extension rows may belong to; they are counted where they are written
    known = new_messages(replace(source, counts=None), since)
    ids = known.select(F.col("source_rowid").alias("_o"), F.col("id").alias("message_id"))
    for name, (table, ddl, renamed, jids, times) in EXTENSIONS.items():
        rows = source.read(table, f"message_row_id long, {ddl}").where(F.col("message_row_id") > since)
        for row_id, jid in jids.items():
            rows = source.jid_of(rows, row_id, jid)
        rows = rows.withColumnsRenamed({"message_row_id": "_o", **renamed}).where(NEEDED.get(name, "true"))
        rows = rows.withColumns({t: fx.ms_to_ts(t) for t in times})
        rows = ids.join(rows, "_o").select("message_id", *(c for c in rows.columns if c != "_o"), "_o")
        if since < after and name in current:
            rows = _changed(current[name], merge.last_wins(rows, ["message_id"], ["_o"]))
        out |= _replaced(current, name, rows, ["message_id"], ["_o"])
        deltas[name] = Delta(merge.last_wins(rows, ["message_id"], ["_o"]).drop("_o"), ["message_id"])
    mentions = source.jid_of(source.read("message_mentions", "message_row_id long, jid_row_id long, display_name string").where(F.col("message_row_id") > since), "jid_row_id", "mentioned_jid")
    mentions = ids.join(mentions.withColumnRenamed("message_row_id", "_o"), "_o").where("mentioned_jid is not null").select("message_id", "mentioned_jid", "display_name")
    if since < after and "message_mentions" in current:
        late = _changed(current["message_mentions"], mentions).select("message_id").distinct()
        mentions = mentions.join(late, "message_id", "left_semi")
    deltas["message_mentions"] = Delta(mentions, ["message_id"])
    if source.deltas is not None:
        source.deltas.update(deltas)
    return out | {"message_mentions": merge.clear_insert(now(current, "message_mentions", mentions), mentions, ["message_id"])}


def system_events(source: Source, current: Tables, run_ts: Column) -> Tables:
    """System events with participants (by row id of the person), changed values and a sentence;
    messages get a stub where they lack the event's row."""
    rows = source.of_messages("message_system", "action_type long", "timestamp long", "system_events")
    people = source.jid_of(source.read("message_system_chat_participant", "message_row_id long, user_jid_row_id long").withColumn("_p", F.col("user_jid_row_id")), "user_jid_row_id", "jid").where("jid <> ''")
    people = people.groupBy(F.col("message_row_id").alias("rowid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "jid"))), lambda x: x["jid"]).alias("people"))
    values = source.read("message_system_value_change", "message_row_id long, old_data string").withColumnRenamed("message_row_id", "rowid")
    numbers = source.read("message_system_number_change", "message_row_id long, old_jid_row_id long, new_jid_row_id long").withColumnRenamed("message_row_id", "rowid")
    numbers = source.jid_of(source.jid_of(numbers, "old_jid_row_id", "old_jid"), "new_jid_row_id", "new_jid")
    rows = rows.join(people, "rowid", "left").join(values, "rowid", "left").join(numbers, "rowid", "left").withColumn("kind", fx.system_kind("action_type"))
    numbered, valued = F.col("kind").rlike("phone_number|lid_change"), F.col("kind").rlike("subject|description")
    rows = rows.withColumns({"old_value": F.when(numbered, F.col("old_jid")).when(valued, F.col("old_data")), "new_value": F.when(numbered, F.col("new_jid")), "_people": F.coalesce("people", F.array().cast("array<string>"))})
    first = F.get("_people", F.lit(0))
    events = rows.select("message_id", "action_type", "kind", fx.system_body("kind", "_people", "old_value", "new_value").alias("body"), F.when(fx.jid_kind(first).isin("user", "lid"), first).alias("actor_jid"), F.col("people").alias("affected_jids"), "old_value", "new_value", F.col("rowid").alias("_o"))
    stubs = rows.where("chat_jid is not null and coalesce(timestamp, 0) <> 0").select(F.col("message_id").alias("id"), F.col("rowid").alias("source_rowid"), "chat_jid", "from_me", fx.ms_to_ts("timestamp").alias("ts"), F.lit("system").alias("type"), F.lit(7).cast("long").alias("type_raw"), "key_id", F.lit(0).alias("starred"))
    have = now(current, "messages", new_messages(replace(source, counts=None)))
    if source.deltas and "messages" in source.deltas:
        # what the messages get so far is in ``have`` already
        gaps = merge.first_wins(stubs, ["id"], ["source_rowid"]).join(have.select("id"), "id", "left_anti")
        rows = source.deltas["messages"].rows
        source.deltas["messages"] = Delta(rows.unionByName(gaps, allowMissingColumns=True).select(rows.columns), ["id"])
    return _replaced(current, "system_events", events, ["message_id"], ["_o"]) | {"messages": merge.insert_ignore(have, stubs, ["id"], ["source_rowid"])}


def _add_ons(source: Source) -> DataFrame:
    """Reactions and votes with the message they belong to."""
    rows = source.read("message_add_on", "_id long, parent_message_row_id long, sender_jid_row_id long, key_id string, from_me long").withColumnsRenamed({"key_id": "add_on_key", "from_me": "add_on_from_me"})
    rows = source.jid_of(rows, "sender_jid_row_id", "who")
    parents = source.messages().select(F.lit(True).alias("parent_found"), F.col("rowid").alias("parent_message_row_id"), F.col("message_id").alias("parent_id"), F.col("chat_jid").alias("parent_chat_jid"), F.col("key_id").alias("parent_key_id"))
    return rows.join(parents, "parent_message_row_id", "left")


def _parentless() -> dict[str, Column]:
    return {"no message": F.col("parent_found").isNull(), "no chat": _blank("parent_chat_jid"), "no key": F.col("parent_key_id").isNull()}


def reactions(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Reactions; the first sighting stays."""
    raw = source.read("message_add_on_reaction", "message_add_on_row_id long, reaction string, sender_timestamp long").withColumnRenamed("message_add_on_row_id", "_id")
    new = source.counted("reactions", _add_ons(source).join(raw, "_id"), {**_parentless(), "no reaction key": _blank("add_on_key")}).select(
        fx.parent_id("parent_chat_jid", "parent_key_id").alias("parent_message_id"), "parent_chat_jid", "parent_key_id", F.col("add_on_key").alias("reaction_key_id"), F.col("who").alias("sender_jid"), F.col("add_on_from_me").cast("int").alias("sender_from_me"),
        F.col("reaction").alias("emoji"), fx.ms_to_ts("sender_timestamp").alias("sender_ts"), run_ts.alias("observed_ts"), F.col("_id").alias("_o"),
    )
    keys = ["parent_chat_jid", "parent_key_id", "reaction_key_id"]
    return {"reactions": merge.insert_ignore(now(current, "reactions", new.drop("_o")), merge.first_wins(new, keys, ["_o"]).drop("_o"), keys)}


def edits(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Edits by message and time; the first sighting stays."""
    rows = source.of_messages("message_edit_info", "edited_timestamp long, sender_timestamp long, original_key_id string", "timestamp long", "edits", {"no time": F.coalesce("edited_timestamp", F.lit(0)) == 0})
    new = rows.select("message_id", fx.ms_to_ts("edited_timestamp").alias("edited_ts"), fx.ms_to_ts("sender_timestamp").alias("sender_ts"), "original_key_id", fx.ms_to_ts("timestamp").alias("original_ts"), run_ts.alias("observed_ts"), F.col("rowid").alias("_o"))
    keys = ["message_id", "edited_ts"]
    return {"edits": merge.insert_ignore(now(current, "edits", new.drop("_o")), merge.first_wins(new, keys, ["_o"]).drop("_o"), keys)}


def calls(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Calls by id; participants are loaded anew."""
    raw = source.read("call_log", "_id long, call_id string, jid_row_id long, group_jid_row_id long, call_creator_device_jid_row_id long, from_me long, timestamp long, video_call long, duration long, call_result long, bytes_transferred long, is_dnd_mode_on long, call_type long, scheduled_id string")
    rows = source.counted("calls", raw, {"no call id": _blank("call_id")})
    for row_id, jid in {"jid_row_id": "peer_jid", "group_jid_row_id": "group_jid", "call_creator_device_jid_row_id": "creator_jid"}.items():
        rows = source.jid_of(rows, row_id, jid)
    new = rows.select("call_id", F.col("_id").alias("source_rowid"), "peer_jid", "group_jid", "creator_jid", "from_me", fx.ms_to_ts("timestamp").alias("ts"), F.col("video_call").alias("video"), F.col("duration").alias("duration_s"), F.col("call_result").alias("result"), "bytes_transferred", "is_dnd_mode_on", "call_type", "scheduled_id", F.col("_id").alias("_o"))
    people = source.jid_of(source.read("call_log_participant_v2", "call_log_row_id long, jid_row_id long, call_result long"), "jid_row_id", "participant_jid")
    people = people.join(raw.where("call_id <> ''").select(F.col("_id").alias("call_log_row_id"), "call_id"), "call_log_row_id").select("call_id", "participant_jid", F.col("call_result").alias("result"))
    return _replaced(current, "calls", new, ["call_id"], ["_o"]) | {"call_participants": people}


def polls(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Polls, options numbered from 0 by their row id, and votes as sorted option numbers."""
    rows = source.of_messages("message_poll", "selectable_options_count long, poll_type long, content_type long, end_time long, allow_add_option long, hide_participant_names long, invalid_state long", counted="polls")
    new = rows.select("message_id", F.col("selectable_options_count").alias("selectable_count"), "poll_type", "content_type", fx.ms_to_ts("end_time").alias("end_time_ts"), "allow_add_option", F.col("hide_participant_names").alias("hide_participants"), F.col("invalid_state").alias("invalid"), F.col("rowid").alias("_o"))
    options = source.read("message_poll_option", "_id long, message_row_id long, option_name string, vote_total long").join(rows.select(F.col("rowid").alias("message_row_id"), "message_id"), "message_row_id")
    place = (F.row_number().over(Window.partitionBy("message_id").orderBy("message_row_id", "_id")) - 1).cast("long")
    options = options.withColumn("option_index", place)
    listed = options.select("message_id", "option_index", "option_name", "vote_total")
    chosen = source.read("message_add_on_poll_vote_selected_option", "message_add_on_row_id long, message_poll_option_id long").join(options.select(F.col("_id").alias("message_poll_option_id"), "option_index"), "message_poll_option_id")
    chosen = chosen.groupBy(F.col("message_add_on_row_id").alias("_id")).agg(F.sort_array(F.collect_list("option_index")).alias("selected_indexes"))
    votes = source.read("message_add_on_poll_vote", "message_add_on_row_id long, sender_timestamp long").withColumnRenamed("message_add_on_row_id", "_id")
    votes = source.counted("poll_votes", _add_ons(source).join(votes, "_id"), _parentless()).join(chosen, "_id", "left").select(F.col("parent_id").alias("parent_message_id"), F.col("who").alias("voter_jid"), fx.ms_to_ts("sender_timestamp").alias("sender_ts"), F.coalesce("selected_indexes", F.array().cast("array<bigint>")).alias("selected_indexes"))
    old = now(current, "poll_options", listed).join(new.select("message_id").distinct(), "message_id", "left_anti")
    return _replaced(current, "polls", new, ["message_id"], ["_o"]) | {"poll_options": old.unionByName(listed), "poll_votes": votes}


def status_posts(source: Source, current: Tables, run_ts: Column) -> Tables:
    rows = source.of_messages("status_message_info", "status_distribution_mode long, audience_type long, can_be_reshared long, has_embedded_music long, is_mentioned long, status_mentions string, poster_status_id string", counted="status_posts")
    new = rows.select("message_id", F.col("sender_jid").alias("poster_jid"), F.col("status_distribution_mode").alias("distribution_mode"), "audience_type", "can_be_reshared", "has_embedded_music", "is_mentioned", F.col("status_mentions").alias("mention_jids"), "poster_status_id", F.col("rowid").alias("_o"))
    return _replaced(current, "status_posts", new, ["message_id"], ["_o"])


RECEIVED_ONLY = "media_url string, direct_path string, media_key binary, enc_file_hash string"


def status_archive(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Own statuses, their media and who saw them."""
    other = ~F.coalesce((F.col("from_me") == 1) & (F.col("chat_jid") == STATUS_CHAT), F.lit(False))
    rows = source.of_messages("status_message_info", "audience_type long", "timestamp long, received_timestamp long, message_type long, text_data string", "status_archive", {"not an own status": other})
    new = rows.select(F.col("message_id").alias("id"), F.lit("own").alias("kind"), "sender_jid", "chat_jid", fx.type_label("message_type").alias("type"), F.col("message_type").alias("type_raw"), fx.ms_to_ts("timestamp").alias("ts"), fx.ms_to_ts("received_timestamp").alias("received_ts"), F.col("text_data").alias("text"), "audience_type", "message_id", F.col("rowid").alias("_o"))
    base = now(current, "status_archive", new.drop("_o").withColumns({"is_archived": F.lit(None).cast("long"), "uuid": F.lit(None).cast("string")}))
    ids = rows.select("rowid", F.col("message_id").alias("status_id"))
    media = source.read("message_media", f"message_row_id long, {EXTENSIONS['message_media'][1]}").withColumnRenamed("message_row_id", "rowid").join(ids, "rowid")
    media = media.select("status_id", F.col("mime_type").alias("mime"), "width", "height", F.col("media_duration").alias("duration_s"), "file_size", "file_path", F.col("media_caption").alias("accessibility_label"), "file_hash", "media_name", F.col("rowid").alias("_o"))
    views = source.read("receipt_user", "_id long, message_row_id long, receipt_user_jid_row_id long, receipt_timestamp long, read_timestamp long, played_timestamp long").withColumnRenamed("message_row_id", "rowid")
    views = source.jid_of(views.join(ids, "rowid"), "receipt_user_jid_row_id", "viewer_jid").where("viewer_jid <> ''")
    views = views.select("status_id", "viewer_jid", fx.ms_to_ts("receipt_timestamp").alias("received_ts"), fx.ms_to_ts("read_timestamp").alias("read_ts"), fx.ms_to_ts("played_timestamp").alias("played_ts"), F.col("_id").alias("_o"))
    # columns that only received statuses fill
    links = {c: F.lit(None).cast(kind) for c, kind in (d.split() for d in RECEIVED_ONLY.split(", "))}
    return {
        "status_archive": merge.upsert(base, new, ["id"], order=["_o"]),
        "status_archive_media": merge.upsert(now(current, "status_archive_media", media.drop("_o").withColumns(links)), media, ["status_id"], order=["_o"]),
        "status_archive_views": merge.upsert(now(current, "status_archive_views", views.drop("_o")), views, ["status_id", "viewer_jid"], order=["_o"]),
    }


def received_statuses(backup: Source, current: Tables, run_ts: Column) -> Tables:
    """Statuses of others from the tables of a status backup: rows, media and thumbnails."""
    about = backup.read("status_info", "row_id long, chat_jid string").withColumnRenamed("row_id", "status_info_row_id")
    rows = backup.read("status", "row_id long, status_info_row_id long, uuid string, sender_user_jid string, type long, timestamp long, received_timestamp long, text_data string, audience_type long, is_archived long").join(about, "status_info_row_id", "left")
    rows = backup.counted("received_statuses", rows, {})
    empty_is_null = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = rows.withColumn("id", fx.received_status_id(empty_is_null("sender_user_jid"), empty_is_null("uuid")))
    new = rows.select("id", F.lit("received").alias("kind"), F.col("sender_user_jid").alias("sender_jid"), "chat_jid", fx.type_label("type").alias("type"), F.col("type").alias("type_raw"), fx.ms_to_ts("timestamp").alias("ts"), fx.ms_to_ts("received_timestamp").alias("received_ts"), F.col("text_data").alias("text"), "audience_type", F.lit(None).cast("string").alias("message_id"), "is_archived", "uuid", F.col("row_id").alias("_o"))
    ids = rows.select(F.col("row_id").alias("status_row_id"), F.col("id").alias("status_id"))
    files = backup.read("media_content", f"row_id long, mime_type string, width long, height long, media_duration long, file_size long, file_path string, accessibility_label string, file_hash string, media_name string, {RECEIVED_ONLY}").withColumnRenamed("row_id", "media_content_row_id")
    media = backup.read("status_media_link", "status_row_id long, media_content_row_id long").join(files, "media_content_row_id").join(ids, "status_row_id")
    media = media.withColumnsRenamed({"mime_type": "mime", "media_duration": "duration_s"}).select("status_id", "mime", "width", "height", "duration_s", "file_size", "file_path", "accessibility_label", "file_hash", "media_name", *(d.split()[0] for d in RECEIVED_ONLY.split(", ")), F.col("status_row_id").alias("_o"), F.col("media_content_row_id").alias("_m"))
    thumbs = backup.read("status_thumbnail", "status_row_id long, thumbnail binary, thumbnail_path string, highres_thumbnail_path string").join(ids, "status_row_id")
    thumbs = thumbs.select("status_id", "thumbnail", "thumbnail_path", "highres_thumbnail_path", F.col("status_row_id").alias("_o"))
    return {
        "status_archive": merge.upsert(now(current, "status_archive", new.drop("_o")), new, ["id"], keep=["kind", "message_id"], order=["_o"]),
        "status_archive_media": merge.upsert(now(current, "status_archive_media", media.drop("_o", "_m")), media, ["status_id"], order=["_o", "_m"]),
        "status_archive_thumbnails": merge.upsert(now(current, "status_archive_thumbnails", thumbs.drop("_o")), thumbs, ["status_id"], order=["_o"]),
    }


def newsletter(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Newsletter data, statistics of their messages, and reaction counts."""
    ddl = "name string, description string, handle string, picture_url string, preview_url string, invite_code string, subscribers_count long, verified long, suspended long, deleted long, privacy long, membership long"
    about = source.counted("newsletter", source.read("newsletter", f"chat_row_id long, {ddl}").join(source.chats(), "chat_row_id", "left"), {"no chat": F.col("chat_jid").isNull()})
    about = about.select("chat_jid", *(c.split()[0] for c in ddl.split(", ")), run_ts.alias("observed_at"), F.col("chat_row_id").alias("_o"))
    stats = "server_message_id long, view_count long, forwards_count long, comments_count long, is_paid_partnership long"
    posts = source.of_messages("newsletter_message", stats).select("message_id", *(c.split()[0] for c in stats.split(", ")), F.col("rowid").alias("_o"))
    counts = source.of_messages("newsletter_message_reaction", "_id long, reaction string, reaction_count long").where("reaction <> ''")
    counts = counts.select("message_id", F.col("reaction").alias("emoji"), F.coalesce("reaction_count", F.lit(0)).alias("count"), F.col("_id").alias("_o"))
    return {
        **_replaced(current, "newsletter_metadata", about, ["chat_jid"], ["_o"]),
        **_replaced(current, "newsletter_messages", posts, ["message_id"], ["_o"]),
        **_replaced(current, "newsletter_message_reactions", counts, ["message_id", "emoji"], ["_o"]),
    }


def transcriptions(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Audio data, and transcript segments numbered from 0 with their text cut out."""
    audio = source.of_messages("audio_data", "waveform binary, transcription_status long, transcription_locale long, transcription_id string", counted="transcriptions")
    audio = audio.select("message_id", "transcription_status", "transcription_locale", "transcription_id", F.col("waveform").isNotNull().cast("int").alias("has_waveform"), F.col("rowid").alias("_o"))
    parts = source.of_messages("transcription_segment", "_id long, substring_start long, substring_length long, timestamp long, duration long, confidence long", "text_data string")
    seq = (F.row_number().over(Window.partitionBy("message_id").orderBy("rowid", "_id")) - 1).cast("long")
    parts = parts.select("message_id", seq.alias("seq"), fx.segment("text_data", "substring_start", "substring_length").alias("text"), "substring_start", "substring_length", F.col("timestamp").alias("seg_ts"), F.col("duration").alias("duration_ms"), "confidence")
    return _replaced(current, "message_audio", audio, ["message_id"], ["_o"]) | {"message_transcription_segments": merge.clear_insert(now(current, "message_transcription_segments", parts), parts, ["message_id"])}


def vcards(source: Source, current: Tables, run_ts: Column) -> Tables:
    links = source.jid_of(source.read("message_vcard_jid", "vcard_row_id long, vcard_jid_row_id long"), "vcard_jid_row_id", "contact_jid").withColumnRenamed("vcard_row_id", "_id")
    new = source.of_messages("message_vcard", "_id long, vcard string", counted="vcards").join(links, "_id", "left").select("message_id", "contact_jid", "vcard")
    return {"message_vcards": merge.clear_insert(now(current, "message_vcards", new), new, ["message_id"])}


def bot_messages(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Bot messages with their rich response in one JSON value, and assistant threads."""
    bots = source.of_messages("bot_message_info", "target_id string, message_state long, invoker_jid_row_id long, bot_jid_row_id long, model_type long, message_disclaimer string, bot_response_id string", counted="bot_messages")
    bots = source.jid_of(source.jid_of(bots, "invoker_jid_row_id", "invoker_jid"), "bot_jid_row_id", "bot_jid")
    bots = merge.last_wins(bots, ["message_id"], ["rowid"]).select("message_id", F.lit(True).alias("_bot"), "target_id", "message_state", "invoker_jid", "bot_jid", "model_type", F.col("message_disclaimer").alias("disclaimer"), "bot_response_id")
    rich = source.of_messages("ai_rich_response_message_core_info", "ai_rich_response_message_type long, ai_rich_response_submessage_types string, planning_status long")
    rich = merge.last_wins(rich, ["message_id"], ["rowid"]).select("message_id", F.struct(F.col("ai_rich_response_message_type").alias("type"), F.col("ai_rich_response_submessage_types").alias("submessage_types"), "planning_status").alias("rich_response"))
    names = bots.columns[2:]
    own = [F.col(c) for c in names]
    some, more = F.col("_bot").isNotNull(), F.col("rich_response").isNotNull()
    both = bots.join(rich, "message_id", "full")
    # a rich response whose bot row is no longer in the source joins what is stored
    had = now(current, "bot_messages", both.select("message_id", F.lit("").alias("raw_json"))).select("message_id", F.col("raw_json").alias("_had"))
    both = both.join(had, "message_id", "left").withColumn("_old", F.from_json("_had", bots.select(*names).schema))
    stored = F.coalesce(F.array_contains(F.json_object_keys("_had"), names[0]), F.lit(False))
    raw = F.when(some & more, _json(*own, F.col("rich_response"))).when(some, _json(*own)).when(stored, _json(*(F.col(f"_old.{c}") for c in names), F.col("rich_response")))
    both = both.select("message_id", raw.otherwise(_json(F.col("rich_response"))).alias("raw_json"))
    threads = source.read("ai_thread_info", "thread_id_row_id long, title string, creation_ts long, last_message_timestamp long, variant long, unseen_message_count long, selected_mode long")
    threads = threads.select(F.col("thread_id_row_id").alias("thread_id"), _json(F.col("title"), _iso("creation_ts"), _iso("last_message_timestamp").alias("last_msg_ts"), F.col("variant"), F.col("unseen_message_count").alias("unseen"), F.col("selected_mode")).alias("raw_json"))
    return _replaced(current, "bot_messages", both, ["message_id"], []) | _replaced(current, "ai_threads", threads, ["thread_id"], [])


def templates(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Templates with their buttons by row id, as JSON."""
    rows = source.of_messages("message_template", "content_text_data string, footer_text_data string, template_id string, csat_trigger_expiration_ts long, category string, tag string", counted="templates")
    button = F.struct(F.col("_id").alias("id"), F.col("text_data").alias("text"), F.col("button_type").alias("type"), "used", "selected_index", F.col("extra_data").alias("extra"))
    buttons = source.read("message_template_button", "_id long, message_row_id long, text_data string, button_type long, used long, selected_index long, extra_data string").groupBy(F.col("message_row_id").alias("rowid")).agg(F.sort_array(F.collect_list(button)).alias("buttons"))
    rows = rows.join(buttons, "rowid", "left").withColumn("buttons", F.coalesce("buttons", F.array()))
    new = rows.select("message_id", _json(F.col("content_text_data").alias("content"), F.col("footer_text_data").alias("footer"), F.col("template_id"), _iso("csat_trigger_expiration_ts").alias("csat_expiry_ts"), F.col("category"), F.col("tag"), F.col("buttons")).alias("raw_json"), F.col("rowid").alias("_o"))
    return _replaced(current, "template_messages", new, ["message_id"], ["_o"])


def communities(source: Source, current: Tables, run_ts: Column) -> Tables:
    """Communities with their participants in order of identifier, as JSON."""
    people = source.read("parent_group_participants", "parent_group_jid_row_id long, user_jid_row_id long")
    people = source.jid_of(source.jid_of(people, "parent_group_jid_row_id", "parent_jid", "inner"), "user_jid_row_id", "user_jid", "inner")
    people = people.groupBy("parent_jid").agg(F.array_sort(F.collect_list("user_jid")).alias("participants"))
    rows = source.read("community_chat", "chat_row_id long, last_activity_ts long, join_ts long, closed long, nesting_state long").join(source.chats(), "chat_row_id", "left")
    rows = source.counted("communities", rows, {"no chat": _blank("chat_jid")}).withColumnRenamed("chat_jid", "parent_jid")
    rows = rows.join(people, "parent_jid", "left")
    new = rows.select("parent_jid", _json(_iso("last_activity_ts"), _iso("join_ts"), F.col("closed"), F.col("nesting_state"), F.coalesce("participants", F.array().cast("array<string>")).alias("participants")).alias("raw_json"), F.col("chat_row_id").alias("_o"))
    return _replaced(current, "communities", new, ["parent_jid"], ["_o"])


Extractor = Callable[[Source, Tables, Column], Tables]
#: In the order they run: later ones see what earlier ones made.
EXTRACTORS: list[Extractor] = [identities, chats, group_members, messages, system_events, reactions, edits, calls, polls, status_posts, status_archive, newsletter, transcriptions, vcards, bot_messages, templates, communities]


def extract_all(source: Source, current: Tables, run_ts: Column, after: int = 0, backup: Source | None = None, look_back: int | None = 0, extractors: Sequence[Extractor] | None = None) -> Tables:
    """The next version of every archive table, as lazy plans; received statuses only with a backup."""
    out = dict(current)
    for f in EXTRACTORS if extractors is None else extractors:
        out |= messages(source, out, run_ts, after, look_back) if f is messages else f(source, out, run_ts)
    return out | received_statuses(backup, out, run_ts) if backup else out


def skipped(source: Source) -> DataFrame:
    """Why messages were left out: reason and count."""
    rows = source.messages("timestamp long, message_type long")
    return rows.groupBy(first_reason(_message_reasons()).alias("reason")).agg(F.count("*").alias("rows")).where("reason is not null")


@dataclass
class _Asked(Source):
    """Notes the tables and columns that extractors ask for."""

    asked: dict[str, dict[str, None]] = field(default_factory=dict)

    def _table(self, name: str, columns: Sequence[str]) -> DataFrame | None:
        self.asked.setdefault(name, {}).update(dict.fromkeys(columns))
        return None


def asked(spark: SparkSession, extractors: Sequence[Extractor] | None = None) -> dict[str, list[str]]:
    """By source table, the columns that the extractors read."""
    note = _Asked(spark)
    for f in EXTRACTORS if extractors is None else extractors:
        f(note, {}, F.lit(None).cast("timestamp"))
    return {name: list(columns) for name, columns in note.asked.items()}


@dataclass
class Staged(Source):
    """Parquet copies of the tables, with messages already joined to their chat and sender."""

    resolved: DataFrame | None = None

    def messages(self, extra: str = "") -> DataFrame:
        if self.resolved is None:
            return super().messages(extra)
        more = {d.split()[0] for d in MESSAGE_COLUMNS.split(", ")} - {d.split()[0] for d in extra.split(", ") if d}
        return self.resolved.drop(*more)


def staged(source: Source, folder: str, extractors: Sequence[Extractor] | None = None) -> Staged:
    """Read every table that the extractors need once, with their columns only, into ``folder``."""
    spark = source.spark
    found = {name: (source._table(name, columns), columns) for name, columns in asked(spark, extractors).items()}
    found = {name: have.select(*(c for c in have.columns if c in columns)) for name, (have, columns) in found.items() if have is not None}

    def copy(name: str) -> DataFrame:
        found[name].write.parquet(f"{folder}/{name}")
        return spark.read.schema(found[name].schema).parquet(f"{folder}/{name}")

    with ThreadPoolExecutor(READERS) as pool:
        tables = dict(zip(found, pool.map(copy, found)))
    out = Staged(spark, tables, source.counts, source.deltas)
    if "message" in tables:
        out.messages(MESSAGE_COLUMNS).write.parquet(f"{folder}/_messages")
        out.resolved = spark.read.parquet(f"{folder}/_messages")
    return out
