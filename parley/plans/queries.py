"""The named queries over an archive (a dict of DataFrames); all are lazy.

Every top-k has a total order. Names are resolved after the limit, where a query
does not filter on them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators.merge import effective_contacts
from parley.plans.names import Archive, with_names

STATUS_CHAT = "status@broadcast"


def _all(conditions: Sequence[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def between(ts: str, since: str | datetime | None, until: str | datetime | None) -> Column:
    """Inclusive bounds; a bare date is its midnight."""
    at = lambda x: F.lit(x).cast("timestamp") if isinstance(x, str) else F.lit(x)
    return _all([F.col(ts) >= at(since) if since else None, F.col(ts) <= at(until) if until else None])


def list_chats(arch: Archive, kind: str | None = None, since=None, until=None, limit: int = 100, names: bool = True) -> DataFrame:
    per_chat = arch["messages"].groupBy(F.col("chat_jid").alias("jid")).agg(F.max("ts").alias("last_ts"), F.count("*").alias("message_count"))
    out = arch["chats"].select("jid", "kind", "subject").join(per_chat, "jid", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    out = out.where(_all([F.col("kind") == kind if kind else None, between("last_ts", since, until)]))
    out = out.orderBy(F.desc_nulls_last("last_ts"), "jid").limit(limit)
    return with_names(out, arch, "jid", "display_name") if names else out


def numbered_messages(arch: Archive) -> DataFrame:
    """Messages with their 1-based index in the chat and the chat's total."""
    w = Window.partitionBy("chat_jid")
    return arch["messages"].withColumns({"idx": F.row_number().over(w.orderBy("ts", "source_rowid", "id")), "total": F.count("*").over(w)})


def chat_message_at(arch: Archive, chat: str, index: int) -> str:
    """The id of the n-th message (1 oldest, -1 newest)."""
    if index == 0:
        raise ValueError("message indexes start at 1 (or -1 from the end)")
    one = arch["messages"].where(F.col("chat_jid") == chat)
    order = [F.col(c) for c in ("ts", "source_rowid", "id")]
    # skip to the wanted one: a single row reaches the driver
    rows = one.orderBy(*(order if index > 0 else [c.desc() for c in order])).offset(abs(index) - 1).limit(1).select("id").collect()
    if not rows:
        raise LookupError(f"no message {index} in this chat")
    return rows[0].id


def tail(arch: Archive, last: int) -> DataFrame:
    """The last messages of every chat, with their stable indexes."""
    return numbered_messages(arch).where(F.col("idx") > F.col("total") - last)


def chat_info(arch: Archive, chat: str | None = None) -> DataFrame:
    pick = (lambda df, c: df.where(F.col(c) == chat)) if chat else (lambda df, c: df)
    msgs = pick(arch["messages"], "chat_jid").groupBy(F.col("chat_jid").alias("jid")).agg(F.count("*").alias("message_count"), F.min("ts").alias("first_message_ts"), F.max("ts").alias("last_message_ts"))
    reacts = pick(arch["reactions"], "parent_chat_jid").groupBy(F.col("parent_chat_jid").alias("jid")).agg(F.count("*").alias("reaction_count"))
    chats = pick(arch["chats"], "jid").drop("last_message_ts")
    return with_names(chats.join(msgs, "jid", "left").join(reacts, "jid", "left").fillna(0, ["message_count", "reaction_count"]), arch, "jid", "display_name")


def members_for(arch: Archive, chat: str, include_history: bool = False, owner_jid: str | None = None) -> DataFrame:
    if chat.endswith(fx.PHONE_SERVER) or chat.endswith("@lid"):
        spark = arch["chats"].sparkSession
        rows = [(chat, "peer")] + ([(owner_jid, "owner")] if owner_jid else [])
        now = spark.createDataFrame(rows, "jid string, role string").withColumn("joined_ts", F.lit(None).cast("timestamp"))
    else:
        now = arch["chat_members"].where(F.col("chat_jid") == chat).select(F.col("member_jid").alias("jid"), fx.role("rank").alias("role"), "joined_ts")
    if include_history:
        left = arch["chat_members_history"].where((F.col("chat_jid") == chat) & (F.col("op") == "leave")).orderBy(F.desc("observed_at"), "member_jid").limit(200)
        now = now.unionByName(left.select(F.col("member_jid").alias("jid"), F.lit("left").alias("role"), F.col("observed_at").alias("joined_ts")))
    # superadmins sort with plain members
    return with_names(now, arch, "jid", "name").orderBy(F.col("role") != "admin", F.lower("name"), "jid")


def person_jids(arch: Archive, name: str) -> DataFrame:
    """Phones whose contact is the name or holds it, and the pseudonyms linked to them."""
    hit = effective_contacts(arch["contacts"]).where((F.col("name") == name) | fx.contains_folded("name", name)).select(F.col("phone_jid").alias("jid"))
    linked = arch["identity_links"].join(hit, F.col("phone_jid") == F.col("jid"), "left_semi").select(F.col("lid_jid").alias("jid"))
    return hit.union(linked).distinct()


def timeline_for_member(arch: Archive, name: str, limit: int = 100, since=None, until=None) -> DataFrame:
    rows = arch["messages"].where(between("ts", since, until)).join(person_jids(arch, name).withColumnRenamed("jid", "sender_jid"), "sender_jid", "left_semi")
    rows = rows.orderBy(F.desc("ts"), F.desc("source_rowid"), "id").limit(limit)
    media = arch["message_media"].select(F.col("message_id").alias("id"), "file_path", "mirrored_path", "mime")
    chats = arch["chats"].select(F.col("jid").alias("chat_jid"), F.col("kind").alias("chat_kind"), "subject")
    return rows.join(media, "id", "left").join(chats, "chat_jid", "left").select("id", "ts", "text", "type", "subject", "chat_kind", "chat_jid", "sender_jid", "file_path", "mirrored_path", "mime").orderBy(F.desc("ts"), "id")


def forgotten_contacts(arch: Archive, as_of: date, days: int = 365, limit: int = 50) -> DataFrame:
    """Contacts not written to since a day; date-granular, phone chats only."""
    sent = arch["messages"].where("from_me = 1").groupBy(F.col("chat_jid").alias("phone_jid")).agg(F.max("ts").alias("last_ts"))
    out = effective_contacts(arch["contacts"]).select("phone_jid", "name").join(sent, "phone_jid", "left")
    old = F.col("last_ts").isNull() | (F.to_date("last_ts") < F.date_sub(F.lit(as_of), days))
    return out.where(old).orderBy(F.asc_nulls_first("last_ts"), "phone_jid").limit(limit)


def search_messages(arch: Archive, needle: str, chat: str | None = None, since=None, until=None, limit: int = 50) -> DataFrame:
    media = arch["message_media"].select(F.col("message_id").alias("id"), "caption", "file_path", "mime")
    hit = arch["messages"].where(_all([F.col("chat_jid") == chat if chat else None, between("ts", since, until)])).join(media, "id", "left")
    hit = hit.where(fx.contains_folded("text", needle) | fx.contains_folded("caption", needle))
    top = hit.orderBy(F.desc("ts"), "id").limit(limit).join(arch["chats"].select(F.col("jid").alias("chat_jid"), "subject"), "chat_jid", "left")
    return with_names(top, arch, "sender_jid", "sender_name", "from_me")


def list_links(arch: Archive, chat: str | None = None, since=None, until=None, limit: int = 200) -> DataFrame:
    """Previews and links in texts: each branch is limited by message, then the first of
    each url stays (previews are not compared among themselves)."""
    msgs = arch["messages"].where(_all([F.col("chat_jid") == chat if chat else None, between("ts", since, until)]))
    order = [F.desc("ts"), F.desc("source_rowid"), F.col("id")]
    previews = msgs.join(arch["message_link_previews"].where("url is not null").withColumnRenamed("message_id", "id"), "id").orderBy(*order).limit(limit)
    previews = previews.select("url", "title", "ts", "chat_jid", "sender_jid")
    inline = msgs.where(F.lower("text").contains("http")).orderBy(*order).limit(limit)
    inline = inline.select("ts", "source_rowid", "id", "chat_jid", "sender_jid", F.posexplode(fx.urls("text")).alias("pos", "url"))
    w = Window.partitionBy("url").orderBy(*order, "pos")
    inline = inline.join(previews.select("url").distinct(), "url", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    both = previews.unionByName(inline.select("url", F.lit(None).cast("string").alias("title"), "ts", "chat_jid", "sender_jid"))
    return both.orderBy(F.desc("ts"), "url").limit(limit)


def list_status(arch: Archive, kind: str | None = None, sender: str | None = None, since=None, until=None, limit: int = 50, strict: bool = True) -> DataFrame:
    """``strict`` filters by sender after the limit, as the reference behaviour has it."""
    rows = arch["status_archive"].where(_all([F.col("kind") == kind if kind else None, between("ts", since, until)]))
    media = arch["status_archive_media"].select(F.col("status_id").alias("id"), "mime", "file_path", "media_name")
    rows = rows.join(media, "id", "left")
    top = lambda df: df.orderBy(F.desc_nulls_last("ts"), "id").limit(limit)
    named = with_names(top(rows) if strict or not sender else rows, arch, "sender_jid", "sender_name")
    if sender:
        named = named.where(fx.contains_folded("sender_name", sender))
    return named if strict else top(named)


def own_status_views(arch: Archive) -> DataFrame:
    """Own statuses with their numbers of viewers and reactions."""
    views = arch["status_archive_views"].groupBy(F.col("status_id").alias("id")).agg(F.count("*").alias("view_count"))
    reacts = arch["reactions"].where(F.col("parent_chat_jid") == STATUS_CHAT).groupBy(F.col("parent_key_id").alias("key_id")).agg(F.count("*").alias("reaction_count"))
    own = arch["status_archive"].where("kind = 'own'").withColumn("key_id", F.element_at(F.split("id", ":"), -1))
    return own.join(views, "id", "left").join(reacts, "key_id", "left").fillna(0, ["view_count", "reaction_count"])


def own_status_view_summary(arch: Archive, since=None, until=None, limit: int = 50, sort: str = "ts") -> DataFrame:
    out = own_status_views(arch).where(between("ts", since, until)).select("id", "ts", "type", "text", "view_count", "reaction_count")
    first = [F.desc("view_count")] if sort == "views" else []
    return out.orderBy(*first, F.desc_nulls_last("ts"), "id").limit(limit)


def resolve_own_status_id(arch: Archive, reference: str) -> str:
    """``latest``, ``top`` (most viewed), a number (k-th newest) or an id."""
    own = own_status_views(arch)
    if reference == "top":
        rows = own.orderBy(F.desc("view_count"), F.desc_nulls_last("ts"), "id").limit(1).collect()
    elif reference == "latest" or reference.isdigit():
        k = 1 if reference == "latest" else int(reference)
        rows = own.orderBy(F.desc_nulls_last("ts"), "id").offset(k - 1).limit(1).collect() if k > 0 else []
    else:
        return reference
    if not rows:
        raise LookupError(f"no own status for {reference!r}")
    return rows[0].id


def views_for_status(arch: Archive, status_id: str) -> DataFrame:
    rows = arch["status_archive_views"].where(F.col("status_id") == status_id)
    return with_names(rows, arch, "viewer_jid", "viewer_name").orderBy(F.desc_nulls_last(F.coalesce("read_ts", "received_ts")), "viewer_jid")


def reactions_for_status(arch: Archive, status_id: str) -> DataFrame:
    own = arch["status_archive"].where(F.col("id") == status_id).join(arch["messages"].select(F.col("id").alias("message_id"), F.col("chat_jid").alias("parent_chat_jid"), F.col("key_id").alias("parent_key_id")), "message_id")
    rows = own.select("parent_chat_jid", "parent_key_id").join(arch["reactions"], ["parent_chat_jid", "parent_key_id"])
    return with_names(rows, arch, "sender_jid", "sender_name", "sender_from_me").orderBy("sender_ts", "reaction_key_id")


def status_media(arch: Archive, status_id: str) -> DataFrame:
    thumbs = arch["status_archive_thumbnails"].select("status_id", F.lit(True).alias("has_thumb"))
    return arch["status_archive_media"].where(F.col("status_id") == status_id).join(thumbs, "status_id", "left").fillna(False, ["has_thumb"])


def receipts_for(arch: Archive, source: Archive, message_id: str) -> DataFrame:
    """Receipts stay in the source; joined by chat, direction and key."""
    msg = arch["messages"].where(F.col("id") == message_id).select("chat_jid", "from_me", "key_id")
    jid = source["jid"].select("_id", "raw_string")
    src = source["message"].select(F.col("_id").alias("message_row_id"), "chat_row_id", F.coalesce("from_me", F.lit(0)).cast("int").alias("from_me"), "key_id")
    chat = source["chat"].select(F.col("_id").alias("chat_row_id"), F.col("jid_row_id").alias("_id")).join(jid, "_id").select("chat_row_id", F.col("raw_string").alias("chat_jid"))
    hit = src.join(msg.withColumn("from_me", F.col("from_me").cast("int")), ["key_id", "from_me"]).join(chat, ["chat_row_id", "chat_jid"])
    got = source["receipt_user"].join(hit.select("message_row_id"), "message_row_id").join(jid.select(F.col("_id").alias("receipt_user_jid_row_id"), F.col("raw_string").alias("recipient_jid")), "receipt_user_jid_row_id", "left")
    r = fx.receipt(fx.ms_to_ts("read_timestamp"), fx.ms_to_ts("played_timestamp"), fx.ms_to_ts("receipt_timestamp"))
    return with_names(got.withColumn("r", r).select("recipient_jid", "r.status", "r.ts"), arch, "recipient_jid", "recipient").orderBy("ts", "recipient_jid")


def quick_stats(arch: Archive, tables: Sequence[str]) -> DataFrame:
    """(table, rows); a table that is not there has none."""
    spark = next(iter(arch.values())).sparkSession
    parts = [arch[t].agg(F.count("*").alias("rows")) if t in arch else spark.range(1).select(F.lit(0).cast("long").alias("rows")) for t in tables]
    return reduce(DataFrame.unionByName, [p.select(F.lit(t).alias("table"), "rows") for t, p in zip(tables, parts)])


def list_contacts(arch: Archive, source: str | None = None, limit: int = 1000) -> DataFrame:
    rows = arch["contacts"].where(F.col("source") == source) if source else effective_contacts(arch["contacts"])
    return rows.orderBy(F.lower("name"), "name", "phone_jid").limit(limit)


def sender_phones(arch: Archive) -> DataFrame:
    """Incoming messages by the phone behind their sender."""
    links = arch["identity_links"].select(F.col("lid_jid").alias("sender_jid"), F.col("phone_jid").alias("linked"))
    rows = arch["messages"].where("sender_jid is not null and from_me = 0").select("sender_jid", "ts").join(links, "sender_jid", "left")
    return rows.select(F.coalesce("linked", "sender_jid").alias("phone_jid"), F.col("sender_jid").alias("raw_jid"), "ts")


def unresolved_senders(arch: Archive, min_messages: int = 1, limit: int = 200) -> DataFrame:
    phones = sender_phones(arch).where(F.col("phone_jid").endswith(fx.PHONE_SERVER))
    # aggregate first: the anti join then sees one row for each phone
    per = phones.groupBy("phone_jid").agg(F.count("*").alias("message_count"), F.max("ts").alias("last_seen"), F.min("raw_jid").alias("sample_jid"))
    out = per.where(F.col("message_count") >= min_messages).join(arch["contacts"].select("phone_jid"), "phone_jid", "left_anti")
    return out.orderBy(F.desc("message_count"), "phone_jid").limit(limit)


def resolution_stats(arch: Archive) -> DataFrame:
    phones = sender_phones(arch).where(F.col("phone_jid").endswith(fx.PHONE_SERVER)).select("phone_jid").distinct()
    known = arch["contacts"].select("phone_jid", F.lit(1).alias("k")).dropDuplicates(["phone_jid"])
    return phones.join(known, "phone_jid", "left").agg(F.count("*").alias("total"), F.count("k").alias("resolved"))


def reaction_groups(arch: Archive, owner_name: str = "Me", known: DataFrame | None = None) -> DataFrame:
    """Reactions of a message by emoji: how many, and the distinct names."""
    named = with_names(arch["reactions"], arch, "sender_jid", "sender_name", "sender_from_me", owner_name, known)
    return named.groupBy("parent_chat_jid", "parent_key_id", "emoji").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("sender_name")).alias("names"))


def export_media(arch: Archive, chat: str, limit: int = 1000) -> DataFrame:
    msgs = arch["messages"].where(F.col("chat_jid") == chat).select(F.col("id").alias("message_id"), "ts")
    rows = arch["message_media"].join(msgs, "message_id").withColumn("path", F.coalesce("mirrored_path", "file_path")).where("path is not null")
    return rows.select("message_id", "ts", "path", fx.relative_path("path").alias("relative"), "mime").orderBy("ts", "message_id").limit(limit)


def most_reacted(arch: Archive, since, limit: int = 10) -> DataFrame:
    msgs = arch["messages"].where(between("ts", since, None)).select("id", "ts", F.col("chat_jid").alias("parent_chat_jid"), F.col("key_id").alias("parent_key_id"))
    return msgs.join(arch["reactions"], ["parent_chat_jid", "parent_key_id"]).groupBy("id", "ts").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def unengaged_chats(arch: Archive, before) -> DataFrame:
    """Chats whose last own message is older than a time, or that never had one."""
    own = arch["messages"].groupBy("chat_jid").agg(F.max(F.when(F.col("from_me") == 1, F.col("ts"))).alias("last_own_ts"))
    return own.where(F.col("last_own_ts").isNull() | (F.col("last_own_ts") < F.lit(before).cast("timestamp"))).orderBy("chat_jid")


def transcripts(arch: Archive) -> DataFrame:
    """Each message's segments joined in order."""
    return arch["message_transcription_segments"].groupBy("message_id").agg(F.expr("listagg(text, ' ') within group (order by seq)").alias("transcript"))


def search_transcripts(arch: Archive, needle: str) -> DataFrame:
    return transcripts(arch).where(fx.contains_folded("transcript", needle)).orderBy("message_id")


def _ambiguous(reference: str, names: Sequence[str]) -> LookupError:
    return LookupError(f"{reference!r} is ambiguous: " + ", ".join(names[:10]))


def resolve_chat(arch: Archive, reference: str, aliases: dict[str, str] | None = None, cache: Sequence[str] = ()) -> str:
    """A chat from an alias, a list number (up to 5 digits), an id, a subject, a contact
    or a phone number that has a chat or messages; ambiguity is an error that names up to ten
    candidates, the most recently active first."""
    reference = reference.strip()
    if aliases and reference in aliases:
        return aliases[reference]
    if reference.isdigit() and len(reference) <= 5:
        if not 1 <= int(reference) <= len(cache):
            raise LookupError(f"no chat number {reference}" + ("" if cache else ": list the chats first"))
        return cache[int(reference) - 1]
    if "@" in reference:
        return reference
    activity = arch["messages"].groupBy(F.col("chat_jid").alias("jid")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    named = arch["chats"].where(fx.contains_folded("subject", reference)).select("jid", "subject")
    hits = named.join(activity, "jid", "left").orderBy(F.desc_nulls_last("last"), "jid").limit(11).collect()
    if len(hits) == 1:
        return hits[0].jid
    if hits:
        raise _ambiguous(reference, [f"{h.subject} [{h.jid}]" for h in hits])
    people = effective_contacts(arch["contacts"]).where(fx.contains_folded("name", reference)).select("phone_jid", "name")
    linked = arch["identity_links"].join(people, "phone_jid").select(F.col("lid_jid").alias("jid"), F.lit(None).cast("string").alias("name"))
    ids = people.select(F.col("phone_jid").alias("jid"), "name").union(linked)
    active = ids.join(arch["chats"].select("jid").distinct(), "jid", "left_semi").join(activity, "jid").orderBy(F.desc("n"), F.desc_nulls_last("last"), "jid").limit(11).collect()
    first = people.orderBy("name", "phone_jid").limit(11).collect()
    if len(first) > 1 and len({a.name for a in active}) > 1:
        raise _ambiguous(reference, [f"{p.name} [{p.phone_jid}]" for p in first])
    if active:
        return active[0].jid
    if first:
        return first[0].phone_jid
    spark = arch["chats"].sparkSession
    phone = spark.range(1).select(fx.number_to_jid(F.lit(reference)).alias("jid")).first().jid
    if phone:
        here = arch["chats"].select("jid").union(arch["messages"].select("chat_jid")).where(F.col("jid") == phone)
        if here.limit(1).collect():
            return phone
    raise LookupError(f"no chat matches {reference!r}")


def resolve_message(arch: Archive, reference: str, **options) -> str:
    """A full id, ``chat:index`` or ``chat`` (its newest message)."""
    parts = reference.split(":")
    if len(parts) >= 3 and "@" in parts[0] and parts[1] in ("0", "1", "?"):
        return reference
    head, _, last = reference.rpartition(":")
    if head and last.lstrip("-").isdigit():
        return chat_message_at(arch, resolve_chat(arch, head, **options), int(last))
    return chat_message_at(arch, resolve_chat(arch, reference, **options), -1)


def explain_member(arch: Archive, chat: str, member: str) -> tuple[str, list[str]]:
    """The resolved name of an identifier and the steps that led to it."""
    trace = [f"kind of {member}"]
    phone = member
    one = arch["chat_members"].where((F.col("chat_jid") == chat) & (F.col("member_jid") == member)).limit(1).collect()
    trace.append(f"member of {chat} with rank {one[0]['rank']}" if one else f"not a current member of {chat}")
    if member.endswith("@lid"):
        link = arch["identity_links"].where(F.col("lid_jid") == member).limit(1).collect()
        phone = link[0].phone_jid if link else None
        trace.append(f"linked to {phone}" if phone else "no link to a phone")
    for table, key, value in (("contacts", "phone_jid", "name"), ("identity_display_names", "jid", "display_name")):
        got = arch[table].where(F.col(key).isin([x for x in (phone, member) if x])).limit(1).collect()
        trace.append(f"{table}: {got[0][value]}" if got else f"{table}: nothing")
    spark = arch["chats"].sparkSession
    name = with_names(spark.createDataFrame([(member,)], "jid string"), arch, "jid", "name").first().name
    return name, [*trace, f"resolved to {name}"]
