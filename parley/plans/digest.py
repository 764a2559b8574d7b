"""Chat digests: Markdown lines and JSON rows, each one ordered plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.plans.names import Archive, owner, resolved, with_names
from parley.plans.queries import numbered_messages, reaction_groups


def pseudonyms(rows: DataFrame) -> DataFrame:
    """(chat_jid, sender_jid, pseudonym): P1, P2, ... by first appearance in the chat."""
    first = rows.where("from_me = 0 and sender_jid is not null").groupBy("chat_jid", "sender_jid").agg(F.min("idx").alias("first"))
    n = F.row_number().over(Window.partitionBy("chat_jid").orderBy("first"))
    return first.select("chat_jid", "sender_jid", F.concat(F.lit("P"), n.cast("string")).alias("pseudonym"))


def last_messages(arch: Archive, chat: str, last: int) -> DataFrame:
    one = {**arch, "messages": arch["messages"].where(F.col("chat_jid") == chat)}
    return numbered_messages(one).where(F.col("idx") > F.col("total") - last)


def people_of(arch: Archive, rows: DataFrame, said: DataFrame, given: DataFrame, owner_name: str) -> DataFrame:
    """(jid, name) of all who sent, are quoted or reacted."""
    people = [rows.select(F.col("sender_jid").alias("jid")), said.select(F.col("quoted_sender_jid").alias("jid")), given.select(F.col("sender_jid").alias("jid"))]
    return resolved(arch, people[0].union(people[1]).union(people[2]), owner_name)


def digest_rows(arch: Archive, chat: str, last: int = 200, pseudonymise: bool = False, owner_name: str | None = None) -> DataFrame:
    """One row for each of the last messages with all that a digest shows."""
    owner_name = owner_name or owner_of(arch)
    rows = last_messages(arch, chat, last)
    shown = rows.select(F.col("id").alias("message_id"))
    # only what the messages shown have; all their people are resolved at once
    said = arch["message_quoted"].join(shown, "message_id", "left_semi")
    given = arch["reactions"].where(F.col("parent_chat_jid") == chat).join(rows.select(F.col("key_id").alias("parent_key_id")), "parent_key_id", "left_semi")
    known = None if pseudonymise else people_of(arch, rows, said, given, owner_name)
    if pseudonymise:
        rows = rows.join(pseudonyms(rows), ["chat_jid", "sender_jid"], "left").withColumn("sender", F.when(F.col("from_me") == 1, "ME").otherwise(F.coalesce("pseudonym", F.lit("?"))))
    else:
        rows = with_names(rows, arch, "sender_jid", "sender", "from_me", owner_name, known)
    have = arch["message_media"].columns
    parts = ("mime", "caption", "duration_s", "file_path", "mirrored_path", "file_size")
    fields = [F.col(c) if c in have else F.lit(None).cast("long" if c in ("duration_s", "file_size") else "string").alias(c) for c in parts]
    media = arch["message_media"].select(F.col("message_id").alias("id"), F.struct(*fields).alias("media"))
    if pseudonymise:  # of people who only were quoted or reacted nothing is shown
        said = said.withColumn("quoted_sender", F.lit("?"))
    else:
        said = with_names(said, arch, "quoted_sender_jid", "quoted_sender", known=known)
    quoted = said.select(F.col("message_id").alias("id"), F.struct("quoted_key_id", "quoted_text", "quoted_sender_jid", "quoted_sender").alias("quoted"))
    links = arch["message_link_previews"].select(F.col("message_id").alias("id"), F.struct("url", "title").alias("link"))
    edits = arch["edits"].groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("edit_count"))
    if pseudonymise:
        who = F.when(F.col("sender_from_me") == 1, "ME").otherwise(F.coalesce("pseudonym", F.lit("?")))
        people = pseudonyms(rows).drop("chat_jid")
        reacts = given.join(people, "sender_jid", "left").groupBy("parent_key_id", "emoji").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(who)).alias("names"))
    else:
        reacts = reaction_groups({**arch, "reactions": given}, owner_name, known)
    reacts = reacts.groupBy(F.col("parent_key_id").alias("key_id")).agg(F.array_sort(F.collect_list(F.struct("emoji", "n", "names"))).alias("reactions"))
    for part in (media, quoted, links, edits):
        rows = rows.join(part, "id", "left")
    return rows.join(reacts, "key_id", "left").orderBy("idx")


def owner_of(arch: Archive) -> str:
    """The owner's name; one small row."""
    row = owner(arch).first()
    return row.owner_name if row else "Me"


def _line(*parts: Column | str) -> Column:
    """An indented line with a Markdown line break; null if a part is."""
    return F.concat(F.lit("  "), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("  "))


def markdown(arch: Archive, chat: str, last: int = 200, pseudonymise: bool = False, owner_name: str | None = None) -> DataFrame:
    """(idx, line): the head at 0, then one block for each message; joined by newlines they are the digest."""
    owner_name = owner_name or owner_of(arch)
    rows = digest_rows(arch, chat, last, pseudonymise, owner_name)
    text = F.nullif("text", F.lit(""))
    lines = F.array_join(F.transform(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n"), lambda x: F.concat(F.lit("  "), x, F.lit("  "))), "\n")
    path = F.coalesce("media.mirrored_path", "media.file_path")
    some = lambda c, before, after="": F.coalesce(F.when(c.cast("string") != "", F.concat(F.lit(before), c.cast("string"), F.lit(after))), F.lit(""))
    media = F.concat(F.coalesce("media.mime", F.lit("?")), some(F.col("media.caption"), ' caption="', '"'), F.when(F.col("media.duration_s") != 0, some(F.col("media.duration_s"), " dur=", "s")).otherwise(""), some(path, " file="))
    given = F.array_join(F.transform("reactions", lambda r: F.concat(r["emoji"], F.lit("×"), r["n"].cast("string"), F.lit(" ("), F.array_join(r["names"], ", "), F.lit(")"))), "  ")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("**[#"), F.col("idx").cast("string"), F.lit("] ["), F.coalesce(fx.trimmed_ts("ts"), F.lit("?")), F.lit("] "), F.col("sender"), F.lit("** _("), F.col("type"), F.lit(")_  ")),
        F.when(F.col("quoted").isNotNull(), _line("↪ replying to ", F.coalesce("quoted.quoted_sender", F.lit("?")), ': "', F.coalesce(fx.shortened("quoted.quoted_text"), F.lit("")), '"')),
        lines,
        F.when(F.col("media").isNotNull(), _line("_[media: ", media, "]_")),
        F.when(F.col("link").isNotNull(), _line("_[link: ", F.col("link.url"), "]_")),
        F.when(F.col("link.title") != "", _line("_title: ", F.col("link.title"), "_")),
        F.when(F.size("reactions") > 0, _line("_reactions: ", given, "_")),
        F.when(F.col("edit_count") > 0, _line("_[edited ", F.col("edit_count").cast("string"), "× — current text above]_")),
        F.lit(""),
    )
    # a chat that is not among the chats still has a name, and its kind from its id
    this = arch["chats"].sparkSession.range(1).select(F.lit(chat).alias("jid"))
    kinds = arch["chats"].where(F.col("jid") == chat).select("jid", "kind").limit(1)
    title = with_names(this.join(kinds, "jid", "left"), arch, "jid", "title").select(F.coalesce("title", F.lit(chat)).alias("title"), F.coalesce("kind", fx.jid_kind(F.lit(chat))).alias("kind"))
    span = rows.agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    note = "- senders: pseudonymised (ME = owner, P1..PN = others)" if pseudonymise else f"- owner: {owner_name}"
    # two tables of one row each
    head = span.join(F.broadcast(title)).select(
        F.lit(0).alias("idx"),
        F.concat_ws("\n", F.concat(F.lit("# Digest: "), "title"), F.lit(""), F.concat(F.lit("- chat kind: "), "kind"), F.concat(F.lit("- messages: "), F.col("n").cast("string")), F.concat(F.lit("- range: "), fx.iso_utc("a"), F.lit(" … "), fx.iso_utc("z"), F.lit(" (UTC)")), F.lit(note), F.lit(""), F.lit("---"), F.lit("")).alias("line"),
    )
    return head.unionByName(rows.select("idx", block.alias("line"))).orderBy("idx")


def jsonl(arch: Archive, chat: str, last: int = 200, owner_name: str | None = None) -> DataFrame:
    """(idx, json): scalars keep nulls, absent sub-objects are left out."""
    owner_name = owner_name or owner_of(arch)
    rows = digest_rows(arch, chat, last, False, owner_name)
    given = with_names(arch["reactions"].where(F.col("parent_chat_jid") == chat), arch, "sender_jid", "sender_name", "sender_from_me", owner_name)
    given = given.groupBy(F.col("parent_key_id").alias("key_id")).agg(F.array_sort(F.collect_list(F.struct("emoji", "sender_name"))).alias("each"))
    rows = rows.drop("reactions").join(given, "key_id", "left")
    name = F.when((F.col("from_me") == 1) | F.col("sender_jid").isNotNull(), F.col("sender"))
    base = F.struct("idx", "id", fx.iso_utc("ts").alias("ts"), (F.col("from_me") == 1).alias("from_me"), "sender_jid", name.alias("sender_name"), "type", "text")
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(base, keep)
    quoted = F.when(F.col("quoted").isNotNull(), F.struct(F.col("quoted.quoted_sender_jid").alias("sender_jid"), F.col("quoted.quoted_text").alias("text")))
    extra = [F.when(c.isNotNull(), F.concat(F.lit(f',"{n}":'), F.to_json(c, keep))).otherwise("") for n, c in (("media", F.col("media")), ("quoted", quoted), ("reactions", F.col("each")))]
    return rows.select("idx", F.concat(head.substr(F.lit(1), F.length(head) - 1), *extra, F.lit("}")).alias("json")).orderBy("idx")
