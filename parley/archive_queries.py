"""Registered queries of the archive operators over the driver's tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators import merge
from parley.plans import digest, names
from parley.plans import queries as q
from parley.plans.driver_views import SQL as VIEWS
from parley.plans.driver_views import archive, phone, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The observation time of these checks.
RUN = "2025-01-01 00:00:00"


def run_ts() -> F.Column:
    return F.lit(RUN).cast("timestamp_ntz")


def query(sql: str | None = None, views: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {VIEWS} {sql}" if views else sql
        return f

    return register


@query("SELECT jid, 'group' AS kind, last_ts, coalesce(n, 0) AS message_count FROM chats LEFT JOIN (SELECT chat_jid, max(ts) AS last_ts, count(*) AS n FROM msg GROUP BY 1) m ON m.chat_jid = jid ORDER BY last_ts DESC NULLS LAST, jid LIMIT 22", True)
def chat_list(spark, d):
    return q.list_chats(archive(spark, d), limit=22, names=False).select("jid", "kind", "last_ts", "message_count")


@query("""SELECT ts, text, type, m.chat_jid, sender_jid FROM msg m WHERE sender_jid IN (SELECT phone_jid FROM contacts WHERE contains(lower(name), '00001') UNION SELECT lid_jid FROM links WHERE phone_jid IN (SELECT phone_jid FROM contacts WHERE contains(lower(name), '00001')))
ORDER BY ts DESC, source_rowid DESC LIMIT 50""", True)
def member_timeline(spark, d):
    return q.timeline_for_member(archive(spark, d), "00001", 50).select("ts", "text", "type", "chat_jid", "sender_jid")


_SP = "sp AS (SELECT coalesce(l.phone_jid, m.sender_jid) AS phone_jid, m.sender_jid AS raw_jid, m.ts FROM msg m LEFT JOIN links l ON l.lid_jid = m.sender_jid WHERE m.from_me = 0)"


@query(f", {_SP} SELECT phone_jid, count(*) AS message_count, max(ts) AS last_seen, min(raw_jid) AS sample_jid FROM sp WHERE phone_jid LIKE '%@s.whatsapp.net' AND phone_jid NOT IN (SELECT phone_jid FROM contacts) GROUP BY phone_jid HAVING count(*) >= 10 ORDER BY message_count DESC, phone_jid LIMIT 200", True)
def unresolved_senders(spark, d):
    return q.unresolved_senders(archive(spark, d), 10)


@query(f", {_SP} SELECT count(*) AS total, count(c.phone_jid) AS resolved FROM (SELECT DISTINCT phone_jid FROM sp WHERE phone_jid LIKE '%@s.whatsapp.net') p LEFT JOIN contacts c USING (phone_jid)", True)
def resolution_stats(spark, d):
    return q.resolution_stats(archive(spark, d))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS phone_jid, c_name AS name, m AS last_ts FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON o_custkey = c_custkey
WHERE m IS NULL OR CAST(m AS DATE) < DATE '1998-08-01' - 365 ORDER BY m ASC NULLS FIRST, phone_jid LIMIT 50""")
def forgotten_contacts(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    arch = {
        "messages": o.select(F.col("o_custkey").cast("string").alias("chat_jid"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("from_me")),
        "contacts": c.select(F.col("c_custkey").cast("string").alias("phone_jid"), F.col("c_name").alias("name"), F.lit("manual").alias("source")),
    }
    return q.forgotten_contacts(arch, date(1998, 8, 1))


@query("SELECT id, chat_jid, row_number() OVER (PARTITION BY chat_jid ORDER BY ts, source_rowid) AS idx, count(*) OVER (PARTITION BY chat_jid) AS total FROM msg", True)
def message_ordinal(spark, d):
    return q.numbered_messages(archive(spark, d)).select("id", "chat_jid", F.col("idx").cast("long").alias("idx"), "total")


@query("SELECT conv_id, count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id")
def conversation_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("SELECT id, ts, type, text FROM msg WHERE contains(lower(text), '7}') ORDER BY ts DESC, id LIMIT 50", True)
def search_messages(spark, d):
    return q.search_messages(archive(spark, d), "7}").select("id", "ts", "type", "text")


@query("SELECT l_orderkey, list_sort(list(i)) AS indexes FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem) GROUP BY l_orderkey")
def poll_ordinals(spark, d):
    """Orders as polls, their lines as options."""
    from parley.operators import extract as ex

    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("message_row_id"), F.col("l_linenumber").cast("long").alias("_id"))
    orders = lines.select("message_row_id").distinct()
    source = ex.Source(spark, {
        "jid": spark.createDataFrame([(1, "1@g.us")], "_id long, raw_string string"), "chat": spark.createDataFrame([(1, 1)], "_id long, jid_row_id long"),
        "message": orders.select(F.col("message_row_id").alias("_id"), F.lit(1).alias("chat_row_id"), F.col("message_row_id").cast("string").alias("key_id")),
        "message_poll": orders, "message_poll_option": lines,
    })
    options = ex.polls(source, {}, run_ts())["poll_options"].withColumn("l_orderkey", F.element_at(F.split("message_id", ":"), -1).cast("long"))
    return options.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("option_index")).alias("indexes"))


@query("SELECT CAST(conv_id AS VARCHAR) AS message_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript_concat(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("message_id"), F.col("turn").alias("seq"), "text")
    return q.transcripts({"message_transcription_segments": rows})


@query("SELECT doc_id, s, nullif(substr(text, s + 1, n), '') AS segment FROM (SELECT doc_id, text, doc_id % 50 AS s, doc_id % 7 AS n FROM documents) WHERE n > 0")
def transcript_segments(spark, d):
    rows = table(spark, d, "documents").withColumn("s", F.col("doc_id") % 50).withColumn("n", F.col("doc_id") % 7)
    return rows.where("n > 0").select("doc_id", "s", fx.segment("text", "s", "n").alias("segment"))


_PHONES = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '\+?[0-9][0-9 ()\-./]{6,}[0-9]')) AS raw FROM documents)"
_STRIP = r"regexp_replace(raw, '[\s()\-./]', '', 'g')"
_NORM = "CASE WHEN starts_with(r, '+') THEN substr(r, 2) WHEN starts_with(r, '00') THEN substr(r, 3) WHEN starts_with(r, '0') THEN '41' || substr(r, 2) ELSE r END"


@query(rf"SELECT raw, CASE WHEN regexp_full_match(r, '\+?[0-9]+') AND length(n) BETWEEN 7 AND 15 THEN n END AS number FROM (SELECT raw, r, {_NORM} AS n FROM (SELECT raw, {_STRIP} AS r FROM {_PHONES}))")
def normalize_phone(spark, d):
    hits = F.explode(F.regexp_extract_all("text", F.lit(r"\+?[0-9][0-9 ()\-./]{6,}[0-9]"), F.lit(0)))
    return table(spark, d, "documents").select(hits.alias("raw")).distinct().select("raw", fx.normalize_number("raw").alias("number"))


@query(r"SELECT page_id, regexp_replace(unnest(regexp_extract_all('see ' || url || ', and <' || url || '!>', 'https?://[^\s<>\"'')]+')), '[,.;:!?]+$', '') AS url FROM pages")
def url_clean(spark, d):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(", and <"), F.col("url"), F.lit("!>"))
    return table(spark, d, "pages").select("page_id", F.explode(fx.urls(text)).alias("url"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS trimmed FROM events")
def iso_seconds(spark, d):
    return table(spark, d, "events").select("event_id", fx.iso_utc("ts").alias("iso"), fx.trimmed_ts("ts").alias("trimmed"))


def _members(spark, d, where):
    return table(spark, d, "events").where(where).groupBy((F.col("event_id") % 20).alias("chat_jid"), F.col("user_id").alias("member_jid")).agg((F.max("event_id") % 3).cast("int").alias("rank"), F.min("ts").alias("joined_ts"))


def _members_sql(where):
    return f"SELECT event_id % 20 AS chat_jid, user_id AS member_jid, CAST(max(event_id) % 3 AS INT) AS rank, min(ts) AS joined_ts FROM events WHERE {where} GROUP BY 1, 2"


@query(f"""SELECT chat_jid, member_jid, CASE WHEN c.rank IS NULL THEN 'join' WHEN i.rank IS NULL THEN 'leave' ELSE 'role_change' END AS op, i.rank AS rank, c.rank AS old_rank
FROM ({_members_sql("event_type <> 'click'")}) c FULL JOIN ({_members_sql("event_type <> 'view'")}) i USING (chat_jid, member_jid) WHERE c.rank IS DISTINCT FROM i.rank""")
def membership_diff(spark, d):
    _, history = merge.membership_changes(_members(spark, d, "event_type <> 'click'"), _members(spark, d, "event_type <> 'view'"), run_ts())
    return history.select("chat_jid", "member_jid", "op", "rank", "old_rank")


@query(f"""SELECT chat_jid, member_jid, i.rank AS rank, coalesce(c.joined_ts, i.joined_ts) AS joined_ts
FROM ({_members_sql("event_type <> 'view'")}) i LEFT JOIN ({_members_sql("event_type <> 'click'")}) c USING (chat_jid, member_jid)""")
def merge_coalesce(spark, d):
    state, _ = merge.membership_changes(_members(spark, d, "event_type <> 'click'"), _members(spark, d, "event_type <> 'view'"), run_ts())
    return state


@query("""SELECT parent_chat_jid, parent_key_id, emoji, count(*) AS n, list_sort(list(DISTINCT coalesce(name, '+41 ' || substr(sender_jid, 3, 2) || ' ' || substr(sender_jid, 5, 3) || ' ' || substr(sender_jid, 8, 2) || ' ' || substr(sender_jid, 10, 2)))) AS names
FROM reacts LEFT JOIN contacts ON phone_jid = sender_jid GROUP BY 1, 2, 3""", True)
def reactions_by_type(spark, d):
    return q.reaction_groups(archive(spark, d))


@query("""SELECT url, min(page_id) AS first_page, count(*) AS seen FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages WHERE page_id % 2 = 0) GROUP BY url""")
def link_first_seen(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    both = p.unionByName(p.where("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 1000000))
    return both.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("seen"))


@query("""SELECT chat_jid, sender_jid, 'P' || CAST(row_number() OVER (PARTITION BY chat_jid ORDER BY f) AS VARCHAR) AS pseudonym FROM (SELECT chat_jid, sender_jid, min(idx) AS f FROM (
SELECT *, row_number() OVER (PARTITION BY chat_jid ORDER BY ts, source_rowid) AS idx FROM msg) WHERE from_me = 0 GROUP BY 1, 2)""", True)
def pseudonyms(spark, d):
    return digest.pseudonyms(q.numbered_messages(archive(spark, d)))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    """Documents as files of a mirrored folder."""
    from parley.sources.text import media_files

    path = F.concat(F.lit("/m/WhatsApp Documents/"), F.col("doc_id").cast("string"))
    files = table(spark, d, "documents").select(path.alias("path"), F.length("text").cast("long").alias("length"), F.encode("text", "utf-8").alias("content"), F.current_timestamp().alias("modificationTime"))
    return media_files(files).select(F.element_at(F.split("source_path", "/"), -1).cast("long").alias("doc_id"), F.col("file_hash").alias("hash"))


@query("""SELECT DISTINCT jid, CASE WHEN ends_with(jid, '@g.us') THEN 'group' WHEN ends_with(jid, '@s.whatsapp.net') THEN 'user' WHEN ends_with(jid, '@lid') THEN 'lid' ELSE 'other' END AS kind, split_part(jid, '@', 1) AS user_part, split_part(jid, '@', 2) AS server_part
FROM (SELECT sender_jid AS jid FROM msg UNION SELECT chat_jid FROM msg)""", True)
def jid_classify(spark, d):
    m = archive(spark, d)["messages"]
    ids = m.select(F.col("sender_jid").alias("jid")).union(m.select("chat_jid")).distinct()
    return ids.select("jid", fx.jid_kind("jid").alias("kind"), fx.jid_user("jid").alias("user_part"), fx.jid_server("jid").alias("server_part"))


@query("SELECT phone_jid, '+41 ' || substr(phone_jid, 3, 2) || ' ' || substr(phone_jid, 5, 3) || ' ' || substr(phone_jid, 8, 2) || ' ' || substr(phone_jid, 10, 2) AS pretty FROM contacts", True)
def pretty_phone(spark, d):
    return archive(spark, d)["contacts"].select("phone_jid", fx.pretty_phone("phone_jid").alias("pretty"))


#: The name of every sender.
NAMES = """SELECT DISTINCT m.sender_jid AS jid, CASE WHEN sender_jid LIKE '%@s.whatsapp.net' THEN coalesce(c.name, p1) WHEN l.phone_jid IS NULL THEN coalesce(s.display_name, 'lid:' || split_part(sender_jid, '@', 1))
    WHEN starts_with(coalesce(lc.name, p2), '+') THEN coalesce(s.display_name, p2) ELSE lc.name END AS name
FROM (SELECT *, '+41 ' || substr(sender_jid, 3, 2) || ' ' || substr(sender_jid, 5, 3) || ' ' || substr(sender_jid, 8, 2) || ' ' || substr(sender_jid, 10, 2) AS p1 FROM msg) m
LEFT JOIN contacts c ON c.phone_jid = m.sender_jid
LEFT JOIN (SELECT *, '+41 ' || substr(phone_jid, 3, 2) || ' ' || substr(phone_jid, 5, 3) || ' ' || substr(phone_jid, 8, 2) || ' ' || substr(phone_jid, 10, 2) AS p2 FROM links) l ON l.lid_jid = m.sender_jid
LEFT JOIN contacts lc ON lc.phone_jid = l.phone_jid LEFT JOIN (SELECT * FROM shown WHERE display_name LIKE 'Shown%') s ON s.jid = m.sender_jid"""


@query(NAMES, True)
def resolve_names(spark, d):
    arch = archive(spark, d)
    return names.resolved(arch, arch["messages"].select(F.col("sender_jid").alias("jid")))


@query("SELECT id, chat_jid, idx FROM (SELECT id, chat_jid, row_number() OVER (PARTITION BY chat_jid ORDER BY ts, source_rowid) AS idx, count(*) OVER (PARTITION BY chat_jid) AS total FROM msg) WHERE idx > total - 20", True)
def digest_tail(spark, d):
    return q.tail(archive(spark, d), 20).select("id", "chat_jid", F.col("idx").cast("long").alias("idx"))


@query("""SELECT url, title, page_id AS ts FROM (SELECT page_id, url, 'page' AS title FROM pages WHERE page_id % 2 = 0 ORDER BY page_id DESC LIMIT 60)
UNION ALL SELECT url, NULL, page_id FROM (SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 60) WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0 ORDER BY page_id DESC LIMIT 60) ORDER BY ts DESC, url LIMIT 60""")
def link_list(spark, d):
    p = table(spark, d, "pages")
    ids = p.select(F.col("page_id").alias("source_rowid"), F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("ts"), F.lit("c").alias("chat_jid"), F.lit("s").alias("sender_jid"))
    own = p.where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("message_id"), "url", F.lit("page").alias("title"))
    texts = p.select(F.col("page_id").cast("string").alias("id"), F.concat(F.lit("see "), "url", F.lit(",")).alias("text"))
    return q.list_links({"messages": ids.join(texts, "id"), "message_link_previews": own}, limit=60).select("url", "title", "ts")


_KEEP = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _orders(spark, d, where, price=0.0):
    return table(spark, d, "orders").where(where).select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") + price).alias("o_totalprice"))


@query(f"SELECT {_KEEP} FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def merge_replace(spark, d):
    return merge.replace(_orders(spark, d, "o_orderkey % 3 = 0"), _orders(spark, d, "o_orderkey % 2 = 0", 1.0), ["o_orderkey"])


@query(f"SELECT {_KEEP} FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def merge_ignore(spark, d):
    return merge.insert_ignore(_orders(spark, d, "o_orderkey % 3 = 0"), _orders(spark, d, "o_orderkey % 2 = 0", 1.0), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def merge_upsert_keep(spark, d):
    return merge.upsert(_orders(spark, d, "o_orderkey % 3 = 0"), _orders(spark, d, "o_orderkey % 2 = 0", 1.0), ["o_orderkey"], keep=["o_totalprice"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber < 3) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber < 3")
def clear_insert(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return merge.clear_insert(rows, rows.where("l_orderkey % 4 = 0 and l_linenumber < 3"), ["l_orderkey"])


_LINK = "SELECT CAST(user_id AS VARCHAR) AS lid_jid, CAST(max(event_id % 4) AS VARCHAR) AS phone_jid FROM events WHERE {} GROUP BY user_id"


@query(f"SELECT i.lid_jid AS lid_jid, i.phone_jid AS phone_jid, 'set' AS op FROM ({_LINK.format("event_type <> 'view'")}) i LEFT JOIN ({_LINK.format("event_type = 'click'")}) c USING (lid_jid) WHERE c.phone_jid IS DISTINCT FROM i.phone_jid")
def link_cdc(spark, d):
    side = lambda where: table(spark, d, "events").where(where).groupBy(F.col("user_id").cast("string").alias("lid_jid")).agg(F.max(F.col("event_id") % 4).cast("string").alias("phone_jid"))
    current = side("event_type = 'click'").withColumns({"first_observed_ts": run_ts(), "last_observed_ts": run_ts()})
    _, history = merge.link_changes(current, side("event_type <> 'view'"), run_ts())
    return history.select("lid_jid", "phone_jid", "op")


@query("""SELECT coalesce(c.k, i.k) AS phone_jid, i.n AS name, CASE WHEN i.n IS NULL THEN 'remove' ELSE 'set' END AS op FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n FROM customer WHERE c_custkey % 3 = 0) c
FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS n FROM customer WHERE c_custkey % 2 = 0) i ON c.k = i.k WHERE c.n IS DISTINCT FROM i.n""")
def contact_cdc(spark, d):
    c = table(spark, d, "customer").withColumn("phone_jid", F.col("c_custkey").cast("string"))
    now = c.where("c_custkey % 3 = 0").select("phone_jid", F.col("c_name").alias("name"), F.lit("address_book").alias("source"), run_ts().alias("updated_at"))
    inc = c.where("c_custkey % 2 = 0").select("phone_jid", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return merge.contact_changes(now, inc, run_ts())[1].select("phone_jid", "name", "op")


@query("SELECT CAST(c_custkey AS VARCHAR) AS jid FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 3 <> 0 OR c_custkey % 5 = 0)")
def snapshot_history(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_custkey").cast("string").alias("jid"), F.col("c_mktsegment").alias("subject"), F.lit(0).alias("archived"))
    inc = c.where("c_custkey % 2 = 0").withColumn("archived", F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0))
    return merge.snapshot_changes(c.where("c_custkey % 3 = 0").drop("c_custkey"), inc.drop("c_custkey"), "jid", ["subject", "archived"], run_ts()).select("jid")


@query("SELECT event_id, event_type FROM events WHERE event_id > 5000")
def incremental_scan(spark, d):
    return table(spark, d, "events").where(F.col("event_id") > 5000).select("event_id", "event_type")


@query("SELECT o_orderkey, c_name AS peer, n.n_name AS creator, r_name AS grp FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def call_dimensions(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", F.col("c_name").alias("peer"), F.col("n_name").alias("creator"), F.col("r_name").alias("grp"))


def _statuses(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return {
        "status_archive": c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("own").alias("kind"), F.col("c_custkey").alias("ts"), F.lit("text").alias("type"), F.col("c_name").alias("text")),
        "status_archive_views": o.where("o_orderstatus = 'O'").select(F.col("o_custkey").cast("string").alias("status_id")),
        "reactions": o.where("o_orderstatus = 'F' and o_custkey % 2 = 0").select(F.lit(q.STATUS_CHAT).alias("parent_chat_jid"), F.col("o_custkey").cast("string").alias("parent_key_id")),
    }


_STATUS = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS ts, coalesce(v.n, 0) AS view_count, coalesce(r.n, 0) AS reaction_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) v ON v.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 GROUP BY 1) r ON r.o_custkey = c_custkey"


@query(f"{_STATUS} ORDER BY view_count DESC, ts DESC LIMIT 50")
def status_summary(spark, d):
    return q.own_status_view_summary(_statuses(spark, d), sort="views").select("id", "ts", "view_count", "reaction_count")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY c_custkey DESC LIMIT 1 OFFSET 2")
def status_kth(spark, d):
    return spark.createDataFrame([(q.resolve_own_status_id(_statuses(spark, d), "3"),)], "id string")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'read' WHEN user_id % 2 = 0 THEN 'played' ELSE 'delivered' END AS status, ts + CASE WHEN user_id % 3 = 0 THEN INTERVAL 2 HOUR WHEN user_id % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS ts FROM events""")
def receipt_status(spark, d):
    u = F.col("user_id")
    r = fx.receipt(F.when(u % 3 == 0, F.col("ts") + F.expr("interval 2 hours")), F.when(u % 2 == 0, F.col("ts") + F.expr("interval 1 hour")), F.col("ts"))
    return table(spark, d, "events").select("event_id", r.alias("r")).select("event_id", "r.status", "r.ts")


@query("""SELECT c_nationkey AS chat, c_name AS name, role, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN role = 'admin' THEN 0 ELSE 1 END, lower(c_name)) AS place
FROM (SELECT c_nationkey, c_name, CASE c_custkey % 4 WHEN 0 THEN 'member' WHEN 1 THEN 'admin' WHEN 2 THEN 'superadmin' ELSE 'rank_3' END AS role FROM customer)""")
def member_sort(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("chat"), F.col("c_name").alias("name"), fx.role(F.col("c_custkey") % 4).alias("role"))
    place = F.row_number().over(Window.partitionBy("chat").orderBy(F.col("role") != "admin", F.lower("name")))
    return rows.withColumn("place", place.cast("long"))


# Fixed values, written out for the SQL: what the labels and sentences must be.
_LABELS = """
    WHEN 0 THEN 'text'
    WHEN 1 THEN 'image'
    WHEN 2 THEN 'audio'
    WHEN 3 THEN 'video'
    WHEN 4 THEN 'contact'
    WHEN 5 THEN 'location'
    WHEN 7 THEN 'system'
    WHEN 9 THEN 'document'
    WHEN 10 THEN 'call_log'
    WHEN 11 THEN 'empty'
    WHEN 13 THEN 'gif'
    WHEN 15 THEN 'deleted'
    WHEN 16 THEN 'template'
    WHEN 20 THEN 'sticker'
    WHEN 25 THEN 'product'
    WHEN 27 THEN 'group_invite'
    WHEN 28 THEN 'list'
    WHEN 36 THEN 'poll'
    WHEN 42 THEN 'text'
    WHEN 90 THEN 'reaction_stub'
"""
_SYSTEM = """
    WHEN 1 THEN 'group_subject_change'
    WHEN 4 THEN 'group_chat_participant_added'
    WHEN 5 THEN 'group_chat_participant_left'
    WHEN 6 THEN 'group_subject_change'
    WHEN 7 THEN 'group_chat_participant_removed'
    WHEN 11 THEN 'group_created'
    WHEN 12 THEN 'group_chat_participant_added'
    WHEN 14 THEN 'group_chat_participant_removed'
    WHEN 15 THEN 'group_chat_participant_left'
    WHEN 18 THEN 'encryption_change'
    WHEN 19 THEN 'ephemeral_change'
    WHEN 20 THEN 'group_chat_participant_promoted'
    WHEN 21 THEN 'group_chat_participant_demoted'
    WHEN 25 THEN 'group_icon_change'
    WHEN 27 THEN 'phone_number_change'
    WHEN 46 THEN 'video_call_missed'
    WHEN 50 THEN 'blocked_contact'
    WHEN 56 THEN 'voice_call_missed'
    WHEN 58 THEN 'business_state'
    WHEN 61 THEN 'group_description_change'
    WHEN 67 THEN 'ephemeral_setting_off'
    WHEN 68 THEN 'ephemeral_setting_on'
    WHEN 101 THEN 'lid_change'
"""


@query(f"SELECT event_id, CASE event_id % 100 {_LABELS} ELSE 'unknown_' || CAST(event_id % 100 AS VARCHAR) END AS label FROM events")
def type_labels(spark, d):
    return table(spark, d, "events").select("event_id", fx.type_label(F.col("event_id") % 100).alias("label"))


_BODY = """CASE
    WHEN kind = 'group_created' THEN 'Group created'
    WHEN kind = 'group_icon_change' THEN 'Group icon changed'
    WHEN kind = 'group_description_change' THEN 'Group description changed'
    WHEN kind = 'encryption_change' THEN 'Encryption details changed'
    WHEN kind = 'ephemeral_setting_off' THEN 'Disappearing messages: off'
    WHEN kind = 'ephemeral_setting_on' THEN 'Disappearing messages: on'
    WHEN kind = 'blocked_contact' THEN 'Block status changed'
    WHEN kind = 'video_call_missed' THEN 'Missed video call'
    WHEN kind = 'voice_call_missed' THEN 'Missed voice call'
    WHEN kind = 'group_chat_participant_added' THEN CASE WHEN len(p) > 0 THEN 'Added ' || array_to_string(p, ', ') ELSE 'Participant added' END
    WHEN kind = 'group_chat_participant_removed' THEN CASE WHEN len(p) > 0 THEN 'Removed ' || array_to_string(p, ', ') ELSE 'Participant removed' END
    WHEN kind = 'group_chat_participant_left' THEN CASE WHEN len(p) > 0 THEN 'Left: ' || array_to_string(p, ', ') ELSE 'Participant left' END
    WHEN kind = 'group_chat_participant_promoted' THEN CASE WHEN len(p) > 0 THEN 'Promoted ' || array_to_string(p, ', ') ELSE 'Participant promoted' END
    WHEN kind = 'group_chat_participant_demoted' THEN CASE WHEN len(p) > 0 THEN 'Demoted ' || array_to_string(p, ', ') ELSE 'Participant demoted' END
    WHEN kind = 'group_subject_change' AND o IS NULL THEN 'Subject changed'
    WHEN kind = 'group_subject_change' THEN 'Subject changed: ' || coalesce(o, '?') || ' → ?'
    WHEN kind = 'phone_number_change' THEN 'Phone number changed: ' || coalesce(o, '?') || ' → ?'
    WHEN kind = 'lid_change' THEN 'LID changed: ' || coalesce(o, '?') || ' → ?'
    ELSE 'System event: ' || kind END
"""


@query(f"""SELECT event_id, kind, {_BODY} AS body FROM (SELECT event_id, CASE event_id % 110 {_SYSTEM} ELSE 'unknown_system_' || CAST(event_id % 110 AS VARCHAR) END AS kind,
CASE WHEN event_id % 2 = 0 THEN [CAST(user_id AS VARCHAR), 'x'] ELSE [] END AS p, CASE WHEN event_id % 3 = 0 THEN event_type END AS o FROM events)""")
def system_event_bodies(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", fx.system_kind(e % 110).alias("kind"), F.when(e % 2 == 0, F.array(F.col("user_id").cast("string"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("p"), F.when(e % 3 == 0, F.col("event_type")).alias("o"))
    return rows.select("event_id", "kind", fx.system_body("kind", "p", "o", F.lit(None).cast("string")).alias("body"))


@query("SELECT c_name AS name, '+41 79 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS number FROM customer WHERE c_name IS NOT NULL")
def vcard_roundtrip(spark, d):
    from parley.sources.text import parse_vcards

    c = table(spark, d, "customer")
    card = F.concat(F.lit("BEGIN:VCARD\r\nVERSION:3.0\r\nFN:"), "c_name", F.lit("\r\nTEL;TYPE=CELL:+41 79\r\n  "), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit("\r\nEND:VCARD\r\n"))
    return parse_vcards(c.select(card.alias("value"))).select("name", "number")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES) + " UNION ALL SELECT 'absent', 0")
def table_stats(spark, d):
    return q.quick_stats({t: table(spark, d, t) for t in TABLES}, [*TABLES, "absent"])


@query("SELECT id, ts, count(*) AS n FROM msg m JOIN reacts r ON r.parent_chat_jid = m.chat_jid AND r.parent_key_id = m.key_id GROUP BY 1, 2 ORDER BY n DESC, id LIMIT 10", True)
def most_reacted(spark, d):
    return q.most_reacted(archive(spark, d), None)


@query("SELECT chat_jid, max(ts) FILTER (from_me = 1) AS last_own_ts FROM msg GROUP BY 1 HAVING last_own_ts IS NULL OR last_own_ts < TIMESTAMP '2030-01-01' ORDER BY 1", True)
def unengaged_chats(spark, d):
    return q.unengaged_chats(archive(spark, d), "2030-01-01 00:00:00")


def _full(spark, d):
    """The archive view with members and their past, media, quotes, link previews and edits."""
    arch = archive(spark, d)
    ev = table(spark, d, "events")
    m = arch["messages"]
    id_ = F.col("event_id").cast("string")
    arch["chat_members"] = m.groupBy("chat_jid", F.col("sender_jid").alias("member_jid")).agg((F.max("source_rowid") % 3).cast("int").alias("rank"), F.min("ts").alias("joined_ts"))
    arch["message_media"] = ev.where("event_id % 4 = 0").select(
        F.col("event_id").cast("string").alias("message_id"), F.concat(F.lit("Media/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("file_path"),
        F.lit(None).cast("string").alias("mirrored_path"), F.when(F.col("event_type") == "view", "seen").alias("caption"), F.when(F.col("event_type") != "error", "image/jpeg").alias("mime"), F.lit(3).alias("duration_s"),
    )
    arch["edits"] = ev.where("event_id % 6 = 0").select(F.col("event_id").cast("string").alias("message_id"))
    # quotes of two lines and more than a digest shows of them
    quote = F.concat("props", F.lit("\n"), F.repeat("props", 20))
    arch["message_quoted"] = ev.where("event_id % 3 = 0").select(id_.alias("message_id"), F.concat(F.lit("q"), id_).alias("quoted_key_id"), F.when(F.col("event_type") != "error", quote).otherwise(F.col("props")).alias("quoted_text"), phone(F.col("event_id") % 150).alias("quoted_sender_jid"))
    arch["message_link_previews"] = ev.where("event_id % 7 < 3").select(id_.alias("message_id"), F.concat(F.lit("https://x.org/"), id_).alias("url"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("title"))
    arch["chat_members_history"] = m.where("source_rowid % 5 < 2").select("chat_jid", F.col("sender_jid").alias("member_jid"), F.when(F.col("source_rowid") % 5 == 0, "leave").otherwise("join").alias("op"), F.col("ts").alias("observed_at"))
    return arch


@query("""SELECT jid, coalesce(m.n, 0) AS message_count, coalesce(r.n, 0) AS reaction_count, m.a AS first_message_ts, m.z AS last_message_ts FROM chats
LEFT JOIN (SELECT chat_jid, count(*) AS n, min(ts) AS a, max(ts) AS z FROM msg GROUP BY 1) m ON m.chat_jid = jid LEFT JOIN (SELECT parent_chat_jid, count(*) AS n FROM reacts GROUP BY 1) r ON r.parent_chat_jid = jid""", True)
def chat_info(spark, d):
    return q.chat_info(archive(spark, d)).select("jid", "message_count", "reaction_count", "first_message_ts", "last_message_ts")


@query(f""", nm AS ({NAMES}) SELECT sender_jid AS jid, nm.name AS name, CASE max(source_rowid) % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'admin' ELSE 'superadmin' END AS role, min(ts) AS joined_ts
FROM msg JOIN nm ON nm.jid = sender_jid WHERE chat_jid = '3@g.us' GROUP BY 1, 2""", True)
def members_for(spark, d):
    return q.members_for(_full(spark, d), "3@g.us").select("jid", "name", "role", "joined_ts")


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY ts, source_rowid) AS n FROM msg WHERE chat_jid = '7@g.us') WHERE n = 4 UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY ts DESC, source_rowid DESC) AS n FROM msg WHERE chat_jid = '7@g.us') WHERE n IN (1, 2)", True)
def message_references(spark, d):
    arch = archive(spark, d)
    return spark.createDataFrame([(q.resolve_message(arch, r),) for r in ("7@g.us:4", "7@g.us:-2", "7@g.us")], "id string")


@query("SELECT phone_jid, name FROM contacts ORDER BY lower(name), name, phone_jid LIMIT 1000", True)
def list_contacts(spark, d):
    return q.list_contacts(archive(spark, d)).select("phone_jid", "name")


@query("SELECT CAST(event_id AS VARCHAR) AS message_id, ts, event_type || '/' || CAST(event_id AS VARCHAR) AS relative, 'Media/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path FROM events WHERE event_id % 4 = 0 AND event_id % 20 = 8 ORDER BY ts, message_id LIMIT 1000")
def export_media(spark, d):
    return q.export_media(_full(spark, d), "8@g.us").select("message_id", "ts", "relative", "path")


@query("""SELECT DISTINCT sender_jid AS jid, CASE WHEN sender_jid LIKE '%@lid' THEN lc.name IS NOT NULL OR s.jid IS NOT NULL ELSE c.name IS NOT NULL END AS known FROM msg m
LEFT JOIN contacts c ON c.phone_jid = m.sender_jid LEFT JOIN links l ON l.lid_jid = m.sender_jid LEFT JOIN contacts lc ON lc.phone_jid = l.phone_jid LEFT JOIN (SELECT * FROM shown WHERE display_name LIKE 'Shown%') s ON s.jid = m.sender_jid""", True)
def known_senders(spark, d):
    arch = archive(spark, d)
    return names.is_known(arch, arch["messages"].select(F.col("sender_jid").alias("jid")))


@query("""SELECT sender_jid AS owner_jid, coalesce(name, 'Me') AS owner_name FROM (SELECT sender_jid FROM msg WHERE from_me = 1 ORDER BY ts DESC, source_rowid DESC LIMIT 1) LEFT JOIN contacts ON phone_jid = sender_jid""", True)
def owner_name(spark, d):
    return names.owner(archive(spark, d))


@query(f", {_SP} SELECT count(*) AS total, count(c.phone_jid) AS resolved, round(100.0 * count(c.phone_jid) / count(*), 1) AS percent FROM (SELECT DISTINCT phone_jid FROM sp WHERE phone_jid LIKE '%@s.whatsapp.net') p LEFT JOIN contacts c USING (phone_jid)", True)
def resolution_percent(spark, d):
    from parley.plans.run import resolution_percent as percent

    return percent(archive(spark, d))


_OWNER = "(SELECT coalesce(any_value(name), 'Me') FROM (SELECT sender_jid FROM msg WHERE from_me = 1 ORDER BY ts DESC, source_rowid DESC LIMIT 1) o LEFT JOIN contacts ON phone_jid = sender_jid)"
_PRETTY = "'+41 ' || substr({0}, 3, 2) || ' ' || substr({0}, 5, 3) || ' ' || substr({0}, 8, 2) || ' ' || substr({0}, 10, 2)"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({0}, '%f') = '000000' THEN '' ELSE '.' || strftime({0}, '%f') END || '+00:00'"
#: The last 20 messages of a chat with names, and reactions with names.
_DIGEST = f"""nm AS ({NAMES}),
lastm AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts, source_rowid) AS idx, count(*) OVER () AS total FROM msg WHERE chat_jid = '0@g.us') WHERE idx > total - 20),
named AS (SELECT l.* EXCLUDE (quoted), CASE WHEN from_me = 1 THEN {_OWNER} ELSE nm.name END AS sender, e.event_type AS et, CASE WHEN source_rowid % 3 = 0 THEN quoted END AS quoted, quoted_jid, coalesce(qc.name, {_PRETTY.format('quoted_jid')}) AS quoted_sender
    FROM (SELECT *, '4179' || lpad(CAST(source_rowid % 150 AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS quoted_jid, CASE WHEN type <> 'error' THEN text || chr(10) || repeat(text, 20) ELSE text END AS quoted FROM lastm) l
    JOIN nm ON nm.jid = l.sender_jid JOIN events e ON e.event_id = l.source_rowid LEFT JOIN contacts qc ON qc.phone_jid = quoted_jid),
given AS (SELECT r.parent_key_id AS key_id, r.emoji, coalesce(c.name, {_PRETTY.format('r.sender_jid')}) AS who FROM reacts r LEFT JOIN contacts c ON c.phone_jid = r.sender_jid WHERE r.parent_chat_jid = '0@g.us')"""


@query(f""", {_DIGEST},
parts AS (SELECT key_id, string_agg(emoji || '×' || n || ' (' || names || ')', '  ' ORDER BY emoji) AS line FROM (SELECT key_id, emoji, count(*) AS n, array_to_string(list_sort(list(DISTINCT who)), ', ') AS names FROM given GROUP BY 1, 2) GROUP BY 1)
SELECT 0 AS idx, '# Digest: <group 0>' || chr(10) || chr(10) || '- chat kind: group' || chr(10) || '- messages: ' || count(*) || chr(10) || '- range: ' || {_ISO.format('min(ts)')} || ' … ' || {_ISO.format('max(ts)')} || ' (UTC)' || chr(10) || '- owner: ' || {_OWNER} || chr(10) || chr(10) || '---' || chr(10) AS line FROM lastm
UNION ALL SELECT idx, '**[#' || idx || '] [' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || sender || '** _(' || type || ')_  ' || chr(10)
    || CASE WHEN quoted IS NOT NULL THEN '  ↪ replying to ' || quoted_sender || ': "' || CASE WHEN length(trim(replace(quoted, chr(10), ' '))) > 140 THEN substr(trim(replace(quoted, chr(10), ' ')), 1, 140) || '…' ELSE trim(replace(quoted, chr(10), ' ')) END || '"  ' || chr(10) ELSE '' END
    || '  ' || text || '  ' || chr(10)
    || CASE WHEN source_rowid % 4 = 0 THEN '  _[media: ' || CASE WHEN et = 'error' THEN '?' ELSE 'image/jpeg' END || CASE WHEN et = 'view' THEN ' caption="seen"' ELSE '' END || ' dur=3s file=Media/' || et || '/' || id || ']_  ' || chr(10) ELSE '' END
    || CASE WHEN source_rowid % 7 < 3 THEN '  _[link: https://x.org/' || id || ']_  ' || chr(10) || CASE WHEN et <> 'click' THEN '  _title: ' || et || '_  ' || chr(10) ELSE '' END ELSE '' END
    || CASE WHEN line IS NOT NULL THEN '  _reactions: ' || line || '_  ' || chr(10) ELSE '' END
    || CASE WHEN source_rowid % 6 = 0 THEN '  _[edited 1× — current text above]_  ' || chr(10) ELSE '' END FROM named LEFT JOIN parts USING (key_id)""", True)
def digest_markdown(spark, d):
    return digest.markdown(_full(spark, d), "0@g.us", 20).select(F.col("idx").cast("long").alias("idx"), "line")


@query(f""", {_DIGEST},
parts AS (SELECT key_id, to_json(list(struct_pack(emoji := emoji, sender_name := who) ORDER BY emoji, who)) AS line FROM given GROUP BY 1)
SELECT idx, regexp_replace(CAST(to_json(struct_pack(idx := idx, id := id, ts := {_ISO.format('ts')}, from_me := from_me = 1, sender_jid := sender_jid, sender_name := sender, "type" := type, "text" := text)) AS VARCHAR), '\\}}$', '')
    || CASE WHEN source_rowid % 4 = 0 THEN ',"media":' || CAST(to_json(struct_pack(mime := CASE WHEN et <> 'error' THEN 'image/jpeg' END, caption := CASE WHEN et = 'view' THEN 'seen' END, duration_s := 3, file_path := 'Media/' || et || '/' || id, mirrored_path := CAST(NULL AS VARCHAR), file_size := CAST(NULL AS BIGINT))) AS VARCHAR) ELSE '' END
    || CASE WHEN quoted IS NOT NULL THEN ',"quoted":' || CAST(to_json(struct_pack(sender_jid := quoted_jid, "text" := quoted)) AS VARCHAR) ELSE '' END
    || CASE WHEN line IS NOT NULL THEN ',"reactions":' || CAST(line AS VARCHAR) ELSE '' END || '}}' AS json FROM named LEFT JOIN parts USING (key_id)""", True)
def digest_jsonl(spark, d):
    return digest.jsonl(_full(spark, d), "0@g.us", 20).select(F.col("idx").cast("long").alias("idx"), "json")


def _status_archive(spark, d):
    """Customers as statuses, orders as who saw and what reacted."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    own = c.select(F.concat(F.lit("status@broadcast:1:"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_acctbal") > 5000, "own").otherwise("received").alias("kind"), phone(F.col("c_custkey")).alias("sender_jid"), F.timestamp_seconds(F.col("c_custkey").cast("long") * 1000).cast("timestamp_ntz").alias("ts"), F.lit("text").alias("type"), F.col("c_name").alias("text")).withColumn("message_id", F.col("id"))
    status = F.concat(F.lit("status@broadcast:1:"), key)
    return archive(spark, d) | {
        "status_archive": own,
        "status_archive_media": c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("status@broadcast:1:"), F.col("c_custkey").cast("string")).alias("status_id"), F.lit("image/png").alias("mime"), F.col("c_name").alias("file_path"), F.lit(None).cast("string").alias("media_name")),
        "status_archive_thumbnails": c.where("c_acctbal < 0").select(F.concat(F.lit("status@broadcast:1:"), F.col("c_custkey").cast("string")).alias("status_id")),
        "status_archive_views": o.select(status.alias("status_id"), phone(F.col("o_orderkey") % 1000).alias("viewer_jid"), F.col("o_orderdate").alias("received_ts"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("read_ts")),
        "messages": own.select("id", F.lit("status@broadcast").alias("chat_jid"), F.element_at(F.split("id", ":"), -1).alias("key_id"), "sender_jid", F.lit(1).alias("from_me"), "ts", F.lit(1).alias("source_rowid")),
        "reactions": o.where("o_orderstatus = 'F'").select(F.lit(q.STATUS_CHAT).alias("parent_chat_jid"), key.alias("parent_key_id"), F.col("o_orderkey").cast("string").alias("reaction_key_id"), F.col("o_orderpriority").alias("emoji"), phone(F.col("o_orderkey") % 1000).alias("sender_jid"), F.lit(0).alias("sender_from_me"), F.col("o_orderdate").alias("sender_ts")),
    }


_ST = "st AS (SELECT 'status@broadcast:1:' || c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'own' ELSE 'received' END AS kind, c_custkey, make_timestamp(CAST(c_custkey AS BIGINT) * 1000000000) AS ts, c_name AS text, c_mktsegment, c_acctbal FROM customer)"
_WHO = f"coalesce(name, {_PRETTY.format('who')})"


@query(f", {_ST} SELECT id, ts, text, coalesce(name, {_PRETTY.format('pj')}) AS sender_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'image/png' END AS mime FROM (SELECT *, '4179' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS pj FROM st WHERE kind = 'received') LEFT JOIN contacts ON phone_jid = pj || '@s.whatsapp.net' ORDER BY ts DESC, id LIMIT 50", True)
def list_status(spark, d):
    return q.list_status(_status_archive(spark, d), kind="received").select("id", "ts", "text", "sender_name", "mime")


@query(f", {_ST} SELECT id, sender_name FROM (SELECT id, coalesce(name, {_PRETTY.format('pj')}) AS sender_name FROM (SELECT *, '4179' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS pj FROM st ORDER BY ts DESC, id LIMIT 50) LEFT JOIN contacts ON phone_jid = pj || '@s.whatsapp.net') WHERE contains(lower(sender_name), '4')", True)
def status_sender_after_limit(spark, d):
    return q.list_status(_status_archive(spark, d), sender="4").select("id", "sender_name")


@query(f", v AS (SELECT '4179' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS who, o_orderdate AS received_ts, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS read_ts FROM orders WHERE o_custkey = 4) SELECT who AS viewer_jid, {_WHO} AS viewer_name, received_ts, read_ts FROM v LEFT JOIN contacts ON phone_jid = who", True)
def views_for_status(spark, d):
    return q.views_for_status(_status_archive(spark, d), "status@broadcast:1:4").select("viewer_jid", "viewer_name", "received_ts", "read_ts")


@query(f", v AS (SELECT '4179' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS who, o_orderpriority AS emoji, o_orderdate AS sender_ts FROM orders WHERE o_custkey = 4 AND o_orderstatus = 'F') SELECT who AS sender_jid, {_WHO} AS sender_name, emoji, sender_ts FROM v LEFT JOIN contacts ON phone_jid = who", True)
def reactions_for_status(spark, d):
    return q.reactions_for_status(_status_archive(spark, d), "status@broadcast:1:4").select("sender_jid", "sender_name", "emoji", "sender_ts")


@query("SELECT 'status@broadcast:1:' || c_custkey AS status_id, 'image/png' AS mime, c_name AS file_path, c_acctbal < 0 AS has_thumb FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')")
def status_media(spark, d):
    first = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").agg(F.min("c_custkey")).first()[0]
    return q.status_media(_status_archive(spark, d), f"status@broadcast:1:{first}").select("status_id", "mime", "file_path", "has_thumb")


@query("""SELECT k AS phone_jid, i.n AS name, CASE WHEN i.n IS NULL THEN 'remove' ELSE 'set' END AS op FROM
(SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n FROM customer WHERE c_acctbal >= 0) c FULL JOIN
(SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_nationkey < 5 THEN c_name || '!' ELSE c_name END AS n FROM customer WHERE c_mktsegment <> 'BUILDING') i USING (k)
WHERE c.n IS DISTINCT FROM i.n AND NOT (i.n IS NOT NULL AND k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3))""")
def contact_sync_pinned(spark, d):
    c = table(spark, d, "customer").withColumn("phone_jid", F.col("c_custkey").cast("string"))
    row = lambda source: ("phone_jid", F.col("c_name").alias("name"), F.lit(source).alias("source"), run_ts().alias("updated_at"))
    current = c.where("c_acctbal >= 0").select(*row("address_book")).unionByName(c.where("c_nationkey = 3").select(*row("manual")))
    incoming = c.where("c_mktsegment <> 'BUILDING'").select("phone_jid", F.when(F.col("c_nationkey") < 5, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return merge.contact_changes(current, incoming, run_ts())[1].select("phone_jid", "name", "op")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS phone_jid, CASE WHEN c_nationkey < 5 THEN c_name || '!' ELSE c_name END AS name FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3 AND NOT (c_acctbal >= 0 AND c_nationkey >= 5)""")
def vcard_import(spark, d):
    c = table(spark, d, "customer").withColumn("phone_jid", F.col("c_custkey").cast("string"))
    row = lambda source: ("phone_jid", F.col("c_name").alias("name"), F.lit(source).alias("source"), run_ts().alias("updated_at"))
    current = c.where("c_acctbal >= 0").select(*row("address_book")).unionByName(c.where("c_nationkey = 3").select(*row("manual")))
    incoming = c.where("c_mktsegment <> 'BUILDING'").select("phone_jid", F.when(F.col("c_nationkey") < 5, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return merge.add_contacts(current, incoming, run_ts(), "vcard")[1].select("phone_jid", "name")


@query("SELECT event_id AS k, CASE WHEN user_id < 100 THEN '4179' || lpad(CAST(user_id AS VARCHAR), 7, '0') || '@s.whatsapp.net' END AS jid, CASE WHEN user_id >= 100 THEN 'x' END AS bad FROM events")
def phone_arguments(spark, d):
    raw = F.when(F.col("user_id") < 100, F.concat(F.lit("079 "), F.lpad(F.col("user_id").cast("string"), 7, "0"))).otherwise(F.concat(F.col("user_id").cast("string"), F.lit("@lid")))
    rows = table(spark, d, "events").select(F.col("event_id").alias("k"), fx.phone_argument(raw).alias("p"))
    return rows.select("k", F.col("p.jid").alias("jid"), F.when(F.col("p.error").isNotNull(), "x").alias("bad"))


@query("SELECT id, ts, type FROM msg WHERE contains(lower(text), 'seen') OR (source_rowid % 4 = 0 AND type = 'view') ORDER BY ts DESC, id LIMIT 50", True)
def search_captions(spark, d):
    return q.search_messages(_full(spark, d), "SEEN").select("id", "ts", "type")


#: A stretch of the events' time, bounds included, by whole days of the data.
_BOUNDS = "(SELECT date_trunc('day', min(ts)) + INTERVAL 2 DAY AS a, date_trunc('day', min(ts)) + INTERVAL 9 DAY AS z FROM events)"


def _bounds(spark, d):
    row = table(spark, d, "events").agg(F.expr("date_trunc('day', min(ts)) + interval 2 days").alias("a"), F.expr("date_trunc('day', min(ts)) + interval 9 days").alias("z")).first()
    return {"since": row.a, "until": row.z}


@query(f"SELECT id, ts, type FROM msg, {_BOUNDS} WHERE ts >= a AND ts <= z AND contains(lower(text), '7') ORDER BY ts DESC, id LIMIT 50", True)
def search_between(spark, d):
    return q.search_messages(archive(spark, d), "7", **_bounds(spark, d)).select("id", "ts", "type")


@query(f"""SELECT ts, text, type, m.chat_jid, sender_jid FROM msg m, {_BOUNDS} WHERE ts >= a AND ts <= z AND sender_jid IN (SELECT phone_jid FROM contacts WHERE contains(lower(name), '0000') UNION SELECT lid_jid FROM links WHERE phone_jid IN (SELECT phone_jid FROM contacts WHERE contains(lower(name), '0000')))
ORDER BY ts DESC, source_rowid DESC LIMIT 50""", True)
def timeline_between(spark, d):
    return q.timeline_for_member(archive(spark, d), "0000", 50, **_bounds(spark, d)).select("ts", "text", "type", "chat_jid", "sender_jid")


@query(f"SELECT jid, coalesce(n, 0) AS message_count, last_ts FROM chats JOIN (SELECT chat_jid, count(*) AS n, max(ts) AS last_ts FROM msg GROUP BY 1) ON chat_jid = jid, {_BOUNDS} WHERE last_ts >= a ORDER BY last_ts DESC, jid LIMIT 100", True)
def chats_since(spark, d):
    return q.list_chats(archive(spark, d), since=_bounds(spark, d)["since"], names=False).select("jid", "message_count", "last_ts")


@query(f""", nm AS ({NAMES}), past AS (SELECT sender_jid, ts FROM msg WHERE chat_jid = '5@g.us' AND source_rowid % 5 = 0 ORDER BY ts DESC, sender_jid LIMIT 200)
SELECT sender_jid AS jid, nm.name AS name, CASE max(source_rowid) % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'admin' ELSE 'superadmin' END AS role, min(ts) AS joined_ts FROM msg JOIN nm ON nm.jid = sender_jid WHERE chat_jid = '5@g.us' GROUP BY 1, 2
UNION ALL SELECT sender_jid, nm.name, 'left', ts FROM past JOIN nm ON nm.jid = sender_jid""", True)
def members_with_past(spark, d):
    return q.members_for(_full(spark, d), "5@g.us", include_history=True).select("jid", "name", "role", "joined_ts")


@query(f"SELECT jid, name FROM ({NAMES}) WHERE jid IN (SELECT min(sender_jid) FROM msg WHERE sender_jid LIKE '%@lid' UNION SELECT max(sender_jid) FROM msg WHERE sender_jid LIKE '%@lid' UNION SELECT min(sender_jid) FROM msg WHERE sender_jid LIKE '%@s.whatsapp.net')", True)
def explained_members(spark, d):
    arch = _full(spark, d)
    ends = arch["messages"].agg(*(F.expr(f"{f}(sender_jid) filter (where sender_jid like '%{s}')") for f, s in (("min", "@lid"), ("max", "@lid"), ("min", "@s.whatsapp.net")))).first()
    return spark.createDataFrame([(jid, q.explain_member(arch, "0@g.us", jid)[0]) for jid in set(ends) if jid], "jid string, name string")


@query("""SELECT 'team 7.' AS reference, min(jid) AS jid FROM (SELECT DISTINCT CAST(event_id % 20 AS VARCHAR) || '@g.us' AS jid FROM events WHERE event_id % 3 <> 0) WHERE 'Team ' || replace(jid, '@g.us', '.') = 'Team 7.'
UNION ALL SELECT name, phone_jid FROM (SELECT c.name, c.phone_jid FROM contacts c WHERE phone_jid IN (SELECT '4179' || lpad(CAST(user_id % 100 AS VARCHAR), 7, '0') || '@s.whatsapp.net' FROM events WHERE event_id % 3 = 0) ORDER BY name LIMIT 1)
UNION ALL SELECT '079 0000099', CASE WHEN count(*) > 0 THEN '41790000099@s.whatsapp.net' END FROM events WHERE event_id % 3 = 0 AND user_id % 100 = 99
UNION ALL SELECT 'x@g.us', 'x@g.us' UNION ALL SELECT 'nobody at all', NULL""", True)
def resolve_chats(spark, d):
    """References of every kind, over an archive with groups and chats of two."""
    arch, ev = archive(spark, d), table(spark, d, "events")
    two = phone(F.col("user_id") % 100)
    arch["messages"] = ev.select(F.when(F.col("event_id") % 3 == 0, two).otherwise(F.concat((F.col("event_id") % 20).cast("string"), F.lit("@g.us"))).alias("chat_jid"), "ts")
    ids = arch["messages"].select(F.col("chat_jid").alias("jid")).distinct()
    arch["chats"] = ids.withColumn("subject", F.when(F.col("jid").endswith("@g.us"), F.concat(F.lit("Team "), fx.jid_user("jid"), F.lit("."))))
    name = arch["contacts"].join(ids, F.col("phone_jid") == F.col("jid"), "left_semi").agg(F.min("name")).first()[0]

    def found(reference):
        try:
            return q.resolve_chat(arch, reference)
        except LookupError:
            return None

    return spark.createDataFrame([(r, found(r)) for r in ("team 7.", name, "079 0000099", "x@g.us", "nobody at all") if r], "reference string, jid string")


@query("SELECT '4179' || lpad(CAST(c_custkey % 50 AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS phone_jid, arg_max(c_name, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS name FROM customer GROUP BY 1")
def vcard_order(spark, d):
    """A file for each nation, and many cards for a number: the last one counts."""
    from parley.sources.text import card_contacts, parse_vcards

    c = table(spark, d, "customer")
    card = F.concat(F.lit("BEGIN:VCARD\r\nFN:"), "c_name", F.lit("\r\nTEL:+41 79 "), F.lpad((F.col("c_custkey") % 50).cast("string"), 7, "0"), F.lit("\r\nEND:VCARD\r\n"))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("card")))), lambda x: x["card"])
    files = c.groupBy(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("path")).agg(F.array_join(cards, "").alias("value"))
    none = spark.createDataFrame([], "phone_jid string, name string, source string, updated_at timestamp_ntz")
    return merge.add_contacts(none, card_contacts(parse_vcards(files)), run_ts(), "vcard", ["place"])[0].select("phone_jid", "name")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '[' || CASE WHEN event_type <> 'error' THEN 'image/jpeg ' ELSE '' END || 'Media/' || event_type || '/' || event_id || ']' END AS tag FROM events")
def media_tags(spark, d):
    ev = table(spark, d, "events")
    path = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Media/"), "event_type", F.lit("/"), F.col("event_id").cast("string")))
    return ev.select("event_id", fx.media_tag(F.lit(None).cast("string"), path, F.when(F.col("event_type") != "error", "image/jpeg")).alias("tag"))


@query(f", top AS (SELECT jid, max(ts) AS last_ts, count(ts) AS message_count FROM chats LEFT JOIN msg ON chat_jid = jid GROUP BY 1 ORDER BY last_ts DESC NULLS LAST, jid LIMIT 12) SELECT jid, message_count, '<group ' || replace(jid, '@g.us', '') || '>' AS display_name FROM top", True)
def chat_list_named(spark, d):
    return q.list_chats(archive(spark, d), limit=12).select("jid", "message_count", "display_name")


#: Calling codes by customer, and what a number of each looks like.
_CODES = {
    "49": ("lpad(k, 9, '1')", "'+49 ' || substr(r, 1, 3) || ' ' || substr(r, 4)"), "1": ("lpad(k, 10, '2')", "'+1 ' || substr(r, 1, 3) || ' ' || substr(r, 4, 3) || ' ' || substr(r, 7)"),
    "44": ("lpad(k, 10, '7')", "'+44 ' || substr(r, 1, 1) || ' ' || substr(r, 2, 3) || ' ' || substr(r, 5, 3) || ' ' || substr(r, 8)"), "352": ("lpad(k, 8, '6')", "'+352 ' || substr(r, 1, 2) || ' ' || substr(r, 3, 3) || ' ' || substr(r, 6)"),
    "7": ("lpad(k, 10, '9')", "'+7 ' || substr(r, 1, 1) || ' ' || substr(r, 2, 3) || ' ' || substr(r, 5, 3) || ' ' || substr(r, 8)"), "0": ("lpad(k, 9, '5')", "'+0' || r"),
}


@query("WITH c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer) " + " UNION ALL ".join(f"SELECT c_custkey, '{'' if cc == '0' else cc}' AS code, {look} AS pretty FROM (SELECT c_custkey, {rest} AS r FROM c WHERE c_custkey % 6 = {n})" for n, (cc, (rest, look)) in enumerate(_CODES.items())))
def pretty_phone_codes(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    digits = F.coalesce(*(F.when(F.col("c_custkey") % 6 == n, F.concat(F.lit(cc), F.expr(rest))) for n, (cc, (rest, _)) in enumerate(_CODES.items())))
    return c.select("c_custkey", fx.country_code(digits).alias("code"), fx.pretty_phone(F.concat(digits, F.lit(fx.PHONE_SERVER))).alias("pretty"))


@query(f"SELECT event_id AS k, CAST(to_json(struct_pack(event_id := event_id, ts := {_ISO.format('ts')}, event_type := CASE WHEN event_type <> 'error' THEN event_type END, props := props)) AS VARCHAR) AS value FROM events")
def json_lines(spark, d):
    from parley.sources.sinks import json_lines as lines

    rows = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "props")
    return lines(rows).select(F.get_json_object("value", "$.event_id").cast("long").alias("k"), "value")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS event_type FROM events")
def table_rows(spark, d):
    from parley.sources.sinks import table_rows as shown

    return shown(table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type")))


@query(f"SELECT {_PRETTY.format('phone_jid')} AS phone, '' AS name FROM contacts", True)
def contact_starter(spark, d):
    from parley.sources.text import contact_starter as starter

    return starter(archive(spark, d)["contacts"])


def _scratch(spark) -> str:
    """A new place in the folder that all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{where or tempfile.mkdtemp(prefix='parley-')}/parley-check-{uuid.uuid4().hex}"


_PIN = "SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'empty phone' WHEN c_custkey % 13 = 0 THEN 'empty name' WHEN c_custkey % 11 = 0 THEN 'not a phone number' END AS reason, row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer"


@query(f"SELECT CASE WHEN reason IS NULL THEN '4179' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '@s.whatsapp.net' END AS phone_jid, CASE WHEN reason IS NULL THEN 'B, \"' || c_name || '\"' END AS name, CASE WHEN reason IS NOT NULL THEN line END AS line, reason FROM ({_PIN})")
def csv_pins(spark, d):
    """Customers as a CSV of pins, some of them unusable."""
    from parley.sources.text import read_pins

    c, at = table(spark, d, "customer"), _scratch(spark)
    k = F.col("c_custkey")
    number = F.when(k % 7 == 0, "").when(k % 11 == 0, "abc").otherwise(F.concat(F.lit("079 "), F.lpad(k.cast("string"), 7, "0")))
    name = F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit('"B, ""'), "c_name", F.lit('"""')))
    rows = c.select(k, F.concat(number, F.lit(","), name).alias("value"))
    head = spark.createDataFrame([(-1, "Phone,Display Name")], "c_custkey long, value string")
    head.unionByName(rows.select(k.cast("long").alias("c_custkey"), "value")).orderBy("c_custkey").coalesce(1).select("value").write.text(at)
    good, bad = read_pins(spark, at)
    line, reason = F.lit(None).cast("long"), F.lit(None).cast("string")
    return good.select("phone_jid", "name", line.alias("line"), reason.alias("reason")).unionByName(bad.select(reason.alias("phone_jid"), reason.alias("name"), F.col("line").cast("long").alias("line"), "reason"))


@query("SELECT '4179' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS phone_jid, c_name AS name FROM customer WHERE c_custkey % 5 <> 0")
def contact_list(spark, d):
    """Customers as contact lists, one for each nation."""
    from parley.sources.text import read_contact_list

    c, at = table(spark, d, "customer"), _scratch(spark)
    number = F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.concat(F.lit("079 "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    lists = c.groupBy(F.col("c_nationkey").alias("n")).agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit(" "), "c_name").alias("name"), number.alias("number")))).alias("value"))
    lists.write.partitionBy("n").text(at)
    return read_contact_list(spark, at)


@query("SELECT phone_jid, name, 'address_book' AS source FROM contacts", True)
def migrated_contacts(spark, d):
    """Contacts stored before they had a source, opened with the newest schema."""
    from parley.sources.store import Store

    at = _scratch(spark)
    Store(spark, at, {1: lambda tables: tables}).commit({"contacts": archive(spark, d)["contacts"].select("phone_jid", "name")}, {})
    return Store(spark, at).open()["contacts"]


@query("SELECT user_id, event_type, 'history' AS seen FROM events WHERE event_type = 'click' UNION ALL SELECT DISTINCT user_id, event_type, 'new' FROM events WHERE event_type <> 'click'")
def append_new(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type")
    return merge.append_new(ev.where("event_type = 'click'").withColumn("seen", F.lit("history")), ev.withColumn("seen", F.lit("new")), ["user_id", "event_type"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_sightings(spark, d):
    return merge.first_wins(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f""", {_ST}, top AS (SELECT st.id FROM st LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE kind = 'own' ORDER BY coalesce(n, 0) DESC, ts DESC, id LIMIT 1)
SELECT viewer_jid, seen_at FROM (SELECT '4179' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS viewer_jid, o_orderdate AS seen_at FROM orders JOIN top ON top.id = 'status@broadcast:1:' || o_custkey) ORDER BY seen_at DESC NULLS LAST, viewer_jid LIMIT 10""", True)
def latest_viewers(spark, d):
    """Who saw the most viewed own status last; the order is by an expression."""
    arch = _status_archive(spark, d)
    return q.views_for_status(arch, q.resolve_own_status_id(arch, "top")).limit(10).select("viewer_jid", F.coalesce("read_ts", "received_ts").alias("seen_at"))
