"""Archive-shaped views of the driver's tables: a deterministic adapter for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.names import Archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phone(number) -> F.Column:
    return F.concat(F.lit("4179"), F.lpad(number.cast("string"), 7, "0"), F.lit("@s.whatsapp.net"))


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    ev = table(spark, sf_dir, "events")
    cust = table(spark, sf_dir, "customer")
    user = F.col("user_id")
    chat = lambda m: F.concat((F.col("event_id") % m).cast("string"), F.lit("@g.us"))
    messages = ev.select(
        F.col("event_id").alias("source_rowid"), F.col("event_id").cast("string").alias("id"), "ts", F.col("event_type").alias("type"), F.col("props").alias("text"),
        chat(20).alias("chat_jid"), F.when(user % 10 == 0, 1).otherwise(0).alias("from_me"),
        F.when(user < 100, phone(user)).otherwise(F.concat(user.cast("string"), F.lit("@lid"))).alias("sender_jid"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key_id"),
    )
    links = ev.where((user >= 100) & (user % 2 == 0)).select(F.concat(user.cast("string"), F.lit("@lid")).alias("lid_jid"), phone(user - 100).alias("phone_jid")).distinct()
    contacts = cust.where("c_acctbal >= 0").select(phone(F.col("c_custkey")).alias("phone_jid"), F.col("c_name").alias("name"), F.lit("address_book").alias("source"))
    chats = ev.select(chat(25).alias("jid")).distinct().select("jid", F.lit("group").alias("kind"), F.lit(None).cast("string").alias("subject"))
    names = ev.where((user >= 100) & (user % 3 == 0)).select(F.concat(user.cast("string"), F.lit("@lid")).alias("jid"), F.when(user % 2 == 0, F.concat(F.lit("Shown "), user.cast("string"))).otherwise(F.lit("+41 ••• 77")).alias("display_name")).distinct()
    reactions = ev.where(F.col("event_id") % 7 == 0).select(
        F.concat(((F.col("event_id") - F.col("event_id") % 5) % 20).cast("string"), F.lit("@g.us")).alias("parent_chat_jid"), F.concat(F.lit("k"), (F.col("event_id") - F.col("event_id") % 5).cast("string")).alias("parent_key_id"),
        F.col("event_id").cast("string").alias("reaction_key_id"), F.col("event_type").alias("emoji"), phone(user).alias("sender_jid"), F.lit(0).alias("sender_from_me"), F.col("ts").alias("sender_ts"),
    )
    none = spark.createDataFrame([], "chat_jid string, name string, message_id string, file_path string, mirrored_path string, caption string, mime string")
    return {
        "messages": messages, "identity_links": links, "contacts": contacts, "chats": chats, "identity_display_names": names, "reactions": reactions,
        "newsletter_metadata": none.select("chat_jid", "name"), "message_media": none.select("message_id", "file_path", "mirrored_path", "caption", "mime"),
    }


SQL = """
msg AS (SELECT event_id AS source_rowid, CAST(event_id AS VARCHAR) AS id, ts, event_type AS type, props AS text, CAST(event_id % 20 AS VARCHAR) || '@g.us' AS chat_jid,
    CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS from_me, 'k' || CAST(event_id AS VARCHAR) AS key_id,
    CASE WHEN user_id < 100 THEN '4179' || lpad(CAST(user_id AS VARCHAR), 7, '0') || '@s.whatsapp.net' ELSE CAST(user_id AS VARCHAR) || '@lid' END AS sender_jid FROM events),
links AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '@lid' AS lid_jid, '4179' || lpad(CAST(user_id - 100 AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS phone_jid FROM events WHERE user_id >= 100 AND user_id % 2 = 0),
contacts AS (SELECT '4179' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS phone_jid, c_name AS name FROM customer WHERE c_acctbal >= 0),
chats AS (SELECT DISTINCT CAST(event_id % 25 AS VARCHAR) || '@g.us' AS jid FROM events),
shown AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '@lid' AS jid, CASE WHEN user_id % 2 = 0 THEN 'Shown ' || CAST(user_id AS VARCHAR) ELSE '+41 ••• 77' END AS display_name FROM events WHERE user_id >= 100 AND user_id % 3 = 0),
reacts AS (SELECT CAST((event_id - event_id % 5) % 20 AS VARCHAR) || '@g.us' AS parent_chat_jid, 'k' || CAST(event_id - event_id % 5 AS VARCHAR) AS parent_key_id, event_type AS emoji,
    '4179' || lpad(CAST(user_id AS VARCHAR), 7, '0') || '@s.whatsapp.net' AS sender_jid FROM events WHERE event_id % 7 = 0)
"""
