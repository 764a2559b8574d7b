"""Name resolution as joins over distinct identifiers.

``resolved`` needs the archive tables contacts, identity_links,
identity_display_names, chats and newsletter_metadata; it resolves each distinct
identifier once, so the result is joined to any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators.merge import effective_contacts

Archive = dict[str, DataFrame]


def owner(arch: Archive, default: str = "Me") -> DataFrame:
    """One row (owner_jid, owner_name): the latest sender of an own message."""
    sent = arch["messages"].where("from_me = 1 and sender_jid is not null")
    jid = sent.agg(F.max_by("sender_jid", F.struct("ts", "source_rowid")).alias("owner_jid"))
    known = effective_contacts(arch["contacts"]).select(F.col("phone_jid").alias("owner_jid"), "name")
    return jid.join(known, "owner_jid", "left").select("owner_jid", F.coalesce("name", F.lit(default)).alias("owner_name"))


def resolved(arch: Archive, jids: DataFrame, owner_name: str | Column = "Me") -> DataFrame:
    """(jid, name) for every distinct non-null ``jid``."""
    contacts = effective_contacts(arch["contacts"]).select("phone_jid", "name")
    shown = arch["identity_display_names"].where(fx.looks_like_name("display_name")).select("jid", "display_name")
    out = jids.select("jid").where("jid is not null").distinct()
    out = out.join(arch["identity_links"].select(F.col("lid_jid").alias("jid"), F.col("phone_jid").alias("linked")), "jid", "left")
    out = out.withColumn("phone", F.when(F.col("jid").endswith("@lid"), F.col("linked")).otherwise(F.col("jid")))
    out = out.join(contacts.select(F.col("phone_jid").alias("phone"), F.col("name").alias("contact")), "phone", "left")
    out = out.join(shown.select(F.col("jid").alias("phone"), F.col("display_name").alias("phone_shown")), "phone", "left")
    out = out.join(shown.select("jid", F.col("display_name").alias("own_shown")), "jid", "left")
    out = out.join(arch["chats"].select("jid", "subject"), "jid", "left")
    out = out.join(arch["newsletter_metadata"].select(F.col("chat_jid").alias("jid"), F.col("name").alias("channel")), "jid", "left")
    out = out.withColumn("by_phone", F.coalesce("contact", "phone_shown", fx.pretty_phone("phone")))
    by_phone = F.col("by_phone")
    user = fx.jid_user("jid")
    lid = F.when(F.col("linked").isNull(), F.coalesce("own_shown", F.concat(F.lit("lid:"), user))).when(by_phone.startswith("+"), F.coalesce("own_shown", by_phone)).otherwise(by_phone)
    me = F.lit(owner_name) if isinstance(owner_name, str) else owner_name
    name = fx._cases(
        [
            (F.col("jid").isin("lid_me", "status_me"), me),
            (F.col("jid").endswith(fx.PHONE_SERVER), by_phone),
            (F.col("jid").endswith("@lid"), lid),
            (F.col("jid").endswith("@g.us"), F.coalesce(F.nullif("subject", F.lit("")), F.concat(F.lit("<group "), user, F.lit(">")))),
            (F.col("jid").endswith("@newsletter"), F.coalesce("channel", F.lit("<newsletter>"))),
            (F.col("jid").endswith("@broadcast"), F.lit("<broadcast>")),
            (F.col("jid").endswith("@status"), F.lit("<status>")),
        ],
        F.col("jid"),
    )
    return out.select("jid", name.alias("name"))


def with_names(df: DataFrame, arch: Archive, column: str, to: str, from_me: str | None = None, owner_name: str = "Me", known: DataFrame | None = None) -> DataFrame:
    """``df`` plus the name of ``column``; own rows have the owner's, null is ``?``.

    ``known`` are names that were resolved before, for plans that need several columns of them."""
    names = resolved(arch, df.select(F.col(column).alias("jid")), owner_name) if known is None else known
    names = names.select(F.col("jid").alias(column), F.col("name").alias("_name"))
    name = F.coalesce("_name", F.lit("?"))
    if from_me:
        name = F.when(F.coalesce(F.col(from_me), F.lit(0)) == 1, F.lit(owner_name)).otherwise(name)
    return df.join(names, column, "left").withColumn(to, name).drop("_name")


def is_known(arch: Archive, jids: DataFrame) -> DataFrame:
    """(jid, known): whether an identifier has a name of its own, not only a number."""
    phones = effective_contacts(arch["contacts"]).select(F.col("phone_jid").alias("phone"), F.lit(True).alias("named"))
    links = arch["identity_links"].select(F.col("lid_jid").alias("jid"), "phone_jid")
    shown = arch["identity_display_names"].where(fx.looks_like_name("display_name")).select("jid", F.lit(True).alias("shown")).distinct()
    out = jids.select("jid").where("jid is not null").distinct().join(links, "jid", "left")
    kind = fx.jid_kind("jid")
    out = out.withColumn("phone", F.when(kind == "user", F.col("jid")).when(kind == "lid", F.col("phone_jid")))
    out = out.join(phones, "phone", "left").join(shown, "jid", "left")
    known = F.when(kind == "user", F.col("named")).when(kind == "lid", F.coalesce("named", "shown"))
    return out.select("jid", F.coalesce(known, F.lit(False)).alias("known"))
