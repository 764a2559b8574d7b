"""Merging incoming rows into a current table, and change histories.

Plain Parquet has no MERGE, so each policy is one join or grouping over both
sides. Incoming batches may repeat a key: ``order`` says which row came last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, [F.desc_nulls_last(o) for o in order])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, [F.asc_nulls_last(o) for o in order])


def _pick(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    if not order:
        return df.dropDuplicates(list(keys))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Whole rows by key; columns that the incoming side lacks become null."""
    new = last_wins(incoming, keys, order)
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True).select(current.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Incoming columns win, nulls included; ``keep`` columns stay what they were once known."""
    new = last_wins(incoming, keys, order)
    cur, inc = current.alias("cur"), new.withColumn("_new", F.lit(True)).alias("inc")
    both = cur.join(inc, list(keys), "full")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in new.columns:
            out.append(F.col(f"cur.{c}").alias(c))
        elif c in keep:
            out.append(F.coalesce(F.col(f"cur.{c}"), F.col(f"inc.{c}")).alias(c))
        else:
            out.append(F.when(F.col("inc._new"), F.col(f"inc.{c}")).otherwise(F.col(f"cur.{c}")).alias(c))
    return both.select(*out)


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows with a new key; what is there stays."""
    new = first_wins(incoming, keys, order).join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(new, allowMissingColumns=True)


def clear_insert(current: DataFrame, incoming: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Children of every parent seen are replaced together."""
    seen = incoming.select(*parent).distinct()
    return current.join(seen, list(parent), "left_anti").unionByName(incoming, allowMissingColumns=True)


def append_new(history: DataFrame, incoming: DataFrame, natural: Sequence[str]) -> DataFrame:
    """Append rows whose natural key (null-safe) is not in the history yet."""
    h = history.select(F.struct(*natural).alias("_k")).distinct()
    new = incoming.dropDuplicates(list(natural)).withColumn("_k", F.struct(*natural))
    return history.unionByName(new.join(h, new["_k"].eqNullSafe(h["_k"]), "left_anti").drop("_k"), allowMissingColumns=True)


def link_changes(current: DataFrame, incoming: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Cumulative links (lid_jid -> phone_jid): new state, and history rows for new or
    changed links. Links that are no longer seen stay."""
    inc = incoming.select("lid_jid", F.col("phone_jid").alias("new_phone"))
    both = current.join(inc, "lid_jid", "full")
    seen = F.col("new_phone").isNotNull()
    state = both.select(
        "lid_jid",
        F.coalesce("new_phone", "phone_jid").alias("phone_jid"),
        F.coalesce("first_observed_ts", run_ts).alias("first_observed_ts"),
        F.when(seen, run_ts).otherwise(F.col("last_observed_ts")).alias("last_observed_ts"),
    )
    changed = both.where(seen & ~F.col("phone_jid").eqNullSafe(F.col("new_phone")))
    return state, changed.select("lid_jid", F.col("new_phone").alias("phone_jid"), F.lit("set").alias("op"), run_ts.alias("observed_at"))


def membership_changes(current: DataFrame, incoming: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """A full snapshot of (chat_jid, member_jid, rank, ...): new state, and join, leave
    and role_change rows. ``joined_ts`` stays once known; membership is by presence."""
    keys = ["chat_jid", "member_jid"]
    cur, inc = current.withColumn("_old", F.lit(True)).alias("cur"), incoming.withColumn("_new", F.lit(True)).alias("inc")
    both = cur.join(inc, keys, "full")
    was, now = F.col("cur._old").isNotNull(), F.col("inc._new").isNotNull()
    rest = [c for c in current.columns if c not in (*keys, "joined_ts")]
    state = both.where(now).select(*keys, *(F.col(f"inc.{c}").alias(c) for c in rest), F.coalesce("cur.joined_ts", "inc.joined_ts").alias("joined_ts")).select(current.columns)
    op = F.when(~was, "join").when(~now, "leave").when(~F.col("cur.rank").eqNullSafe(F.col("inc.rank")), "role_change")
    history = both.withColumn("op", op).where("op is not null").select(
        *keys, "op", F.when(now, F.col("inc.rank")).alias("rank"), F.when(was, F.col("cur.rank")).alias("old_rank"), F.when(~was, F.coalesce("inc.joined_ts", run_ts)).otherwise(run_ts).alias("observed_at"), F.lit("snapshot").alias("source")
    )
    return state, history


def snapshot_changes(previous: DataFrame, incoming: DataFrame, key: str, compare: Sequence[str], run_ts: Column) -> DataFrame:
    """History rows (key, observed_at, snapshot_json) of rows that are new or differ in a compared column."""
    old = previous.select(key, F.struct(*compare).alias("_old"), F.lit(True).alias("_was"))
    both = incoming.withColumn("_now", F.struct(*compare)).join(old, key, "left")
    changed = both.where(F.col("_was").isNull() | ~F.col("_now").eqNullSafe(F.col("_old")))
    return changed.select(key, run_ts.alias("observed_at"), F.to_json("_now", {"ignoreNullFields": "false"}).alias("snapshot_json"))


def contact_changes(current: DataFrame, incoming: DataFrame, run_ts: Column, source: str = "address_book", order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Sync one source of contacts (phone_jid, name): rows of other sources are never
    touched, numbers pinned by hand are skipped, and rows of this source that are gone are
    deleted and logged. Of several names for a number the first in ``order`` stays."""
    mine, others = current.where(F.col("source") == source), current.where(F.col("source") != source)
    new = first_wins(incoming.where("phone_jid is not null and trim(name) <> ''"), ["phone_jid"], list(order) or ["name"])
    pinned = current.where("source = 'manual'").select("phone_jid", F.lit(True).alias("_pinned")).distinct()
    both = mine.select("phone_jid", F.col("name").alias("_old"), "updated_at").join(new.select("phone_jid", F.col("name").alias("_new"), F.lit(True).alias("_listed")), "phone_jid", "full")
    both = both.join(pinned, "phone_jid", "left")
    # a pinned number that is still listed keeps what this source had
    both = both.withColumn("_new", F.when(F.col("_pinned") & F.col("_listed"), F.col("_old")).otherwise(F.col("_new")))
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    state = both.where("_new is not null").select("phone_jid", F.col("_new").alias("name"), F.lit(source).alias("source"), F.when(changed, run_ts).otherwise(F.col("updated_at")).alias("updated_at"))
    history = both.where(changed).select("phone_jid", F.col("_new").alias("name"), F.lit(source).alias("source"), F.when(F.col("_new").isNull(), "remove").otherwise("set").alias("op"), run_ts.alias("observed_at"))
    return others.unionByName(state), history


def add_contacts(current: DataFrame, incoming: DataFrame, run_ts: Column, source: str, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Import that never deletes: new names replace this source's rows and are logged.

    Cards skip numbers pinned by hand and names that already are the effective ones,
    whatever source has them; a pin by hand always counts."""
    new = last_wins(incoming.where("phone_jid is not null and trim(name) <> ''"), ["phone_jid"], order).select("phone_jid", "name")
    if source != "manual":
        new = new.join(current.where("source = 'manual'").select("phone_jid"), "phone_jid", "left_anti")
        new = new.join(effective_contacts(current).select("phone_jid", "name"), ["phone_jid", "name"], "left_anti")
    new = new.select("phone_jid", "name", F.lit(source).alias("source"), run_ts.alias("updated_at"))
    history = new.select("phone_jid", "name", "source", F.lit("set").alias("op"), F.col("updated_at").alias("observed_at"))
    return replace(current, new, ["phone_jid", "source"]), history


def restore_pins(current: DataFrame, pins: DataFrame, run_ts: Column) -> DataFrame:
    """The contacts with the pins of a sidecar (phone_jid, name) put back, without history."""
    new = pins.where("phone_jid is not null and trim(name) <> ''").select("phone_jid", "name", F.lit("manual").alias("source"), run_ts.alias("updated_at"))
    return replace(current, last_wins(new, ["phone_jid"], ["name"]), ["phone_jid", "source"])


def unpin(current: DataFrame, phones: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Without the manual rows of these numbers; other sources then name them again."""
    gone = current.where("source = 'manual'").join(phones.select("phone_jid").distinct(), "phone_jid", "left_semi")
    history = gone.select("phone_jid", F.lit(None).cast("string").alias("name"), "source", F.lit("remove").alias("op"), run_ts.alias("observed_at"))
    return current.join(gone.select("phone_jid", "source"), ["phone_jid", "source"], "left_anti"), history


def effective_contacts(contacts: DataFrame) -> DataFrame:
    """One name for each phone: manual, then vcard, then address book."""
    rank = F.when(F.col("source") == "manual", 0).when(F.col("source") == "vcard", 1).otherwise(2)
    rest = [c for c in contacts.columns if c not in ("phone_jid", "name")]
    # a minimum is combined before the shuffle, a window is not
    best = F.min(F.struct(rank.alias("_r"), F.col("name").isNull().alias("_n"), "name", *rest)).alias("_best")
    return contacts.groupBy("phone_jid").agg(best).select(*(c if c == "phone_jid" else F.col(f"_best.{c}").alias(c) for c in contacts.columns))
