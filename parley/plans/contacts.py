"""Changes of the contacts of a stored archive, each one commit, and references to chats
that lean on the state beside it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import merge
from parley.plans import queries as q
from parley.sources.sidecars import Sidecars
from parley.sources.store import Store
from parley.sources.text import card_contacts, read_vcards

CONTACTS = "phone_jid string, name string, source string, updated_at timestamp"
HISTORY = "phone_jid string, name string, source string, op string, observed_at timestamp"


def table_of(store: Store, name: str, ddl: str) -> DataFrame:
    have = store.open().get(name)
    return store.spark.createDataFrame([], ddl) if have is None else have


def change(store: Store, make: Callable[[DataFrame, F.Column], tuple[DataFrame, DataFrame]], at: datetime | None = None) -> int:
    """Commit the contacts that ``make`` returns, and its changes to their history."""
    base = store.version()
    now = F.lit(at or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
    state, changed = make(table_of(store, "contacts", CONTACTS), now)
    history = table_of(store, "contacts_history", HISTORY)
    return store.commit({"contacts": state, "contacts_history": history.unionByName(changed)}, {}, base)


def pin(store: Store, sidecars: Sidecars, phone_jid: str, name: str, at: datetime | None = None) -> int:
    """Name a number by hand; the name stays until it is unpinned, and outlives the archive."""
    row = store.spark.createDataFrame([(phone_jid, name)], "phone_jid string, name string")
    number = change(store, lambda contacts, now: merge.add_contacts(contacts, row, now, "manual"), at)
    sidecars.pin(phone_jid, name)
    return number


def unpin(store: Store, sidecars: Sidecars, phone_jid: str, at: datetime | None = None) -> int:
    """Take a name given by hand back; other sources then name the number again."""
    row = store.spark.createDataFrame([(phone_jid,)], "phone_jid string")
    number = change(store, lambda contacts, now: merge.unpin(contacts, row, now), at)
    sidecars.pin(phone_jid, None)
    return number


def import_vcards(store: Store, path: str, country: str = "41", at: datetime | None = None) -> int:
    """Names of a .vcf file or of all below a folder. Of several cards with one number the last
    counts: files by their path, cards by their place."""
    cards = card_contacts(read_vcards(store.spark, path), country)
    return change(store, lambda contacts, now: merge.add_contacts(contacts, cards, now, "vcard", ["place"]), at)


def list_chats(arch: q.Archive, sidecars: Sidecars, **options) -> DataFrame:
    """``queries.list_chats``, remembered so that its numbers can stand for chats."""
    out = q.list_chats(arch, **options)
    sidecars.remember(out)
    return out


def resolve_chat(arch: q.Archive, sidecars: Sidecars, reference: str) -> str:
    """A chat from an alias, a number of the last list, or what else ``queries.resolve_chat`` knows."""
    return q.resolve_chat(arch, reference, sidecars.aliases(), sidecars.last_list())
