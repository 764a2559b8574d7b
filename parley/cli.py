"""Commands over a stored archive: ``python -m parley.cli HOME COMMAND ...``.

HOME holds the archive (``archive``) and the state beside it (``config``). Every command is
one call of the library; what it returns is shown as a table or as JSON Lines."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime
from functools import cached_property
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators import merge
from parley.plans import contacts, digest
from parley.plans import queries as q
from parley.plans import run as runs
from parley.plans.archive import archive_of
from parley.plans.names import Archive
from parley.session import local_session
from parley.sources import sinks, sqlite, text
from parley.sources.sidecars import Sidecars
from parley.sources.store import Store
from parley.streaming import media

Result = DataFrame | str | None


@dataclass
class Home:
    spark: SparkSession
    root: str

    @cached_property
    def store(self) -> Store:
        return Store(self.spark, f"{self.root}/archive")

    @cached_property
    def side(self) -> Sidecars:
        return Sidecars(self.spark, f"{self.root}/config")

    @cached_property
    def archive(self) -> Archive:
        return archive_of(self.store)

    def chat(self, reference: str) -> str:
        return contacts.resolve_chat(self.archive, self.side, reference)

    def source(self, path: str):
        return sqlite.read_source(self.spark, path)

    def phone(self, typed: str, country: str) -> str:
        got = self.spark.range(1).select(fx.phone_argument(F.lit(typed), country).alias("p")).select("p.*").first()
        if got.error:
            raise LookupError(got.error)
        return got.jid


Command = Callable[[Home, argparse.Namespace], Result]
COMMANDS: dict[str, tuple[Command, list[tuple[tuple, dict]], str]] = {}


def arg(*names: str, **options) -> tuple[tuple, dict]:
    return names, options


LIMIT = arg("--limit", "-n", type=int, default=50)
SPAN = [arg("--since"), arg("--until")]
COUNTRY = arg("--country", default="41")
SOURCE = arg("--source", required=True, help="a SQLite file with the source tables")


def command(name: str, *arguments: tuple[tuple, dict]) -> Callable[[Command], Command]:
    def register(f: Command) -> Command:
        COMMANDS[name] = (f, list(arguments), (f.__doc__ or "").strip())
        return f

    return register


@command("run", SOURCE, arg("--status-backup"), arg("--media-root"), arg("--look-back", type=int, default=runs.LOOK_BACK))
def run(home: Home, a: argparse.Namespace) -> Result:
    """extract a source into the next version, mirror new media, and say what was done"""
    backup = home.source(a.status_backup) if a.status_backup else None
    runs.run(home.store, home.source(a.source), backup=backup, sidecars=home.side, look_back=a.look_back, media_root=a.media_root, archive_root=f"{home.root}/media")
    return runs.summary(home.store)


@command("follow", SOURCE, arg("--forever", action="store_true"))
def follow(home: Home, a: argparse.Namespace) -> Result:
    """run whenever the messages of a source have grown"""
    runs.follow(home.spark, home.store, a.source, f"{home.root}/config/follow", once=not a.forever, sidecars=home.side).awaitTermination()
    return None


@command("summary")
def summary(home: Home, a: argparse.Namespace) -> Result:
    """what the last run read, left out and wrote"""
    return runs.summary(home.store)


@command("stats")
def stats(home: Home, a: argparse.Namespace) -> Result:
    """rows of every table"""
    return home.spark.createDataFrame(sorted(home.store.rows().items()), "table string, rows long")


@command("vacuum", arg("--keep", type=int, default=10))
def vacuum(home: Home, a: argparse.Namespace) -> Result:
    """remove all but the last versions"""
    return f"{len(home.store.vacuum(a.keep))} folders removed"


@command("mirror", arg("--media-root", required=True), arg("--forever", action="store_true"))
def mirror(home: Home, a: argparse.Namespace) -> Result:
    """enter new media files into the ledger"""
    media.watch(home.spark, home.store, a.media_root, f"{home.root}/media", f"{home.store.root}/media-checkpoint", once=not a.forever).awaitTermination()
    return None


@command("contact-list", arg("--source"), arg("--limit", "-n", type=int, default=1000))
def contact_list(home: Home, a: argparse.Namespace) -> Result:
    """contacts by name"""
    return q.list_contacts(home.archive, a.source, a.limit)


@command("contact-pin", arg("phone"), arg("name"), COUNTRY)
def contact_pin(home: Home, a: argparse.Namespace) -> Result:
    """name a number by hand"""
    contacts.pin(home.store, home.side, home.phone(a.phone, a.country), a.name)
    return None


@command("contact-unpin", arg("phone"), COUNTRY)
def contact_unpin(home: Home, a: argparse.Namespace) -> Result:
    """take a name given by hand back"""
    contacts.unpin(home.store, home.side, home.phone(a.phone, a.country))
    return None


@command("contact-sync", arg("path"), COUNTRY)
def contact_sync(home: Home, a: argparse.Namespace) -> Result:
    """make the address book what a JSON contact list says"""
    rows = text.read_contact_list(home.spark, a.path, a.country)
    contacts.change(home.store, lambda have, now: merge.contact_changes(have, rows, now))
    return None


@command("contact-import-vcard", arg("path"), COUNTRY)
def contact_import_vcard(home: Home, a: argparse.Namespace) -> Result:
    """add the names of vCards"""
    contacts.import_vcards(home.store, a.path, a.country)
    return None


@command("contact-import-csv", arg("path"), COUNTRY)
def contact_import_csv(home: Home, a: argparse.Namespace) -> Result:
    """pin the names of a CSV; shows the lines that cannot be used"""
    good, bad = text.read_pins(home.spark, a.path, a.country)
    contacts.change(home.store, lambda have, now: merge.add_contacts(have, good, now, "manual"))
    for row in good.collect():  # written by hand
        home.side.pin(row.phone_jid, row.name)
    return bad


@command("contact-unresolved", arg("--min-messages", type=int, default=1), arg("--limit", "-n", type=int, default=200), arg("--csv", help="write a CSV to fill in"))
def contact_unresolved(home: Home, a: argparse.Namespace) -> Result:
    """senders without a name"""
    rows = q.unresolved_senders(home.archive, a.min_messages, a.limit)
    if a.csv:
        sinks.write_contact_starter(rows, a.csv)
    return rows


@command("contact-resolution")
def contact_resolution(home: Home, a: argparse.Namespace) -> Result:
    """the share of senders with a name"""
    return runs.resolution_percent(home.archive)


@command("chat-list", arg("--kind"), *SPAN, arg("--limit", "-n", type=int, default=100))
def chat_list(home: Home, a: argparse.Namespace) -> Result:
    """chats by last activity; their numbers stand for them in other commands"""
    return contacts.list_chats(home.archive, home.side, kind=a.kind, since=a.since, until=a.until, limit=a.limit)


@command("chat-alias", arg("word", nargs="?"), arg("chat", nargs="?"), arg("--remove", action="store_true"))
def chat_alias(home: Home, a: argparse.Namespace) -> Result:
    """list, set or remove own words for chats"""
    if a.word:
        home.side.alias(a.word, None if a.remove else home.chat(a.chat))
    return home.spark.createDataFrame(sorted(home.side.aliases().items()), "word string, chat string")


@command("chat-info", arg("chat"))
def chat_info(home: Home, a: argparse.Namespace) -> Result:
    """counts and times of a chat"""
    return q.chat_info(home.archive, home.chat(a.chat))


@command("chat-members", arg("chat"), arg("--history", action="store_true"))
def chat_members(home: Home, a: argparse.Namespace) -> Result:
    """who is, and was, in a chat"""
    return q.members_for(home.archive, home.chat(a.chat), a.history)


@command("chat-why", arg("chat"), arg("member"))
def chat_why(home: Home, a: argparse.Namespace) -> Result:
    """how a member's name is found"""
    name, steps = q.explain_member(home.archive, home.chat(a.chat), a.member)
    return "\n".join([name, *steps])


@command("chat-digest", arg("chat"), arg("--last", "-n", type=int, default=200), arg("--pseudonyms", action="store_true"), arg("--jsonl", action="store_true"))
def chat_digest(home: Home, a: argparse.Namespace) -> Result:
    """the last messages as Markdown or JSON Lines"""
    chat = home.chat(a.chat)
    if a.jsonl:
        return "\n".join(r.json for r in digest.jsonl(home.archive, chat, a.last).collect())
    return "\n".join(r.line for r in digest.markdown(home.archive, chat, a.last, a.pseudonyms).collect())


@command("chat-export", arg("chat"), arg("--out", "-o", default="export"), arg("--last", "-n", type=int, default=999_999), arg("--media-root"), arg("--no-media", action="store_true"))
def chat_export(home: Home, a: argparse.Namespace) -> Result:
    """a folder with digests and media of a chat"""
    return sinks.export_chat(home.archive, home.chat(a.chat), a.out, a.last, not a.no_media, a.media_root)


@command("timeline", arg("name"), *SPAN, LIMIT)
def timeline(home: Home, a: argparse.Namespace) -> Result:
    """what a person wrote, in all chats"""
    return q.timeline_for_member(home.archive, a.name, a.limit, a.since, a.until)


@command("forgotten", arg("--days", type=int, default=365), LIMIT)
def forgotten(home: Home, a: argparse.Namespace) -> Result:
    """contacts not written to for long"""
    return q.forgotten_contacts(home.archive, datetime.now(UTC).date(), a.days, a.limit)


@command("search", arg("needle"), arg("--chat"), *SPAN, LIMIT)
def search(home: Home, a: argparse.Namespace) -> Result:
    """messages and captions that hold a text"""
    return q.search_messages(home.archive, a.needle, home.chat(a.chat) if a.chat else None, a.since, a.until, a.limit)


@command("links", arg("--chat"), *SPAN, arg("--limit", "-n", type=int, default=200))
def links(home: Home, a: argparse.Namespace) -> Result:
    """links that were shared"""
    return q.list_links(home.archive, home.chat(a.chat) if a.chat else None, a.since, a.until, a.limit)


@command("most-reacted", arg("--since"), arg("--limit", "-n", type=int, default=10))
def most_reacted(home: Home, a: argparse.Namespace) -> Result:
    """messages with the most reactions"""
    return q.most_reacted(home.archive, a.since, a.limit)


@command("unengaged", arg("--before", default=str(date.today())))
def unengaged(home: Home, a: argparse.Namespace) -> Result:
    """chats without an own message since a day"""
    return q.unengaged_chats(home.archive, a.before)


@command("transcripts", arg("needle"))
def transcripts(home: Home, a: argparse.Namespace) -> Result:
    """transcribed audio that holds a text"""
    return q.search_transcripts(home.archive, a.needle)


@command("receipts", arg("message"), SOURCE)
def receipts(home: Home, a: argparse.Namespace) -> Result:
    """who got and read a message; receipts stay in the source"""
    message = q.resolve_message(home.archive, a.message, aliases=home.side.aliases(), cache=home.side.last_list())
    return q.receipts_for(home.archive, home.source(a.source).tables, message)


@command("status-list", arg("--kind"), arg("--sender"), *SPAN, LIMIT)
def status_list(home: Home, a: argparse.Namespace) -> Result:
    """own and received statuses"""
    return q.list_status(home.archive, a.kind, a.sender, a.since, a.until, a.limit)


@command("status-summary", *SPAN, LIMIT, arg("--sort", choices=("ts", "views"), default="ts"))
def status_summary(home: Home, a: argparse.Namespace) -> Result:
    """views and reactions of own statuses"""
    return q.own_status_view_summary(home.archive, a.since, a.until, a.limit, a.sort)


@command("status-views", arg("status", nargs="?", default="latest"))
def status_views(home: Home, a: argparse.Namespace) -> Result:
    """who saw an own status: an id, latest, top or a number"""
    return q.views_for_status(home.archive, q.resolve_own_status_id(home.archive, a.status))


@command("status-reactions", arg("status", nargs="?", default="latest"))
def status_reactions(home: Home, a: argparse.Namespace) -> Result:
    """who reacted to an own status"""
    return q.reactions_for_status(home.archive, q.resolve_own_status_id(home.archive, a.status))


@command("status-media", arg("status", nargs="?", default="latest"))
def status_media(home: Home, a: argparse.Namespace) -> Result:
    """the media of a status"""
    return q.status_media(home.archive, q.resolve_own_status_id(home.archive, a.status))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parley", description=__doc__)
    p.add_argument("home")
    p.add_argument("--format", "-f", choices=("table", "json"), default="table")
    each = p.add_subparsers(dest="command", required=True)
    for name, (_, arguments, about) in COMMANDS.items():
        one = each.add_parser(name, help=about, description=about)
        for names, options in arguments:
            one.add_argument(*names, **options)
    return p


def show(df: DataFrame, form: str, out: TextIO) -> None:
    """Every command limits its own rows."""
    if form == "json":
        for row in sinks.json_lines(df).collect():
            print(row.value, file=out)
        return
    rows = [df.columns, *(list(r) for r in sinks.table_rows(df).collect())]
    width = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    for row in rows:
        print("  ".join(c.ljust(w) for c, w in zip(row, width)).rstrip(), file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: TextIO = sys.stdout) -> int:
    """0, or 1 with a message if something asked for is not there."""
    a = parser().parse_args(argv)
    home = Home(spark or local_session(), a.home.rstrip("/"))
    try:
        result = COMMANDS[a.command][0](home, a)
    except LookupError as e:
        print(e.args[0], file=sys.stderr)
        return 1
    if isinstance(result, str):
        print(result, file=out)
    elif result is not None:
        show(result, a.format, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
