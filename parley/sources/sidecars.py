"""Small state that outlives an archive, as JSON files beside it: names pinned by hand, chat
aliases, and the last chat list. A file is replaced as a whole or not at all; one that is
absent or broken reads as empty."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from parley.sources.store import Files

PINS, ALIASES, LAST_LIST = "manual_pins.json", "chat_aliases.json", "last_chat_list.json"
#: Chats that a list remembers at most.
MOST_LISTED = 99_999


class Sidecars:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.files = spark, Files(spark, folder.rstrip("/"))

    def _read(self, name: str, kind: type) -> dict | list:
        try:
            got = json.loads(self.files.read(name))
        except (Py4JJavaError, ValueError):
            return kind()
        return got if isinstance(got, kind) else kind()

    def _names(self, name: str) -> dict[str, str]:
        return {k: v for k, v in self._read(name, dict).items() if isinstance(v, str)}

    def _change(self, name: str, key: str, value: str | None) -> None:
        """Set or, with None, drop an entry; only the user may read the file."""
        entries = self._names(name)
        if value is None:
            entries.pop(key, None)
        else:
            entries[key] = value
        self.files.replace(name, json.dumps(entries, ensure_ascii=False, indent=2, sort_keys=True), private=True)

    def pins(self) -> dict[str, str]:
        return self._names(PINS)

    def pin(self, phone_jid: str, name: str | None) -> None:
        self._change(PINS, phone_jid, name)

    def pinned(self) -> DataFrame:
        """(phone_jid, name)"""
        return self.spark.createDataFrame(sorted(self.pins().items()), "phone_jid string, name string")

    def aliases(self) -> dict[str, str]:
        return self._names(ALIASES)

    def alias(self, word: str, chat: str | None) -> None:
        self._change(ALIASES, word, chat)

    def remember(self, chats: DataFrame) -> None:
        """Keep a chat list in its order, so that its numbers can stand for chats."""
        rows = chats.limit(MOST_LISTED).collect()
        label = lambda r: r.asDict().get("display_name") or r.asDict().get("subject") or ""
        self.files.replace(LAST_LIST, json.dumps([{"idx": k + 1, "jid": r.jid, "name": label(r), "kind": r.kind} for k, r in enumerate(rows)], ensure_ascii=False))

    def last_list(self) -> list[str]:
        """The chats of the last list, the first being number 1."""
        return [e["jid"] for e in self._read(LAST_LIST, list) if isinstance(e, dict) and "jid" in e]
