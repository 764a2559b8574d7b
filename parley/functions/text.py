"""Scalar functions of the archive as Column expressions; no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message type numbers and their labels.
MESSAGE_TYPES = {
    0: "text", 1: "image", 2: "audio", 3: "video", 4: "contact", 5: "location", 7: "system", 9: "document",
    10: "call_log", 11: "empty", 13: "gif", 15: "deleted", 16: "template", 20: "sticker", 25: "product",
    27: "group_invite", 28: "list", 36: "poll", 42: "text", 90: "reaction_stub",
}

# System event numbers and their kinds.
SYSTEM_KINDS = {
    1: "group_subject_change", 4: "group_chat_participant_added", 5: "group_chat_participant_left",
    6: "group_subject_change", 7: "group_chat_participant_removed", 11: "group_created",
    12: "group_chat_participant_added", 14: "group_chat_participant_removed", 15: "group_chat_participant_left",
    18: "encryption_change", 19: "ephemeral_change", 20: "group_chat_participant_promoted",
    21: "group_chat_participant_demoted", 25: "group_icon_change", 27: "phone_number_change",
    46: "video_call_missed", 50: "blocked_contact", 56: "voice_call_missed", 58: "business_state",
    61: "group_description_change", 67: "ephemeral_setting_off", 68: "ephemeral_setting_on", 101: "lid_change",
}

# Sentences for kinds without parameters.
PLAIN_BODIES = {
    "group_created": "Group created",
    "group_icon_change": "Group icon changed",
    "group_description_change": "Group description changed",
    "encryption_change": "Encryption details changed",
    "ephemeral_setting_off": "Disappearing messages: off",
    "ephemeral_setting_on": "Disappearing messages: on",
    "blocked_contact": "Block status changed",
    "video_call_missed": "Missed video call",
    "voice_call_missed": "Missed voice call",
}
# Kinds that name participants: with and without names.
PARTICIPANT_BODIES = {
    "group_chat_participant_added": ("Added ", "Participant added"),
    "group_chat_participant_removed": ("Removed ", "Participant removed"),
    "group_chat_participant_left": ("Left: ", "Participant left"),
    "group_chat_participant_promoted": ("Promoted ", "Participant promoted"),
    "group_chat_participant_demoted": ("Demoted ", "Participant demoted"),
}
# Kinds that name an old and a new value.
CHANGE_BODIES = {"group_subject_change": "Subject changed", "phone_number_change": "Phone number changed", "lid_change": "LID changed"}

# Two- and three-digit country calling codes.
CC2 = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
]
CC3 = [
    "212", "213", "216", "218", "220", "221", "222", "223", "224", "225", "226", "227", "228", "229", "230", "231", "232", "233", "234", "235", "236",
    "237", "238", "239", "240", "241", "242", "243", "244", "245", "248", "249", "250", "251", "252", "253", "254", "255", "256", "257", "258", "260",
    "261", "262", "263", "264", "265", "266", "267", "268", "269", "350", "351", "352", "353", "354", "355", "356", "357", "358", "359", "370", "371",
    "372", "373", "374", "375", "376", "377", "378", "380", "381", "382", "383", "385", "386", "387", "389", "420", "421", "423", "591", "592", "593",
    "594", "595", "597", "598", "670", "672", "673", "674", "675", "676", "677", "678", "679", "680", "681", "682", "683", "685", "686", "687", "688",
    "689", "690", "691", "692", "850", "852", "853", "855", "856", "880", "886", "960", "961", "962", "963", "964", "965", "966", "967", "968", "970",
    "971", "972", "973", "974", "975", "976", "977", "992", "993", "994", "995", "996", "998",
]

# Server suffix of an identifier and its kind.
KINDS = {"@g.us": "group", "@s.whatsapp.net": "user", "@lid": "lid", "@broadcast": "broadcast", "@newsletter": "newsletter", "@status": "status"}
PHONE_SERVER = "@s.whatsapp.net"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    if not pairs:
        return otherwise
    return reduce(lambda out, p: out.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(otherwise)


def jid_kind(jid: Column | str) -> Column:
    j = _col(jid)
    known = [(j.endswith(suffix), F.lit(kind)) for suffix, kind in KINDS.items()]
    return _cases([(j.isNull() | (j == ""), F.lit("unknown")), *known], F.lit("other"))


def jid_user(jid: Column | str) -> Column:
    j = _col(jid)
    return F.when(F.instr(j, "@") > 0, F.substring_index(j, "@", 1))


def jid_server(jid: Column | str) -> Column:
    j = _col(jid)
    return F.when(F.instr(j, "@") > 0, j.substr(F.instr(j, "@") + 1, F.length(j)))


def looks_like_name(name: Column | str) -> Column:
    return F.coalesce(_col(name).rlike("[A-Za-zÀ-ÿ]"), F.lit(False))


def message_id(chat: Column | str, from_me: Column | str, key: Column | str) -> Column:
    return F.concat(F.coalesce(_col(chat), F.lit("unknown")), F.lit(":"), F.when(F.coalesce(_col(from_me).cast("int"), F.lit(0)) != 0, "1").otherwise("0"), F.lit(":"), _col(key))


def parent_id(chat: Column | str, key: Column | str) -> Column:
    return F.concat(F.coalesce(_col(chat), F.lit("unknown")), F.lit(":?:"), _col(key))


def received_status_id(sender: Column | str, uuid: Column | str) -> Column:
    return F.concat(F.lit("status_recv:"), F.coalesce(_col(sender), F.lit("?")), F.lit(":"), F.coalesce(_col(uuid), F.lit("?")))


def type_label(number: Column | str) -> Column:
    n = _col(number)
    known = [(n == k, F.lit(v)) for k, v in MESSAGE_TYPES.items()]
    return _cases([(n.isNull(), F.lit("unknown")), *known], F.concat(F.lit("unknown_"), n.cast("string")))


def ms_to_ts(ms: Column | str) -> Column:
    """Unix milliseconds to a timestamp; null and 0 are unknown."""
    return F.timestamp_millis(F.nullif(_col(ms).cast("long"), F.lit(0).cast("long")))


def iso_utc(ts: Column | str) -> Column:
    """ISO text in UTC (session time zone UTC); microseconds only where there are any."""
    t = _col(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("+00:00"))


def trimmed_ts(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def normalize_number(raw: Column | str, country: str = "41") -> Column:
    r = F.regexp_replace(_col(raw), r"[\s()\-./]", "")
    n = _cases([(r.startswith("+"), r.substr(F.lit(2), F.length(r))), (r.startswith("00"), r.substr(F.lit(3), F.length(r))), (r.startswith("0"), F.concat(F.lit(country), r.substr(F.lit(2), F.length(r))))], r)
    return F.when(r.rlike(r"^\+?[0-9]+$") & F.length(n).between(7, 15), n)


def number_to_jid(raw: Column | str, country: str = "41") -> Column:
    return F.concat(normalize_number(raw, country), F.lit(PHONE_SERVER))


CC_PATTERN = f"^(1(?=[0-9]{{10}})|(?:{'|'.join(CC3)})(?=[0-9])|(?:{'|'.join(CC2)})(?=[0-9]{{2}})|7)"


def country_code(digits: Column | str) -> Column:
    """1 before ten digits or more, then three-digit codes, two-digit codes and 7; else empty."""
    return F.regexp_extract(_col(digits), CC_PATTERN, 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grouped(d: Column, cc: Column) -> Column:
    rest = d.substr(F.length(cc) + 1, F.length(d))
    threes = F.trim(F.reverse(F.regexp_replace(F.reverse(rest), r"([0-9]{3})", "$1 ")))
    return _cases(
        [
            ((cc == "49") & (F.length(rest) >= 4), F.regexp_replace(rest, r"^(...)", "$1 ")),
            ((cc == "41") & (F.length(rest) == 9), F.regexp_replace(rest, r"^(..)(...)(..)(..)$", "$1 $2 $3 $4")),
            ((cc == "1") & (F.length(rest) == 10), F.regexp_replace(rest, r"^(...)(...)(....)$", "$1 $2 $3")),
        ],
        threes,
    )


def pretty_phone(jid: Column | str) -> Column:
    j = _col(jid)
    pretty = _let(F.substring_index(j, "@", 1), lambda d: _let(country_code(d), lambda cc: F.when(~d.rlike("^[0-9]+$") | (cc == ""), F.concat(F.lit("+"), d)).otherwise(F.concat(F.lit("+"), cc, F.lit(" "), _grouped(d, cc)))))
    return F.when(j.isNull() | (j == ""), F.lit("?")).otherwise(pretty)


def phone_argument(raw: Column | str, country: str = "41") -> Column:
    """struct(jid, error): a phone identifier from what a user typed."""
    r = F.trim(_col(raw))
    jid = _cases([(r.endswith("@lid"), F.lit(None).cast("string")), (r.endswith(PHONE_SERVER), r), (r.contains("@"), F.lit(None).cast("string"))], number_to_jid(r, country))
    error = _cases([(jid.isNotNull(), F.lit(None).cast("string")), (r.endswith("@lid"), F.lit("is a LID, not a phone number")), (r.contains("@"), F.lit("not a phone identifier"))], F.lit("not a phone number"))
    return F.struct(jid.alias("jid"), error.alias("error"))


def urls(text: Column | str) -> Column:
    found = F.regexp_extract_all(_col(text), F.lit("https?://[^\\s<>\"')]+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[,.;:!?]+$", ""))


def system_kind(action: Column | str) -> Column:
    a = _col(action)
    known = [(a == k, F.lit(v)) for k, v in SYSTEM_KINDS.items()]
    return _cases([(a.isNull(), F.lit("unknown_system")), *known], F.concat(F.lit("unknown_system_"), a.cast("string")))


def system_body(kind: Column | str, participants: Column | str, old: Column | str, new: Column | str) -> Column:
    k, p = _col(kind), _col(participants)
    o, n = F.nullif(_col(old), F.lit("")), F.nullif(_col(new), F.lit(""))
    change = lambda head: F.concat(F.lit(f"{head}: "), F.coalesce(o, F.lit("?")), F.lit(" → "), F.coalesce(n, F.lit("?")))
    cases = [(k == kind_, F.lit(text)) for kind_, text in PLAIN_BODIES.items()]
    cases += [((k == kind_) & (F.size(p) > 0), F.concat(F.lit(head), F.array_join(p, ", "))) for kind_, (head, _) in PARTICIPANT_BODIES.items()]
    cases += [(k == kind_, F.lit(bare)) for kind_, (_, bare) in PARTICIPANT_BODIES.items()]
    cases.append(((k == "group_subject_change") & o.isNull() & n.isNull(), F.lit("Subject changed")))
    cases += [(k == kind_, change(head)) for kind_, head in CHANGE_BODIES.items()]
    return _cases(cases, F.concat(F.lit("System event: "), k))


def segment(text: Column | str, start: Column | str, length: Column | str) -> Column:
    t, s, n = _col(text), _col(start).cast("int"), _col(length).cast("int")
    return F.when((s >= 0) & (n > 0), F.nullif(t.substr(s + 1, n), F.lit("")))


def receipt(read: Column | str, played: Column | str, received: Column | str) -> Column:
    """struct(status, ts) of a receipt."""
    r, p, d = _col(read), _col(played), _col(received)
    status = F.when(r.isNotNull(), "read").when(p.isNotNull(), "played").otherwise("delivered")
    return F.struct(status.alias("status"), F.coalesce(r, p, d).alias("ts"))


def role(rank: Column | str) -> Column:
    r = _col(rank)
    return _cases([(r.isNull() | (r == 0), F.lit("member")), (r == 1, F.lit("admin")), (r == 2, F.lit("superadmin"))], F.concat(F.lit("rank_"), r.cast("string")))


def shortened(text: Column | str, most: int = 140) -> Column:
    t = F.trim(F.regexp_replace(_col(text), "\n", " "))
    return F.when(F.length(t) > most, F.concat(t.substr(1, most), F.lit("…"))).otherwise(t)


def media_tag(mirrored: Column | str, path: Column | str, mime: Column | str) -> Column:
    where = F.coalesce(_col(mirrored), _col(path))
    return F.when(where.isNotNull(), F.concat(F.lit("["), F.concat_ws(" ", _col(mime), where), F.lit("]")))


def relative_path(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), "^Media/", "")


def contains_folded(text: Column | str, needle: str) -> Column:
    """Literal, case-insensitive substring; null text never matches."""
    return F.coalesce(F.contains(F.lower(_col(text)), F.lit(needle.lower())), F.lit(False))
