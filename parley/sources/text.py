"""Text sources: vCards, contact lists, CSV pins, media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as fx

# Header names a CSV of pins may use.
PHONE_HEADERS = ("phone", "number", "tel")
NAME_HEADERS = ("name", "display_name")
# Media folders that are mirrored, and endings that never are.
MEDIA_FOLDERS = ("WhatsApp Images", "WhatsApp Video", "WhatsApp Audio", "WhatsApp Voice Notes", "WhatsApp Documents", "WhatsApp Stickers", "WhatsApp Animated Gifs", "WhatsApp Video Notes", "WhatsApp Profile Photos", ".Statuses")
SKIPPED_ENDINGS = (".nomedia", ".tmp")


def parse_vcards(files: DataFrame) -> DataFrame:
    """(path, card, line, name, number) from whole vCard texts in ``value``: folded lines are
    joined, FN wins over N, every TEL is a row, cards without a name or number are left out.
    ``card`` and ``line`` count from 0; ``path`` is null where the files have none."""
    unfolded = F.regexp_replace("value", "\r?\n[ \t]", "")
    cards = F.regexp_extract_all(unfolded, F.lit(r"(?is)BEGIN:VCARD(.*?)END:VCARD"), F.lit(1))
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    rows = files.select(path.alias("path"), F.posexplode(cards).alias("card", "body")).withColumn("lines", F.split("body", "\r?\n"))

    def values(key: str):
        hit = F.filter("lines", lambda x: x.rlike(f"(?i)^([A-Za-z0-9-]+\\.)?{key}(;[^:]*)?:"))
        return F.filter(F.transform(hit, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), lambda x: x != "")

    n = F.split(F.get(values("N"), F.lit(0)), ";")
    from_n = F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.get(n, F.lit(1)), F.lit("")), F.nullif(F.get(n, F.lit(0)), F.lit("")))), F.lit(""))
    return rows.select("path", "card", F.coalesce(F.get(values("FN"), F.lit(0)), from_n).alias("name"), F.posexplode(values("TEL")).alias("line", "number")).where("name is not null")


def card_contacts(cards: DataFrame, country: str = "41") -> DataFrame:
    """(phone_jid, name, place) of parsed cards; ``place`` orders them as they were read."""
    rows = cards.select(fx.number_to_jid("number", country).alias("phone_jid"), "name", F.struct(F.coalesce("path", F.lit("")), "card", "line").alias("place"))
    return rows.where("phone_jid is not null")


def read_vcards(spark: SparkSession, path: str) -> DataFrame:
    """A .vcf file, or all of a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.vcf")
    return parse_vcards(files.select("value", F.col("_metadata.file_path").alias("path")))


def read_contact_list(spark: SparkSession, path: str, country: str = "41") -> DataFrame:
    """(phone_jid, name) from a JSON array of {name, number}; unusable numbers are left out."""
    rows = spark.read.schema("name string, number string").json(path, multiLine=True)
    return rows.select(fx.number_to_jid("number", country).alias("phone_jid"), F.trim("name").alias("name")).where("phone_jid is not null and name <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, header, text) of a text file, or of all in a folder: lines count from 1 in
    each file, ``header`` is the first one that is not blank (null if all are). Large files are
    read in blocks: the lines of the blocks before give each line its number."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    # two scans may cut files differently; an RDD is cut once, so that both sides see the same blocks
    text = spark.createDataFrame(text.rdd, text.schema, verifySchema=False).withColumn("at", F.monotonically_increasing_id())
    filled = F.when(F.trim("text") != "", F.col("at"))
    blocks = text.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min(filled).alias("filled"))
    file = Window.partitionBy("file")
    before = F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("shift", F.coalesce(before, F.lit(0)) - F.col("first") + 1)
    blocks = blocks.select("file", "block", "shift", F.min(F.col("filled") + F.col("shift")).over(file).alias("header"))
    return text.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "header", "text")


def read_pins(spark: SparkSession, path: str, country: str = "41") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a CSV with a phone and a name column under any known header.

    Rejects carry the line of the file they stand on, the first being 1. A pin is one line."""
    columns = spark.read.csv(path, header=True, encoding="UTF-8").columns
    fold = [c.replace("\ufeff", "").strip().lower().replace(" ", "_") for c in columns]
    phone = next((i for i, f in enumerate(fold) if f in PHONE_HEADERS), None)
    name = next((i for i, f in enumerate(fold) if f in NAME_HEADERS), None)
    if phone is None or name is None:
        raise ValueError("the header needs a phone and a name column")
    lines = numbered_lines(spark, path).where("line > header and trim(text) <> ''")
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(columns))), {"escape": '"'})
    rows = lines.select("line", cells.alias("c")).select("line", F.trim(f"c.c{phone}").alias("value"), F.trim(f"c.c{name}").alias("name"))
    rows = rows.withColumn("p", fx.phone_argument("value", country))
    reason = F.when(F.coalesce("value", F.lit("")) == "", "empty phone").when(F.coalesce("name", F.lit("")) == "", "empty name").otherwise(F.col("p.error"))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select(F.col("p.jid").alias("phone_jid"), "name"), rows.where("reason is not null").select("line", "value", "name", "reason")


def contact_starter(phones: DataFrame) -> DataFrame:
    """phone and an empty name, for a CSV to fill in."""
    return phones.select(fx.pretty_phone("phone_jid").alias("phone"), F.lit("").alias("name"))


def media_files(files: DataFrame) -> DataFrame:
    """Rows of a binaryFile read that belong to mirrored folders, with their SHA-256."""
    name = F.element_at(F.split("path", "/"), -1)
    inside = F.array_contains(F.transform(F.array(*map(F.lit, MEDIA_FOLDERS)), lambda f: F.contains(F.col("path"), F.concat(F.lit("/"), f, F.lit("/")))), True)
    skipped = name.startswith(".")
    for ending in SKIPPED_ENDINGS:
        skipped |= name.endswith(ending)
    return files.where(inside & ~skipped).select(F.col("path").alias("source_path"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("source_modified_ts"), F.contains("path", F.lit("/.Statuses/")).cast("int").alias("is_status"), F.lit(0).alias("is_view_once"))
