"""The stored archive as the named queries read it: every table, empty where nothing was
stored yet, and media with the place of their mirrored copy."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.operators import extract
from parley.plans.contacts import CONTACTS, HISTORY
from parley.plans.names import Archive
from parley.sources.store import Store
from parley.sources.text import MEDIA_FOLDERS
from parley.streaming.media import ledger


def below_media(path: str) -> F.Column:
    """The part of a path from the mirrored folder on; null outside these folders."""
    return F.nullif(F.regexp_extract(path, "((?:" + "|".join(f.replace(".", "[.]") for f in MEDIA_FOLDERS) + ")/.*)$", 1), F.lit(""))


_SCHEMAS: dict[str, StructType] = {}


def schemas(spark: SparkSession) -> dict[str, StructType]:
    """What every archive table looks like; the extractors say so, and are asked once."""
    if not _SCHEMAS:
        none = extract.Source(spark)
        tables = extract.extract_all(none, {}, F.lit(None).cast("timestamp"), backup=none)
        tables |= {"contacts": spark.createDataFrame([], CONTACTS), "contacts_history": spark.createDataFrame([], HISTORY)}
        _SCHEMAS.update((name, t.schema) for name, t in tables.items())
    return _SCHEMAS


def archive_of(store: Store) -> Archive:
    spark, have = store.spark, store.open()
    out = {name: spark.createDataFrame([], schema) for name, schema in schemas(spark).items() if name not in have} | have
    mirror = ledger(store)
    media = out["message_media"]
    if mirror is None:
        return out | {"message_media": media.withColumn("mirrored_path", F.lit(None).cast("string"))}
    copies = mirror.select(below_media("source_path").alias("_below"), F.col("archive_path").alias("mirrored_path")).where("_below is not null").dropDuplicates(["_below"])
    return out | {"message_media": media.withColumn("_below", below_media("file_path")).join(copies, "_below", "left").drop("_below")}
