"""Exact dedup by 128-bit content hash, built-in functions only.

Texts are equal when they are after each run of ASCII white space has become one space. Groups come from
the hash; inside a group every member's bytes are compared with the bytes of the row that stays, and rows
that differ (a collision) are grouped anew by their bytes. A group of many rows is split by a salt: each
split compares with a copy of the one row.

Null texts count as empty; empty texts are equal to each other. A null doc_id comes after every other id.
Rows that repeat the id that stays are that document listed again and are kept too. An empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, salt, small_or_shuffled, write_table

#: Rows that compare with one copy of the row that stays.
EACH = 2000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hashed=content_hash, each: int = EACH) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. ``hashed`` may be a weaker hash, for tests.

    Only hashes are grouped. Texts move for the members of groups of two and more alone, and where the list
    of such groups is small (it is counted) not even theirs: the list goes to the texts.
    """
    rows = columns_of(docs).select("doc_id", normalised(F.col("text")).alias("body")).withColumn("h", hashed(F.col("body")))
    keys = write_table(rows.select("doc_id", "h", F.unhex(F.sha2("body", 256)).alias("sha")), "keys")
    groups = write_table(keys.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    listed = small_or_shuffled(groups, groups.count())
    alone = keys.join(listed, "h", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))

    several = write_table(rows.join(listed, "h").withColumn("s", salt(F.col("doc_id"), F.col("group_size"), each)), "several")
    stays = several.filter("doc_id <=> keep_id").groupBy("h").agg(F.min("body").alias("kept_body"), F.first("group_size").alias("n"))
    copies = stays.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / F.lit(each)), F.lit(1)).cast("long") - 1))).drop("n")
    compared = several.join(copies, ["h", "s"]).withColumn("same", F.col("body") == F.col("kept_body")).withColumn("text_sha256", F.sha2("body", 256))
    found = write_table(compared.select("doc_id", "h", "keep_id", "group_size", "same", "text_sha256", F.when(~F.col("same"), F.col("body")).alias("body")), "compared")
    differ = found.filter("not same")
    collided = differ.count()
    fewer = differ.groupBy("h").agg(F.count(F.lit(1)).alias("less"))
    same = found.filter("same").join(small_or_shuffled(fewer, collided), "h", "left").select("doc_id", "keep_id", (F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"), "text_sha256")
    anew = differ.groupBy("h", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    others = differ.drop("keep_id", "group_size").join(small_or_shuffled(anew, 1000 * collided), ["h", "body"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(same).unionByName(others).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
