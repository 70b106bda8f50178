"""Exact dedup by content sort.

Sampled splitters range-partition the normalised text, an external sort puts equal texts side by side,
and full comparison with the neighbour finds the runs of equal texts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """``text`` (null: empty) with A-Z lower-cased and all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def marked(docs: DataFrame, id_col: str, text_col: str, prefix: int, hot_rows: int, hot_texts: int) -> DataFrame:
    """(row, id, keep, size, kept, sha) with the whole rows of ``docs`` as the struct ``row``; see :func:`exact_dedup`.

    All columns of ``docs`` travel inside the struct, so none of their names can clash with the ones used here.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col).cast("string")
    rows = rows.select("row", F.col("row").getField(id_col).alias("id"), F.xxhash64(ascii_lower(text)).alias("h"))

    counts = rows.groupBy("h").count().where(F.col("count") > hot_rows)
    hot = [(r["h"], -(-r["count"] // hot_rows)) for r in counts.orderBy(F.desc("count"), "h").limit(hot_texts).collect()]
    dealt = rows.withColumn("blocks", F.lit(1).cast("long"))
    if hot:
        table = F.broadcast(spark.createDataFrame(hot, "hot long, many long"))
        dealt = rows.join(table, F.col("h") == F.col("hot"), "left").select("row", "id", "h", F.coalesce("many", F.lit(1)).alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("prefix", ascii_lower(F.substring(text, 1, prefix)))
    # The text itself travels once; its normal form, which is what is sorted and compared, is made on arrival.
    ranged = dealt.repartitionByRange("prefix", "h", "block").withColumn("norm", ascii_lower(text))
    run = W.partitionBy("prefix", "h", "block", "norm")
    out = ranged.select(
        "row", "id", "blocks", F.max("id").over(run).alias("keep"), F.count(F.lit(1)).over(run).alias("size"),
        F.row_number().over(run.orderBy(F.desc_nulls_last("id"))).alias("nth"), F.sha2("norm", 256).alias("sha"),
    )
    if hot:
        # one row for each hot text, and colliding ones, so a broadcast of bounded size
        found = rows.join(table, F.col("h") == F.col("hot"), "left_semi").groupBy(F.sha2(ascii_lower(text), 256).alias("hot_sha"))
        found = found.agg(F.max("id").alias("all_keep"), F.count(F.lit(1)).alias("all_size")).limit(4 * hot_texts)
        out = out.join(F.broadcast(found), F.col("sha") == F.col("hot_sha"), "left")
        split = F.col("blocks") > 1
        out = out.withColumns({"keep": F.when(split, F.col("all_keep")).otherwise(F.col("keep")), "size": F.when(split, F.col("all_size")).otherwise(F.col("size"))})
    return out.select("row", "id", "keep", "size", ((F.col("nth") == 1) & F.col("keep").eqNullSafe(F.col("id"))).alias("kept"), "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, hot_rows: int = 500, hot_texts: int = 65_536) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. The row with the largest id of
    a group stays; of rows repeated with one id exactly one stays, and a null id stays only in a group of null ids.
    An empty table gives an empty result; other columns of ``docs`` play no part, whatever their names.

    Splitters are drawn on (first ``prefix`` characters, 64-bit hash, block), a key of bounded size, so what the
    sampler brings to the driver is small and texts with one opening still spread out. A text with over
    ``hot_rows`` copies is dealt in blocks by id, so that no task holds all its copies; block results of the at
    most ``hot_texts`` most frequent such texts (16 bytes each on the driver) are merged through a summary of a row each,
    4 * ``hot_texts`` rows at most. A text beyond those has less than one ``hot_texts``-th of all rows and takes the ordinary
    path, which is exact at any size.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = marked(given, "doc_id", "text", prefix, hot_rows, hot_texts)
    return out.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, hot_rows: int = 500, hot_texts: int = 65_536) -> DataFrame:
    """The rows of ``docs`` that stay under :func:`exact_dedup`, with all their columns, in one pass over the texts."""
    return marked(docs, id_col, text_col, prefix, hot_rows, hot_texts).where("kept").select("row.*")
