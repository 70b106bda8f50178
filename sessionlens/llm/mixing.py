"""Mixing of sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the total of ``value`` before each row, in order of (bucket, order) for each of ``keys``.

    Sums by bucket are added up first, so only the rows of one bucket meet in a task, never those of a whole key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col(bucket) == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, same)
        .withColumn(out, F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, weight, target from rows of (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all sizes; no target
    exceeds ``most`` times its source's size and what a source can't use goes to the others by weight. All sources
    fill up in step to one level of words per weight. With sources in order of the level at which they are full, the
    level that is left when all before a source are full rises up to the first source that stays open and falls after
    it, so the final level is the largest.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = W.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(n) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")))
    per = per.withColumn("_most", most * F.col("source_size")).withColumn("_full", F.col("_most") / F.col("weight"))
    order = W.orderBy("_full", F.asc_nulls_last("source"))
    full, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_most").over(full), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("_level", level)
    target = F.least(F.col("_most"), F.max("_level").over(everything) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", bucket_rows: int = 20_000, most_steps: int = 65_536, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, and the columns ``keep`` of ``docs``.

    Each source's documents are shuffled by a hash of (seed, id) and played ``most`` times at most. A play's virtual
    finish time is the source's words up to and with it, divided by the source's weight. All plays in order of finish
    time are taken while they fit the budget of ``share`` times all words: a source that runs out leaves its room to
    the others, which is what :func:`source_targets` says in closed form. ``taken`` is copies times size. Repeated ids
    are documents of their own, ids may be of any type, null ids come first in the shuffle, a null or empty text has size 0 and takes nothing;
    an empty table gives an empty result. The order depends on ids alone, so reruns agree.

    The global order by finish time is cut into equal steps of time. Their sums say which step holds the budget's
    end, and only that step's plays are sorted, so no task sees more than one step or one bucket of a source.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), *keep)
    sized = cut(sized.withColumn("_shuffle", F.coalesce(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), F.lit(""))))
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    budget, buckets = share * total["size"], max(1, -(-total["n"] // bucket_rows))
    digits = max(1, len(f"{buckets - 1:x}"))
    targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "_source")
    queued = (
        running_total(sized.withColumn("_bucket", F.substring("_shuffle", 1, digits)), ["source"], "_bucket", ["_shuffle", "doc_id", "size"], "size", "_start")
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
    )
    queued = cut(queued.select("doc_id", "source", "size", "source_size", "weight", "target", "_shuffle", "_start", *keep))

    step = max(1.0, most * total["size"] / min(64 * buckets, most_steps))
    finish = lambda play: (play * F.col("source_size") + F.col("_start") + F.col("size")) / F.col("weight")
    step_of = lambda time: F.floor(time / step)
    plays = queued.withColumn("_play", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("_finish", finish(F.col("_play")))
    plays = plays.withColumn("_step", step_of(F.col("_finish")))
    sums = plays.groupBy("_step").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_to", F.sum("_sum").over(W.orderBy("_step").rowsBetween(W.unboundedPreceding, 0)))
    end = sums.where(F.col("_to") > budget).orderBy("_step").limit(1).collect()
    if not end:
        copies = F.lit(most)
    else:
        at, below = end[0]["_step"], end[0]["_to"] - end[0]["_sum"]
        key = lambda play, time: F.struct(time.alias("a"), F.col("source").isNull().alias("b"), F.coalesce("source", F.lit("")).alias("c"), play.alias("d"), F.col("_shuffle").alias("e"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("f"), F.col("size").alias("g"))
        edge = plays.where(F.col("_step") == at).withColumn("_key", key(F.col("_play"), F.col("_finish")))
        edge = edge.withColumn("_to", F.sum("size").over(W.orderBy("_key").rowsBetween(W.unboundedPreceding, 0)) + below)
        last = edge.where(F.col("_to") <= budget).agg(F.max("_key").alias("k")).first()["k"]
        fits = lambda play: F.lit(False) if last is None else key(play, finish(play)) <= F.struct(*[F.lit(v).alias(n) for n, v in last.asDict().items()])
        copies = sum((F.when((step_of(finish(F.lit(p))) < at) | ((step_of(finish(F.lit(p))) == at) & fits(F.lit(p))), 1).otherwise(0) for p in range(most)), F.lit(0))
    return queued.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), *keep)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with all their columns.

    Rows are told apart by a key of their own, so rows with null or repeated ids are taken as often as :func:`mix` counts, and
    columns travel inside a struct, so none of their names can clash.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = cut(docs.select(whole, F.monotonically_increasing_id().alias("nth")))
    of = lambda c: F.col("row").getField(c).alias(c)
    given = rows.select(of(id_col).alias("doc_id"), of(text_col).alias("text"), of(source_col).alias("source"), "nth")
    taken = mix(given, keep=("nth",), **options).where("copies > 0").select(F.col("nth").alias("taken"), F.col("copies").cast("int").alias("copies"))
    return rows.join(taken, F.col("nth") == F.col("taken")).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same in one pass for DuckDB; seed, weights, share and number of plays as above.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS size,
    md5('mix' || CAST(doc_id AS VARCHAR)) AS shuffle
  FROM {docs}),
per AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0 * source_size AS most FROM per),
levels AS (
  SELECT *, most / weight AS f,
    (1.5 * (sum(source_size) OVER ()) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, weight, CAST(least(most, (SELECT max(level) FROM levels) * weight) AS DOUBLE) AS target FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.weight, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY shuffle, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
plays AS (
  SELECT *, sum(size) OVER (ORDER BY CAST(play * source_size + upto AS DOUBLE) / weight, source NULLS LAST, play, shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      <= 1.5 * (SELECT sum(size) FROM sized) AS fits
  FROM queued CROSS JOIN (VALUES (0), (1)) p(play))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(max(source_size) AS BIGINT) AS source_size, max(target) AS target,
  CAST(count(*) FILTER (fits) * size AS BIGINT) AS taken, count(*) FILTER (fits) AS copies
FROM plays GROUP BY doc_id, source, size
"""
