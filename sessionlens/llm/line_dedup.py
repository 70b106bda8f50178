"""Lines that many documents share: levelled sorted runs of line hashes, and the texts without such lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import cut, fresh

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def hashed(key: Column) -> dict[str, Column]:
    """Two independent 64-bit hashes: 128 bits tell all lines of a corpus apart."""
    return {"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit("second"), key)}


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Sorted runs of (h1, h2, n documents) in levels, as a log-structured store keeps them.

    Each run is a table bucketed and sorted by the hashes in the folder that driver and executors share, so a merge join
    with a batch that is dealt alike moves and sorts nothing of the run. A batch first loses the keys that some run
    already holds with ``least`` documents, by a merge-anti-join with each run: nothing can change them any more. What is
    left becomes a run of level 0. ``fanout`` runs of a level are merged into one of the next, so there are at most
    ``fanout`` - 1 runs a level and a key is rewritten once a level.
    """

    def __init__(self, spark: SparkSession, least: int, fanout: int = 4, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: list[str] = []
        home = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not home:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            home = tempfile.mkdtemp(prefix="spark-runs-")
        self.home = f"{home.rstrip('/')}/line-runs-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, by: str | None = None, dealt: bool = False) -> str:
        """``rows``, with unique keys, as a sorted run; ``by`` keeps a run for each value of that column in one table."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, *KEY)
        out = rows.sortWithinPartitions(*([by] if by else []), *KEY).write.format("parquet").option("path", f"{self.home}/{name}")
        if by:
            out = out.partitionBy(by)
        out.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch's (h1, h2, n), a row for each key."""
        for run in self.runs():
            batch = batch.join(run.where(F.col("n") >= self.least).hint("merge"), KEY, "left_anti")
        self._put(0, self.write(batch))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            self._put(level + 1, self.write(self._merged(self.levels[level]), dealt=True))
            for x in self.levels[level]:
                self._drop(x)
            self.levels[level] = []

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs added up. Read as plain files: over a union of bucketed scans Spark 4.1 takes the buckets for the union's own partitioning, yet doesn't scan by bucket."""
        out = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.home}/{name}" for name in names])
        return out.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """(h1, h2, n) of the keys with at least ``least`` documents."""
        if not any(self.levels):
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        names = [name for level in self.levels for name in level]
        return (self.spark.table(names[0]) if len(names) == 1 else self._merged(names)).where(F.col("n") >= self.least)

    def _drop(self, name: str) -> None:
        """Takes the table out of the catalog and its files out of the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.made.remove(name)

    def drop(self) -> None:
        for name in list(self.made):
            self._drop(name)
        self.levels = []


def line_counts(docs: DataFrame, text: str, batch: Column, least_chars: int = 1) -> DataFrame:
    """(batch, h1, h2, n): documents of each batch that hold each line key. A document's own repeats go before anything travels."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), line_key))
    lines = docs.select(batch.alias("batch"), F.explode(keys).alias("key")).where(F.length("key") >= least_chars)
    return lines.select("batch", *[v.alias(k) for k, v in hashed(F.col("key")).items()]).groupBy("batch", *KEY).agg(F.count(F.lit(1)).alias("n"))


def frequent_lines(docs: DataFrame, text: str, least: int, least_chars: int, batches: int, fanout: int, batch: Column) -> tuple[LineRuns, DataFrame]:
    """The runs that ``batches`` batches of ``docs`` leave, and their keys of at least ``least`` documents."""
    runs = LineRuns(docs.sparkSession, least, fanout)
    arrived = runs.write(line_counts(docs, text, F.pmod(batch, F.lit(batches)), least_chars), by="batch")
    for b in range(batches):
        runs.add(docs.sparkSession.table(arrived).where(F.col("batch") == b).drop("batch"))
    return runs, runs.frequent()


def joined_lines(lines: DataFrame, frequent: DataFrame, most_broadcast: int, hot: int) -> DataFrame:
    """The rows of ``lines`` whose key is frequent.

    Up to ``most_broadcast`` keys (24 bytes each) are sent to all tasks. Beyond that the ``hot`` most frequent ones are, and
    only the other lines are shuffled, so that a shuffled key has less than one ``hot``-th of all line-document pairs.
    """
    if frequent.limit(most_broadcast + 1).count() <= most_broadcast:
        return lines.join(F.broadcast(frequent.select(*KEY)), KEY, "left_semi")
    top = cut(frequent.orderBy(F.desc("n"), *KEY).limit(hot).select(*KEY))
    rest = frequent.join(F.broadcast(top), KEY, "left_anti").select(*KEY)
    return lines.join(F.broadcast(top), KEY, "left_semi").unionByName(lines.join(F.broadcast(top), KEY, "left_anti").join(rest.hint("merge"), KEY, "left_semi"))


def marked(docs: DataFrame, id_col: str, text_col: str, keep: list[str], least: int, least_chars: int, batches: int, fanout: int, most_broadcast: int, hot: int) -> DataFrame:
    """(row, lines, drop): each row's ``keep`` columns as a struct, its lines, and the places of those that go, or null."""
    text = F.col(text_col).cast("string")
    named = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    # A row is known by what it holds, so its key is the same whenever a lost task runs again. Equal rows lose equal lines.
    keyed = named.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit("row"), "id", "text")})
    runs, frequent = frequent_lines(named, "text", least, least_chars, batches, fanout, F.xxhash64("id", "text"))
    lines = keyed.select("k1", "k2", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars).select("k1", "k2", "at", *[v.alias(k) for k, v in hashed(F.col("key")).items()])
    gone = joined_lines(lines, frequent, most_broadcast, hot)
    places = cut(gone.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("drop")))
    runs.drop()
    return keyed.select("row", "k1", "k2", lines_of(F.col("text")).alias("lines")).join(places, ["k1", "k2"], "left").select("row", "lines", "drop")


def _kept(lines: str, drop: str) -> Column:
    """The lines between the dropped ones, joined again."""
    ends = F.concat(F.array(F.lit(-1)), F.col(drop), F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size(drop) + 1), lambda i: F.slice(lines, F.element_at(ends, i) + 2, F.element_at(ends, i + 1) - F.element_at(ends, i) - 1))
    return F.array_join(F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.flatten(between)), "\n")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, least_chars: int = 1, batches: int = 4, fanout: int = 4, most_broadcast: int = 500_000, hot: int = 65_536) -> DataFrame:
    """``docs`` with the lines that at least ``least`` documents hold taken out of their texts, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of under ``least_chars`` code
    points stay. Every row counts as a document, also repeated and null ids. A null or empty text has one empty line and
    comes back empty. If ``docs`` has columns named n_lines or n_dropped, the added ones get underscores in front. An empty
    table stays empty.

    Documents arrive in ``batches`` batches, by a hash of the row, at :class:`LineRuns`. Keys are 128-bit hashes. No text is
    shuffled unless the places of dropped lines are too large to be sent to all tasks; then it is once.
    """
    out = marked(docs, id_col, text_col, docs.columns, least, least_chars, batches, fanout, most_broadcast, hot)
    n_lines, n_dropped = fresh(docs.columns, "n_lines", "n_dropped")
    columns = [_kept("lines", "drop").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, F.size("lines").cast("long").alias(n_lines), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(n_dropped))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): what :func:`without_common_lines` makes of each row, with a digest for the text."""
    out = without_common_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), **how)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
