"""Line dedup over levelled sorted runs of line keys, with DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z in lower case; keys of at least ``shortest``
code points take part, as two 64-bit hashes of different seeds.  A run holds one entry for each key of a batch of
documents: in how many documents it stands and the largest of their ids.  Runs are bucketed and sorted by key, so
that a new batch meets them in merge joins for which only the batch is shuffled.  A batch leaves out the entries
that a run has settled already (enough documents, an id as large), and adds the rest as a run of level 0; as soon
as a level holds ``fanout`` runs they are merged into one of the next level.  What the runs know at the end decides
which lines go.

A key that very many documents hold never gathers in one task: batches count by (key, document) first and combine
before they shuffle, and keys of more than a 50,000th of all lines, of which there can be 50,000 at most, are
broadcast when lines look up their keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, whole_texts

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["hi", "lo"]

#: At most so many keys are broadcast as frequent ones.
FREQUENT = 50_000


def line_keys(docs: DataFrame, shortest: int = 20) -> DataFrame:
    """(doc_id, text_hash, pos, hi, lo) of every line whose key has at least ``shortest`` code points.

    Null and empty texts are one empty line.  Rows that repeat a doc_id count as one document; text_hash tells
    their texts apart.
    """
    texts = whole_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    lines = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.length("line") >= shortest)
    ascii_only = F.length("line") == F.octet_length("line")
    keyed = bare.withColumn("line", F.when(ascii_only, F.lower("line")).otherwise(F.translate("line", UPPER, LOWER)))
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("hi"), F.xxhash64(F.lit("second"), "line").alias("lo"))


def entries(keys: DataFrame) -> DataFrame:
    """(hi, lo, docs, last): in how many documents a key stands, and the largest id of them; a null id is a document below all others."""
    return keys.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


class LineRuns:
    """Runs of line keys in a folder that all executors share.

    ``state`` lists (level, table folder) and may be given to a later session, which then goes on with the same runs.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, enough: int = 3, fanout: int = 3, state: list[tuple[int, str]] | None = None):
        if fanout < 2:
            raise ValueError("runs are merged by two at least")
        self.spark, self.folder, self.buckets, self.enough, self.fanout = spark, folder.rstrip("/"), buckets, enough, fanout
        self.runs: list[tuple[int, str, str]] = []
        for level, path in state or []:
            self.runs.append((level, path, self._table(path)))

    @property
    def state(self) -> list[tuple[int, str]]:
        return [(level, path) for level, path, _ in self.runs]

    def _table(self, path: str) -> str:
        """Names a run's folder to the session, with its buckets; the name is dropped again by ``close``."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (hi BIGINT, lo BIGINT, docs BIGINT, last BIGINT) USING parquet "
            f"CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return name

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str, str]:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        name = self._table(path)
        # one file for each bucket: the rows are dealt out as the buckets are
        rows.repartition(self.buckets, *KEY).select(*KEY, "docs", "last").write.insertInto(name)
        return level, path, name

    def _merged(self, runs: list[tuple[int, str, str]]) -> DataFrame:
        # the filter, which all rows pass, makes rows of the scans' columns: Spark 4.1 pairs up the buckets of a union of
        # rows, as the plan then counts on, but not those of a union of columns
        both = self.spark.table(runs[0][2]).where("docs > 0")
        for _, _, name in runs[1:]:
            both = both.unionAll(self.spark.table(name).where("docs > 0"))
        return both.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, batch: DataFrame, frequent: int) -> None:
        """Takes in a batch's keys (as of ``line_keys``), whose documents no earlier batch has held.

        Entries of at least ``frequent`` documents are kept even where a run has settled them, so that the runs
        know the frequent keys.
        """
        new = entries(batch)
        for _, _, name in self.runs:
            run = self.spark.table(name).where(F.col("docs") >= self.enough).alias("run")
            settled = (F.col("new.hi") == F.col("run.hi")) & (F.col("new.lo") == F.col("run.lo")) & (F.col("new.docs") < frequent) & (F.coalesce("new.last", F.lit(-(2**63))) <= F.col("run.last"))
            new = new.alias("new").join(run, settled, "left_anti")
        self.runs.append(self._write(new, 0))
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self._write(self._merged(full), level + 1)
            self.runs = [r for r in self.runs if r[0] != level] + [merged]
            level += 1

    def repeated(self) -> DataFrame:
        """(hi, lo, docs, last) of the keys of enough documents; docs counts too low where entries were left out."""
        return self._merged(self.runs).where(F.col("docs") >= self.enough)

    def close(self) -> None:
        """Forgets the tables' names; their files stay."""
        for _, _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, shortest: int = 20, enough: int = 3, batches: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row, its text without repeated lines.

    Keys of at least ``shortest`` code points in at least ``enough`` documents lose all their lines but those in the
    document of the largest id.  The table is dealt into ``batches`` by ranges of ids, largest first; their number does
    not touch the result.  A null or empty text is one empty line; repeated rows of a document repeat; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(batches - 1, 0, -1)], 1000)).first()[0] or []
    batch = sum([F.when(F.coalesce(F.col("doc_id") <= c, F.lit(True)), 1).otherwise(0) for c in cuts], F.lit(0))
    line_keys(docs, shortest).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/keys")
    schema = "doc_id long, text_hash long, pos int, hi long, lo long, batch int"
    keys = spark.read.schema(schema).parquet(f"{folder}/keys")
    sizes = dict(keys.groupBy("batch").count().collect())  # one row for each batch
    frequent = max(1000, sum(sizes.values()) // FREQUENT)
    runs = LineRuns(spark, f"{folder}/runs", int(spark.conf.get("spark.sql.shuffle.partitions")), enough)
    for k in sorted(sizes):
        runs.add(keys.where(F.col("batch") == k), frequent)
    if not runs.runs:
        gone = spark.createDataFrame([], "doc_id long, text_hash long, gone array<int>")
    else:
        runs.repeated().write.parquet(f"{folder}/repeated")
        runs.close()
        repeated = spark.read.schema("hi long, lo long, docs long, last long").parquet(f"{folder}/repeated")
        often, seldom = repeated.where(F.col("docs") >= frequent), repeated.where(F.col("docs") < frequent)
        lines = keys.drop("batch")
        # each key is in one of the two; the frequent ones, a bounded number, do not gather their lines
        dropped = lines.join(F.broadcast(often), KEY).unionAll(lines.join(F.broadcast(often.select(*KEY)), KEY, "left_anti").join(seldom, KEY))
        dropped = dropped.where(F.coalesce(F.col("doc_id") < F.col("last"), F.lit(True)))
        gone = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    texts = whole_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    same = texts.doc_id.eqNullSafe(gone.doc_id) & (texts.text_hash == gone.text_hash)
    # the drop lists are built into the hash table of the join, so texts are not sorted
    met = texts.join(gone.hint("shuffle_hash"), same, "left").select(texts.doc_id, texts.text, "gone")
    met = met.withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n"))
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), rest.alias("text"))


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text's hash."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
