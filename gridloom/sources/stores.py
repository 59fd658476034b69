"""Stores: upserts, retention, logs, indexes and what is written, as DataFrame operations.

Paths are any that Spark's writers reach; what must be all or nothing goes to a folder of its own first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], seq: list[Column]) -> DataFrame:
    """The last row of each key in the given order; max_by combines on the map side, so hot keys do not pile up."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, F.struct(*seq)).alias("r")).select("r.*")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """New rows replace stored ones of the same key, later new rows earlier ones."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, [F.col("_new"), F.col(seq)]).drop("_new")


def retained(rows: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the newest one."""
    newest = rows.agg(F.max(time).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.col(time) >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def newest(rows: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def orphans(files: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return files.join(index, key, "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends issued rows by month of their issue."""
    rows.withColumn("month", F.substring("issue", 1, 7)).write.mode("append").partitionBy("month").parquet(path)


def load_log(log: DataFrame, since: str | None, keys: list[str], seq: str) -> DataFrame:
    """Rows since an issue, months pruned, the last of each key."""
    rows = log.where((F.col("month") >= since[:7]) & (F.col("issue") >= since)) if since else log
    return last_wins(rows, keys, [F.col(seq)])


# ---------------------------------------------------------------- writing and reading

FRAME = ("source", "run_init", "init_time", "point", "step", "valid_time", "t2m", "wind_speed", "wind_dir", "precip", "precip_accum")


def to_frame(series: DataFrame, source: str) -> DataFrame:
    """Long rows of one source in the store's columns, those that the series has, ordered by point and step."""
    named = series.withColumn("source", F.lit(source)).withColumnRenamed("init", "init_time").withColumn("run_init", F.date_format("init_time", "yyyyMMddHH")).withColumn("valid_time", F.col("init_time") + F.make_dt_interval(F.lit(0), F.col("step")))
    return named.select(*[c for c in FRAME if c in named.columns]).orderBy("point", "step")


def stacked(members: dict[str, DataFrame]) -> DataFrame:
    """Members one above the other with their name; a column that a member lacks is null."""
    from functools import reduce

    tables = [df.withColumn("member", F.lit(m)) for m, df in members.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_store(frames: list[DataFrame], path: str, replace: bool = True) -> None:
    """Frames as one table by source and run, sorted by point for look-ups; replaces the runs that the frames have, and no others, or adds to them."""
    if not frames:
        raise ValueError("no frames to write")
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).hint("rebalance", "source", "run_init")
    writer = both.sortWithinPartitions("source", "run_init", "point", "valid_time").write.mode("overwrite" if replace else "append")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("source", "run_init").parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int, keys: list[str], order: list[str]) -> None:
    """A table of the session under an explicit path, dealt out and sorted by key: joins of such tables by these keys move no rows.

    There is one file for each bucket, since rows are dealt out as buckets are before they are written.
    """
    rows.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(name)


def read_store(spark: SparkSession, path: str, schema: str, corrupt_is_none: bool = True) -> DataFrame:
    """A store's rows; files that cannot be read are left out."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", corrupt_is_none).parquet(path)


def save_points(points: DataFrame, path: str) -> None:
    """The point table in order of id, each file with a heading."""
    points.orderBy("id").write.mode("overwrite").option("header", True).csv(path)


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored document, or nothing where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by the session's spark.checkpoint.dir.

    Where that is unset a local master (tests, one machine) gets a temporary one; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


# ---------------------------------------------------------------- keeping up to date


def latest(rows: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.max(time).alias("latest"))


def due(keys: DataFrame, stored: DataFrame, key: str, time: str, overlap_hours: int, since: Column) -> DataFrame:
    """From when each key has to be fetched again: ``overlap_hours`` before its newest row, or ``since`` where it has none."""
    have = stored.groupBy(key).agg(F.max(time).alias("_t"))
    return keys.join(have, key, "left").select(key, F.greatest(F.coalesce(F.col("_t") - F.make_dt_interval(F.lit(0), F.lit(overlap_hours)), since), since).alias("fetch_from"))


def updated(stored: DataFrame, new: DataFrame, keys: list[str], seq: str, time: str, oldest: Column) -> DataFrame:
    """An archive with new rows merged by key, the later ones counting, and rows before ``oldest`` dropped."""
    return upsert(stored, new, keys, seq).where(F.col(time) >= oldest)


def merged_maps(left: Column, right: Column) -> Column:
    """Two maps as one; the right one counts where both have a key."""
    old = F.map_filter(F.coalesce(left, F.create_map().cast("map<string,double>")), lambda k, v: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(old, F.coalesce(right, F.create_map().cast("map<string,double>")))


def index_of(documents: DataFrame, hourly: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` documents (file, county, run, generated), newest first, and whether an hourly file stands beside each; ``latest`` marks the first."""
    w = Window.partitionBy("county").orderBy(F.desc("generated"), F.desc("run"))  # the runs of one county
    d = documents.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
    return d.join(hourly.select("file").distinct().withColumn("_h", F.lit(True)), "file", "left").withColumn("hourly", F.coalesce("_h", F.lit(False))).withColumn("latest", F.col("place") == 1).drop("_h")


def current(wanted: DataFrame, stored: DataFrame, schema_version: int, need_hourly: bool = True) -> DataFrame:
    """Wanted documents (county, run, first) with ``is_current``: one of the same run, first period and format is stored, and its hourly file where that is needed."""
    have = stored.where((F.col("schema") == schema_version) & (F.col("hourly") | F.lit(not need_hourly))).select("county", "run", "first").distinct().withColumn("_c", F.lit(True))
    return wanted.join(have, ["county", "run", "first"], "left").withColumn("is_current", F.coalesce("_c", F.lit(False))).drop("_c")


def publish_once(spark: SparkSession, make, path: str, run: str, first: str, schema_version: int = 2, force: bool = False) -> bool:
    """Writes ``make()`` as the documents of a run unless they stand there with the same first period and format; whether it wrote.

    The folder is named by all three, and Spark's commit leaves a ``_SUCCESS`` only in a whole one, so a run that broke off
    is made again and one that is done is not.
    """
    folder = f"{path.rstrip('/')}/run={run}/first={first}/schema={schema_version}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    done = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if done and not force:
        return False
    make().write.mode("overwrite").json(folder)
    return True
