"""Catalogues of binary messages, and rows of the services' documents; the messages themselves are in ``archives``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import weather as W

# Kinds of places that count as townships.
TOWNSHIP_KINDS = ("镇", "乡", "街道", "民族乡", "苏木", "民族苏木")


def json_index(lines: DataFrame) -> DataFrame:
    """``lines``: file, line, each a JSON object: param, levtype, offset, length; broken lines are left out."""
    d = F.from_json("line", "param string, levtype string, _offset bigint, _length bigint")
    return lines.select("file", d.alias("d")).where("d.param IS NOT NULL").select("file", "d.param", "d.levtype", F.col("d._offset").alias("offset"), F.col("d._length").alias("length"))


def select_fields(index: DataFrame, wanted: dict[str, list[str]], required: list[str]) -> DataFrame:
    """(file, field, param, offset, length): for each field the first of its candidate names that a file's surface messages have.

    A file that lacks a required field has a row for it with nulls, which ``lacking`` lists.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("rank"), F.lit(p).alias("param"), F.lit(f in required).alias("required")) for f, names in wanted.items() for k, p in enumerate(names)])
    asked = index.select("file").distinct().select("file", F.explode(pairs).alias("a")).select("file", "a.*")
    surface = index.where("levtype = 'sfc'").groupBy("file", "param").agg(F.min(F.struct("offset", "length")).alias("m"))
    j = asked.join(surface, ["file", "param"], "left")
    best = j.groupBy("file", "field").agg(F.min_by(F.struct("param", "m"), F.when(F.col("m").isNotNull(), F.col("rank"))).alias("b"), F.max("required").alias("required"))
    return best.where("b IS NOT NULL OR required").select("file", "field", F.col("b.param").alias("param"), F.col("b.m.offset").alias("offset"), F.col("b.m.length").alias("length"))


def lacking(selected: DataFrame) -> DataFrame:
    return selected.where("param IS NULL").select("file", "field")


def normalised(fields: DataFrame) -> DataFrame:
    """Messages' values (i, j, step, field, unit, value, lat, lon) in canonical units and longitudes, one row for each cell with the fields as columns.

    A cell without window extremes has its temperature in their place.
    """
    names = ["t2m", "tmax3", "tmin3", "u10", "v10", "tp", "snow", "tcc", "orog", "gust"]
    f = fields.withColumn("value", W.canonical(F.col("value"), F.col("unit"), F.col("field"))).withColumn("lon", W.wrap_longitude(F.col("lon")))
    wide = f.groupBy("lat", "lon", "step").pivot("field", names).agg(F.first("value", ignorenulls=True))
    return wide.withColumn("tmax3", F.coalesce("tmax3", "t2m")).withColumn("tmin3", F.coalesce("tmin3", "t2m"))


def candidate_runs(nows: DataFrame, lookback: int = 2, least_age_hours: float = 2.0, cycles: tuple[int, ...] = (18, 12, 6, 0)) -> DataFrame:
    """Cycles worth considering at each ``now``, the newest first by ``place``; how many there are is fixed."""
    back = F.explode(F.sequence(F.lit(0), F.lit(lookback)))
    c = nows.withColumn("_back", back).withColumn("_hour", F.explode(F.array(*map(F.lit, cycles))))
    c = c.withColumn("init", F.date_sub(F.to_date("now"), F.col("_back")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_hour")))
    old = c.where(F.timestamp_diff("SECOND", F.col("init"), F.col("now")) >= least_age_hours * 3600)
    from pyspark.sql import Window

    return old.withColumn("place", F.row_number().over(Window.partitionBy("now").orderBy(F.desc("init")))).drop("_back", "_hour")


def latest_run(candidates: DataFrame, catalogue: DataFrame, least_step: int) -> DataFrame:
    """The newest candidate that the catalogue (init, step) holds to the step: a semi-join, then one row for each ``now``."""
    there = catalogue.where(F.col("step") >= least_step).select("init").distinct()
    return candidates.join(there, "init", "left_semi").groupBy("now").agg(F.max("init").alias("init"))


def previous_runs(docs: DataFrame, variables: list[str], leads: list[int]) -> DataFrame:
    """Rows (station, time, lead, variables) of documents (station, json) whose arrays are named <variable>_previous_day<lead>."""
    fields = ", ".join(f"{v}_previous_day{n}: array<double>" for v in variables for n in leads)
    parsed = docs.select("station", F.from_json("json", f"hourly struct<time: array<string>, {fields}>").alias("d"))
    per = F.array(*[F.struct(F.lit(n).alias("lead"), *[F.col(f"d.hourly.{v}_previous_day{n}").alias(v) for v in variables]) for n in leads])
    each = parsed.select("station", F.col("d.hourly.time").alias("time"), F.explode(per).alias("p"))
    return each.select("station", "p", F.posexplode("time").alias("k", "time")).select("station", "time", F.col("p.lead").alias("lead"), *[F.get(F.col(f"p.{v}"), F.col("k")).alias(v) for v in variables])


def place_rows(docs: DataFrame) -> DataFrame:
    """(name, lat, lon) of a query service's JSON bindings (json): places of township kinds with a point, the first of each name."""
    value = "struct<value:string>"
    d = docs.select(F.posexplode(F.from_json("json", f"results struct<bindings:array<struct<label:{value},kind:{value},coord:{value}>>>")["results"]["bindings"]).alias("k", "b"))
    lon, lat = (F.regexp_extract("b.coord.value", r"Point\((-?[0-9.]+) (-?[0-9.]+)\)", i) for i in (1, 2))
    rows = d.select("k", F.trim("b.label.value").alias("name"), F.col("b.kind.value").alias("kind"), F.nullif(lat, F.lit("")).cast("double").alias("lat"), F.nullif(lon, F.lit("")).cast("double").alias("lon"))
    good = rows.where(F.col("kind").isin(*TOWNSHIP_KINDS) & F.col("lat").isNotNull() & (F.col("name") != ""))
    return good.groupBy("name").agg(F.min_by(F.struct("lat", "lon"), "k").alias("p")).select("name", "p.lat", "p.lon")


def around(points: DataFrame, pad: float) -> DataFrame:
    """The box of all points, padded: one row lat_min, lat_max, lon_min, lon_max."""
    return points.agg((F.min("lat") - pad).alias("lat_min"), (F.max("lat") + pad).alias("lat_max"), (F.min("lon") - pad).alias("lon_min"), (F.max("lon") + pad).alias("lon_max"))


def step_subset(rows: DataFrame, steps: list[int]) -> DataFrame:
    """Rows at the steps, all of which must be there."""
    have = {r["step"] for r in rows.where(F.col("step").isin(*steps)).select("step").distinct().collect()}  # at most the steps asked for
    if missing := sorted(set(steps) - have):
        raise ValueError(f"steps not in the run: {missing}")
    return rows.where(F.col("step").isin(*steps))


def step_gap(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median and least positive gap of the distinct steps of each key."""
    from pyspark.sql import Window

    d = rows.select(*by, "step").distinct().withColumn("_g", F.col("step") - F.lag("step").over(Window.partitionBy(*by).orderBy("step")))  # steps of a run
    return d.groupBy(*by).agg(F.median("_g").alias("gap"), F.min("_g").alias("cadence"))
