"""Station reports and forecast documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hours of precipitation groups by code digit.
RAIN_HOURS = {"1": 6, "2": 12, "3": 18, "4": 24, "5": 1, "6": 2, "7": 3, "8": 9, "9": 15}
KNOT = 0.514444
REPORT = "t double, td double, wind_dir double, wind_speed double, gust double, p6 double, p12 double, r24 double, tx24 double, tn24 double, ww int"


def signed_tenths(group: Column) -> Column:
    """Temperature of a group whose second character is the sign and the next three tenths of a degree."""
    v = F.try_to_number(F.substring(group, 3, 3), F.lit("999")).cast("double") / 10
    return F.when(F.substring(group, 2, 1) == "0", v).when(F.substring(group, 2, 1) == "1", 0.0 - v)  # 0 has no sign


def rain_code(code: Column) -> Column:
    """Millimetres; 990 is a trace (0.05), 991 to 999 are tenths."""
    n = F.try_to_number(code, F.lit("999")).cast("int")
    return F.when(n == 990, 0.05).when(n > 990, (n - 990) / 10.0).otherwise(n.cast("double"))


def decode_reports(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``line``: wmo,YYYY,MM,DD,hh,mm,report. One row for each readable line: wmo, time and the measures, all nullable.

    Built-in functions only: groups are filtered by section and first digit, so nothing runs row by row in
    Python.  Of repeated groups the first counts.  Columns named in ``also`` are passed on.
    """
    p = F.split("line", ",", 7)
    ok = lines.where(F.col("line").rlike(r"^\d{5},\d{4},\d\d,\d\d,\d\d,\d\d,")).select(*also, p[0].alias("wmo"), F.concat_ws("-", p[1], p[2], p[3]).alias("d"), F.concat_ws(":", p[4], p[5]).alias("h"), F.split(F.trim(F.regexp_replace(F.regexp_replace(p[6], "=.*", ""), r"\s+", " ")), " ").alias("all"))
    five = ok.withColumn("head", F.coalesce(F.array_position("all", F.col("wmo")).cast("int"), F.lit(0))).withColumn("g", F.expr("slice(all, head + 1, size(all))"))
    three = F.array_position("g", "333").cast("int")
    stop = F.array_position("g", "555").cast("int")
    parts = five.withColumn("at3", three).withColumn("at5", F.when(stop > 0, stop).otherwise(F.size("g") + 1)).withColumn("n1", F.when(F.col("at3") > 0, F.col("at3")).otherwise(F.col("at5")) - 1)
    parts = parts.withColumn("sec1", F.expr("filter(slice(g, 3, greatest(n1 - 2, 0)), x -> length(x) = 5 AND x NOT LIKE '00%')")).withColumn("sec3", F.expr("CASE WHEN at3 > 0 THEN filter(slice(g, at3 + 1, greatest(at5 - at3 - 1, 0)), x -> length(x) = 5) ELSE CAST(array() AS array<string>) END"))
    first = lambda sec, digit: F.get(F.filter(sec, lambda x: x.startswith(digit)), F.lit(0))
    unit = F.when(F.substring(F.get("all", F.lit(1)), 5, 1).isin("3", "4"), KNOT).otherwise(1.0)
    wind = F.get("g", F.lit(1))
    ff = F.try_to_number(F.substring(wind, 4, 2), F.lit("99")).cast("double") * unit
    dd = F.try_to_number(F.substring(wind, 2, 2), F.lit("99")).cast("double") * 10
    digits = F.create_map(*[F.lit(x) for k, v in RAIN_HOURS.items() for x in (k, v)])
    rain = lambda sec, hours: rain_code(F.substring(F.get(F.filter(sec, lambda x: x.startswith("6") & (F.try_element_at(digits, F.substring(x, 5, 1)) == hours)), F.lit(0)), 2, 3))
    none = F.substring(F.get("g", F.lit(0)), 1, 1) == "3"
    day = F.substring(first("sec3", "7"), 2, 4)
    gust = F.try_to_number(F.substring(first("sec3", "911"), 4, 2), F.lit("99")).cast("double") * unit
    return parts.select(
        *also, "wmo", F.try_to_timestamp(F.concat_ws(" ", "d", "h"), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("time"),
        signed_tenths(first("sec1", "1")).alias("t"), signed_tenths(F.when(F.substring(first("sec1", "2"), 2, 1).isin("0", "1"), first("sec1", "2"))).alias("td"),
        F.when(dd <= 360, dd).alias("wind_dir"), ff.alias("wind_speed"), gust.alias("gust"),
        F.coalesce(rain("sec1", 6), rain("sec3", 6), F.when(none, 0.0)).alias("p6"), F.coalesce(rain("sec1", 12), rain("sec3", 12)).alias("p12"),
        F.when(day == "9999", 0.05).otherwise(F.try_to_number(day, F.lit("9999")).cast("double") / 10).alias("r24"),
        signed_tenths(first("sec3", "1")).alias("tx24"), signed_tenths(first("sec3", "2")).alias("tn24"), F.try_to_number(F.substring(first("sec1", "7"), 2, 2), F.lit("99")).cast("int").alias("ww"),
    )


class BadTable(ValueError):
    """A table that a run cannot start with."""


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """The point table: id, name, lat, lon, elevation_m, parent; texts trimmed, the five first columns required.

    Raises for a table without rows.
    """
    schema = "id string, name string, lat string, lon string, elevation_m string, parent string"
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    t = lambda c: F.trim(F.regexp_replace(c, "\ufeff", ""))
    points = df.select(t("id").alias("id"), t("name").alias("name"), *[t(c).cast("double").alias(c) for c in ("lat", "lon", "elevation_m")], F.nullif(t("parent"), F.lit("")).alias("parent"))
    if points.isEmpty():
        raise BadTable(f"{path} has no points")
    return points


def checked_points(points: DataFrame) -> DataFrame:
    """The points, all of which must have an elevation; raises with the first that lack one."""
    if lacking := [r.id for r in points.where("elevation_m IS NULL OR isnan(elevation_m)").select("id").orderBy("id").limit(5).collect()]:
        raise BadTable(f"points without an elevation: {', '.join(map(str, lacking))}")
    return points


def points_geojson(spark: SparkSession, path: str, name_field: str = "name", id_field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of a GeoJSON document as points (id, name, lat, lon), and the edges of their polygons (id, part, x1, y1, x2, y2).

    A polygon's point lies inside of it; point features stand for themselves.  An id falls back to adcode, then to the place
    in the list; a name to NAME, then to that place.  Features without a geometry are skipped; raises for no features.
    """
    from gridloom.operators import geometry as G

    doc = spark.read.schema("features array<struct<properties:map<string,string>,geometry:string>>").option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("k", "f"))
    if f.isEmpty():
        raise BadTable(f"{path} has no features")
    p, k = F.col("f.properties"), F.col("k").cast("string")
    own = F.try_element_at(p, F.lit(id_field)) if id_field else F.try_element_at(p, F.lit("adcode"))
    of = lambda name: F.nullif(F.try_element_at(p, F.lit(name)), F.lit(""))
    named = f.select(F.coalesce(own, F.lpad(k, 4, "0")).alias("id"), F.coalesce(of(name_field), of("NAME"), F.concat(F.lit("feature_"), k)).alias("name"), F.col("f.geometry").alias("_g"))
    edges = G.edges_of(named.withColumn("_r", G.rings_of(F.col("_g"))), ["id"], "_r")
    inside = named.select("id", "name").join(G.interior_points(edges, ["id"]), "id")
    at = F.from_json("_g", "coordinates array<double>")["coordinates"]
    single = named.where((F.get_json_object("_g", "$.type") == "Point") & (F.size(at) >= 2)).select("id", "name", at[1].alias("lat"), at[0].alias("lon"))
    points = inside.unionByName(single).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))
    return points, edges


def message_index(lines: DataFrame) -> DataFrame:
    """Byte ranges of an index ``seq:offset:date:var:level:window:``; a message ends where the next one begins."""
    from pyspark.sql import Window

    p = F.split("line", ":")
    idx = lines.where(F.col("line").rlike(r"^\d+(\.\d+)?:\d+:")).select("file", F.try_to_number(F.split(p[0], r"\.")[0], F.lit("999999")).cast("int").alias("seq"), p[1].cast("long").alias("offset"), p[3].alias("var"), p[4].alias("level"), p[5].alias("window"))
    w = Window.partitionBy("file").orderBy("offset", "seq")
    later = F.min("offset").over(Window.partitionBy("file").orderBy("offset").rangeBetween(1, Window.unboundedFollowing))
    begin = F.when(F.col("window").rlike(r"^\d+-\d+"), F.try_to_number(F.regexp_extract("window", r"^(\d+)-", 1), F.lit("9999")).cast("int")).otherwise(-1)
    return idx.select("*", (later - F.col("offset")).alias("length"), begin.alias("window_start"))


def pick_messages(index: DataFrame, accumulated: list[str]) -> DataFrame:
    """One message for each (file, var, level): accumulations since the start first, other fields the instant one first, then the earliest window."""
    rank = F.when(F.col("var").isin(accumulated), F.when(F.col("window_start") == 0, -1).otherwise(F.col("window_start"))).otherwise(F.col("window_start"))
    row = F.struct("seq", "offset", "length", "window")
    return index.groupBy("file", "var", "level").agg(F.min_by(row, F.struct(rank, F.col("seq"))).alias("m")).select("file", "var", "level", "m.*")


def hourly_json(docs: DataFrame, members: list[str], variables: list[str]) -> DataFrame:
    """Rows (point, member, time, variables) of documents (point, json) with hourly arrays named <variable>_<member>; members without temperature are left out."""
    fields = ", ".join(f"{v}_{m}: array<double>" for v in variables for m in members)
    parsed = docs.select("point", F.from_json("json", f"hourly struct<time: array<string>, {fields}>").alias("d"))
    per = F.array(*[F.struct(F.lit(m).alias("member"), *[F.col(f"d.hourly.{v}_{m}").alias(v) for v in variables]) for m in members])
    each = parsed.select("point", F.col("d.hourly.time").alias("time"), F.explode(per).alias("m")).where(f"exists(m.{variables[0]}, x -> x IS NOT NULL)")
    return each.select("point", "m.member", F.posexplode("time").alias("k", "time"), "m").select("point", "member", "time", *[F.get(F.col(f"m.{v}"), F.col("k")).alias(v) for v in variables])


def parse_isd(lines: DataFrame) -> DataFrame:
    """``line``: fixed-width hourly records. One row for each dated record: wmo, time and the measures, all nullable.

    An embedded report gives all of them; a record relayed from a binary message only its coded temperature and
    wind. The coded wind counts wherever its quality flag passes; the coded temperature where the report has none.
    """
    at = lambda a, b: F.substring("line", a + 1, b - a)
    stamp = F.try_to_timestamp(at(15, 27), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    good = lambda flag: flag.isin("0", "1", "4", "5", "9")
    number = lambda text, digits: F.try_to_number(F.regexp_replace(text, r"^\+", ""), F.lit("S" + "9" * digits)).cast("double")
    place = F.instr("line", "REMSYN")
    head, size = F.expr("substring(line, instr(line, 'REMSYN'), 16)"), F.expr("substring(line, instr(line, 'REMSYN') + 6, 3)")
    body = F.expr("substring(line, instr(line, 'REMSYN') + 9, coalesce(try_cast(substring(line, instr(line, 'REMSYN') + 6, 3) AS INT), 0))")
    text = F.when((place > 0) & ~head.contains("BUFR") & size.rlike(r"^\d{3}$"), F.concat(F.lit("AAXX "), F.date_format(stamp, "ddHH"), F.lit("1 "), body)).otherwise("")
    speed = F.when((at(65, 69) != "9999") & good(at(69, 70)), number(at(65, 69), 4) / 10)
    record = lines.where((F.length("line") >= 105) & at(4, 10).rlike(r"^\d{6}$") & stamp.isNotNull()).select(
        F.when((~at(87, 92).isin("+9999", "-9999")) & good(at(92, 93)), number(at(87, 92), 4) / 10).alias("_t"), speed.alias("_w"),
        F.when(speed.isNotNull() & (speed != 0) & (at(60, 63) != "999"), number(at(60, 63), 3)).alias("_d"),
        F.concat_ws(",", at(4, 9), F.date_format(stamp, "yyyy,MM,dd,HH,mm"), text).alias("line"),
    )
    d = decode_reports(record, ("_t", "_w", "_d"))
    coded = F.col("_w").isNotNull()
    return d.withColumn("t", F.coalesce("t", "_t")).withColumn("wind_dir", F.when(coded, F.col("_d")).otherwise(F.col("wind_dir"))).withColumn("wind_speed", F.coalesce("_w", "wind_speed")).drop("_t", "_w", "_d")
