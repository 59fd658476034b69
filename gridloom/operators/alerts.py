"""Warnings from county periods and rain series, and the clauses of the headline.

``by`` names the columns that tell counties apart; without it the tables are of one county.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import windows

# Rain signals (hours, mm, level), wind signals (mean force, gust force, level), and the order of levels.
RAIN_SIGNALS = ((3, 100.0, "红色"), (3, 50.0, "橙色"), (6, 50.0, "黄色"), (12, 50.0, "蓝色"), (24, 50.0, "关注"))
WIND_SIGNALS = ((12, 13, "红色"), (10, 11, "橙色"), (8, 9, "黄色"), (6, 7, "蓝色"))
LEVELS = {"关注": 0, "蓝色": 1, "黄色": 2, "橙色": 3, "红色": 4}


def level_rank(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level)


def heat(days: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``days``: by, date, temp_max; one row for each date of a county, so few. Days without a value do not break a run."""
    w = windows.run_lengths(days.where("temp_max IS NOT NULL").withColumn("_all", F.lit(0)), [*by, "_all"], "date", F.col("temp_max") >= 35)
    t = F.col("temp_max")
    level = F.when(t >= 40, "红色").when(t >= 37, "橙色").when((t >= 35) & (F.col("run") >= 3), "黄色").when(t >= 35, "关注")
    criterion = F.when(t >= 40, "日最高气温≥40℃").when(t >= 37, "日最高气温≥37℃").when(F.col("run") >= 3, "连续三天日最高气温≥35℃").otherwise("日最高气温≥35℃")
    amount = F.bround(t).cast("long")
    return w.select(*by, F.lit("高温").alias("type"), "date", level.alias("level"), amount.alias("amount"), F.lit(0).alias("seq"), criterion.alias("criterion"), F.concat(F.lit("局地最高气温"), amount.cast("string"), F.lit("℃")).alias("detail")).where("level IS NOT NULL")


def rain(series: DataFrame, gap: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """``series``: by, point, step, date, precip, a row for each step. A full window counts for the date of its wettest step; of a date the highest level counts, then the largest amount.

    All windows of a signal are frames of one sort by point; only qualifying windows go on.
    """
    order = Window.partitionBy(*by, "point").orderBy("step")
    mm = F.coalesce(F.col("precip"), F.lit(0.0))
    hits, s = [], series
    for k, (hours, limit, level) in enumerate(RAIN_SIGNALS):
        n = max(1, hours // gap)
        frame = order.rowsBetween(1 - n, 0)
        whole = F.count(F.lit(1)).over(frame) == n
        s = s.withColumn(f"_s{k}", F.when(whole, F.sum(mm).over(frame))).withColumn(f"_d{k}", F.max_by("date", F.struct(mm, -F.col("step"))).over(frame))
        hits.append(F.when(F.col(f"_s{k}") >= limit, F.struct(F.col(f"_d{k}").alias("date"), F.lit(LEVELS[level]).alias("rank"), F.col(f"_s{k}").alias("mm"), F.lit(-k).alias("k"), F.lit(level).alias("level"))))
    each = s.select(*by, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*by, "h.*")
    best = each.groupBy(*by, "date").agg(F.max(F.struct("rank", "mm", "k", "level")).alias("b"))
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), 1 - F.col("b.k"))
    amount = F.bround("b.mm").cast("long")
    criterion, hours = pick([f"{h}小时降水量≥{mm:.0f}毫米" for h, mm, _ in RAIN_SIGNALS]), pick([f"局地{h}小时降水量约" for h, _, _ in RAIN_SIGNALS])
    return best.select(*by, F.lit("暴雨").alias("type"), "date", F.col("b.level").alias("level"), amount.alias("amount"), F.lit(1).alias("seq"), criterion.alias("criterion"), F.concat(hours, amount.cast("string"), F.lit("毫米")).alias("detail"))


def wind(periods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``periods``: by, date, kind, force_max, gust_force_max and perhaps label; unknown forces count as 0."""
    f, g = F.coalesce("force_max", F.lit(0)), F.coalesce("gust_force_max", F.lit(0))
    level = F.coalesce(*[F.when((f >= mean) | (g >= gust), name) for mean, gust, name in WIND_SIGNALS])
    criterion = F.coalesce(*[F.when((f >= mean) | (g >= gust), f"平均风力≥{mean}级或阵风≥{gust}级") for mean, gust, name in WIND_SIGNALS])
    detail = F.concat(_label(periods), F.lit("平均风力"), f.cast("string"), F.lit("级，阵风"), g.cast("string"), F.lit("级"))
    return periods.select(*by, F.lit("大风").alias("type"), "date", level.alias("level"), f.cast("long").alias("amount"), F.when(F.col("kind") == "day", 2).otherwise(3).alias("seq"), criterion.alias("criterion"), detail.alias("detail")).where("level IS NOT NULL")


def _label(periods: DataFrame) -> Column:
    return F.coalesce("label", F.lit("")) if "label" in periods.columns else F.lit("")


def frost(periods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return periods.where("kind = 'night' AND temp_min <= 0").select(*by, F.lit("霜冻").alias("type"), "date", F.lit("关注").alias("level"), F.bround("temp_min").cast("long").alias("amount"), F.lit(4).alias("seq"), F.lit("夜间最低气温≤0℃").alias("criterion"), F.concat(_label(periods), F.lit("局地最低气温"), F.bround("temp_min").cast("long").cast("string"), F.lit("℃")).alias("detail"))


def conclusions(periods: DataFrame, series: DataFrame, first_lead: int | None = None, gap: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """One alert for each county, type and date with its criterion and detail: the highest level, of equals the earlier period.

    Rain counts from windows that begin at ``first_lead`` or later.
    """
    series = series if first_lead is None else series.where(F.col("step") - gap >= first_lead)
    every = reduce(DataFrame.unionByName, [heat(periods.where("kind = 'day'").select(*by, "date", "temp_max"), by), rain(series, gap, by), wind(periods, by), frost(periods, by)])
    best = F.max_by(F.struct("level", "amount", "criterion", "detail"), F.struct(level_rank(F.col("level")), -F.col("seq")))
    return every.groupBy(*by, "type", "date").agg(best.alias("b")).select(*by, "type", "date", "b.*")


def rain_grades(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``cells``: by, point, date, weather. Per county and date the grade that at least half of the points reach and the heaviest anywhere.

    A point counts with its wetter half; grades are counted, so only a few numbers for each date are ordered.
    """
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in W.RAIN_RANK.items() for x in kv]), F.col("weather"))
    point = cells.groupBy(*by, "date", "point").agg(F.max(rank).alias("rank"))
    n = [F.count_if(F.col("rank") >= r).alias(f"n{r}") for r in W.RAIN_RANK.values()]
    names = dict((v, k) for k, v in W.RAIN_RANK.items())
    d = point.groupBy(*by, "date").agg(F.count("*").alias("n"), F.max("rank").alias("top"), *n)
    common = F.lit(None).cast("string")
    for r in sorted(names):
        common = F.when(F.col(f"n{r}") * 2 >= F.col("n"), F.lit(names[r])).otherwise(common)
    return d.select(*by, "date", common.alias("common"), F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("top")).alias("local"))


def month_day(date: Column) -> Column:
    return F.concat(F.month(date).cast("string"), F.lit("月"), F.day(date).cast("string"), F.lit("日"))


def date_span(a: Column, b: Column) -> Column:
    tail = F.when(F.month(a) == F.month(b), F.concat(F.day(b).cast("string"), F.lit("日"))).otherwise(month_day(b))
    return F.when(a == b, month_day(a)).otherwise(F.concat(month_day(a), F.lit("—"), tail))


def clauses(grades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive dates of a county with the same wording as one clause: first, last, text; dry ones are left out."""
    named = grades.withColumn("word", F.concat_ws("/", F.coalesce("common", F.lit("")), F.coalesce("local", F.lit("")))).withColumn("_all", F.lit(0))
    runs = windows.same_wording(named, [*by, "_all"], "date", "word").where("word <> '/'")  # one row for each date of a county: few
    common, local = F.split("word", "/")[0], F.split("word", "/")[1]
    span = date_span(F.col("first"), F.col("last"))
    more = F.when(common != local, F.concat(F.lit("，局地"), local)).otherwise("")
    return runs.select(*by, "first", "last", F.when(common == "", F.concat(span, F.lit("局地有"), local)).otherwise(F.concat(span, F.lit("有"), common, more)).alias("text"))


def headline(lead: Column | str, grades: DataFrame, periods: DataFrame, alerts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each county that has periods: the opening, at most three rain clauses, the extremes, and what to guard against (by date, then type)."""
    grouped = lambda df: df.withColumn("_all", F.lit(0)).groupBy(*by, "_all")
    keys = [*by, "_all"]
    said = grouped(clauses(grades, by)).agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("c"))  # a county's clauses
    span = grouped(periods).agg(F.bround(F.max(F.when(F.col("kind") == "day", F.col("temp_max")))).cast("long").alias("hi"), F.bround(F.min(F.when(F.col("kind") == "night", F.col("temp_min")))).cast("long").alias("lo"))
    first_dates = alerts.groupBy(*by, "type").agg(F.min("date").alias("d"))
    kinds = grouped(first_dates).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "type"))), lambda x: x["type"]), "、").alias("kinds"))
    after = F.when(F.coalesce(F.size("c"), F.lit(0)) < 1, "之后无明显降水").otherwise(F.concat(F.lit("之后"), F.array_join(F.transform(F.slice("c", 1, 3), lambda x: x["text"]), "；")))
    heat_text = F.concat(F.lit("；全县最高气温"), F.col("hi").cast("string"), F.lit("℃，夜间最低"), F.col("lo").cast("string"), F.lit("℃"))
    guard = F.when(F.col("kinds") != "", F.concat(F.lit("注意防范"), F.col("kinds"), F.lit("。"))).otherwise("")
    first = F.lit(lead) if isinstance(lead, str) else lead
    each = span if by else periods.sparkSession.range(1).select(F.lit(0).alias("_all")).join(span, "_all", "left")  # a single county has a headline even without periods
    whole = each.join(said, keys, "left").join(kinds, keys, "left")
    return whole.select(*by, F.concat(first, F.lit("；"), after, F.coalesce(heat_text, F.lit("")), F.lit("。"), guard).alias("headline"))
