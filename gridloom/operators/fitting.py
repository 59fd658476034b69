"""Statistical corrections whose fitting is aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_fit(pairs: DataFrame, keys: list[str], least: int = 20, most: float = 3.0) -> DataFrame:
    """Corrections of each point from matched rows (t2m, wind_speed, precip, each with its ``_obs``).

    ``bias`` is what observations exceed the forecast by; the factors are observed over modelled, clipped, and
    need a mean wind above 0.1 and a total of rain above 1. Each needs ``least`` pairs of its own.
    """

    def both(c: str) -> tuple[Column, Column, Column]:
        known = F.col(c).isNotNull() & F.col(f"{c}_obs").isNotNull()
        return F.count_if(known) >= least, F.when(known, F.col(c)), F.when(known, F.col(f"{c}_obs"))

    def factor(c: str, agg, floor: float) -> Column:
        enough, f, o = both(c)
        return F.when(enough & (agg(f) > floor), F.least(F.greatest(F.try_divide(agg(o), agg(f)), F.lit(1 / 3)), F.lit(most)))

    enough, f, o = both("t2m")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.when(enough, F.avg(o - f)).alias("bias"), factor("wind_speed", F.avg, 0.1).alias("wind_factor"), factor("precip", F.sum, 1.0).alias("precip_factor"))


def apply_point_fit(series: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Corrected measures of a point series, the uncorrected ones beside them as ``*_raw``; points without a fit stay."""
    add, blow, wet = F.coalesce("_b", F.lit(0.0)), F.coalesce("_w", F.lit(1.0)), F.coalesce("_p", F.lit(1.0))
    change = {**{c: F.col(c) + add for c in ("t2m", "tmax3", "tmin3")}, **{c: F.col(c) * blow for c in ("wind_speed", "u10", "v10", "gust")}, **{c: F.col(c) * wet for c in ("precip", "precip_accum")}}
    kept = [F.col(c).alias(f"{c}_raw") for c in ("t2m", "tmax3", "tmin3", "wind_speed", "precip", "precip_accum") if c in series.columns]
    j = series.join(fit.select(*keys, F.col("bias").alias("_b"), F.col("wind_factor").alias("_w"), F.col("precip_factor").alias("_p")), keys, "left")
    return j.select(*[change.get(c, F.col(c)).alias(c) for c in series.columns], *kept)


def recency_weight(end: Column, newest: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), (F.unix_timestamp(newest.cast("timestamp")) - F.unix_timestamp(end.cast("timestamp"))) / 86400 / half_life_days)


def ewma_bias(errors: DataFrame, keys: list[str], time: str, error: str, alpha: float) -> DataFrame:
    """Decaying average in time order of the mean error at each time, begun by the first."""
    daily = errors.groupBy(*keys, time).agg(F.avg(error).alias("e"))
    seq = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col("e"))))
    state = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0]["e"], lambda a, x: a + alpha * (x["e"] - a))
    return daily.groupBy(*keys).agg(seq.alias("s")).select(*keys, state.alias("bias"), F.size("s").alias("times"))


def ewma_states(errors: DataFrame, keys: list[str], time: str, error: str, alpha: float, block_days: int = 32) -> DataFrame:
    """The same average after every time: one row for each.

    Times are folded within blocks of days, as the average of the block alone and the weight that its past still
    has after each time; a key's blocks, one row each, then hand their last states on.
    """
    daily = errors.groupBy(*keys, time).agg(F.avg(error).alias("e")).withColumn("_block", F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / (86400 * block_days)))
    listed = daily.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("timestamp_ntz").alias("t"), F.col("e")))).alias("s"))
    state = "array<struct<t:timestamp_ntz,own:double,past:double>>"
    before = lambda a, f, none: F.coalesce(F.try_element_at(a, F.lit(-1))[f], F.lit(none))
    folded = F.aggregate("s", F.array().cast(state), lambda a, x: F.array_append(a, F.struct(x["t"].alias("t"), (before(a, "own", 0.0) * (1 - alpha) + alpha * x["e"]).alias("own"), (before(a, "past", 1.0) * (1 - alpha)).alias("past"))))
    blocks = listed.select(*keys, "_block", F.col("s")[0]["e"].alias("_first"), folded.alias("s"))
    order = F.array_sort(F.collect_list(F.struct("_block", F.element_at("s", -1)["own"].alias("own"), F.element_at("s", -1)["past"].alias("past"), F.col("_first").alias("first"))))
    # a key's very first error stands in for what was before it, so the first state is that error
    carried = F.aggregate("b", F.array().cast("array<struct<block:bigint,before:double,after:double>>"), lambda a, x: F.array_append(a, F.struct(x["_block"].alias("block"), F.coalesce(F.try_element_at(a, F.lit(-1))["after"], x["first"]).alias("before"), (x["own"] + x["past"] * F.coalesce(F.try_element_at(a, F.lit(-1))["after"], x["first"])).alias("after"))))
    handed = blocks.groupBy(*keys).agg(order.alias("b")).select(*keys, F.explode(carried).alias("c")).select(*keys, F.col("c.block").alias("_block"), F.col("c.before").alias("_before"))
    each = blocks.join(handed, [*keys, "_block"]).select(*keys, "_before", F.explode("s").alias("x"))
    return each.select(*keys, F.col("x.t").alias(time), (F.col("x.own") + F.col("x.past") * F.col("_before")).alias("bias"))


def _cumulated(d: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Values (keys, _v, _sum, _min; each once) with the sum up to each, ``_c``, and the ``_next`` value; of their key the sum, ``_t``, and the first ``_min``, ``_f``."""
    bounds = d.groupBy(*keys).agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 2000).alias("_b"))
    d = d.join(bounds, keys).withColumn("_part", F.size(F.filter("_b", lambda b: b < F.col("_v")))).drop("_b")
    key, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part")  # at most ``parts`` rows for each key
    ranges = d.groupBy(*keys, "_part").agg(F.sum("_sum").alias("_s"), F.min_by(F.struct("_v", "_min"), "_v").alias("_first"))
    ranges = ranges.select(*keys, "_part", (F.sum("_s").over(order) - F.col("_s")).alias("_off"), F.sum("_s").over(key).alias("_t"), F.first("_first._min").over(order).alias("_f"), F.lead("_first").over(order).alias("_after"))
    w = Window.partitionBy(*keys, "_part").orderBy("_v")
    return d.join(ranges, [*keys, "_part"]).withColumn("_c", F.col("_off") + F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.coalesce(F.lead(F.struct("_v", "_min")).over(w), "_after"))


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, probs: list[float], parts: int = 64, least: str | None = None) -> DataFrame:
    """Exact linear quantiles at positions (cumulated weight - first) / (total - first), rows in order of value, then weight.

    No key is sorted in one task: equal values are summed first (only their least weight and their sum
    matter), the different values are cut into ranges by a sketch, and running sums are taken within
    ranges and offset by the sums of the ranges before.  Rows with a null value or weight take no part.
    Rows that are sums of equal values already name the column of their ``least`` weight.
    """
    d = rows.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"), F.col(least or weight).alias("_l")).dropna(subset=["_v", "_w"]).groupBy(*keys, "_v").agg(F.sum("_w").alias("_sum"), F.min("_l").alias("_min"))
    d = _cumulated(d, keys, parts)
    place = lambda c: F.try_divide(c - F.col("_f"), F.col("_t") - F.col("_f"))
    d = d.select(*keys, "_v", F.coalesce(place(F.col("_c") - F.col("_sum") + F.col("_min")), F.lit(0.0)).alias("_a"), F.coalesce(place(F.col("_c")), F.lit(1.0)).alias("_z"), place(F.col("_c") + F.col("_next._min")).alias("_na"), F.col("_next._v").alias("_nv"))
    first = F.col("_a") <= 1e-12
    asked = d.withColumn("prob", F.explode(F.filter(F.array(*[F.lit(float(q)) for q in probs]), lambda q: ((q >= F.col("_a")) | first) & (q < F.coalesce("_na", F.lit(2.0))))))
    between = F.col("_v") + (F.col("_nv") - F.col("_v")) * F.try_divide(F.col("prob") - F.col("_z"), F.col("_na") - F.col("_z"))
    return asked.groupBy(*keys, "prob").agg(F.max(F.when(F.col("prob") <= F.col("_z"), F.col("_v")).otherwise(F.coalesce(between, "_v"))).alias("q"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: what the product's rounding loses is taken from the halves of its factors' digits, and what the sum's loses is added too."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # 2**27 + 1
        return high, x - high

    (a1, a2), (b1, b2) = halves(a), halves(b)
    product, total = a * b, a * b + c
    lost = a2 * b2 - (((product - a1 * b1) - a2 * b1) - a1 * b2)
    came = total - product
    return total + ((product - (total - came)) + (c - came) + lost)


def ranked_quantiles(rows: DataFrame, keys: list[str], value: str, count: str, probs: list[float], parts: int = 64) -> DataFrame:
    """Exact linear quantiles of rows that stand for ``count`` equal ones, found as the weighted ones are, but by whole ranks.

    A quantile lies at the rank prob * (n - 1), as low * (1 - share) + high * share with the first product not rounded.
    That is bit by bit what ``quantile_cont`` gives, so values that lie on a limit fall on the same side.
    """
    d = rows.select(*keys, F.col(value).alias("_v"), F.col(count).alias("_w")).dropna(subset=["_v", "_w"]).groupBy(*keys, "_v").agg(F.sum("_w").alias("_sum"), F.min("_w").alias("_min"))
    rank = lambda q: q * (F.col("_t") - 1)
    here = lambda q: (F.floor(rank(q)) >= F.col("_c") - F.col("_sum")) & (F.floor(rank(q)) < F.col("_c"))
    asked = _cumulated(d, keys, parts).withColumn("prob", F.explode(F.filter(F.array(*[F.lit(float(q)) for q in probs]), here)))
    share = rank(F.col("prob")) - F.floor(rank(F.col("prob")))
    asked = asked.select(*keys, "prob", "_v", share.alias("_share"), F.when(F.ceil(rank(F.col("prob"))) < F.col("_c"), F.col("_v")).otherwise(F.col("_next._v")).alias("_high"))
    between = fused(F.col("_v"), 1 - F.col("_share"), F.col("_high") * F.col("_share"))
    return asked.select(*keys, "prob", F.when(F.col("_share") == 0, F.col("_v")).otherwise(between).alias("q"))


def quantile_map(pairs: DataFrame, keys: list[str], f: str, o: str, nodes: int, least: int = 60, weight: str | None = None, windows=None) -> DataFrame:
    """Quantiles of forecasts and observations, weighted or not, on a common grid; keys with fewer pairs have none.

    Both columns go through one chain, told apart by a key.  ``windows`` makes maps for many issues: a function that gives
    rows with ``end`` to the issues in whose windows they are, adding ``issue``; a period's equal values are summed before.
    """
    probs = [k / (nodes - 1) for k in range(nodes)]
    known = pairs.withColumn("_one", F.col(weight) if weight else F.lit(1.0)).dropna(subset=[f, o, "_one"])
    day = ["end"] if windows else []
    side = lambda name, c: F.struct(F.lit(name).alias("_side"), F.col(c).cast("double").alias("_x"))
    long = known.select(*keys, *day, "_one", F.inline(F.array(side("f", f), side("o", o))))
    summed = long.groupBy(*keys, *day, "_side", "_x").agg(F.sum("_one").alias("_one"), F.min("_one").alias("_least"), F.count("*").alias("_n"))
    summed, keys = (windows(summed), ["issue", *keys]) if windows else (summed, keys)
    n = summed.where("_side = 'f'").groupBy(*keys).agg(F.sum("_n").alias("n")).where(F.col("n") >= least)
    side_of = [*keys, "_side"]
    q = weighted_quantiles(summed, side_of, "_x", "_one", probs, least="_least") if weight else ranked_quantiles(summed, side_of, "_x", "_one", probs)
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == name, F.struct("prob", "q")))), lambda x: x["q"])
    return n.join(q.groupBy(*keys).agg(of("f").alias("fq"), of("o").alias("oq")), keys).withColumn("p", F.array(*map(F.lit, probs)))


def map_value(x: Column, fq: Column, oq: Column, most: float = 1.5) -> Column:
    """x moved from the forecast's to the observation's distribution: linear between nodes, tail by a clipped ratio, at most ``most`` times x, at least 0."""
    below = F.size(F.filter(fq, lambda q: q < x))
    n = F.size(fq)
    i = F.least(F.greatest(below, F.lit(1)), n - 1)
    a, b = F.get(fq, i - 1), F.get(fq, i)
    share = F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0))
    inside = F.get(oq, i - 1) + (F.get(oq, i) - F.get(oq, i - 1)) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    top_f, top_o = F.get(fq, n - 1), F.get(oq, n - 1)
    tail = x * F.least(F.greatest(F.try_divide(top_o, top_f), F.lit(0.5)), F.lit(3.0))
    mapped = F.least(F.when((top_f > 0) & (x > top_f), tail).otherwise(inside), x * most)
    return F.when(x.isNull(), None).when(fq.isNull(), x).otherwise(F.greatest(mapped, F.lit(0.0)))
