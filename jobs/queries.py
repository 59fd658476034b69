"""The jobs as queries: each runs twice into a new folder of the session's shared one, and its whole output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions import weather as W
from gridloom.plans.catalog import HALF, HALF_DATE, SERIES, ladder_sql
from gridloom.sources import stores
from jobs import bulletin_archive, observation_archive


def _folder(spark: SparkSession, name: str) -> str:
    return f"{stores.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _table(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def job1_observation_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "observations")
    for _ in range(2):
        observation_archive.run(spark, _table(sf_dir, "events"), f"{at}/out", f"{at}/checkpoint")
    kept = observation_archive.records(spark, f"{at}/out")
    return kept.withColumn("day", kept.day.cast("string")).withColumn("latest", kept.latest.cast("string"))


def job2_bulletin_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "bulletins")
    for _ in range(2):
        bulletin_archive.run(spark, _table(sf_dir, "documents"), at)
    return bulletin_archive.archive(spark, at)


QUERIES = {f.__name__: f for f in (job1_observation_archive, job2_bulletin_archive)}

_LAST = SERIES.replace("FROM events", "FROM (SELECT * FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) = 1)", 1)
_WIDE = "ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦"
_BLANK = r"[ \t\n\x0B\f\r]"

ORACLES = {
    "job1_observation_archive": _LAST
    + f""", e AS (SELECT user_id, event_type, ts, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INT)) AS start FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
 n AS (SELECT user_id AS point, {HALF_DATE} AS day, {HALF} AS kind, count(DISTINCT (user_id, event_type, ts)) AS reports, max(ts) AS latest FROM e GROUP BY ALL),
 p AS (SELECT point, {HALF_DATE} AS day, {HALF} AS kind, CASE WHEN count(tmax3) = 4 THEN max(tmax3) END AS tmax, CASE WHEN count(tmin3) = 4 THEN min(tmin3) END AS tmin, round(CASE WHEN count(precip) = 4 THEN sum(precip) END, 3) AS precip, count(*) AS windows FROM series GROUP BY ALL)
SELECT point, CAST(CAST(day AS DATE) AS VARCHAR) AS day, kind, tmax, tmin, precip, windows, reports, rtrim(rtrim(strftime(latest, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS latest,
  CASE WHEN precip IS NOT NULL THEN {ladder_sql('precip', W.RAIN_12H)} END AS grade FROM p JOIN n USING (point, day, kind)""",
    "job2_bulletin_archive": rf"""
WITH d AS (SELECT doc_id, lang, regexp_replace(coalesce(source, 'unknown'), '[^\p{{L}}\p{{N}}]', '_', 'g') AS office, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL),
 l AS (SELECT *, list_transform(string_split(body, chr(10)), lambda x: length(x) + length(regexp_replace(x, '[^{_WIDE}]', '', 'g'))) AS widths FROM d),
 t AS (SELECT doc_id, lang, office, CAST(len(widths) AS INT) AS lines, CAST(list_max(widths) AS INT) AS widest, CAST(len(list_filter(widths, lambda w: w > 80)) AS INT) AS too_wide,
   trim(regexp_extract(body, '[^ \t\n\x0B\f\r][^\n]*'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS heading, sha256(lower(trim(regexp_replace(body, '{_BLANK}+', ' ', 'g'), ' '))) AS wording FROM l),
 o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY office, doc_id ORDER BY wording DESC, lang DESC NULLS LAST) = 1),
 w AS (SELECT wording, min(doc_id) AS first_id, count(*) AS copies FROM o GROUP BY wording),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY office ORDER BY doc_id DESC, heading) AS INT) AS k FROM o)
SELECT office, doc_id, lang, lines, widest, too_wide, heading, wording, first_id, copies, CASE WHEN k <= 20 THEN k END AS place, CASE WHEN k <= 20 THEN k = 1 END AS latest FROM n JOIN w USING (wording)""",
}
