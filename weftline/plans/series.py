"""Queries on the regular monthly series of event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import grid_series
from weftline.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid_series.missing_months(grid_series.regular_series(table(spark, folder, "ged_event")))


def p5_series(spark: SparkSession, folder: str) -> DataFrame:
    return grid_series.regular_series(table(spark, folder, "ged_event"))


def p5_readings(spark: SparkSession, folder: str) -> DataFrame:
    sums = grid_series.period_sums(grid_series.readings(table(spark, folder, "ged_event")))
    return sums.selectExpr("actor_id", "cast(month as long) as month", "total", "n")


_CLEAN = r"""
with told as (
  select id, loaded_at, best,
    try_cast(regexp_extract(trim(side_a_new_id), '^0*(\d{1,18})(?:\.0*)?$', 1) as bigint) as actor_id,
    coalesce(
      try_cast(nullif(regexp_extract(trim(date_start), '^(\d{4}-\d{2}-\d{2})([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$', 1), '') as date),
      cast(try_strptime(nullif(regexp_extract(trim(date_start), '^(\d{8})$', 1), ''), '%Y%m%d') as date),
      cast(try_strptime(nullif(regexp_extract(trim(date_start), '^(\d{1,2}\.\d{1,2}\.\d{4})$', 1), ''), '%d.%m.%Y') as date)) as day
  from ged_event),
newest as (select *, row_number() over (partition by id order by loaded_at desc) as rn from told),
clean as (
  select actor_id, (extract(year from day) * 12 + extract(month from day) - 1)::bigint as month, best from newest
  where rn = 1 and actor_id is not null and day between date '2018-01-01' and date '2025-12-31' and best >= 0 and not isnan(best)),
sums as (select actor_id, month, sum(best) as total, count(*)::bigint as n from clean group by all)
"""

QUERIES = {f.__name__: f for f in (p5_found, p5_series, p5_readings)}
ORACLE_SQL = {
    "p5_readings": _CLEAN + "select actor_id, month, total, n from sums",
    "p5_found": _CLEAN + """,
span as (select actor_id, min(month) a, max(month) b from sums group by 1),
grid as (select actor_id, unnest(range(a, b + 1)) as month from span)
select g.actor_id, printf('%04d-%02d', g.month // 12, g.month % 12 + 1) as month_key
from grid g left join sums s on s.actor_id = g.actor_id and s.month = g.month where s.month is null""",
}
