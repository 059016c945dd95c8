"""Queries of the general training-data problems: messages delivered more than once (2) and rolling totals (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.quotient import exactly_once
from postloom.operators.rolling import topic_rolling, topic_rolling_corrected
from postloom.sources.tables import read

KEYS = {"evidence": ("source_key", "evidence_id"), "material_signal": ("signal_id", "delivery_id")}


def _surplus(spark: SparkSession, d: str) -> DataFrame:
    parts = [exactly_once(read(spark, d, t), key, row).where("surplus").select(F.lit(t).alias("table_name"), "row_id") for t, (key, row) in KEYS.items()]
    return parts[0].union(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _surplus(spark, d)


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows that remain, by table, with and without an identifier."""
    parts = []
    for t, (key, row) in KEYS.items():
        marked = exactly_once(read(spark, d, t), key, row).groupBy().agg(F.count_if(~F.col("surplus")).alias("kept"), F.count_if("surplus").alias("surplus"))
        rows = read(spark, d, t).groupBy().agg(F.count(F.lit(1)).alias("delivered"))
        parts.append(rows.join(F.broadcast(marked)).select(F.lit(t).alias("table_name"), "delivered", (F.col("delivered") - F.col("surplus")).alias("remaining"), F.col("kept").alias("distinct_identifiers")))  # one row each
    return parts[0].union(parts[1])


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return topic_rolling(read(spark, d, "topic_weekly_mentions"))


def p6_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same totals, the statements from December 2026 on applied as late corrections."""
    return topic_rolling_corrected(read(spark, d, "topic_weekly_mentions"), "2026-12-01T00:00:00Z")


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p6_rolling": p6_rolling, "p6_corrected": p6_corrected}

_NORM = "nullif(lower(regexp_replace({c}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')), '')"


def _sql_ranked(t: str) -> str:
    key, row = KEYS[t]
    return f"select '{t}' as table_name, {row} as row_id, {_NORM.format(c=key)} as k, row_number() over (partition by {_NORM.format(c=key)} order by {row}) as rn from {t}"


SQL = {
    "p2_found": f"with r as ({_sql_ranked('evidence')} union all {_sql_ranked('material_signal')}) select table_name, row_id from r where k is not null and rn > 1",
    "p2_kept": f"with r as ({_sql_ranked('evidence')} union all {_sql_ranked('material_signal')}) select table_name, count(*) as delivered, count(*) - count(*) filter (where k is not null and rn > 1) as remaining, count(distinct k) as distinct_identifiers from r group by table_name",
    "p6_rolling": """
with m as (
  select topic_id, upper(trim(period)) as p, mentions, cast(recorded_at as timestamptz) as stated from topic_weekly_mentions
), w as (
  select topic_id, cast(substr(p, 1, 4) as int) as y, cast(regexp_extract(p, 'W([0-9]{1,2})$', 1) as int) as n, mentions, stated
  from m where topic_id is not null and regexp_full_match(p, '[0-9]{4}-?W[0-9]{1,2}')
), n as (
  select topic_id, cast(date_trunc('week', make_date(y, 1, 4)) + to_days(7 * (n - 1)) as date) as monday, y, n, mentions, stated from w
), latest as (
  select topic_id, monday, coalesce(mentions, 0) as mentions from n
  where n >= 1 and year(monday + 3) = y
  qualify row_number() over (partition by topic_id, monday order by stated desc nulls last, mentions desc nulls last) = 1
), first as (select topic_id, min(monday) as a from latest group by 1),
grid as (
  select topic_id, cast(unnest(generate_series(cast(a as timestamp), (select cast(max(monday) as timestamp) from latest), interval 7 day)) as date) as monday from first
), filled as (
  select g.topic_id, g.monday, coalesce(l.mentions, 0) as m, case when l.topic_id is null then 0 else 1 end as c
  from grid g left join latest l using (topic_id, monday)
)
select topic_id, strftime(monday, '%G-W%V') as period,
  cast(m as bigint) as total_1w, round(m / 1.0, 6) as avg_1w, cast(c as bigint) as stated_1w,
  cast(sum(m) over w4 as bigint) as total_4w, round(sum(m) over w4 / 4.0, 6) as avg_4w, cast(sum(c) over w4 as bigint) as stated_4w,
  cast(sum(m) over w13 as bigint) as total_13w, round(sum(m) over w13 / 13.0, 6) as avg_13w, cast(sum(c) over w13 as bigint) as stated_13w
from filled
window w4 as (partition by topic_id order by monday rows between 3 preceding and current row),
       w13 as (partition by topic_id order by monday rows between 12 preceding and current row)
""",
}
SQL["p6_corrected"] = SQL["p6_rolling"]
