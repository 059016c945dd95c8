"""Queries of the signal analytics, each with its SQL: scans and projections (src, prj), filters (flt), joins (join),
aggregates (agg), windows (win), set operations (set), functions (fn) and composites (dat)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.operators import bursts as B
from postloom.operators import evaluation as E
from postloom.operators import relational as R
from postloom.operators.quotient import identifier
from postloom.operators.rolling import latest_statements, week_name
from postloom.sources.tables import read

WEEK = "2026-W50"
OBSERVED = 8
REMOVED = ("[deleted]", "[removed]")
HOST = "https://posts.example"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "evidence")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """topic_id, period, mentions: the latest statement of each week."""
    return latest_statements(read(spark, d, "topic_weekly_mentions")).select(F.col("entity").alias("topic_id"), week_name(F.col("week")).alias("period"), F.col("value").alias("mentions"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row per signal and cited post: delivery_id, topic_id, signal_type, summary, score, evidence_id."""
    return read(spark, d, "material_signal").select("delivery_id", "signal_id", "topic_id", "signal_type", "summary", F.col("materiality_score").alias("score"), "week", F.explode("evidence_ids").alias("evidence_id"))


_M = """m as (
  select topic_id, upper(trim(period)) as p, mentions, cast(recorded_at as timestamptz) as stated from topic_weekly_mentions),
w as (select topic_id, cast(substr(p,1,4) as int) as y, cast(regexp_extract(p,'W([0-9]{1,2})$',1) as int) as n, mentions, stated from m
      where topic_id is not null and regexp_full_match(p,'[0-9]{4}-?W[0-9]{1,2}')),
x as (select topic_id, cast(date_trunc('week', make_date(y,1,4)) + to_days(7*(n-1)) as date) as monday, y, n, mentions, stated from w),
mentions as (select topic_id, strftime(monday,'%G-W%V') as period, coalesce(mentions,0) as mentions from x where n >= 1 and year(monday+3)=y
      qualify row_number() over (partition by topic_id, monday order by stated desc nulls last, mentions desc nulls last)=1)"""
_C = "c as (select delivery_id, signal_id, topic_id, signal_type, summary, materiality_score as score, week, unnest(evidence_ids) as evidence_id from material_signal)"
_IDENT = "nullif(lower(regexp_replace({c}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')), '')"
_AT = "cast({c} as timestamptz)"


# --- scans and projections -------------------------------------------------------------------------------------------


@query("src1_new_posts", f"""
with e as (select source_name, evidence_id, batch_no, {_AT.format(c='published_at')} as ts from evidence where source_name is not null),
s as (select source_name, max((ts, evidence_id)) as stop from e where batch_no < 25 and ts is not null group by 1),
r as (select e.source_name, e.evidence_id, row_number() over (partition by e.source_name order by e.ts desc, e.evidence_id desc) as rn from e left join s on e.source_name = s.source_name where e.ts is not null and (s.stop is null or (e.ts, e.evidence_id) > s.stop))
select source_name, count(*) as new_posts, max(evidence_id) as newest from r where rn <= 100 group by 1""")
def src1(spark, d):
    """What a newest-first scan of each source takes, a hundred posts at most, until it meets the cursor (instant and id) left
    by the batches before the last."""
    e = evidence(spark, d).where("source_name is not null").select("source_name", "evidence_id", "batch_no", F.to_timestamp("published_at").alias("at")).where("at is not null").withColumn("mark", F.struct("at", "evidence_id"))
    stop = e.where("batch_no < 25").groupBy("source_name").agg(F.max("mark").alias("stop_at"))
    taken = R.top_n(R.take_until(e, ["source_name"], "mark", stop), ["source_name"], 100, F.desc("at"), F.desc("evidence_id"))
    return taken.groupBy("source_name").agg(F.count(F.lit(1)).alias("new_posts"), F.max("evidence_id").alias("newest"))


@query("src3_readable_posts", "select source_type, count(*) as posts, count(title) as titled from evidence where coalesce(title,'') not in ('[deleted]','[removed]') and coalesce(content,'') not in ('[deleted]','[removed]') group by 1")
def src3(spark, d):
    gone = F.coalesce("title", F.lit("")).isin(*REMOVED) | F.coalesce("content", F.lit("")).isin(*REMOVED)
    return evidence(spark, d).where(~gone).groupBy("source_type").agg(F.count(F.lit(1)).alias("posts"), F.count("title").alias("titled"))


@query("src4_utc_stamps", f"select evidence_id, strftime({_AT.format(c='published_at')} at time zone 'UTC','%Y-%m-%dT%H:%M:%S+00:00') as published_utc, cast(epoch({_AT.format(c='published_at')}) as bigint) as published_s from evidence")
def src4(spark, d):
    at = F.to_timestamp("published_at")
    return evidence(spark, d).select("evidence_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published_utc"), F.unix_timestamp(at).alias("published_s"))


@query("src10_emitted_ids", "select distinct json_extract_string(metadata, '$.reddit_post_id') as post_id from evidence where json_valid(coalesce(metadata,'')) and json_extract_string(metadata, '$.reddit_post_id') is not null")
def src10(spark, d):
    """Ids read back from JSON lines; lines that are no JSON are passed over."""
    readable = evidence(spark, d).where(F.try_parse_json("metadata").isNotNull())
    return readable.select(F.get_json_object("metadata", "$.reddit_post_id").alias("post_id")).where("post_id is not null").distinct()


@query("src14_cited_tickets", "with t as (select evidence_id, unnest(list_distinct(regexp_extract_all(content, '[A-Z]{3}-[0-9]+-[0-9]+'))) as ticket from evidence) select ticket, count(*) as posts, min(evidence_id) as first_post from t group by 1")
def src14(spark, d):
    cited = evidence(spark, d).select("evidence_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Z]{3}-[0-9]+-[0-9]+)"), 1))).alias("ticket"))
    return cited.groupBy("ticket").agg(F.count(F.lit(1)).alias("posts"), F.min("evidence_id").alias("first_post"))


@query("prj2_topic_summary", "select topic_id, name, description, case when len(aliases) > 0 then array_to_string(aliases, '; ') end as aliases from canonical_topic where status = 'active'")
def prj2(spark, d):
    return read(spark, d, "canonical_topic").where("status = 'active'").select("topic_id", "name", "description", F.when(F.size("aliases") > 0, F.array_join("aliases", "; ")).alias("aliases"))


@query("prj3_indexed", "select delivery_id, topic_id, row_number() over (partition by topic_id order by delivery_id) - 1 as index from material_signal where topic_id is not null")
def prj3(spark, d):
    s = read(spark, d, "material_signal").where("topic_id is not null").select("delivery_id", "topic_id")
    return R.number_rows(s, "delivery_id", "topic_id").select("delivery_id", "topic_id", (F.col("number") - 1).alias("index"))


@query("prj7_envelopes", "select delivery_id, signal_id, signal_type, summary, evidence_ids[1] as first_evidence, len(evidence_ids) as cited from material_signal")
def prj7(spark, d):
    """Event envelopes as JSON and read back."""
    signal = F.struct("signal_id", "signal_type", "summary", "evidence_ids")
    lines = read(spark, d, "material_signal").select("delivery_id", F.to_json(F.struct(F.lit(1).alias("event_version"), signal.alias("signal"))).alias("line"))
    s = F.from_json("line", "event_version int, signal struct<signal_id: string, signal_type: string, summary: string, evidence_ids: array<string>>").getField("signal")
    return lines.select("delivery_id", s["signal_id"].alias("signal_id"), s["signal_type"].alias("signal_type"), s["summary"].alias("summary"), s["evidence_ids"][0].alias("first_evidence"), F.size(s["evidence_ids"]).cast("bigint").alias("cited"))


# --- filters -----------------------------------------------------------------------------------------------------------


@query("flt1_point_lookup", "select evidence_id, source_name, title from evidence where evidence_id = (select min(evidence_id) from evidence)")
def flt1(spark, d):
    e = evidence(spark, d)
    return e.join(F.broadcast(e.agg(F.min("evidence_id").alias("evidence_id"))), "evidence_id", "left_semi").select("evidence_id", "source_name", "title")  # one row


@query("flt2_caller_order", "with q as (select delivery_id, unnest(evidence_ids) as evidence_id, unnest(range(len(evidence_ids))) as pos from material_signal) select q.delivery_id, q.pos, q.evidence_id, e.source_name from q join evidence e using (evidence_id)")
def flt2(spark, d):
    """Posts in the order in which each signal cites them; unknown ids drop out, repeated ones repeat."""
    wanted = read(spark, d, "material_signal").select("delivery_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    return R.in_caller_order(evidence(spark, d).select("evidence_id", "source_name"), "evidence_id", wanted).select("delivery_id", F.col("pos").cast("bigint").alias("pos"), "evidence_id", "source_name")


@query("flt10_posts_of_week", f"select source_name, count(*) as posts from evidence where strftime(cast(substr(captured_at,1,10) as date),'%G-W%V') = '{WEEK}' group by 1")
def flt10(spark, d):
    return evidence(spark, d).where(X.iso_week(X.date_prefix(F.col("captured_at"))) == WEEK).groupBy("source_name").agg(F.count(F.lit(1)).alias("posts"))


@query("flt11_search", f"with {_C} select c.delivery_id, c.summary, c.signal_type, e.evidence_id, e.title, e.source_url from c join evidence e using (evidence_id) where e.title ilike '%retry queue%' or e.content ilike '%retry queue%' or c.summary ilike '%retry queue%'")
def flt11(spark, d):
    """Signals and the posts they cite, where a keyword stands in the post or in the signal."""
    e = evidence(spark, d).select("evidence_id", "title", "content", "source_url")
    hit = F.col("title").ilike("%retry queue%") | F.col("content").ilike("%retry queue%")
    both = candidates(spark, d).join(e.select("evidence_id", "title", "source_url", F.coalesce(hit, F.lit(False)).alias("hit")), "evidence_id")
    return both.where(F.col("hit") | F.col("summary").ilike("%retry queue%")).select("delivery_id", "summary", "signal_type", "evidence_id", "title", "source_url")


@query("flt12_topic_pairs", f"with {_C}, p as (select distinct evidence_id, topic_id from c where topic_id is not null) select a.topic_id as one, b.topic_id as other, count(*) as posts from p a join p b on a.evidence_id=b.evidence_id and a.topic_id<b.topic_id group by 1,2 having count(*) >= 2")
def flt12(spark, d):
    """Pairs of topics, in either order one pair, that cite a post in common at least twice. A post is cited by the few
    signals of its own time, so the pairs of one post are few; the topics of a post are made distinct first."""
    p = candidates(spark, d).where("topic_id is not null").select("evidence_id", "topic_id").distinct()
    a, b = p.withColumnRenamed("topic_id", "one"), p.withColumnRenamed("topic_id", "other")
    return a.join(b, "evidence_id").where("one < other").groupBy("one", "other").agg(F.count(F.lit(1)).alias("posts")).where("posts >= 2")


@query("flt14_topics_of_week", f"select distinct topic_id from material_signal where week = '{WEEK}' and topic_id is not null")
def flt14(spark, d):
    return read(spark, d, "material_signal").where((F.col("week") == WEEK) & F.col("topic_id").isNotNull()).select("topic_id").distinct()


@query("flt16_tagged", "select signal_type, count(*) as signals from material_signal where list_contains(string_split(coalesce(topic_id,'') || ';' || signal_type, ';'), 'pricing_change') group by 1")
def flt16(spark, d):
    tags = F.concat_ws(";", F.coalesce("topic_id", F.lit("")), "signal_type")
    return read(spark, d, "material_signal").where(F.array_contains(F.split(tags, ";"), "pricing_change")).groupBy("signal_type").agg(F.count(F.lit(1)).alias("signals"))


# --- joins -------------------------------------------------------------------------------------------------------------


@query("join1_cited_posts", f"with {_C} select e.source_name, c.signal_type, count(*) as citations from c join evidence e using (evidence_id) group by 1,2")
def join1(spark, d):
    return candidates(spark, d).join(evidence(spark, d).select("evidence_id", "source_name"), "evidence_id").groupBy("source_name", "signal_type").agg(F.count(F.lit(1)).alias("citations"))


@query("join3_uncited_posts", f"with {_C} select evidence_id from evidence where not exists (select 1 from c where c.evidence_id = evidence.evidence_id)")
def join3(spark, d):
    return evidence(spark, d).select("evidence_id").join(candidates(spark, d).select("evidence_id"), "evidence_id", "left_anti")


@query("join2_pending", f"with {_C}, n as (select evidence_id, count(*) as signals from c group by 1) select e.batch_no, count(*) as pending from evidence e left join n using (evidence_id) where e.duplicate_of is null and (n.signals is null or n.signals < 2) group by 1")
def join2(spark, d):
    n = candidates(spark, d).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("signals"))
    return evidence(spark, d).select("evidence_id", "batch_no", "duplicate_of").join(n, "evidence_id", "left").where("duplicate_of is null and (signals is null or signals < 2)").groupBy("batch_no").agg(F.count(F.lit(1)).alias("pending"))


@query("join9_new_rows_only", "select batch_no, count(distinct signal_id) as new_signals from material_signal s where batch_no >= 13 and signal_id is not null and not exists (select 1 from material_signal o where o.batch_no < 13 and o.signal_id = s.signal_id) group by 1")
def join9(spark, d):
    s = read(spark, d, "material_signal").where("signal_id is not null")
    return s.where("batch_no >= 13").join(s.where("batch_no < 13").select("signal_id"), "signal_id", "left_anti").groupBy("batch_no").agg(F.countDistinct("signal_id").alias("new_signals"))


@query("join11_as_of", f"with {_M} select topic_id, max(period) as period, arg_max(mentions, period) as mentions from mentions where period <= '{WEEK}' group by 1")
def join11(spark, d):
    return R.as_of(mentions(spark, d), "topic_id", "period", "period", WEEK)


@query("join12_registry_as_of", f"select t.topic_id, t.name from canonical_topic t left join canonical_topic m on t.merged_into = m.topic_id where t.first_seen <= '{WEEK}' and coalesce(case when t.status = 'merged' then t.last_seen end, '9999-W99') > '{WEEK}'")
def join12(spark, d):
    """Topics seen by then and not merged away by then."""
    t = read(spark, d, "canonical_topic")
    return t.where((F.col("first_seen") <= WEEK) & (F.coalesce(F.when(F.col("status") == "merged", F.col("last_seen")), F.lit("9999-W99")) > WEEK)).select("topic_id", "name")


@query("join13_redirects", """
with recursive r as (select topic_id as node, topic_id as at, cast(0 as bigint) as steps from canonical_topic
 union all select r.node, t.merged_into, r.steps + 1 from r join canonical_topic t on r.at = t.topic_id where t.merged_into is not null and r.steps < 500),
e as (select r.node, r.at as root, r.steps from r left join canonical_topic t on r.at = t.topic_id where t.merged_into is null)
select c.topic_id as node, e.root, e.steps, e.node is null as cycle from canonical_topic c left join e on c.topic_id = e.node""")
def join13(spark, d):
    return R.follow_pointers(read(spark, d, "canonical_topic"), "topic_id", "merged_into")


@query("join15_one_decision", "select signal_id, count(*) as deliveries, count(distinct topic_id) as topics, case when count(distinct topic_id) = 1 then min(topic_id) end as topic_id from material_signal where signal_id is not null group by 1")
def join15(spark, d):
    one = F.countDistinct("topic_id")
    return read(spark, d, "material_signal").where("signal_id is not null").groupBy("signal_id").agg(F.count(F.lit(1)).alias("deliveries"), one.alias("topics"), F.min("topic_id").alias("first")).select("signal_id", "deliveries", "topics", F.when(F.col("topics") == 1, F.col("first")).alias("topic_id"))


@query("join17_either_end", "with e as (select topic_id as a, merged_into as b from canonical_topic where merged_into is not null), x as (select a as topic_id, a, b from e union select b, a, b from e) select topic_id, count(*) as merges from x group by 1")
def join17(spark, d):
    e = read(spark, d, "canonical_topic").where("merged_into is not null").select(F.col("topic_id").alias("a"), F.col("merged_into").alias("b"))
    return e.select(F.explode(F.array("a", "b")).alias("topic_id"), "a", "b").distinct().groupBy("topic_id").agg(F.count(F.lit(1)).alias("merges"))


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("agg1_mentions", f"with {_C} select c.topic_id, strftime(cast(substr(e.captured_at,1,10) as date),'%G-W%V') as period, count(*) as mentions from c join evidence e using (evidence_id) where e.duplicate_of is null and c.topic_id is not null group by 1,2")
def agg1(spark, d):
    e = evidence(spark, d).where("duplicate_of is null").select("evidence_id", X.iso_week(X.date_prefix(F.col("captured_at"))).alias("period"))
    return candidates(spark, d).where("topic_id is not null").join(e, "evidence_id").groupBy("topic_id", "period").agg(F.count(F.lit(1)).alias("mentions"))


@query("agg2_rebuild_diff", f"with {_M}, {_C}, v as (select c.topic_id, strftime(cast(substr(e.captured_at,1,10) as date),'%G-W%V') as period, count(*) as derived from c join evidence e using (evidence_id) where e.duplicate_of is null and c.topic_id is not null group by 1,2) select coalesce(m.topic_id, v.topic_id) as topic_id, count(*) as changed_weeks from mentions m full join v on m.topic_id = v.topic_id and m.period = v.period where m.mentions is distinct from v.derived group by 1")
def agg2(spark, d):
    """Weeks whose stated count differs from the derived one."""
    both = mentions(spark, d).join(agg1(spark, d).withColumnRenamed("mentions", "derived"), ["topic_id", "period"], "full_outer")
    return both.where(~F.col("mentions").eqNullSafe(F.col("derived"))).groupBy("topic_id").agg(F.count(F.lit(1)).alias("changed_weeks"))


@query("agg3_totals", f"with {_M} select topic_id, cast(sum(mentions) as bigint) as total, cast(coalesce(sum(mentions) filter (period = '{WEEK}'), 0) as bigint) as this_week from mentions group by 1")
def agg3(spark, d):
    return mentions(spark, d).groupBy("topic_id").agg(F.sum("mentions").alias("total"), F.coalesce(F.sum(F.when(F.col("period") == WEEK, F.col("mentions"))), F.lit(0)).alias("this_week"))


@query("agg4_topic_week", "select topic_id, week, round(avg(case when isnan(materiality_score) then null else materiality_score end), 9) as mean_score, case when count(distinct signal_type) = 1 then min(signal_type) else 'mixed_signal_types' end as signal_type from material_signal where topic_id is not null group by 1,2")
def agg4(spark, d):
    s = read(spark, d, "material_signal").where("topic_id is not null")
    return s.groupBy("topic_id", "week").agg(F.round(F.avg(F.when(~F.isnan("materiality_score"), F.col("materiality_score"))), 9).alias("mean_score"), F.when(F.min("signal_type") == F.max("signal_type"), F.min("signal_type")).otherwise("mixed_signal_types").alias("signal_type"))


@query("agg6_cited_ids", f"with {_C}, u as (select distinct topic_id, evidence_id from c where topic_id is not null and week = '{WEEK}') select topic_id, list(evidence_id order by evidence_id) as evidence_ids from u group by 1")
def agg6(spark, d):
    u = candidates(spark, d).where((F.col("week") == WEEK) & F.col("topic_id").isNotNull()).select("topic_id", "evidence_id").distinct()
    return u.groupBy("topic_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


@query("agg7_usage", "select signal_type, confidence_label, count(*) as calls, cast(coalesce(sum(len(evidence_ids)),0) as bigint) as input_tokens, cast(coalesce(sum(len(materiality_reasons)),0) as bigint) as output_tokens from material_signal where created_at >= '2026-10-01' group by 1,2")
def agg7(spark, d):
    """Ledger usage since a day: calls, what went in (cited posts) and came out (reasons)."""
    s = read(spark, d, "material_signal").where("created_at >= '2026-10-01'")
    s = s.select("signal_type", "confidence_label", F.size("evidence_ids").alias("input_tokens"), F.size("materiality_reasons").alias("output_tokens"))
    return E.token_totals(spark, s, ["signal_type", "confidence_label"])


@query("agg8_health", f"""with {_C}, n as (select signal_id, count(*) as deliveries, count(topic_id) as topics from material_signal where signal_id is not null group by 1)
select (select count(*) from evidence where duplicate_of is null and evidence_id not in (select evidence_id from c)) as posts_pending, (select count(*) from evidence where content in ('[deleted]','[removed]')) as posts_dead,
 (select count(*) from evidence where duplicate_of is not null) as duplicates, (select count(*) from n where topics = 0 and deliveries < 3) as signals_unmatched, (select count(*) from n where topics = 0 and deliveries >= 3) as signals_stuck,
 (select count(*) from material_signal where signal_id is null) as signals_without_id, (select count(*) from material_signal where isnan(materiality_score)) as scores_unusable, (select count(*) from canonical_topic where status = 'merged' and merged_into is null) as merges_open,
 (select count(*) from canonical_topic where status = 'active') as active_topics, (select count(*) from topic_weekly_mentions where mentions is null) as weeks_without_count""")
def agg8(spark, d):
    """Ten counts of what is pending, stuck or unusable."""
    one = lambda t, **c: t.agg(*[F.count_if(F.expr(v)).alias(k) for k, v in c.items()])
    s, e = read(spark, d, "material_signal"), evidence(spark, d)
    pending = e.where("duplicate_of is null").select("evidence_id").join(candidates(spark, d).select("evidence_id"), "evidence_id", "left_anti")
    n = s.where("signal_id is not null").groupBy("signal_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count("topic_id").alias("topics"))
    parts = [
        one(pending, posts_pending="true"),
        one(e, posts_dead="content in ('[deleted]','[removed]')", duplicates="duplicate_of is not null"),
        one(n, signals_unmatched="topics = 0 and deliveries < 3", signals_stuck="topics = 0 and deliveries >= 3"),
        one(s, signals_without_id="signal_id is null", scores_unusable="isnan(materiality_score)"),
        one(read(spark, d, "canonical_topic"), merges_open="status = 'merged' and merged_into is null", active_topics="status = 'active'"),
        one(read(spark, d, "topic_weekly_mentions"), weeks_without_count="mentions is null"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@query("agg24_first_of_key", f"with e as (select evidence_id, {_IDENT.format(c='source_key')} as k from evidence) select evidence_id, case when k is null then evidence_id else min(evidence_id) over (partition by k) end as first_row from e")
def agg24(spark, d):
    e = evidence(spark, d).select("evidence_id", identifier("source_key").alias("k"))
    return R.first_of_key(e, "k", "evidence_id").select("evidence_id", "first_row")


@query("agg22_same_members", f"with {_C}, g as (select signal_id, list(distinct evidence_id order by evidence_id) as members from c where signal_id is not null group by 1) select members, count(*) as signals, min(signal_id) as first_signal from g group by 1 having count(*) > 1")
def agg22(spark, d):
    """Signals that cite the same set of posts, whatever they are called."""
    g = candidates(spark, d).where("signal_id is not null").select("signal_id", "evidence_id").distinct().groupBy("signal_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("members"))
    return g.groupBy("members").agg(F.count(F.lit(1)).alias("signals"), F.min("signal_id").alias("first_signal")).where("signals > 1")


# --- windows -----------------------------------------------------------------------------------------------------------


@query("win1_trailing_average", f"with {_M}, r as (select topic_id, mentions, row_number() over (partition by topic_id order by period desc) as rn from mentions where period < '{WEEK}'), k as (select * from r where rn <= {OBSERVED}), n as (select *, count(*) over (partition by topic_id) - rn + 1 as w from k) select topic_id, round(sum(w*mentions)/sum(w), 9) as average from n group by 1")
def win1(spark, d):
    return R.trailing_weighted(mentions(spark, d), "topic_id", "period", "mentions", WEEK, OBSERVED).withColumn("average", F.round("average", 9))


@query("win3_latest_signal", "select topic_id, week, max(delivery_id) as delivery_id, arg_max(materiality_label, delivery_id) as materiality_label from material_signal where topic_id is not null group by 1,2")
def win3(spark, d):
    s = read(spark, d, "material_signal").where("topic_id is not null").select("topic_id", "week", "delivery_id", "materiality_label")
    return R.latest(s, ["topic_id", "week"], "delivery_id")


@query("win4_newest_per_source", f"with r as (select source_name, evidence_id, row_number() over (partition by source_name order by {_AT.format(c='published_at')} desc, evidence_id desc) as rank from evidence where duplicate_of is null) select source_name, evidence_id, rank from r where rank <= 10")
def win4(spark, d):
    e = evidence(spark, d).where("duplicate_of is null").select("source_name", "evidence_id", F.to_timestamp("published_at").alias("at"))
    return R.top_n(e, ["source_name"], 10, F.desc("at"), F.desc("evidence_id")).select("source_name", "evidence_id", F.col("rank").cast("bigint").alias("rank"))


@query("win5_bursts", f"""with recursive e as (select source_name || ' ' || strftime({_AT.format(c='published_at')} at time zone 'UTC','%G-W%V') as grp, cast(epoch({_AT.format(c='published_at')}) as bigint) as t, evidence_id from evidence where source_name is not null),
n as (select *, row_number() over (partition by grp order by t, evidence_id) as rn from e where grp is not null),
k as (select a.grp, a.rn, a.t, a.evidence_id, count(*) as posts, max(b.t) as to_s from n a join n b on a.grp = b.grp and b.rn >= a.rn and b.t <= a.t + 86400 group by all),
g as (select * from k where rn = 1 union all select k.* from g join k on k.grp = g.grp and k.rn = g.rn + case when g.posts >= 4 then g.posts else 1 end)
select grp, evidence_id as first_row, t as from_s, to_s, posts from g where posts >= 4""")
def win5(spark, d):
    """Greedy bursts of four posts or more within a day, by source and week of publication (a hot source falls apart by weeks)."""
    e = evidence(spark, d).withColumn("at", F.to_timestamp("published_at"))
    e = e.withColumn("grp", F.concat("source_name", F.lit(" "), X.iso_week(F.to_date("at"))))
    return B.bursts(e, "grp", "at", "evidence_id", span_s=86_400)


@query("win5_burst_starts", f"with e as (select source_name, evidence_id, {_AT.format(c='published_at')} as ats from evidence where source_name is not null), k as (select source_name, evidence_id, cast(epoch(ats) as bigint) as t, strftime(ats at time zone 'UTC','%G-W%V') as week from e), n as (select *, count(*) over (partition by source_name, week order by t range between current row and 86400 following) as posts from k) select source_name, evidence_id, posts from n where posts >= 4")
def win5_starts(spark, d):
    """Posts from which on their source has four posts or more within a day of the same week."""
    e = evidence(spark, d).where("source_name is not null").withColumn("at", F.to_timestamp("published_at"))
    e = e.withColumn("grp", F.concat("source_name", F.lit("\n"), X.iso_week(F.to_date("at"))))
    starts = B.burst_starts(e, "grp", "at", "evidence_id", span_s=86_400)
    return starts.select(F.substring_index("grp", "\n", 1).alias("source_name"), F.col("row_id").alias("evidence_id"), "posts")


@query("win6_error_runs", "with s as (select batch_no, delivery_id, confidence_label = 'low' as bad, row_number() over (partition by batch_no order by delivery_id) - row_number() over (partition by batch_no, confidence_label = 'low' order by delivery_id) as island from material_signal) select batch_no, min(delivery_id) as first_delivery, count(*) as length from s where bad group by batch_no, island having count(*) >= 2")
def win6(spark, d):
    """Runs of two or more deliveries in a row of low confidence, within a batch."""
    return R.runs_of(read(spark, d, "material_signal"), "batch_no", "delivery_id", F.col("confidence_label") == "low").withColumnRenamed("first", "first_delivery")


@query("win8_week_before", f"with {_M} select topic_id, period, mentions, strftime(strptime(period || '-1', '%G-W%V-%u') - interval 7 day, '%G-W%V') as week_before from mentions")
def win8(spark, d):
    m = latest_statements(read(spark, d, "topic_weekly_mentions"))
    return m.select(F.col("entity").alias("topic_id"), week_name(F.col("week")).alias("period"), F.col("value").alias("mentions"), week_name(F.col("week") - 1).alias("week_before"))


# --- set operations ----------------------------------------------------------------------------------------------------


@query("set1_topics_of_both", "with s as (select distinct topic_id, batch_no < 13 as early from material_signal where topic_id is not null) select topic_id, case when count(*) = 2 then 'both' when bool_and(early) then 'only before' else 'only after' end as side from s group by 1")
def set1(spark, d):
    """The topics of two runs: in both, only before, only after. One aggregate instead of three set operations."""
    s = read(spark, d, "material_signal").where("topic_id is not null and batch_no is not null")
    early = F.col("batch_no") < 13
    sides = s.groupBy("topic_id").agg(F.max(early).alias("before"), F.max(~early).alias("after"))
    return sides.select("topic_id", F.when(F.col("before") & F.col("after"), "both").when(F.col("before"), "only before").otherwise("only after").alias("side"))


@query("set2_missing_keys", "select evidence_id, len(list_filter(['score','num_comments','reddit_post_id'], lambda k: not json_valid(coalesce(metadata,'')) or json_type(metadata) <> 'OBJECT' or not list_contains(json_keys(metadata), k))) as missing from evidence where json_valid(coalesce(metadata,'null'))")
def set2(spark, d):
    """How many of the expected keys a post's metadata lack (rows whose metadata is readable JSON or absent)."""
    keys = F.coalesce(F.json_object_keys("metadata"), F.array().cast("array<string>"))
    missing = F.size(F.array_except(F.array(*map(F.lit, ("score", "num_comments", "reddit_post_id"))), keys)).cast("bigint")
    valid = F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull()
    return evidence(spark, d).where(valid).select("evidence_id", missing.alias("missing"))


_ROOTS = """r as (select topic_id as node, topic_id as at, 0 as steps from canonical_topic
 union all select r.node, t.merged_into, r.steps + 1 from r join canonical_topic t on r.at = t.topic_id where t.merged_into is not null and r.steps < 500),
roots as (select r.node, r.at as root from r left join canonical_topic t on r.at = t.topic_id where t.merged_into is null)"""


@query("set4_alias_union", f"""with recursive {_ROOTS}, x as (select o.root, t.topic_id <> o.root as merged, t.topic_id, case when t.topic_id = o.root then t.aliases else list_prepend(t.name, t.aliases) end as names from roots o join canonical_topic t on o.node = t.topic_id),
a as (select root, merged, topic_id, unnest(names) as alias, unnest(range(len(names))) as pos from x),
f as (select *, row_number() over (partition by root, alias order by merged, topic_id, pos) as nth from a where alias is not null)
select f.root as topic_id, list(f.alias order by f.merged, f.topic_id, f.pos) as aliases from f join canonical_topic t on f.root = t.topic_id where f.nth = 1 and f.alias <> t.name group by 1""")
def set4(spark, d):
    """What each topic is called besides its name: its own aliases, then the names and aliases of all topics merged into it
    (directly or over others, by topic_id), each in its order and once."""
    t = read(spark, d, "canonical_topic")
    roots = R.follow_pointers(t, "topic_id", "merged_into").where("root is not null").select(F.col("node").alias("topic_id"), "root")
    names = F.when(F.col("topic_id") == F.col("root"), F.col("aliases")).otherwise(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    x = t.join(roots, "topic_id").select("root", F.posexplode(names).alias("pos", "alias"), F.struct((F.col("topic_id") != F.col("root")).alias("merged"), "topic_id").alias("at")).where("alias is not null")
    first = x.groupBy("root", "alias").agg(F.min(F.struct("at", "pos")).alias("first"))
    own = t.select(F.col("topic_id").alias("root"), F.col("name").alias("own"))
    kept = first.join(own, "root").where("alias <> own")
    return kept.groupBy(F.col("root").alias("topic_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "alias"))), lambda v: v["alias"]).alias("aliases"))


# --- functions ---------------------------------------------------------------------------------------------------------


@query("fn1_iso_week", "select evidence_id, strftime(cast(substr(captured_at,1,10) as date),'%G-W%V') as week from evidence")
def fn1(spark, d):
    return evidence(spark, d).select("evidence_id", X.iso_week(X.date_prefix(F.col("captured_at"))).alias("week"))


_WORD = "\\pL\\pN_"
_SPACE = "[\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}]"
_NOSPACE = "[^\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}]"


def _scrub(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '(^|[^{_WORD}/])/?u/[A-Za-z0-9_-]+', '\\1u/[user]', 'g'), '[{_WORD}.+-]+@[{_WORD}-]+(?:\\.[{_WORD}-]+)+', '[email]', 'g')"


def _summary(c: str) -> str:
    t = f"trim(regexp_replace({_scrub(c)}, '{_SPACE}+', ' ', 'g'))"
    return f"case when length({t}) > 300 then rtrim(substr({t},1,299)) || '…' else {t} end"


def _detail(title: str, content: str) -> str:
    text = _scrub(f"coalesce({title},'') || chr(10) || chr(10) || coalesce({content},'')")
    return f"substr(regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, 2000)"


@query("fn3_normalise", f"select evidence_id, trim(regexp_replace(regexp_replace(lower(coalesce(title,'') || ' ' || coalesce(content,'')), 'https?://{_NOSPACE}+', ' ', 'g'), '[^{_WORD}]+', ' ', 'g')) as text from evidence")
def fn3(spark, d):
    return evidence(spark, d).select("evidence_id", X.normalise(F.col("title"), F.col("content")).alias("text"))


@query("fn5_slug", "select topic_id, coalesce(regexp_replace(regexp_replace(lower(name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),'') as slug from canonical_topic")
def fn5(spark, d):
    return read(spark, d, "canonical_topic").select("topic_id", X.slug(F.col("name")).alias("slug"))


@query("fn6_strict_date", "select evidence_id, try_cast(case when regexp_full_match(p, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then p end as date)::varchar as day from (select evidence_id, substr(published_at,1,10) as p from evidence)")
def fn6(spark, d):
    return evidence(spark, d).select("evidence_id", X.strict_date(F.substring("published_at", 1, 10)).cast("string").alias("day"))


@query("fn8_scrub", f"select evidence_id, {_scrub('content')} as content from evidence where content is not null")
def fn8(spark, d):
    return evidence(spark, d).where("content is not null").select("evidence_id", X.scrub(F.col("content")).alias("content"))


@query("fn9_summary", f"select evidence_id, {_summary('content')} as summary from evidence where content is not null")
def fn9(spark, d):
    return evidence(spark, d).where("content is not null").select("evidence_id", X.summary(F.col("content")).alias("summary"))


@query("fn10_url", f"select evidence_id, case when starts_with(source_url,'/') then '{HOST}' || source_url else source_url end as url from evidence")
def fn10(spark, d):
    return evidence(spark, d).select("evidence_id", X.absolute_url(F.col("source_url"), HOST).alias("url"))


@query("fn12_escape_tags", "select evidence_id, regexp_replace('<post_body>' || coalesce(content,'') || '</ post_body>', '<\\s*(/?)\\s*(post_title|post_body|topics|candidates|evidence)\\s*>', '&lt;\\1\\2&gt;', 'gi') as text from evidence")
def fn12(spark, d):
    return evidence(spark, d).select("evidence_id", X.escape_tags(F.concat(F.lit("<post_body>"), F.coalesce("content", F.lit("")), F.lit("</ post_body>"))).alias("text"))


@query("fn13_fingerprint", "select evidence_id, substr(sha256(content),1,12) as print from evidence where content is not null")
def fn13(spark, d):
    return evidence(spark, d).where("content is not null").select("evidence_id", X.fingerprint(F.col("content")).alias("print"))


@query("fn14_sample", "select evidence_id from evidence where cast('0x' || substr(sha256(evidence_id),1,8) as bigint) / 4294967295.0 < 0.05")
def fn14(spark, d):
    """A sample of a twentieth that depends on the ids only (a sampling operator)."""
    return evidence(spark, d).where(X.sample_share(F.col("evidence_id")) < 0.05).select("evidence_id")


@query("fn15_labels", "select delivery_id, case when isnan(materiality_score) or materiality_score is null or materiality_score not between 0 and 1 then null when round(materiality_score,12) >= 0.85 then 'high' when round(materiality_score,12) >= 0.6 then 'medium' else 'low' end as label from material_signal")
def fn15(spark, d):
    return read(spark, d, "material_signal").select("delivery_id", X.label_of(F.col("materiality_score")).alias("label"))


@query("fn20_json_path", "select evidence_id, try_cast(json_extract_string(case when json_valid(metadata) then metadata end, '$.score') as bigint) as score from evidence where json_valid(coalesce(metadata,'null'))")
def fn20(spark, d):
    valid = F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull()
    return evidence(spark, d).where(valid).select("evidence_id", F.get_json_object("metadata", "$.score").try_cast("bigint").alias("score"))


@query("fn22_sequence_ids", "with o as (select topic_id, row_number() over (order by topic_id) as n from (select distinct topic_id from topic_weekly_mentions where topic_id is not null)) select topic_id, 'T-' || lpad(cast(n as varchar), 6, '0') as id from o")
def fn22(spark, d):
    rows = read(spark, d, "topic_weekly_mentions").where("topic_id is not null").select("topic_id").distinct()
    return R.number_rows(rows, "topic_id").select("topic_id", X.sequence_id("T-", F.col("number"), 6).alias("id"))


# --- evaluation --------------------------------------------------------------------------------------------------------


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Two labels of each signal as expected and actual, its score as confidence."""
    return read(spark, d, "material_signal").select("delivery_id", F.col("materiality_label").alias("expected"), F.col("confidence_label").alias("actual"), F.col("materiality_score").alias("confidence"))


_G = "g as (select delivery_id, materiality_label as expected, confidence_label as actual, materiality_score as confidence from material_signal)"


@query("agg14_confusion", f"with {_G} select expected, actual, count(*) as n from g where expected is distinct from actual group by 1,2")
def agg14(spark, d):
    return E.confusion(graded(spark, d))


_CAL = f"{_G}, b(bin, low, high) as (values (0,0.0,0.6),(1,0.6,0.85),(2,0.85,1.0)), k as (select case when confidence >= 0.85 then 2 when confidence >= 0.6 then 1 else 0 end as bin, confidence, cast(expected is not distinct from actual as int) as ok from g where not isnan(confidence) and confidence between 0 and 1), s as (select bin, count(*) as rows, round(avg(confidence),9) as mean_confidence, round(avg(ok),9) as accuracy from k group by 1), cal as (select b.bin, cast(b.low as double) as low, cast(b.high as double) as high, coalesce(s.rows,0) as rows, s.mean_confidence, s.accuracy from b left join s using (bin))"


@query("agg15_calibration", f"with {_CAL} select * from cal")
def agg15(spark, d):
    return E.calibration(graded(spark, d))


@query("agg16_calibration_error", f"with {_CAL} select round(sum(rows*abs(accuracy-mean_confidence))/sum(rows), 9) as ece from cal")
def agg16(spark, d):
    return E.expected_calibration_error(graded(spark, d))


@query("agg17_agreement", f"with {_G} select count(*) filter (expected is not null and actual is not null) as graded, count(*) filter (expected = actual) as agreed, count(*) filter (expected <> 'high' and actual = 'high') as false_pass, count(*) filter (expected = 'high' and actual <> 'high') as false_fail, count(*) filter (expected is null or actual is null) as unusable from g")
def agg17(spark, d):
    return E.agreement(graded(spark, d).select(F.col("expected").alias("human"), F.col("actual").alias("judge")), "high")


@query("agg19_sweep", f"with {_G}, t(threshold) as (values (0.7),(0.8),(0.9),(0.95)), x as (select threshold, actual = 'low' and not isnan(confidence) and confidence >= threshold as skip, expected = 'low' as low from g cross join t) select cast(threshold as double) as threshold, count(*) filter (skip) as would_skip, count(*) filter (skip and low) as caught, count(*) filter (skip and not low) as false_skips from x group by 1")
def agg19(spark, d):
    g = graded(spark, d).select(F.when(F.col("actual") == "low", "skip").otherwise("extract").alias("route"), "confidence", (F.col("expected") == "low").alias("skip_expected"))
    return E.sweep(g)


_RUN = "select signal_id as key, case when max(case when materiality_label = 'low' then 1 else 0 end) = 1 then 'failed' else 'passed' end as status from material_signal where signal_id is not null and batch_no {0} 13 group by 1"


@query("dat16_compare_runs", f"with b as ({_RUN.format('<')}), a as ({_RUN.format('>=')}) select coalesce(b.key,a.key) as key, b.status as was, a.status as now, case when a.status is null then 'only before' when b.status is null then 'only after' when a.status = b.status then 'same' when b.status = 'passed' then 'regression' when a.status = 'passed' then 'fix' else 'other change' end as change from b full join a on a.key = b.key")
def dat16(spark, d):
    s = read(spark, d, "material_signal").where("signal_id is not null")
    run = lambda x: x.groupBy(F.col("signal_id").alias("key")).agg(F.when(F.max((F.col("materiality_label") == "low").cast("int")) == 1, "failed").otherwise("passed").alias("status"))
    return E.compare_runs(run(s.where("batch_no < 13")), run(s.where("batch_no >= 13")))


@query("agg12_field_accuracy", "with f as (select unnest(['label','topic','week']) as field, unnest([materiality_label is not distinct from confidence_label, topic_id is not null, week is not null]) as passed from material_signal where materiality_label is not null) select field, count(*) filter (passed) as correct, count(*) as graded from f group by 1")
def agg12(spark, d):
    s = read(spark, d, "material_signal").withColumn("status", F.when(F.col("materiality_label").isNull(), "errored").otherwise("graded"))
    field = lambda n, c: F.struct(F.lit(n).alias("field"), c.alias("passed"))
    s = s.withColumn("fields", F.array(field("label", F.col("materiality_label").eqNullSafe(F.col("confidence_label"))), field("topic", F.col("topic_id").isNotNull()), field("week", F.col("week").isNotNull())))
    return E.field_accuracy(s)


# --- composites --------------------------------------------------------------------------------------------------------


@query("dat1_weekly_report", f"with {_M}, r as (select topic_id, mentions, row_number() over (partition by topic_id order by period desc) as rn from mentions where period < '{WEEK}'), k as (select * from r where rn <= {OBSERVED}), n as (select *, count(*) over (partition by topic_id) - rn + 1 as w from k), a as (select topic_id, sum(w*mentions)/sum(w) as average from n group by 1), s as (select topic_id, cast(sum(mentions) as bigint) as total, cast(coalesce(sum(mentions) filter (period='{WEEK}'),0) as bigint) as now from mentions group by 1), z as (select t.topic_id, t.name, coalesce(s.now,0) as mentions_this_week, coalesce(s.total,0) as total_mentions, t.first_seen, round(coalesce(a.average,0),9) as average from canonical_topic t left join s using (topic_id) left join a using (topic_id) where t.status='active') select topic_id, name, mentions_this_week, total_mentions, average, case when first_seen='{WEEK}' then 'new' when average=0 then case when mentions_this_week>0 then 'rising' else 'stable' end when mentions_this_week > 1.2*average then 'rising' when mentions_this_week < 0.8*average then 'falling' else 'stable' end as trend from z")
def dat1(spark, d):
    """Mentions this week and in all, trailing average and direction of every active topic."""
    m = mentions(spark, d)
    topics = read(spark, d, "canonical_topic").where("status = 'active'").select("topic_id", "name", "first_seen")
    average = R.trailing_weighted(m, "topic_id", "period", "mentions", WEEK, OBSERVED)
    totals = m.groupBy("topic_id").agg(F.sum("mentions").alias("total"), F.sum(F.when(F.col("period") == WEEK, F.col("mentions"))).alias("now"))
    z = topics.join(totals, "topic_id", "left").join(average, "topic_id", "left")
    z = z.select("topic_id", "name", "first_seen", F.coalesce("now", F.lit(0)).alias("mentions_this_week"), F.coalesce("total", F.lit(0)).alias("total_mentions"), F.round(F.coalesce("average", F.lit(0.0)), 9).alias("average"))
    n, a = F.col("mentions_this_week"), F.col("average")
    trend = F.when(F.col("first_seen") == WEEK, "new").when(a == 0, F.when(n > 0, "rising").otherwise("stable")).when(n > 1.2 * a, "rising").when(n < 0.8 * a, "falling").otherwise("stable")
    return z.withColumn("trend", trend).drop("first_seen")


@query("dat6_registry_print", "with l as (select substr(sha256(concat_ws('|', topic_id, name, array_to_string(list_sort(aliases), ','))), 1, 12) as p from canonical_topic) select count(*) as topics, min(p) as least, max(p) as greatest, cast(sum(cast('0x' || substr(p,1,6) as bigint)) as bigint) as total from l")
def dat6(spark, d):
    """A fingerprint of the registry that doesn't depend on the order of its rows: row fingerprints, combined by sums."""
    p = read(spark, d, "canonical_topic").select(X.fingerprint(F.concat_ws("|", "topic_id", "name", F.array_join(F.array_sort("aliases"), ","))).alias("p"))
    return p.agg(F.count(F.lit(1)).alias("topics"), F.min("p").alias("least"), F.max("p").alias("greatest"), F.sum(F.conv(F.substring("p", 1, 6), 16, 10).cast("bigint")).alias("total"))


@query("dat11_topic_history", f"with {_M}, {_C}, wk as (select topic_id, count(*) as weeks, min(period) as first_period, max(period) as last_period from mentions group by 1), p as (select topic_id, count(distinct evidence_id) as posts from c group by 1) select t.topic_id, t.name, wk.weeks, wk.first_period, wk.last_period, coalesce(p.posts,0) as posts from canonical_topic t join wk using (topic_id) left join p using (topic_id)")
def dat11(spark, d):
    w = mentions(spark, d).groupBy("topic_id").agg(F.count(F.lit(1)).alias("weeks"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    p = candidates(spark, d).where("topic_id is not null").groupBy("topic_id").agg(F.countDistinct("evidence_id").alias("posts"))
    return read(spark, d, "canonical_topic").select("topic_id", "name").join(w, "topic_id").join(p, "topic_id", "left").withColumn("posts", F.coalesce("posts", F.lit(0)))


@query("dat3_publish", f"""with {_C}, mat as (select distinct topic_id from material_signal where week = '{WEEK}' and topic_id is not null),
x as (select c.topic_id, c.delivery_id, c.signal_type, c.summary, e.*, row_number() over (partition by c.topic_id order by {_AT.format(c='e.published_at')} desc, c.delivery_id desc, e.evidence_id desc) as rank from c join mat using (topic_id) join evidence e using (evidence_id)
  where e.duplicate_of is null and strftime(cast(substr(e.captured_at,1,10) as date),'%G-W%V') = '{WEEK}')
select x.delivery_id, x.evidence_id, substr(x.published_at,1,10) as date, 'community' as source_type, case when starts_with(x.source_url,'/') then '{HOST}' || x.source_url else x.source_url end as source_ref, {_summary('x.summary')} as summary, {_detail('x.title', 'x.content')} as detail, t.slug || ';' || x.signal_type as tags
from x join canonical_topic t using (topic_id) where x.rank <= 10""")
def dat3(spark, d):
    """What is published of a week: of each topic with a signal that week the ten newest cited posts captured in it, as rows
    without account names and addresses."""
    week = X.iso_week(X.date_prefix(F.col("captured_at")))
    e = evidence(spark, d).where(F.col("duplicate_of").isNull() & (week == WEEK)).select("evidence_id", "title", "content", "source_url", "published_at", F.to_timestamp("published_at").alias("at"))
    topics = flt14(spark, d)
    x = candidates(spark, d).join(topics, "topic_id", "left_semi").select("topic_id", "delivery_id", "signal_type", "summary", "evidence_id").join(e, "evidence_id")
    newest = R.top_n(x, ["topic_id"], 10, F.desc("at"), F.desc("delivery_id"), F.desc("evidence_id"))
    rows = newest.join(read(spark, d, "canonical_topic").select("topic_id", "slug"), "topic_id")
    return rows.select(
        "delivery_id", "evidence_id", F.substring("published_at", 1, 10).alias("date"), F.lit("community").alias("source_type"), X.absolute_url(F.col("source_url"), HOST).alias("source_ref"),
        X.summary(F.col("summary")).alias("summary"), X.detail(F.col("title"), F.col("content")).alias("detail"), X.tags(F.col("slug"), F.col("signal_type")).alias("tags"),
    )


@query("dat22_append_ids", "with o as (select delivery_id, summary, signal_id, row_number() over (partition by signal_id, summary order by delivery_id) as rn from material_signal where batch_no >= 13 and signal_id is not null), f as (select delivery_id, row_number() over (order by delivery_id) as n from o where rn = 1 and not exists (select 1 from material_signal m where m.batch_no < 13 and m.signal_id = o.signal_id and m.summary = o.summary)), t as (select max(cast(regexp_extract(delivery_id,'([0-9]+)$',1) as bigint)) as top from material_signal where batch_no < 13) select delivery_id, 'SIG-' || lpad(cast(t.top + f.n as varchar), 12, '0') as id from f cross join t")
def dat22(spark, d):
    """Rows that the store doesn't have yet, with the next ids."""
    s = read(spark, d, "material_signal").where("signal_id is not null").select("delivery_id", "signal_id", "summary", "batch_no")
    store = read(spark, d, "material_signal").where("batch_no < 13").select("signal_id", "summary", F.col("delivery_id").alias("id"))
    return R.append_new(store, s.where("batch_no >= 13"), ["signal_id", "summary"], "delivery_id", "SIG-", 12).select("delivery_id", "id")


@query("tpch_q1", "select l_returnflag, l_linestatus, round(sum(l_quantity),2) as sum_qty, round(sum(l_extendedprice*(1-l_discount)),2) as revenue, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1,2")
def tpch_q1(spark, d):
    li = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


# --- state as tables ---------------------------------------------------------------------------------------------------


@query("dml2_cursors", f"select source_type, source_name, arg_max(evidence_id, (({_AT.format(c='published_at')}), evidence_id)) as newest from evidence where source_name is not null group by 1,2")
def dml2(spark, d):
    """The latest cursor of each source: an append-only log read as its newest rows."""
    e = evidence(spark, d).where("source_name is not null").select("source_type", "source_name", F.to_timestamp("published_at").alias("at"), "evidence_id")
    return R.latest(e, ["source_type", "source_name"], "at", "evidence_id").select("source_type", "source_name", F.col("evidence_id").alias("newest"))


@query("dml4_attempts", """
with o as (select topic_id, delivery_id, confidence_label = 'high' as ok, batch_no % 2 = 0 as counted from material_signal where topic_id is not null and confidence_label is not null),
s as (select *, coalesce(bool_or(ok) over p, false) as was, coalesce(sum(cast(counted and not ok as int)) over p, 0) as failed from o window p as (partition by topic_id order by delivery_id rows between unbounded preceding and 1 preceding)),
f as (select topic_id, cast(sum(cast(counted and not ok as int)) as bigint) as attempts, bool_or(ok) as ok from s where not was and failed < 3 group by 1)
select topic_id, attempts, case when ok then 'done' when attempts >= 3 then 'dead' else 'open' end as status from f""")
def dml4(spark, d):
    """Attempts until the first signal of high confidence, as a fold over each topic's deliveries."""
    s = read(spark, d, "material_signal").where("topic_id is not null and confidence_label is not null")
    return R.fold_attempts(s, "topic_id", "delivery_id", F.col("confidence_label") == "high", F.col("batch_no") % 2 == 0, 3)


@query("dml5_first_topic", "select signal_id, arg_min(topic_id, delivery_id) filter (topic_id is not null) as original_topic_id, arg_max(topic_id, delivery_id) filter (topic_id is not null) as topic_id from material_signal where signal_id is not null group by 1")
def dml5(spark, d):
    """The first topic a signal was given (the first write wins) and its latest."""
    t, at = F.col("topic_id"), F.when(F.col("topic_id").isNotNull(), F.col("delivery_id"))
    return read(spark, d, "material_signal").where("signal_id is not null").groupBy("signal_id").agg(F.min_by(t, at).alias("original_topic_id"), F.max_by(t, at).alias("topic_id"))


@query("dml9_versions", """
with c as (select signal_id, delivery_id, summary, topic_id, lag((summary, topic_id)) over w as before, row_number() over w = 1 as first from material_signal where signal_id is not null window w as (partition by signal_id order by delivery_id)),
k as (select * from c where first or before is distinct from (summary, topic_id))
select signal_id, summary, topic_id, delivery_id as valid_from, lead(delivery_id) over w as valid_to, row_number() over w as version from k window w as (partition by signal_id order by delivery_id)""")
def dml9(spark, d):
    """What each signal has said over its deliveries, as versions with their intervals."""
    return R.versions(read(spark, d, "material_signal").where("signal_id is not null"), "signal_id", "delivery_id", "summary", "topic_id")


@query("join10_unlisted_posts", f"with {_C} select distinct evidence_id from c where not exists (select 1 from evidence e where e.evidence_id = c.evidence_id)")
def join10(spark, d):
    """Cited ids that are no posts: an audit of the reference, empty if all is well."""
    return candidates(spark, d).select("evidence_id").distinct().join(evidence(spark, d).select("evidence_id"), "evidence_id", "left_anti")


@query("join16_slug_lookup", "with s as (select topic_id, coalesce(regexp_replace(regexp_replace(lower(name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),'') as slug from canonical_topic) select s.topic_id, s.slug, f.topic_id as first_topic from s join (select slug, min(topic_id) as topic_id from s where slug <> '' group by 1) f using (slug)")
def join16(spark, d):
    """The topic that a proposed name leads to: the first with the same slug."""
    s = read(spark, d, "canonical_topic").select("topic_id", X.slug(F.col("name")).alias("slug"))
    return s.join(s.where("slug <> ''").groupBy("slug").agg(F.min("topic_id").alias("first_topic")), "slug").select("topic_id", "slug", "first_topic")


@query("prj8_topic_report", f"with {_M}, {_C}, r as (select topic_id, list(period || ':' || mentions order by period) as weeks from mentions group by 1), u as (select topic_id, list(distinct e.source_url order by e.source_url) as evidence_urls from c join evidence e using (evidence_id) where topic_id is not null group by 1) select t.topic_id, t.name, r.weeks, u.evidence_urls from canonical_topic t left join r using (topic_id) left join u using (topic_id)")
def prj8(spark, d):
    """Each topic with its weekly counts in order and the addresses of the posts cited for it."""
    w = mentions(spark, d).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "period", F.col("mentions").cast("string")))).alias("weeks"))
    cited = candidates(spark, d).where("topic_id is not null").select("topic_id", "evidence_id").distinct()
    urls = cited.join(evidence(spark, d).select("evidence_id", "source_url"), "evidence_id").where("source_url is not null").groupBy("topic_id").agg(F.array_sort(F.collect_set("source_url")).alias("evidence_urls"))
    return read(spark, d, "canonical_topic").select("topic_id", "name").join(w, "topic_id", "left").join(urls, "topic_id", "left")


@query("srt3_latest_calls", "select delivery_id, signal_type from material_signal order by delivery_id desc limit 20")
def srt3(spark, d):
    """The newest twenty deliveries (a top-k report)."""
    return read(spark, d, "material_signal").select("delivery_id", "signal_type").orderBy(F.desc("delivery_id")).limit(20)


@query("fn23_validate", "select evidence_id, list_filter([case when coalesce(trim(title),'')='' then 'title is missing' end, case when coalesce(trim(content),'')='' then 'content is missing' end, case when length(title) > 80 then 'title is long' end, case when not regexp_matches(published_at, '(Z|[+-][0-9]{2}:[0-9]{2})$') then 'no offset' end], lambda x: x is not null) as problems from evidence")
def fn23(spark, d):
    """What is wrong with each post, as a list of messages."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = [(blank("title"), "title is missing"), (blank("content"), "content is missing"), (F.length("title") > 80, "title is long"), (~F.col("published_at").rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), "no offset")]
    return evidence(spark, d).select("evidence_id", F.array_compact(F.array(*[F.when(c, m) for c, m in checks])).alias("problems"))


@query("prs1_json_kinds", "select case when metadata is null then 'missing' when not json_valid(metadata) then 'broken' else lower(json_type(metadata)) end as kind, count(*) as posts from evidence group by 1")
def prs1(spark, d):
    """What the metadata are as JSON: missing, broken, object, array, null."""
    v = F.try_parse_json("metadata")
    kind = F.lower(F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1))
    kind = F.when(F.col("metadata").isNull(), "missing").when(v.isNull(), "broken").when(kind == "void", "null").otherwise(kind)
    return evidence(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("posts"))


@query("win9_gap_weeks", f"with {_M}, g as (select topic_id, period, strptime(period || '-1', '%G-W%V-%u') as monday from mentions), l as (select topic_id, period, cast(date_diff('day', lag(monday) over (partition by topic_id order by monday), monday) / 7 - 1 as bigint) as silent from g) select topic_id, period, silent from l where silent > 0")
def win9(spark, d):
    """Weeks without mentions before each week that has some."""
    m = latest_statements(read(spark, d, "topic_weekly_mentions"))
    w = Window.partitionBy("entity").orderBy("week")
    return m.select(F.col("entity").alias("topic_id"), week_name(F.col("week")).alias("period"), (F.col("week") - F.lag("week").over(w) - 1).alias("silent")).where("silent > 0")


# --- events ------------------------------------------------------------------------------------------------------------


@query("evt1_weekly_events", "select event_type, strftime(ts,'%G-W%V') as week, count(*) as events, round(sum(value),4) as total from events group by 1,2")
def evt1(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type", X.iso_week(F.to_date("ts")).alias("week")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("evt2_last_event", "select user_id, event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by 1,2")
def evt2(spark, d):
    return R.latest(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")
