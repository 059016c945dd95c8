"""Further queries of the signal analytics, each with its SQL: ledgers and outcomes, audits of the registry, comparisons of runs,
publication, validation of JSON, coordinated posting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import replies as P
from postloom.functions import text as X
from postloom.operators import coordination as C
from postloom.operators import evaluation as E
from postloom.operators import relational as R
from postloom.plans.reference import _AT, _C, _M, HOST, WEEK, _detail, _summary, candidates, evidence, graded, mentions
from postloom.sources.tables import read

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


def signals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "material_signal")


def topics(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "canonical_topic")


_JSON = "case when json_valid(coalesce(metadata,'')) and json_type(metadata) = 'OBJECT' then metadata end"


# --- scans, projections and filters ----------------------------------------------------------------------------------


@query("src2_posts", f"select evidence_id as id, title, content as selftext, source_url as permalink, try_cast(json_extract_string({_JSON}, '$.score') as bigint) as score, try_cast(json_extract_string({_JSON}, '$.num_comments') as bigint) as num_comments, cast(epoch({_AT.format(c='published_at')}) as bigint) as created_utc from evidence")
def src2(spark, d):
    """Posts as seven fields, never with an author."""
    number = lambda k: F.get_json_object("metadata", f"$.{k}").try_cast("bigint").alias(k)
    return evidence(spark, d).select(F.col("evidence_id").alias("id"), "title", F.col("content").alias("selftext"), F.col("source_url").alias("permalink"), number("score"), number("num_comments"), F.unix_timestamp(F.to_timestamp("published_at")).alias("created_utc"))


@query("src11_golden_audit", "with i as (select example_id, count(*) as n from golden_example group by 1) select source, count(*) as items, count(*) filter (i.n > 1) as repeated, count(*) filter (trim(coalesce(content,'')) = '' or trim(coalesce(reference_summary,'')) = '') as blank, count(*) filter (signal_type is null) as unlabelled from golden_example g left join i using (example_id) group by 1")
def src11(spark, d):
    """Held-out items by source, checked: ids given twice (in any source), blank fields, missing labels."""
    g = read(spark, d, "golden_example")
    n = g.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return g.join(n, "example_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(blank("content") | blank("reference_summary")).alias("blank"), F.count_if(F.col("signal_type").isNull()).alias("unlabelled"))


@query("flt4_unmatched", "with n as (select signal_id, count(*) as attempts, count(topic_id) as topics, max(delivery_id) as newest from material_signal where signal_id is not null group by 1) select signal_id, attempts, newest from n where topics = 0 and attempts < 3")
def flt4(spark, d):
    """Signals without a topic after less than three deliveries; the bound is an optional predicate."""
    n = signals(spark, d).where("signal_id is not null").groupBy("signal_id").agg(F.count(F.lit(1)).alias("attempts"), F.count("topic_id").alias("topics"), F.max("delivery_id").alias("newest"))
    return R.where_given(n.where("topics = 0"), attempts=("<", 3), newest=("<", None)).drop("topics")


@query("flt6_calls", "select delivery_id, signal_type, confidence_label, week from material_signal where confidence_label = 'low' order by delivery_id desc limit 20")
def flt6(spark, d):
    """The newest twenty calls of a status, of any type (a top-k report with optional predicates)."""
    return R.where_given(signals(spark, d), confidence_label=("=", "low"), signal_type=("=", None)).select("delivery_id", "signal_type", "confidence_label", "week").orderBy(F.desc("delivery_id")).limit(20)


@query("flt7_topics_by_status", "select topic_id, slug, status from canonical_topic where status = 'merged'")
def flt7(spark, d):
    """Topics of a status, any if none is given."""
    return R.where_given(topics(spark, d), status=("=", "merged"), first_seen=(">=", None)).select("topic_id", "slug", "status")


@query("flt8_ready_signals", "select delivery_id, signal_id, week from material_signal where confidence_label = 'high' and topic_id is not null and batch_no >= 20")
def flt8(spark, d):
    return R.where_given(signals(spark, d), confidence_label=("=", "high"), batch_no=(">=", 20)).where("topic_id is not null").select("delivery_id", "signal_id", "week")


@query("flt9_pending_signals", "select delivery_id, summary from material_signal where trim(coalesce(signal_id,'')) = '' order by delivery_id")
def flt9(spark, d):
    """Deliveries that were never given an id, in their order."""
    return signals(spark, d).where("trim(coalesce(signal_id, '')) = ''").select("delivery_id", "summary").orderBy("delivery_id")


@query("flt15_golden_of_source", "select example_id, title, signal_type from golden_example where source = 'golden_reddit'")
def flt15(spark, d):
    return read(spark, d, "golden_example").where("source = 'golden_reddit'").select("example_id", "title", "signal_type")


@query("prj6_signal_rows", f"with {_C} select c.delivery_id, e.evidence_id, substr(e.published_at,1,10) as date, case when starts_with(e.source_url,'/') then '{HOST}' || e.source_url else e.source_url end as source_ref, {_summary('c.summary')} as summary, {_detail('e.title', 'e.content')} as detail, t.slug || ';' || c.signal_type as tags from c join evidence e using (evidence_id) join canonical_topic t using (topic_id)")
def prj6(spark, d):
    """Every signal with each post it cites as a row to publish."""
    e = evidence(spark, d).select("evidence_id", "title", "content", "source_url", "published_at")
    rows = candidates(spark, d).join(e, "evidence_id").join(topics(spark, d).select("topic_id", "slug"), "topic_id")
    return rows.select("delivery_id", "evidence_id", F.substring("published_at", 1, 10).alias("date"), X.absolute_url(F.col("source_url"), HOST).alias("source_ref"), X.summary(F.col("summary")).alias("summary"), X.detail(F.col("title"), F.col("content")).alias("detail"), X.tags(F.col("slug"), F.col("signal_type")).alias("tags"))


@query("prj9_topic_history", f"with {_M}, {_C}, wk as (select topic_id, list(period || ':' || mentions order by period) as weeks from mentions group by 1), g as (select merged_into as topic_id, list(topic_id order by topic_id) as merged_from from canonical_topic where merged_into is not null group by 1) select t.topic_id, t.slug, t.first_seen, t.last_seen, t.merged_into, g.merged_from, wk.weeks from canonical_topic t left join g using (topic_id) left join wk using (topic_id)")
def prj9(spark, d):
    """Each topic with its lineage (merged into, merged from) and weekly mentions in order."""
    w = mentions(spark, d).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "period", F.col("mentions").cast("string")))).alias("weeks"))
    g = topics(spark, d).where("merged_into is not null").groupBy(F.col("merged_into").alias("topic_id")).agg(F.array_sort(F.collect_list("topic_id")).alias("merged_from"))
    return topics(spark, d).select("topic_id", "slug", "first_seen", "last_seen", "merged_into").join(g, "topic_id", "left").join(w, "topic_id", "left")


@query("srt6_confusion_ranked", "with g as (select materiality_label as expected, confidence_label as actual from material_signal), c as (select expected, actual, count(*) as n from g where expected is distinct from actual group by 1,2) select *, row_number() over (order by n desc, expected nulls first, actual nulls first) as rank from c")
def srt6(spark, d):
    """The confusions by frequency (a few label pairs)."""
    order = F.struct(-F.col("n"), "expected", "actual")
    return R.number_rows(E.confusion(graded(spark, d)).withColumn("order", order), "order").drop("order").withColumnRenamed("number", "rank")


@query("srt7_first_of_week", f"select delivery_id, topic_id, summary from material_signal where week = '{WEEK}' and topic_id is not null order by delivery_id limit 30")
def srt7(spark, d):
    """The first thirty matched deliveries of a week (a top-k report)."""
    return signals(spark, d).where((F.col("week") == WEEK) & F.col("topic_id").isNotNull()).select("delivery_id", "topic_id", "summary").orderBy("delivery_id").limit(30)


@query("dat17_scenario", f"with r as (select topic_id, slug, name, description, aliases from canonical_topic where first_seen <= '{WEEK}' and coalesce(case when status = 'merged' then last_seen end, '9999-W99') > '{WEEK}'), s as (select delivery_id, topic_id, signal_type, summary from material_signal where week = '{WEEK}' and topic_id is not null order by delivery_id limit 30) select s.delivery_id, s.signal_type, s.summary, r.slug as expected_slug, r.name as expected_name, r.topic_id is null as unlisted from s left join r using (topic_id)")
def dat17(spark, d):
    """A matching scenario drawn from a week: its first thirty matched deliveries with the registry as it stood then."""
    at = (F.col("first_seen") <= WEEK) & (F.coalesce(F.when(F.col("status") == "merged", F.col("last_seen")), F.lit("9999-W99")) > WEEK)
    registry = topics(spark, d).where(at).select("topic_id", F.col("slug").alias("expected_slug"), F.col("name").alias("expected_name"), F.lit(True).alias("listed"))
    s = signals(spark, d).where((F.col("week") == WEEK) & F.col("topic_id").isNotNull()).select("delivery_id", "topic_id", "signal_type", "summary").orderBy("delivery_id").limit(30)
    return s.join(registry, "topic_id", "left").select("delivery_id", "signal_type", "summary", "expected_slug", "expected_name", F.col("listed").isNull().alias("unlisted"))


# --- joins -------------------------------------------------------------------------------------------------------------


_OUTCOME = f"{_C}, o as (select e.evidence_id, e.source_type, e.batch_no, case when e.duplicate_of is not null then 'skipped' when x.evidence_id is not null then 'candidate' end as outcome from evidence e left join (select distinct evidence_id from c) x using (evidence_id))"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each post with what became of it: candidate (a signal cites it), skipped (it repeats another), null (nothing yet)."""
    cited = candidates(spark, d).select("evidence_id").distinct().withColumn("cited", F.lit(True))
    return evidence(spark, d).select("evidence_id", "source_type", "batch_no", "duplicate_of").join(cited, "evidence_id", "left").select("evidence_id", "source_type", "batch_no", F.when(F.col("duplicate_of").isNotNull(), "skipped").when(F.col("cited"), "candidate").alias("outcome"))


@query("join4_outcomes", f"with {_OUTCOME} select batch_no, source_type, count(*) as posts, count(outcome) as decided from o group by 1,2")
def join4(spark, d):
    return outcomes(spark, d).groupBy("batch_no", "source_type").agg(F.count(F.lit(1)).alias("posts"), F.count("outcome").alias("decided"))


@query("agg23_outcome_counts", f"with {_OUTCOME} select coalesce(outcome, 'pending') as outcome, count(*) as posts from o group by 1")
def agg23(spark, d):
    return outcomes(spark, d).groupBy(F.coalesce("outcome", F.lit("pending")).alias("outcome")).agg(F.count(F.lit(1)).alias("posts"))


@query("join8_judge_cases", "select s.delivery_id, s.entity.topic_id as topic_id, t.name as reference, s.entity.topic_name as actual, t.topic_id is null as missing from material_signal s left join canonical_topic t on s.entity.topic_id = t.topic_id where s.entity.topic_id is not null")
def join8(spark, d):
    """What signals call their topic beside the registry's name; topics the registry doesn't have are reported."""
    s = signals(spark, d).select("delivery_id", F.col("entity.topic_id").alias("topic_id"), F.col("entity.topic_name").alias("actual")).where("topic_id is not null")
    t = topics(spark, d).select("topic_id", F.col("name").alias("reference"), F.lit(True).alias("there"))
    return s.join(t, "topic_id", "left").select("delivery_id", "topic_id", "reference", "actual", F.col("there").isNull().alias("missing"))


@query("fn18_entity_match", "with x as (select s.delivery_id, s.entity, t.topic_id as tid, t.name from material_signal s left join canonical_topic t on s.topic_id = t.topic_id) select delivery_id, case when tid is null or entity is null or (entity.topic_id is null and entity.topic_name is null and entity.type is null) then tid is null and (entity is null or (entity.topic_id is null and entity.topic_name is null and entity.type is null)) else lower(trim(coalesce(entity.topic_id,'\\0'))) = lower(trim(tid)) and lower(trim(coalesce(entity.topic_name,'\\0'))) = lower(trim(name)) end as matches from x")
def fn18(spark, d):
    """Whether a signal's entity is the registry's topic: null matches null (an entity of nulls is one), else the named keys match
    without regard to case and surrounding space; keys that aren't named are not graded."""
    x = signals(spark, d).select("delivery_id", "topic_id", "entity").join(topics(spark, d).select("topic_id", "name"), "topic_id", "left")
    expected = F.when(F.col("name").isNotNull(), F.create_map(F.lit("topic_id"), F.col("topic_id"), F.lit("topic_name"), F.col("name")))
    actual = F.create_map(F.lit("type"), F.col("entity.type"), F.lit("topic_id"), F.col("entity.topic_id"), F.lit("topic_name"), F.col("entity.topic_name"))
    return x.select("delivery_id", E.entity_matches(expected, actual).alias("matches"))


@query("dml16_replay", "select signal_id, count(*) as deliveries, max(delivery_id) as newest from material_signal where signal_id is not null group by 1 having bool_and(topic_id is null)")
def dml16(spark, d):
    """Signals whose stored deliveries can be applied again: none of them has a topic yet."""
    return signals(spark, d).where("signal_id is not null").groupBy("signal_id").agg(F.count(F.lit(1)).alias("deliveries"), F.max("delivery_id").alias("newest"), F.bool_and(F.col("topic_id").isNull()).alias("open")).where("open").drop("open")


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("agg11_triage_audit", "with a as (select week, materiality_label as outcome from material_signal where confidence_label = 'low') select week, count(*) as audited_skips, count(*) filter (outcome = 'low') as agreed, count(*) filter (outcome in ('high','critical')) as false_skips, count(*) filter (outcome is null or outcome not in ('low','high','critical')) as pending, case when count(*) filter (outcome in ('low','high','critical')) > 0 then round(count(*) filter (outcome in ('high','critical')) / count(*) filter (outcome in ('low','high','critical')), 9) end as false_skip_rate from a group by 1")
def agg11(spark, d):
    """Deliveries a triage would have skipped against what they were judged to be, with a rate that is null where nothing is decided."""
    a = signals(spark, d).where("confidence_label = 'low'").select("week", F.col("materiality_label").alias("outcome"))
    return E.triage_audit(a, ["week"], F.col("outcome") == "low", F.col("outcome").isin("high", "critical"))


@query("agg11_false_skips", "select week, delivery_id from material_signal where confidence_label = 'low' and materiality_label in ('high','critical')")
def agg11_ids(spark, d):
    """The deliveries behind the false skips, one row each (no list that grows with the data)."""
    return signals(spark, d).where("confidence_label = 'low'").where(F.col("materiality_label").isin("high", "critical")).select("week", "delivery_id")


_GRADED = "g as (select batch_no < 13 as before, case when materiality_label is null or isnan(materiality_score) then 'errored' when materiality_label = confidence_label then 'passed' else 'failed' end as status, materiality_label is not distinct from confidence_label as label, topic_id is not null as topic, materiality_score between 0 and 1 as score from material_signal)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries graded as two runs (``before``): status and fields."""
    s = signals(spark, d)
    status = F.when(F.col("materiality_label").isNull() | F.isnan("materiality_score"), "errored").when(F.col("materiality_label") == F.col("confidence_label"), "passed").otherwise("failed")
    field = lambda n, c: F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit(False)).alias("passed"))
    fields = F.array(field("label", F.col("materiality_label").eqNullSafe(F.col("confidence_label"))), field("topic", F.col("topic_id").isNotNull()), field("score", F.col("materiality_score").between(0, 1)))
    return s.select((F.col("batch_no") < 13).alias("before"), status.alias("status"), fields.alias("fields"))


@query("agg13_statuses", f"with {_GRADED} select before, count(*) as total, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'errored') as errored from g group by 1")
def agg13(spark, d):
    return E.status_counts(runs(spark, d), ["before"])


@query("agg20_deltas", f"with {_GRADED}, f as (select before, status, unnest(['pass rate','label','topic','score']) as field, unnest([status = 'passed', label, topic, coalesce(score,false)]) as ok from g), r as (select before, field, sum(cast(ok as int)) / count(*) as share from f where field = 'pass rate' or status <> 'errored' group by 1,2) select field, round(max(share) filter (before), 9) as was, round(max(share) filter (not before), 9) as now, round(max(share) filter (not before) - max(share) filter (before), 9) as delta from r group by 1")
def agg20(spark, d):
    """Pass rate and accuracy of each field in two runs, and what has changed."""
    r = runs(spark, d)
    return E.compare_rates(r.where("before"), r.where("not before"))


@query("agg21_seen", "with s as (select topic_id, min(week) as a, max(week) as b from material_signal where topic_id is not null and week is not null group by 1) select t.topic_id, least(t.first_seen, s.a) as first_seen, greatest(t.last_seen, s.b) as last_seen from canonical_topic t left join s using (topic_id)")
def agg21(spark, d):
    """First and last week of each topic, widened by its signals."""
    s = signals(spark, d).where("topic_id is not null").groupBy("topic_id").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    return topics(spark, d).join(s, "topic_id", "left").select("topic_id", F.least("first_seen", "a").alias("first_seen"), F.greatest("last_seen", "b").alias("last_seen"))


@query("agg25_moved_weeks", "with v as (select signal_id, arg_min(topic_id, delivery_id) as origin, arg_max(topic_id, delivery_id) as target, min(week) as a, max(week) as b from material_signal where signal_id is not null and topic_id is not null group by 1) select origin, target, count(*) as moved, min(a) as first_week, max(b) as last_week from v where origin <> target group by 1,2")
def agg25(spark, d):
    """Signals that moved from one topic to another, with the weeks they span."""
    s = signals(spark, d).where("signal_id is not null and topic_id is not null").groupBy("signal_id").agg(F.min_by("topic_id", "delivery_id").alias("origin"), F.max_by("topic_id", "delivery_id").alias("target"), F.min("week").alias("a"), F.max("week").alias("b"))
    return s.where("origin <> target").groupBy("origin", "target").agg(F.count(F.lit(1)).alias("moved"), F.min("a").alias("first_week"), F.max("b").alias("last_week"))


@query("fn25_posts_by_year", "select substr(captured_at,1,4) as year, count(*) as posts from evidence group by 1")
def fn25(spark, d):
    return evidence(spark, d).groupBy(F.substring("captured_at", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("posts"))


@query("win7_first_proposal", "with p as (select batch_no, delivery_id, coalesce(regexp_replace(regexp_replace(lower(entity.topic_name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),'') as slug from material_signal) select batch_no, delivery_id, slug, min(delivery_id) over (partition by batch_no, slug) as first_delivery from p where slug <> ''")
def win7(spark, d):
    """Within a batch the first proposal of a name makes the topic, later ones of the same slug go to it."""
    p = signals(spark, d).select("batch_no", "delivery_id", X.slug(F.col("entity.topic_name")).alias("slug")).where("slug <> ''")
    first = p.groupBy(F.col("batch_no").alias("batch"), F.col("slug").alias("name")).agg(F.min("delivery_id").alias("first_delivery"))
    return p.join(first, F.col("batch_no").eqNullSafe(F.col("batch")) & (F.col("slug") == F.col("name"))).select("batch_no", "delivery_id", "slug", "first_delivery")


@query("dml3_outcome_upsert", "select signal_id, case when bool_or(confidence_label = 'high') then 'candidate' when arg_max(confidence_label, delivery_id) = 'low' then 'skipped' else 'open' end as status, max(delivery_id) as updated from material_signal where signal_id is not null group by 1")
def dml3(spark, d):
    """The outcome of each signal as an upsert leaves it: a candidate stays one, else the latest delivery decides."""
    s = signals(spark, d).where("signal_id is not null").groupBy("signal_id").agg(F.bool_or(F.col("confidence_label") == "high").alias("won"), F.max_by("confidence_label", F.when(F.col("confidence_label").isNotNull(), F.col("delivery_id"))).alias("latest"), F.max("delivery_id").alias("updated"))
    return s.select("signal_id", F.when(F.col("won"), "candidate").when(F.col("latest") == "low", "skipped").otherwise("open").alias("status"), "updated")


@query("dml8_slug_audit", "with s as (select topic_id, coalesce(regexp_replace(regexp_replace(lower(name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),'') as slug from canonical_topic) select slug, count(*) as topics, min(topic_id) as first_topic from s group by 1 having count(*) > 1")
def dml8(spark, d):
    """Names that would claim the same slug: violations of its uniqueness."""
    s = topics(spark, d).select("topic_id", X.slug(F.col("name")).alias("slug"))
    return s.groupBy("slug").agg(F.count(F.lit(1)).alias("topics"), F.min("topic_id").alias("first_topic")).where("topics > 1")


@query("dat20_stability", "with f as (select signal_id, delivery_id, signal_type, first_value(signal_type) over (partition by signal_id order by delivery_id) as original from material_signal where signal_id is not null) select signal_id, count(*) as deliveries, count(*) filter (signal_type is not distinct from original) as stable from f group by 1 having count(*) > 1")
def dat20(spark, d):
    """How many deliveries of a signal keep the type of its first one."""
    s = signals(spark, d).where("signal_id is not null").select("signal_id", "delivery_id", "signal_type")
    first = s.groupBy("signal_id").agg(F.min(F.struct("delivery_id", "signal_type")).alias("first"), F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")
    kinds = s.groupBy("signal_id", "signal_type").agg(F.count(F.lit(1)).alias("n"))  # the few types of a signal
    return kinds.join(first, "signal_id").groupBy("signal_id", "deliveries").agg(F.sum(F.when(F.col("signal_type").eqNullSafe(F.col("first.signal_type")), F.col("n")).otherwise(0)).alias("stable"))


# --- JSON and text -----------------------------------------------------------------------------------------------------


@query("prs2_metadata", "with k as (select evidence_id, metadata, case when metadata is null then 'no text' when not json_valid(metadata) then 'no JSON' when json_type(metadata) <> 'OBJECT' then 'no object' when not list_contains(json_keys(metadata), 'score') then 'missing score' when json_type(metadata, '$.score') not in ('BIGINT','UBIGINT','DOUBLE') then 'bad score' else 'ok' end as status from evidence) select evidence_id, status, case when status = 'ok' then cast(json_extract(metadata, '$.score') as double) end as score from k")
def prs2(spark, d):
    """Typed validation of the posts' metadata: what is wrong first, and the score of good ones."""
    m = F.col("metadata")
    missing = ~F.coalesce(F.array_contains(F.json_object_keys(m), "score"), F.lit(False))
    status = F.when(m.isNull(), "no text").when(F.try_parse_json(m).isNull(), "no JSON").when(P.kind_of(m) != "object", "no object").when(missing, "missing score").when(P.number(m, "$.score").isNull(), "bad score").otherwise("ok")
    return evidence(spark, d).select("evidence_id", status.alias("status"), F.when(status == "ok", P.number(m, "$.score")).alias("score"))


@query("fn13_json_fingerprint", """select topic_id, substr(sha256('[' || to_json(topic_id) || ', ' || coalesce(to_json(name),'null') || ', ' || coalesce(to_json(description),'null') || ', [' || array_to_string(list_transform(aliases, lambda x: cast(to_json(x) as varchar)), ', ') || ']]'), 1, 12) as print from canonical_topic""")
def fn13_json(spark, d):
    """The fingerprint of each topic's definition as canonical JSON."""
    return topics(spark, d).select("topic_id", X.json_fingerprint(F.struct("topic_id", "name", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")), as_list=True).alias("print"))


@query("fn4_similarity")
def fn4(spark, d):
    """How alike the text of a post and that of the one it is said to repeat are (ratio of matching characters)."""
    e = evidence(spark, d).select("evidence_id", "duplicate_of", X.normalise(F.col("title"), F.col("content")).alias("text"))
    later = e.where("duplicate_of is not null").select("evidence_id", "duplicate_of", F.col("text").alias("b"))
    return later.join(e.select(F.col("evidence_id").alias("duplicate_of"), F.col("text").alias("a")), "duplicate_of").select("evidence_id", "duplicate_of", F.round(C.text_ratio("a", "b"), 9).alias("ratio"))


def cited_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """Posts that signals of a topic cite, by topic and week of capture (``grp``)."""
    e = evidence(spark, d).select("evidence_id", "title", "content", F.to_timestamp("published_at").alias("at"), X.iso_week(X.date_prefix(F.col("captured_at"))).alias("week"))
    cited = candidates(spark, d).where("topic_id is not null").select("topic_id", "evidence_id").distinct()
    return cited.join(e, "evidence_id").withColumn("grp", F.concat("topic_id", F.lit(" "), "week"))


@query("agg9_clusters")
def agg9(spark, d):
    """Near-duplicate posts within a topic and week: each post with its cluster."""
    return C.clusters(cited_by_topic(spark, d), "grp", "evidence_id", "title", "content")


@query("agg10_coordination")
def agg10(spark, d):
    """Raw and distinct posts, bursts and reasons of each topic and week."""
    return C.assess(cited_by_topic(spark, d), "grp", "evidence_id", "title", "content", "at")
