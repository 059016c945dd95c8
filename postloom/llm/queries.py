"""Queries of the training-text problems, and SQL where SQL can state them at this size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import history, neardup, pii, toxicity
from postloom.llm.leakage import MIN_WORDS, leaked_passages
from postloom.llm.sentences import split_sentences
from postloom.llm.tokenize import encode
from postloom.sources.tables import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(read(spark, d, "evidence"), "evidence_id", "title", "content").select("evidence_id", "field_name", "kind", "start_pos")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(read(spark, d, "evidence"), "evidence_id", "title", "content")


#: Batches are handed over in deliveries that end before these numbers: a history of 23 weekly batches, then each batch as it comes.
DELIVERIES = (23, 24, 25)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.replay(spark, read(spark, d, "evidence"), DELIVERIES).select("kept_id", F.col("row_id").alias("evidence_id"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    evidence = read(spark, d, "evidence")
    model = toxicity.fit(evidence, "content", read(spark, d, "moderation_sample"))
    return toxicity.score(evidence, model, "evidence_id", "content", "source_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("categories is not null").select("evidence_id", F.explode("categories").alias("category"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("evidence_id", "source_name", *toxicity.CATEGORIES, "categories", "passages")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_scored(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(read(spark, d, "evidence"), "evidence_id", "title", "content")
    return pairs.select(F.col("a").alias("evidence_id_a"), F.col("b").alias("evidence_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(read(spark, d, "evidence"), "evidence_id", "title", "content")
    return groups.withColumnRenamed("row_id", "evidence_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(read(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(read(spark, d, "documents"), read(spark, d, "golden_example"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).where(F.col("exact_words") >= MIN_WORDS).select("doc_id", "example_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How often each held-out item leaked."""
    return p8_found(spark, d).groupBy("example_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(read(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_masked": p1_masked, "p7_ids": p7_ids, "p8_found": p8_found, "p8_passages": p8_passages, "p8_items": p8_items, "p3_found": p3_found, "p9_found": p9_found, "p4_found": p4_found, "p4_scores": p4_scores, "p4_rates": p4_rates, "p5_found": p5_found, "p5_groups": p5_groups}

# words of title and content, their distinct three-word runs, and the pairs that share a run among the rarest of one of them: of n
# runs the n - ceil(n/2) + 1 rarest hold a common one with every text that shares half
_RUNS = """w as (select evidence_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(title,'') || ' ' || coalesce(content,'')), 'https?://[^\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}]*', ' ', 'g'), '[^\\pL\\pN_]+'), lambda x: x <> '') as words from evidence where evidence_id is not null),
t as (select words, min(evidence_id) as head, list(evidence_id) as ids from w where len(words) >= 20 group by 1),
s as (select head, ids, list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2])) as runs from t),
e as (select head, unnest(runs) as run, len(runs) as n from s),
f as (select run, count(*) as texts from e group by 1),
k as (select head, run, n, row_number() over (partition by head order by texts, run) as place from e join f using (run)),
x as (select head, run from k where place <= n - ceil(n / 2.0) + 1),
c as (select distinct a.head as a, b.head as b from x a join x b on a.run = b.run and a.head < b.head),
l as (select c.a, c.b from c join s p on c.a = p.head join s q on c.b = q.head where 2 * len(list_intersect(p.runs, q.runs)) >= len(p.runs) + len(q.runs) - len(list_intersect(p.runs, q.runs)))"""
_WORDS12 = "list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN_]+'), lambda x: x <> '')"
_LEAKS = f"""d as (select doc_id, {_WORDS12.format(c='text')} as words from documents where text is not null),
g as (select example_id, {_WORDS12.format(c='content')} as words from golden_example where content is not null),
dr as (select doc_id, unnest(list_transform(range(1, len(words) - 10), lambda i: array_to_string(words[i:i+11], ' '))) as run from d where len(words) >= 12),
gr as (select example_id, unnest(list_transform(range(1, len(words) - 10), lambda i: array_to_string(words[i:i+11], ' '))) as run from g where len(words) >= 12),
leaks as (select distinct doc_id, example_id from dr join gr using (run))"""

SQL: dict[str, str] = {
    "p5_found": f"""with {_RUNS}, m as (select head, unnest(ids) as id from t), r as (
select least(x.id, y.id) as evidence_id_a, greatest(x.id, y.id) as evidence_id_b from l join m x on l.a = x.head join m y on l.b = y.head
union all select x.id, y.id from m x join m y on x.head = y.head and x.id < y.id)
select * from r""",
    "p5_groups": f"""with recursive {_RUNS}, edges as (select a, b from l union select b, a from l),
reach as (select head as node, head as other from t union select r.node, e.b from reach r join edges e on r.other = e.a),
comp as (select node, min(other) as root from reach group by 1),
deg as (select a as head, count(*) as links from edges group by 1),
m as (select head, len(ids) as copies, unnest(ids) as id from t)
select w.evidence_id, coalesce(comp.root, w.evidence_id) as group_id, coalesce(m.copies, 1) as copies, coalesce(deg.links, 0) as links
from w left join m on w.evidence_id = m.id left join comp on m.head = comp.node left join deg on m.head = deg.head""",
    "p8_found": f"with {_LEAKS} select doc_id, example_id from leaks",
    "p8_items": f"with {_LEAKS} select example_id, count(*) as documents from leaks group by 1",
}
