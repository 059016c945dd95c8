"""Typed validation of JSON replies as columns: each check gives a struct with ``status`` and the fields of a good reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import strict_date

#: The kinds of a signal and the routes of a triage.
SIGNAL_TYPES = (
    "complaint_rising", "complaint_falling", "new_feature_demand", "new_use_case", "usability_issue", "reliability_issue", "pricing_complaint", "switching_intent",
    "competitor_mention_rising", "customer_migration_intent", "churn_related_issue", "positive_adoption_pattern",
)
ROUTES = ("skip", "extract")


def kind_of(reply: Column, path: str = "$") -> Column:
    """The JSON kind at ``path``: object, array, string, number, boolean, null; null where there is nothing or no JSON."""
    there = F.try_variant_get(F.try_parse_json(reply), path, "variant")
    kind = F.lower(F.regexp_extract(F.schema_of_variant(there), r"^([A-Z]+)", 1))
    return F.when(kind == "void", "null").when(kind.isin("bigint", "double", "decimal", "float"), "number").otherwise(kind)


def number(reply: Column, path: str) -> Column:
    """The number at ``path``, null for anything else, strings of digits and booleans included."""
    return F.when(kind_of(reply, path) == "number", F.try_variant_get(F.try_parse_json(reply), path, "double"))


def string(reply: Column, path: str) -> Column:
    return F.when(kind_of(reply, path) == "string", F.try_variant_get(F.try_parse_json(reply), path, "string"))


def share(reply: Column, path: str) -> Column:
    """A finite number from 0 to 1."""
    n = number(reply, path)
    return F.when(~F.isnan(n) & n.between(0, 1), n)


def _broken(reply: Column) -> Column:
    return F.when(reply.isNull(), "no text").when(F.try_parse_json(reply).isNull(), "no JSON").when(kind_of(reply) != "object", "no object")


def extraction(reply: Column, kinds: tuple[str, ...] = SIGNAL_TYPES) -> Column:
    """status (ok, skip, or what is wrong first), signal_type, summary, confidence, entity (JSON of an object, else null) and
    effective_date (null unless it is a real yyyy-mm-dd). Only a literal true skips."""
    missing = F.array_except(F.array(*map(F.lit, ("confidence", "signal_type", "summary"))), F.coalesce(F.json_object_keys(reply), F.array().cast("array<string>")))
    kind, text, confidence = string(reply, "$.signal_type"), string(reply, "$.summary"), share(reply, "$.confidence")
    skip = (kind_of(reply, "$.skip") == "boolean") & F.try_variant_get(F.try_parse_json(reply), "$.skip", "boolean")
    wrong = (
        F.when(F.coalesce(skip, F.lit(False)), "skip").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "bad signal_type").when(F.coalesce(F.trim(text), F.lit("")) == "", "bad summary").when(confidence.isNull(), "bad confidence")
    )
    status = F.coalesce(_broken(reply), wrong, F.lit("ok"))
    good = lambda c: F.when(status == "ok", c)
    entity = F.when(kind_of(reply, "$.entity") == "object", F.get_json_object(reply, "$.entity"))
    return F.struct(status.alias("status"), good(kind).alias("signal_type"), good(text).alias("summary"), good(confidence).alias("confidence"), good(entity).alias("entity"), good(strict_date(string(reply, "$.effective_date"))).alias("effective_date"))


def triage(reply: Column) -> Column:
    """status, route, confidence, reason ('' where it is no string)."""
    route, confidence = string(reply, "$.route"), share(reply, "$.confidence")
    wrong = F.when(~F.coalesce(route.isin(*ROUTES), F.lit(False)), "bad route").when(confidence.isNull(), "bad confidence")
    status = F.coalesce(_broken(reply), wrong, F.lit("ok"))
    good = lambda c: F.when(status == "ok", c)
    return F.struct(status.alias("status"), good(route).alias("route"), good(confidence).alias("confidence"), good(F.coalesce(F.trim(string(reply, "$.reason")), F.lit(""))).alias("reason"))


def paraphrases(reply: Column, most: int) -> Column:
    """The first ``most`` usable items (title not blank, content a string) of a JSON array; empty for anything else."""
    items = F.try_variant_get(F.try_parse_json(reply), "$", "array<variant>")
    typed = lambda v, k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.trim(F.try_variant_get(v, f"$.{k}", "string")))
    read = F.transform(items, lambda v: F.struct(typed(v, "title").alias("title"), typed(v, "content").alias("content")))
    return F.coalesce(F.slice(F.filter(read, lambda x: (F.coalesce(x["title"], F.lit("")) != "") & x["content"].isNotNull()), 1, most), F.array().cast("array<struct<title:string,content:string>>"))
