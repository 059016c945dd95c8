"""Text functions as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tag names that frame untrusted text.
TAGS = ("post_title", "post_body", "topics", "candidates", "evidence")


#: Word characters (letters, digits, underscore) and white space of any kind.
WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def normalise(title: Column, content: Column) -> Column:
    """Lower case, links and runs of non-word characters as one space, trimmed."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"https?://(?!{SPACE})(?:(?!{SPACE})[\s\S])+", " "), rf"[^{WORD}]+", " "))


def slug(col: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends; '' for null."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def scrub(col: Column) -> Column:
    """Account mentions as u/[user], e-mail addresses (of any script) as [email]."""
    users = F.regexp_replace(col, rf"(?<![{WORD}/])/?u/[A-Za-z0-9_-]+", "u/[user]")
    return F.regexp_replace(users, rf"[{WORD}.+-]+@[{WORD}-]+(?:\.[{WORD}-]+)+", "[email]")


def summary(col: Column, most: int = 300) -> Column:
    """Scrubbed, white space collapsed; longer texts cut and ended with an ellipsis."""
    text = F.trim(F.regexp_replace(scrub(col), f"{SPACE}+", " "))
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def detail(title: Column, content: Column, most: int = 2000) -> Column:
    """Title and content, scrubbed, without surrounding white space, cut."""
    text = scrub(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit(""))))
    return F.substring(F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", ""), 1, most)


def tags(slug: Column, kind: Column) -> Column:
    """slug;kind"""
    return F.concat(slug, F.lit(";"), kind)


def add_summary(col: Column) -> Column:
    """written (0 for none), skipped and invalid of a line "written: a, b; skipped duplicates: 1; invalid: 0"; null if it isn't one."""
    pattern = r"written: (.*); skipped duplicates: (\d+); invalid: (\d+)"
    part = lambda k: F.regexp_extract(col, pattern, k)
    names = F.trim(part(1))
    written = F.when(names == "none", 0).otherwise(F.size(F.split(names, ",")))
    return F.when(col.rlike(pattern), F.struct(written.alias("written"), part(2).cast("int").alias("skipped"), part(3).cast("int").alias("invalid")))


def escape_tags(col: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """Only the named tags lose their brackets; inner spaces go, other markup stays."""
    return F.regexp_replace(col, r"(?i)<\s*(/?)\s*(" + "|".join(tags) + r")\s*>", "&lt;$1$2&gt;")


def absolute_url(col: Column, host: str) -> Column:
    return F.when(F.startswith(col, F.lit("/")), F.concat(F.lit(host), col)).otherwise(col)


def fingerprint(col: Column) -> Column:
    """The first 12 hex digits of the SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 12)


def json_fingerprint(col: Column, as_list: bool = False) -> Column:
    """The fingerprint of a struct as canonical JSON: keys sorted, ", " and ": " between, ASCII only; ``as_list``: its values."""

    @F.pandas_udf("string")
    def text(rows: pd.DataFrame) -> pd.Series:
        plain = lambda v: None if v is None or v is pd.NA else v.tolist() if hasattr(v, "tolist") else v
        dicts = ({k: plain(v) for k, v in zip(rows.columns, row)} for row in rows.itertuples(index=False, name=None))
        return pd.Series([json.dumps([*x.values()] if as_list else x, sort_keys=True, default=str) for x in dicts], dtype=object)

    return fingerprint(text(col))


def sample_share(col: Column) -> Column:
    """A number from 0 to 1 that depends on the text only."""
    return F.conv(F.substring(F.sha2(col, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def strict_date(col: Column) -> Column:
    """A date written yyyy-mm-dd that exists, else null."""
    return F.when(col.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(col, "yyyy-MM-dd"))


def unfence(col: Column) -> Column:
    """The inside of a reply that is one code fence, else the reply, trimmed."""
    bare = F.trim(F.regexp_replace(col, r"\A\s+|\s+\z", ""))
    inner = F.regexp_extract(bare, r"(?s)\A```(?:json)?\s*(.*?)\s*```\z", 1)
    return F.when(bare.rlike(r"(?s)\A```.*```\z"), inner).otherwise(bare)


def iso_week(date: Column) -> Column:
    """YYYY-Www of a date, by the ISO year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def date_prefix(stamp: Column) -> Column:
    """The date of an instant in its own offset: its first ten characters."""
    return F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")


def valid_share(col: Column) -> Column:
    """Whether a number lies from 0 to 1 (null and NaN don't)."""
    return F.coalesce(~F.isnan(col) & col.between(0, 1), F.lit(False))


def label_of(col: Column, high: float = 0.85, medium: float = 0.6) -> Column:
    """high, medium or low; null and NaN have none."""
    return F.when(valid_share(col), F.when(F.round(col, 12) >= high, "high").when(F.round(col, 12) >= medium, "medium").otherwise("low"))


def sequence_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
