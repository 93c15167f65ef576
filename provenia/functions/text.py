"""Text expressions: tokens, normal forms, redaction, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Redaction patterns in order; earlier replacements change later matches. Fixed values.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"system\s*:\s*",
    r"you\s+are\s+now\s+",
    r"forget\s+(all\s+)?(your\s+)?instructions?",
    r"pretend\s+you\s+are",
    r"override\s+(safety|security)",
    r"disregard\s+(all\s+)?(previous|above)",
    r"new\s+instructions?\s*:",
    r"</?system>",
    r"INJECT\s*:",
]
#: Roles of a source in a paper. Fixed values.
ROLES = ("primary", "secondary", "unknown")
FILTERED = "[FILTERED]"
MAX_TEXT = 10_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def title_key(title: Column) -> Column:
    """Normal form by which titles match."""
    return F.array_join(tokens(title), " ")


def doi_key(doi: Column) -> Column:
    """Normal form by which DOIs match."""
    bare = F.regexp_replace(F.trim(doi), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", "")))


def is_slug(value: Column) -> Column:
    """Names of papers, audits and sessions: lower-case letters, digits, - and _, 64 at most, no sign first."""
    return F.coalesce(value.rlike(r"^[a-z0-9][a-z0-9_-]{0,63}\z"), F.lit(False))


def is_workflow_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^[a-f0-9-]{8,36}\z"), F.lit(False))


def is_role(value: Column) -> Column:
    return F.coalesce(value.isin(*ROLES), F.lit(False))


def first_field(*fields: Column) -> Column:
    """The first of the fields that is not blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(f), F.lit("")) for f in fields))


def redact(rows: DataFrame, column: str) -> DataFrame:
    """rows with every injection pattern replaced in a text column, cut to MAX_TEXT, and modifications, the number of changes.

    A change is a pattern that matched, or the cut; lengths count code points. One projection for each pattern, since
    each text is used twice: as it is, and to see whether the next pattern changes it. (Within one expression the text
    would be written out, and matched, twice as often for each pattern.)
    """
    names = [c for c in rows.columns if c not in (column, "modifications")]
    any_of = "(?i)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS)
    now = rows.select(*names, F.col(column).alias("__text"), F.lit(0).alias("__n"), F.coalesce(F.col(column).rlike(any_of), F.lit(False)).alias("__hit"))
    for p in INJECTION_PATTERNS:
        new = now.select("*", F.when(F.col("__hit"), F.regexp_replace("__text", f"(?i){p}", FILTERED)).otherwise(F.col("__text")).alias("__new"))
        now = new.select(*names, F.col("__new").alias("__text"), (F.col("__n") + (F.col("__hit") & ~F.col("__new").eqNullSafe(F.col("__text"))).cast("int")).alias("__n"), "__hit")
    long = F.coalesce(F.length("__text") > MAX_TEXT, F.lit(False))
    return now.select(*names, F.substring("__text", 1, MAX_TEXT).alias(column), (F.col("__n") + long.cast("int")).alias("modifications"))


def citation(style: str, author: Column, year: Column, title: Column, container: Column) -> Column:
    """A bibliography line; unknown styles are apa.

    author: array<struct<family, given>>; a year that is null or 0 is n.d.; a missing title is Untitled. An empty author
    list or container leaves the separators around it.
    """
    who = F.array_join(F.transform(author, lambda a: F.concat_ws(", ", a["family"], a["given"])), ", ")
    when = F.when(F.coalesce(year, F.lit(0)) == 0, "n.d.").otherwise(year.cast("string"))
    what = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    where = F.coalesce(container, F.lit(""))
    if style == "chicago-author-date":
        return F.concat(who, F.lit(". "), when, F.lit('. "'), what, F.lit('." '), where)
    if style == "ieee":
        return F.concat(who, F.lit(', "'), what, F.lit('," '), where, F.lit(", "), when, F.lit("."))
    if style == "mla":
        return F.concat(who, F.lit('. "'), what, F.lit('." '), where, F.lit(", "), when, F.lit("."))
    return F.regexp_replace(F.concat(who, F.lit(" ("), when, F.lit("). "), what, F.lit(". "), where), r"\. $", ".")


def in_text(style: str, key: Column, author: Column, year: Column) -> Column:
    """The citation inside running text."""
    when = F.when(F.coalesce(year, F.lit(0)) == 0, "n.d.").otherwise(year.cast("string"))
    family = F.coalesce(F.nullif(F.get(author, F.lit(0))["family"], F.lit("")), F.lit("Unknown"))
    if style == "ieee":
        return F.concat(F.lit("["), key, F.lit("]"))
    if style in ("chicago-author-date", "mla"):
        return F.concat(F.lit("("), family, F.lit(" "), when, F.lit(")"))
    return F.concat(F.lit("("), family, F.lit(", "), when, F.lit(")"))
