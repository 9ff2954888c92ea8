"""Record validation: rules in, one row per broken rule out.

A rule is a predicate that is true for a bad row. All rules of a table are
tested in one pass over it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the record contract.
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
SHA256 = r"^[a-f0-9]{64}$"
SERVICE_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*#(?:external|internal|unknown)-\d+$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+\S*$"
LEVELS = ["V3", "V2", "V1", "V0"]
REVIEW_ROLES = [
    "project-lead",
    "transcriber",
    "verifier",
    "office-liaison",
    "field-checker",
    "translator",
    "content-reviewer",
    "platform-maintainer",
    "maintenance-owner",
]
NOT_STATED = ["whereToGo", "officeHours", "output", "eligibility", "fees", "processingTime", "requirements"]
PERSONAL_TITLE = r"(?i)^\s*(hon\.?|mr\.?|ms\.?|mrs\.?|atty\.?|engr\.?|dr\.?)\s"
HELD_DOCUMENT = r"(?i)\bSALN\b|statements?\s+of\s+assets"


@dataclass(frozen=True)
class Rule:
    name: str
    path: str
    broken: Column
    message: str


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """key, rule, path, message - one row per broken rule. An unknown (null)
    verdict counts as not broken."""
    found = F.filter(
        F.array(
            *[
                F.when(
                    r.broken,
                    F.struct(
                        F.lit(r.name).alias("rule"),
                        F.lit(r.path).alias("path"),
                        F.lit(r.message).alias("message"),
                    ),
                )
                for r in rules
            ]
        ),
        lambda v: v.isNotNull(),
    )
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.rule", "v.path", "v.message")


def strict(found: DataFrame) -> None:
    """Raise if any violation exists, with their number and the first five."""
    sample = found.limit(5).collect()
    if sample:
        raise ValueError(f"{found.count()} violations: " + "; ".join(str(r.asDict()) for r in sample))


def uncited_absences(absent: DataFrame, attempts: DataFrame, keys: Sequence[str], cited: Column) -> DataFrame:
    """keys of rows said to be absent for which no attempt looked in the `cited`
    place; a row without any attempt is one of them."""
    looked = attempts.groupBy(*keys).agg(F.max(cited).alias("_cited"))
    return absent.join(looked, list(keys), "left").where(~F.coalesce("_cited", F.lit(False))).select(*keys)


def overclaimed_levels(claims: DataFrame, sources: DataFrame, keys: Sequence[str], retrievable: Column) -> DataFrame:
    """keys of rows that claim a level their sources, none of them retrievable, do not bear out;
    a claim without any source is one of them."""
    borne = sources.groupBy(*keys).agg(F.max(retrievable).alias("_any"))
    return claims.join(borne, list(keys), "left").where(~F.coalesce("_any", F.lit(False))).select(*keys)


def blank(c) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def page_entry_rules(classes: Column) -> list[Rule]:
    """Rules of one page entry; `classes` is true where the data class is known."""
    from civicloom.functions.dates import strict_date

    return [
        Rule("slug-shape", "slug", ~F.col("slug").rlike(SLUG), "must be lowercase kebab-case"),
        Rule("name-missing", "name", blank("name"), "must not be empty"),
        Rule("description-missing", "description", blank("description"), "must not be empty"),
        Rule(
            "checked-not-a-date",
            "lastCheckedAt",
            strict_date(F.col("last_checked_at")).isNull(),
            "not an ISO calendar date",
        ),
        Rule("level-unknown", "verification", ~F.col("verification").isin(LEVELS), "unknown level"),
        Rule(
            "review-role-unknown",
            "lastReview.role",
            F.col("review_role").isNotNull() & ~F.col("review_role").isin(REVIEW_ROLES),
            "unknown review role",
        ),
        Rule("url-shape", "source.url", F.col("url").isNotNull() & ~F.col("url").rlike(URL), "not an address"),
        Rule("class-unknown", "dataClass", ~classes, "a class with no cadence never goes stale"),
    ]


def register_rules() -> list[Rule]:
    """Rules of one disclosure-register row."""
    s = F.col("status")
    half = F.col("requested_of").isNull() & F.col("requested_at").isNull()
    return [
        Rule("linked-needs-url", "source.url", (s == "linked") & F.col("url").isNull(), "no address to follow"),
        Rule("absence-needs-attempt", "lookedFor", (s == "not-located") & (F.col("attempts") == 0), "nobody looked"),
        Rule(
            "request-needs-details",
            "requestedOf",
            (s == "requested") & (F.col("requested_of").isNull() | F.col("requested_at").isNull()),
            "of which office, and when",
        ),
        Rule("details-need-request", "requestedAt", (s != "requested") & ~half, "an ask that never happened"),
        Rule(
            "person-as-office",
            "requestedOf",
            F.coalesce(F.col("requested_of"), F.lit("")).rlike(PERSONAL_TITLE),
            "names an office, never a person",
        ),
        Rule("fiscal-year-shape", "fiscalYear", ~F.col("fiscal_year").rlike(r"^\d{4}$"), "a four-digit year, or null"),
    ]
