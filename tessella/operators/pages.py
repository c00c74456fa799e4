"""Tiered page extraction: the cheapest tier that will do, by page signals, policy and budget.

Tiers are "native" (text layer), "ocr" and "vlm", of order 0, 1, 2. Pages are rows; branches by
tier are filters, so that a costly function sees only the pages that need it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.vector import derived_confidence

TIERS = ("native", "ocr", "vlm")
#: Share of a full page's text below which a text layer is too sparse.
SPARSE_BELOW = 0.05


def order(tier: Column) -> Column:
    return F.when(tier == "vlm", 2).when(tier == "ocr", 1).otherwise(0)


def tier_name(k: Column) -> Column:
    return F.when(k >= 2, "vlm").when(k == 1, "ocr").otherwise("native")


@dataclass(frozen=True)
class Policy:
    """level: "fixed" (tier), "ceiling" (at most highest) or "auto" (lowest to highest)."""

    level: str = "auto"
    lowest: str = "native"
    highest: str = "vlm"
    structure: bool = False
    max_vlm_pages: int | None = None

    def bounds(self) -> tuple[int, int]:
        low, high = TIERS.index(self.lowest), TIERS.index(self.highest)
        return (high, high) if self.level == "fixed" else (0 if self.level == "ceiling" else low, high)

    def allows(self, tier: Column) -> Column:
        low, high = self.bounds()
        return (order(tier) >= low) & (order(tier) <= high)

    def narrowed(self, available: str) -> "Policy":
        """This policy under the highest tier that there is; a fixed tier above it is an error."""
        top = TIERS.index(available)
        if self.level == "fixed" and TIERS.index(self.highest) > top:
            raise ValueError(f"tier {self.highest} is not available")
        cap = lambda t: TIERS[min(TIERS.index(t), top)]
        return Policy(self.level, cap(self.lowest), cap(self.highest), self.structure, self.max_vlm_pages)


def page_signals(pages: DataFrame, text: str = "native_text") -> DataFrame:
    """pages with has_text, coverage, garbled and ocr_reason (null if the text layer will do)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = pages.withColumn("has_text", F.length(T.visible(t)) > 0).withColumn("coverage", T.text_coverage(t)).withColumn("garbled", T.is_garbled(t))
    reason = F.when(~F.col("has_text"), "no_text_layer").when(F.col("garbled"), "garbled_text").when(F.col("coverage") < SPARSE_BELOW, "low_coverage")
    return out.withColumn("ocr_reason", reason)


def page_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    return pages.where(F.col("page").between(start, end))


def plan_tier(pages: DataFrame, policy: Policy) -> DataFrame:
    """pages (with signals and looks_structured) with target and the climbs (from, to, reason) to it."""
    low, high = policy.bounds()
    none = F.array().cast("array<struct<from:string,to:string,reason:string>>")
    if policy.level == "fixed":
        return pages.withColumn("target", F.lit(policy.highest)).withColumn("climbs", none)
    step = lambda a, b, r: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), r.alias("reason"))
    ocr, wants = F.col("ocr_reason").isNotNull(), F.col("looks_structured") & F.lit(policy.structure)
    first = F.when(ocr, step("native", "ocr", F.col("ocr_reason"))).when(wants, step("native", "ocr", F.lit("structure_requested")))
    second = F.when(wants, step("ocr", "vlm", F.lit("structure_requested")))
    target = F.least(F.greatest(F.when(wants, 2).when(ocr, 1).otherwise(0), F.lit(low)), F.lit(high))
    climbs = F.filter(F.array(first, second), lambda c: c.isNotNull() & (order(c["to"]) <= target))
    return pages.withColumn("target", tier_name(target)).withColumn("climbs", climbs)


def escalate(pages: DataFrame, policy: Policy) -> DataFrame:
    """pages (tier, empty, flat) with the next tier and its reason, null where the output will do."""
    if policy.level == "fixed":
        return pages.withColumn("next_tier", F.lit(None).cast("string")).withColumn("next_reason", F.lit(None).cast("string"))
    empty, flat = F.col("empty"), F.col("flat") & F.lit(policy.structure)
    to = F.when((F.col("tier") == "native") & empty, "ocr").when((F.col("tier") == "ocr") & (empty | flat), "vlm")
    reason = F.when(empty, "empty_output").otherwise("flat_where_structure_expected")
    allowed = policy.allows(to) & to.isNotNull()
    return pages.withColumn("next_tier", F.when(allowed, to)).withColumn("next_reason", F.when(allowed, reason))


def vlm_budget(pages: DataFrame, budget: int | None, doc: str = "doc", page: str = "page") -> DataFrame:
    """pages (wants_vlm) with granted: the first budget pages of a document that want the costly tier get it.

    Only wanting pages are ranked. A document with a third of all pages is one sort that spills.
    """
    if budget is None:
        return pages.withColumn("granted", F.col("wants_vlm"))
    rank = F.row_number().over(Window.partitionBy(doc, "wants_vlm").orderBy(page))
    return pages.withColumn("granted", F.col("wants_vlm") & (rank <= budget))


def extract_pages(pages: DataFrame, policy: Policy, ocr=None, vlm=None, doc: str = "doc", page: str = "page") -> DataFrame:
    """(doc, page, tier, text, climbs, divergence, confidence) of every page.

    ocr and vlm map a DataFrame to itself with a column out_text; they are given only the pages
    of their tier, and a tier without a function is not available. One escalation step a page. A
    page that the budget keeps from the vlm goes to ocr where the policy allows that, else to its
    native text, and has a climb that says so; only then does ocr see it.
    """
    if vlm and not ocr:
        raise ValueError("the vlm tier needs the ocr tier below it")
    available = "vlm" if vlm else "ocr" if ocr else "native"
    policy = policy.narrowed(available)
    planned = plan_tier(page_signals(pages).withColumn("looks_structured", F.lit(policy.structure)), policy)
    blank = lambda c: F.length(T.visible(F.coalesce(F.col(c), F.lit("")))) == 0
    native = planned.where("target = 'native'").withColumn("out_text", F.col("native_text"))
    parts = [native.withColumn("tier", F.lit("native"))]
    if ocr:
        parts.append(ocr(planned.where("target = 'ocr'")).withColumn("tier", F.lit("ocr")))
    if vlm:
        parts.append(planned.where("target = 'vlm'").withColumn("out_text", F.lit(None).cast("string")).withColumn("tier", F.lit("vlm")))
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    seen = seen.withColumn("empty", blank("out_text")).withColumn("flat", ~F.coalesce(F.col("out_text"), F.lit("")).contains("\n\n"))
    seen = escalate(seen, policy)
    seen = seen.withColumn("wants_vlm", (F.col("tier") == "vlm") | (F.coalesce(F.col("next_tier"), F.lit("")) == "vlm"))
    seen = vlm_budget(seen, policy.max_vlm_pages if vlm else 0, doc, page)
    to_ocr = (F.col("tier") == "native") & (F.coalesce(F.col("next_tier"), F.lit("")) == "ocr")
    out = seen.where(~F.col("granted") & ~to_ocr & (F.col("tier") != "vlm")).withColumn("final_text", F.col("out_text"))
    if ocr:
        out = out.unionByName(ocr(seen.where(to_ocr).drop("out_text")).withColumn("tier", F.lit("ocr")).withColumn("final_text", F.col("out_text")))
    if vlm:
        low, high = policy.bounds()
        capped = "ocr" if low <= TIERS.index("ocr") <= high else "native"
        fall = F.struct(F.lit("vlm").alias("from"), F.lit(capped).alias("to"), F.lit("budget_exhausted").alias("reason"))
        over = seen.where(~F.col("granted") & (F.col("tier") == "vlm")).withColumn("climbs", F.array_append("climbs", fall)).drop("out_text")
        over = ocr(over) if capped == "ocr" else over.withColumn("out_text", F.col("native_text"))
        out = out.unionByName(over.withColumn("tier", F.lit(capped)).withColumn("final_text", F.col("out_text")))
        known = seen.where("granted").withColumnRenamed("out_text", "known")
        run = vlm(known).withColumn("tier", F.lit("vlm")).withColumn("final_text", F.col("out_text"))
        out = out.unionByName(run.drop("known").withColumn("out_text", F.col("final_text")))
    text, native_text = F.coalesce(F.col("final_text"), F.lit("")), F.coalesce(F.col("native_text"), F.lit(""))
    apart = F.when(F.col("tier") == "vlm", T.divergence(text, native_text)).otherwise(0.0)
    ratio = F.when(F.length(native_text) > 0, F.length(text) / F.length(native_text))
    sure = F.when(F.col("tier") == "native", 1.0).otherwise(derived_confidence(F.length(T.visible(text)) > 0, T.repetition_ratio(text), apart, ratio))
    climb = F.struct(F.when(F.col("next_tier") == "ocr", "native").otherwise("ocr").alias("from"), F.col("next_tier").alias("to"), F.col("next_reason").alias("reason"))
    climbs = F.when(F.col("next_tier").isNotNull() & (F.col("next_tier") == F.col("tier")), F.array_append("climbs", climb)).otherwise(F.col("climbs"))
    return out.select(doc, page, "tier", text.alias("text"), climbs.alias("climbs"), F.round(apart, 6).alias("divergence"), F.round(sure, 6).alias("confidence"))
