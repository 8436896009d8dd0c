"""Recodes, labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Motivations as written in the gold table, and their codes.
MOTIVATIONS = {
    "Spending-driven": "SPENDING_DRIVEN",
    "Countercyclical": "COUNTERCYCLICAL",
    "Deficit-driven": "DEFICIT_DRIVEN",
    "Long-run": "LONG_RUN",
}
#: Source types and the patterns of their document ids; the first that fits counts.
SOURCE_TYPES = (
    ("ERP", "erp|economic.report"),
    ("Treasury", "treasury|annual.report"),
    ("Budget", "budget"),
)
#: Patterns of texts that are easily taken for acts, and their weights.
EDGE_CASES = (
    (r"\bpropose[ds]?\b", 3.0),
    (r"\brecommend[s|ed|ation|ations]?\b", 3.0),
    (r"\bshould\b", 2.0),
    (r"\b(act|legislation)\s+of\s+\d{4}\b", 2.0),
    (r"\bsince\s+(the|\d{4})\b", 2.0),
    (r"\bprevious(ly)?\b", 2.0),
    (r"\benacted\s+(in|to)\b", 1.5),
)


def looked_up(x: Column, names: dict[str, str], keep_unknown: bool = False) -> Column:
    """The value of a key; an unknown key is null or, if asked, stays."""
    found = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[x]
    return F.coalesce(found, x) if keep_unknown else found


def exogenous(flag: Column) -> Column:
    """Whether a flag says Exogenous; null for anything but that and Endogenous."""
    return F.when(flag == "Exogenous", True).when(flag == "Endogenous", False)


def sign_of(amount: Column) -> Column:
    """P09: '+', '-' or '0' of an amount, null stays."""
    return F.when(amount > 0, "+").when(amount < 0, "-").when(amount.isNotNull(), "0")


def source_type(doc_id: Column) -> Column:
    """Type of source by the document's id, ignoring case; null is Other."""
    out = None
    for name, pattern in SOURCE_TYPES:
        fits = F.lower(doc_id).rlike(pattern)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("Other")


def interval_cell(value: Column, low: Column, high: Column) -> Column:
    """P20: '0.123 [0.100, 0.150]'; a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.3f [%.3f, %.3f]", value, low, high))


def ratio_cell(over: Column, under: Column) -> Column:
    """P20: over / under with two decimals, 'n : 0' without a denominator, a dash for null."""
    return (
        F.when(over.isNull() | under.isNull(), "—")
        .when((under == 0) & (over == 0), "0 : 0")
        .when(under == 0, F.format_string("%d : 0", over))
        .otherwise(F.format_string("%.2f", F.try_divide(over.cast("double"), under.cast("double"))))
    )


def edge_case_score(text: Column) -> Column:
    """Weighted matches of the edge-case patterns; null text scores null."""
    score = F.lit(0.0)
    for pattern, weight in EDGE_CASES:
        score = score + F.regexp_count(F.lower(text), F.lit(pattern)) * F.lit(weight)
    return score


def signed_effect(sign: Column, raw: Column) -> Column:
    """Effect in words; a reply of no single sign is quoted."""
    quoted = F.concat(F.lit("NA  *(no single sign; raw model output: “"), raw, F.lit("”)*"))
    return F.when(sign == "+", "increase (+)").when(sign == "-", "decrease (−)").when(F.coalesce(raw, F.lit("")) == "", "NA").otherwise(quoted)
