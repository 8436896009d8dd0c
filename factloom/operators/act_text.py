"""Summaries of acts in running text: blocks, dated changes and quoted passages.

Lines of a document are cut into blocks by windows over the document; what a
block's lines say is read block by block, each where its lines lie.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The line from which blocks are looked for, and the one that ends the last.
FIRST_LINE, LAST_LINE = "II. ACT-BY-ACT SUMMARY", "REFERENCES"
#: What marks a block's first line, a page number, a quarter, an amount and a category.
DATED = r"^(?:Signed|Date|Effective):\s+(.+)$"
PAGE = r"^\d{1,3}$"
QUARTER = re.compile(r"(\d{4})Q(\d)")
AMOUNT = re.compile("([-+–—−])\\$?([\\d,.]+)\\s+billion")
CATEGORY = re.compile(r"\((Endogenous|Exogenous)[;:,]\s*(Spending-driven|Countercyclical|Deficit-driven|Long-run)\)")
#: Headings of the changes of a block.
CHANGES, PRESENT = "Change in Liabilities", "Present Value"
#: Pages of the summaries, how long a line with a mark inside it may be, and how many lines a note may take.
PAGES, WIDE, AHEAD = (17, 95), 80, 30
#: Least length of a quotation, and how far before it its source and date are looked for.
QUOTED, BEFORE_SOURCE, BEFORE_DATE = 15, 200, 150
QUOTE = re.compile('["“]([^"”]+)["”]')
SOURCE = re.compile(r"(?:in (?:his|her|the|a) )?([\w\s]+?)\s*(?:stated|said|reported|announced|noted|wrote)|(\d{4}\s+(?:Economic Report|Budget|Treasury))")
SHORT_DATE = re.compile(r"\d{1,2}/\d{1,2}/\d{2,4}")

CHANGE = T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("quarter", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("category", T.StringType()), T.StructField("exogeneity", T.StringType())]))
LABEL = T.ArrayType(T.StructType([T.StructField("quote", T.StringType()), T.StructField("source", T.StringType()), T.StructField("date", T.StringType())]))
BLOCK = T.StructType([T.StructField("changes", CHANGE), T.StructField("narrative", T.StringType()), T.StructField("labels", LABEL)])


def signed_date(raw: Column) -> Column:
    """The first m/d/y of a text as YYYY-MM-DD (two-digit years from 45 on are of the 1900s); the text itself without one."""
    def part(i: int) -> Column:
        return F.regexp_extract(raw, r"(\d{1,2})/(\d{1,2})/(\d{2,4})", i)

    month, day, year = part(1), part(2), part(3)
    number = year.cast("int")
    full = F.when(F.length(year) == 2, number + F.when(number >= 45, 1900).otherwise(2000)).otherwise(number)
    return F.when(month == "", F.trim(raw)).otherwise(F.concat(full.cast("string"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")))


def act_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of each document: ``key``, ``block`` (from 1), ``act_name``, ``signed_raw``, ``date_signed``, ``lines`` (number and text, blank ones left out).

    A block begins under a dated line; the line before that (a page number
    between them does not count) is the act's name. It ends before the next
    act's name, the last one before the references. Documents without a dated
    line and null texts give no rows. ``key`` names a row of ``docs``.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    whole = lines.filter(F.col("line") != "")
    order = Window.partitionBy(key).orderBy("no")
    first = F.min(F.when(F.contains("line", F.lit(FIRST_LINE)), F.col("no"))).over(Window.partitionBy(key))
    marked = whole.withColumn("_dated", F.col("line").rlike(DATED) & (F.col("no") >= F.coalesce(first, F.lit(0)))).withColumn("_page", F.col("line").rlike(PAGE))
    before, after = (lambda c, n: F.lag(c, n).over(order)), (lambda c, n: F.coalesce(F.lead(c, n).over(order), F.lit(False)))
    name = F.coalesce(F.when(before("_page", 1), before("line", 2)).otherwise(before("line", 1)), F.lit(""))
    # the name above the next dated line, and a page number between them, are of no block
    heads = after("_dated", 1) | (after("_page", 1) & after("_dated", 2))
    marked = marked.select("*", F.when(F.col("_dated"), name).alias("_name"), heads.alias("_head"), F.sum(F.col("_dated").cast("int")).over(order).alias("block"))
    last = F.max("block").over(Window.partitionBy(key))
    ended = F.max(((F.col("line") == LAST_LINE) & (F.col("block") == F.col("_last"))).cast("int")).over(order)
    kept = marked.filter("block > 0").withColumn("_last", last).withColumn("_ended", ended)
    body = ~F.col("_dated") & ~F.col("_head") & (F.col("_ended") == 0)
    raw = F.regexp_extract("line", DATED, 1)
    rows = kept.groupBy(key, "block").agg(
        F.max(F.when(F.col("_dated"), F.col("_name"))).alias("act_name"), F.max(F.when(F.col("_dated"), F.trim(raw))).alias("signed_raw"),
        F.array_sort(F.collect_list(F.when(body, F.struct("no", "line")))).alias("lines"),
    )
    return rows.withColumn("date_signed", signed_date(F.col("signed_raw")))


def _is_page(line: str) -> bool:
    return bool(re.match(PAGE, line))


def _near_front(found: re.Match | None, line: str) -> bool:
    return found is not None and (len(line) < WIDE or found.start() < 5)


def _is_heading(line: str) -> bool:
    """Whether a line belongs to the table of changes by its look."""
    return (
        _is_page(line) or CHANGES in line or line.startswith(PRESENT) or _near_front(QUARTER.search(line), line) or _near_front(AMOUNT.search(line), line)
        or (line.startswith("(") and CATEGORY.search(line) is not None) or line[0] in "+-–—−"
    )


def _tells_change(line: str) -> bool:
    """Whether a later line shows that the table of changes goes on."""
    if _is_page(line):
        return False
    return CHANGES in line or PRESENT in line or bool(QUARTER.search(line) or AMOUNT.search(line)) or (line.startswith("(") and bool(CATEGORY.search(line)))


def split_block(lines: list[tuple[int, str]]) -> tuple[list[str], list[str]]:
    """The lines of the table of changes and those of the narrative.

    Other text among the table's lines is a note and skipped as long as the
    table goes on within the next lines.
    """
    going_on = [n for n, line in lines if _tells_change(line)]
    table = []
    for at, (n, line) in enumerate(lines):
        if _is_page(line) and int(line) <= PAGES[1]:
            continue
        if _is_heading(line):
            table.append(line)
        elif not any(n < later < n + AHEAD for later in going_on):
            return table, [x for _, x in lines[at:]]
    return table, []


def _amount(found: re.Match) -> float:
    return float(found.group(2).replace(",", "")) * (1.0 if found.group(1) == "+" else -1.0)


def dated_changes(table: list[str]) -> list[dict]:
    """Changes in the order standard, retroactive, present value.

    Quarters may stand in a column before their amounts: those that wait take
    the amounts in turn. Quarters of the standard section that still wait when
    the present values begin take the first amounts there. An amount without a
    waiting quarter is of the last one named. A category alone is of the first
    change without one.
    """
    found: dict[str, list[dict]] = {"standard": [], "retroactive": [], "present_value": []}
    section, waiting, owed, last = None, [], [], None
    for line in table:
        if re.match(rf"{CHANGES}:?\s*$", line) or f"{CHANGES} (excluding retroactive" in line:
            section, waiting = "standard", []
            continue
        if f"{CHANGES} (including retroactive" in line:
            section, waiting = "retroactive", []
            continue
        if line.startswith(f"{PRESENT}:"):
            owed = waiting if section == "standard" else []
            section, waiting = "present_value", []
            line = line[len(PRESENT) + 1 :].strip()
        if section is None or not line:
            continue
        quarter, amount, category = QUARTER.search(line), AMOUNT.search(line), CATEGORY.search(line)
        named = dict(zip(("exogeneity", "category"), category.groups() if category else (None, None)))
        if quarter:
            last = f"{quarter.group(1)}-{int(quarter.group(2)):02d}"
        if quarter and amount:
            waiting = []
            found[section].append({"quarter": last, "amount": _amount(amount), **named})
        elif quarter:
            waiting.append(last)
        elif amount and owed:
            found["standard"].append({"quarter": owed.pop(0), "amount": _amount(amount), **named})
        elif amount:
            found[section].append({"quarter": waiting.pop(0) if waiting else last, "amount": _amount(amount), **named})
        elif category:
            open_ = next((x for rows in found.values() for x in rows if x["category"] is None), None)
            if open_:
                open_.update(named)
    return [{"section": s, **x} for s, rows in found.items() for x in rows]


def quoted_labels(narrative: str) -> list[dict]:
    """Quotations of some length with the source and date named shortly before them (empty if none)."""
    out = []
    for found in QUOTE.finditer(narrative):
        quote = found.group(1).strip()
        if len(quote) >= QUOTED:
            before = narrative[max(0, found.start() - BEFORE_SOURCE) : found.start()]
            source, date = SOURCE.search(before), SHORT_DATE.search(before[-BEFORE_DATE:])
            out.append({"quote": quote, "source": next((g for g in source.groups() if g), "").strip() if source else "", "date": date.group() if date else ""})
    return out


def read_block(lines: list[tuple[int, str]]) -> dict:
    table, rest = split_block(lines)
    told = [x for x in rest if not (_is_page(x) and PAGES[0] <= int(x) <= PAGES[1])]
    narrative = re.sub(r"\s+", " ", " ".join(told)).strip()
    return {"changes": dated_changes(table), "narrative": narrative, "labels": quoted_labels(narrative)}


@F.pandas_udf(BLOCK)
def _read(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_block([(x["no"], x["line"]) for x in lines]) for lines in blocks], columns=["changes", "narrative", "labels"])


def read_acts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The blocks with ``changes``, ``narrative``, ``labels`` and the act's ``category`` and ``exogeneity`` (of its first standard change that has both, without standard ones of its first retroactive one; empty if none)."""
    read = act_blocks(docs, key, text).withColumn("_b", _read(F.col("lines")))
    standard = F.filter("_b.changes", lambda c: c["section"] == "standard")
    some = F.when(F.size(standard) > 0, standard).otherwise(F.filter("_b.changes", lambda c: c["section"] == "retroactive"))
    first = F.get(F.filter(some, lambda c: c["category"].isNotNull() & c["exogeneity"].isNotNull()), 0)
    return read.select(key, "block", "act_name", "signed_raw", "date_signed", "_b.changes", "_b.narrative", "_b.labels", F.coalesce(first["category"], F.lit("")).alias("category"), F.coalesce(first["exogeneity"], F.lit("")).alias("exogeneity"))


def act_changes(acts: DataFrame, key: str) -> DataFrame:
    """A row for each change: ``place`` counts from 1 in the block."""
    rows = acts.select(key, "block", "act_name", F.posexplode("changes").alias("_at", "c"))
    return rows.select(key, "block", "act_name", (F.col("_at") + 1).alias("place"), "c.*")


def act_labels(acts: DataFrame, key: str) -> DataFrame:
    """A row for each quotation, with the act's category and exogeneity."""
    rows = acts.select(key, "block", "act_name", "category", "exogeneity", F.posexplode("labels").alias("_at", "c"))
    return rows.select(key, "block", "act_name", "category", "exogeneity", (F.col("_at") + 1).alias("place"), "c.*")
