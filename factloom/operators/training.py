"""Training sets, few-shot examples and the context of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.recodes import edge_case_score
from factloom.operators.consistency import act_request
from factloom.operators.evidence import seeded_order
from factloom.operators.numbering import first_in_order, numbered
from factloom.operators.windows import PAGE_BREAK

#: What a year's context says, and the confidences that examples state.
RECESSION, EXPANSION = "RECESSION YEAR: ", "Economic expansion - no recession"
SURE, SURE_NEGATIVE, SURE_MOTIVATION = 0.95, 0.9, 0.95
#: The share of negative examples that are edge cases, and how much of a text an example quotes.
EDGES, EXCERPT, QUOTED = 0.67, 150, 500
#: Fixed value: the mark of a named act with a year.
NAMED_ACT = r"(?i)\b(act|bill|law|amendment|legislation)\s+(of\s+)?\d{4}\b"

DETECTION_TASK = "Classify this act's PRIMARY motivation."


def detection_set(positives: DataFrame, negatives: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Passages of acts and negative texts as one table: text, is_fiscal_act, act_name, split, year, motivation_category, source, body.

    ``positives`` has passages_text, act_name, split, year, motivation_category;
    ``negatives`` has ``key``, text, year, source, body. Negatives get train and
    val in the positives' shares, rounded half to even, the rest is test;
    without positives all are test. The seeded order of ``key`` decides.
    """
    shares = positives.agg(*[F.coalesce(F.try_divide(F.count_if(F.col("split") == s), F.count(F.lit(1))), F.lit(0.0)).alias(s) for s in ("train", "val")]).first()
    n = negatives.count()
    train, val = round(n * shares["train"]), round(n * shares["val"])
    place = F.col("_k")
    split = F.when(place < train, "train").when(place < train + val, "val").otherwise("test")
    none = F.lit(None).cast("string")
    yes = positives.select(F.col("passages_text").alias("text"), F.lit(1).alias("is_fiscal_act"), "act_name", "split", "year", "motivation_category", none.alias("source"), none.alias("body"))
    no = numbered(negatives, seed, key).select("text", F.lit(0).alias("is_fiscal_act"), none.alias("act_name"), split.alias("split"), "year", none.alias("motivation_category"), "source", "body")
    return yes.unionByName(no)


def motivation_set(acts: DataFrame) -> DataFrame:
    """Acts with their motivation."""
    return acts.select("act_name", "passages_text", "year", F.col("motivation_category").alias("motivation"), "exogenous", "split")


def magnitude_set(acts: DataFrame, quarters: str = "ground_truth_quarters", quarter: str = "quarter", amount: str = "amount") -> DataFrame:
    """Acts with a known quarter and a known amount somewhere among their quarters (a null or empty list has none)."""
    q = F.col(quarters)
    whole = F.exists(q, lambda x: x[quarter].isNotNull()) & F.exists(q, lambda x: x[amount].isNotNull())
    return acts.filter(q.isNotNull() & F.coalesce(whole, F.lit(False))).select("act_name", "passages_text", "year", "date_signed", quarters, "split")


def _example(text: Column, output: Column) -> list[Column]:
    return [text.alias("input"), F.to_json(output, {"ignoreNullFields": "false"}).alias("output")]


def detection_examples(rows: DataFrame, key: str, n_positive: int = 10, n_negative: int = 10, seed: int = 20251206) -> DataFrame:
    """Examples of detection from the training split: kind, input, output (JSON).

    Positives are drawn; of the negatives two thirds are the highest edge-case
    scores above 0 (ties in the seeded order), the rest is drawn among other texts.
    """
    train = rows.filter(F.col("split") == "train")
    drawn = (seeded_order(seed, key), F.col(key))
    yes = first_in_order(train.filter("is_fiscal_act = 1"), n_positive, *drawn)
    no = train.filter("is_fiscal_act = 0").withColumn("_e", edge_case_score(F.col("text")))
    n_edge = round(n_negative * EDGES)
    edge = first_in_order(no.filter("_e > 0"), n_edge, F.desc("_e"), *drawn)
    rest = no.join(F.broadcast(edge.select(F.col("text").alias("_t"))), F.col("text") == F.col("_t"), "left_anti")  # n_edge rows
    plain = first_in_order(rest, n_negative - n_edge, *drawn)
    act = F.struct(F.lit(True).alias("contains_act"), F.col("act_name"), F.lit(SURE).alias("confidence"), F.concat(F.lit("The passage describes "), F.col("act_name"), F.lit(", a piece of fiscal legislation.")).alias("reasoning"))
    none = F.struct(F.lit(False).alias("contains_act"), F.lit(None).cast("string").alias("act_name"), F.lit(SURE_NEGATIVE).alias("confidence"), F.lit("The passage discusses the economy but describes no fiscal act.").alias("reasoning"))
    out = yes.select(F.col(key), F.lit("positive").alias("kind"), *_example(F.col("text"), act))
    for kind, part in (("edge", edge), ("plain", plain)):
        out = out.unionByName(part.select(F.col(key), F.lit(kind).alias("kind"), *_example(F.col("text"), none)))
    return out


def economic_context(rows: DataFrame, recessions: DataFrame | None, year: str = "year") -> DataFrame:
    """The rows with ``economic_context``: that of a year of recession (``year``, ``context``), else of an expansion; null without a table.

    A year with several contexts has the first in order; a null year is an expansion.
    """
    if recessions is None:
        return rows.withColumn("economic_context", F.lit(None).cast("string"))
    known = recessions.groupBy(F.col("year").alias("_y")).agg(F.min("context").alias("_c"))
    met = rows.join(known, F.col(year) == F.col("_y"), "left")
    return met.withColumn("economic_context", F.when(F.col("_y").isNotNull(), F.concat(F.lit(RECESSION), F.coalesce("_c", F.lit("NA")))).otherwise(EXPANSION)).drop("_y", "_c")


def reasoning_for(act: Column, motivation: Column, known: dict[str, str] | None = None) -> Column:
    """The reasoning known for an act by a pattern of its name (the first that fits), else a plain one."""
    plain = F.concat(F.lit("The act is classified as "), motivation, F.lit(" by its legislative context and timing."))
    out = None
    for pattern, text in (known or {}).items():
        out = F.when(act.rlike(pattern), text) if out is None else out.when(act.rlike(pattern), text)
    return plain if out is None else out.otherwise(plain)


def motivation_examples(rows: DataFrame, key: str, per_class: int = 5, required: list[str] | None = None, recessions: DataFrame | None = None, known: dict[str, str] | None = None, seed: int = 20251206) -> DataFrame:
    """Examples of motivation: required (its place among them, null for drawn ones), motivation, input, output (JSON).

    Of each required name the first act by ``key`` that holds it comes, from any
    split, with the reasoning known for it. Each motivation is then filled up to
    ``per_class`` from the training split, without acts that hold a required name.
    """
    names = list(required or [])
    held, chosen = F.lit(False), None
    for place, name in enumerate(names, 1):
        has = F.coalesce(F.contains("act_name", F.lit(name)), F.lit(False))
        held = held | has
        one = first_in_order(rows.filter(has), 1, F.col(key)).withColumn("required", F.lit(place))
        chosen = one if chosen is None else chosen.unionByName(one)
    empty = rows.limit(0).withColumn("required", F.lit(None).cast("int"))
    chosen = empty if chosen is None else chosen
    have = chosen.groupBy("motivation").agg(F.count(F.lit(1)).alias("_have"))  # at most the required names
    pool = rows.filter((F.col("split") == "train") & ~held).join(F.broadcast(have), "motivation", "left").withColumn("_need", F.greatest(F.lit(0), F.lit(per_class) - F.coalesce("_have", F.lit(0))))
    order = Window.partitionBy("motivation").orderBy(seeded_order(seed, key), key)
    drawn = pool.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_class).filter(F.col("_r") <= F.col("_need"))
    every = chosen.unionByName(drawn.select(*rows.columns, F.lit(None).cast("int").alias("required")))
    every = economic_context(every, recessions)
    plain = reasoning_for(F.col("act_name"), F.col("motivation"))
    why = F.when(F.col("required").isNotNull(), reasoning_for(F.col("act_name"), F.col("motivation"), known)).otherwise(plain)
    quoted = F.array(F.struct(F.substring("passages_text", 1, EXCERPT).alias("passage_excerpt"), F.col("motivation").alias("supports")))
    output = F.struct("motivation", "exogenous", F.lit(SURE_MOTIVATION).alias("confidence"), quoted.alias("evidence"), why.alias("reasoning"))
    text = act_request(F.col("act_name"), F.col("passages_text"), DETECTION_TASK, F.col("year"), None, F.col("economic_context"))
    return every.select(key, "required", "motivation", *_example(text, output))


def _span(n_pages: Column, start: Column, pages: int) -> Column:
    return F.least(start + pages - 1, n_pages)


def _drawn_start(seed: int, key: str, first: Column, last: Column) -> Column:
    """A page between ``first`` and ``last``, by a hash of the key."""
    number = F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("long")
    return (first + F.pmod(number, F.greatest(F.lit(1), last - first + 1))).cast("int")


def _chunk_text(doc: Column, year: Column, start: Column, end: Column, text: Column) -> Column:
    """The text of a chunk of a document with its pages, as the extractor gets it."""
    return F.format_string("DOCUMENT: %s\nDOCUMENT YEAR: %d\nPAGES: %d to %d\n\nDOCUMENT TEXT:\n%s", doc, year, start, end, text)


def extraction_examples(acts: DataFrame, docs: DataFrame, act_key: str, doc_key: str, n_positive: int = 5, n_negative: int = 3, pages: int = 3, seed: int = 20251206) -> DataFrame:
    """Examples of extraction: kind, name (the act or the document), input, output (JSON).

    ``acts`` has act_name, year, passages_text, motivation_category; ``docs`` has
    year and an array ``pages``. Drawn acts are put before some pages of the
    document with pages whose year is nearest, at most a year away (the smaller
    key on ties); acts without such a document give no example. Negatives are
    drawn documents of more than ten pages: ``pages`` pages without a named act,
    or, where too few are without one, pages from the document's second half.
    """
    drawn = first_in_order(acts, n_positive, seeded_order(seed, act_key), F.col(act_key))
    paged = docs.filter(F.size("pages") > 0).select(F.col(doc_key).alias("_doc"), F.col("year").alias("_year"), "pages", F.size("pages").alias("_n"))
    near = F.broadcast(drawn).join(paged.select("_doc", "_year"), F.abs(F.col("_year") - F.col("year")) <= 1)  # n_positive rows
    best = near.groupBy(act_key).agg(F.min(F.struct(F.abs(F.col("_year") - F.col("year")).alias("d"), F.col("_doc").alias("doc"))).alias("_b")).select(F.col(act_key).alias("_a"), F.col("_b.doc").alias("_d"))
    met = drawn.join(F.broadcast(best), F.col(act_key) == F.col("_a")).join(paged, F.col("_d") == F.col("_doc"))
    met = met.withColumn("_s", _drawn_start(seed, act_key, F.lit(1), F.greatest(F.lit(1), F.col("_n") - pages)))
    met = met.withColumn("_e", _span(F.col("_n"), F.col("_s"), pages))
    body = F.concat("passages_text", F.lit(PAGE_BREAK), F.array_join(F.slice("pages", F.col("_s"), F.col("_e") - F.col("_s") + 1), PAGE_BREAK))
    passage = F.struct(F.substring("passages_text", 1, QUOTED).alias("text"), F.sequence(F.col("_s"), F.col("_e") + 1).alias("page_numbers"), F.lit(SURE).alias("confidence"))
    why = F.concat(F.lit("The passage describes the "), F.col("act_name"), F.lit(", a "), F.lower("motivation_category"), F.lit(" fiscal act, as its time saw it."))
    found = F.array(F.struct(F.col("act_name"), F.col("year"), F.array(passage).alias("passages"), why.alias("reasoning")))
    output = F.struct(found.alias("acts"), F.lit(False).alias("no_acts_found"), F.lit("An enacted act is described.").alias("extraction_notes"))
    yes = met.select(F.lit("positive").alias("kind"), F.col("act_name").alias("name"), *_example(_chunk_text(F.col("_doc"), F.col("_year"), F.col("_s"), F.col("_e") + 1, body), output))

    long = first_in_order(paged.filter("_n > 10"), n_negative, seeded_order(seed, "_doc"), F.col("_doc"))
    free = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda i: ~F.get("pages", i - 1).rlike(NAMED_ACT))
    long = long.withColumn("_free", free)
    at = _drawn_start(seed, "_doc", F.lit(1), F.size("_free") - pages + 1)
    half = F.floor(F.col("_n") / 2).cast("int")
    start = _drawn_start(seed, "_doc", half, F.greatest(half, F.col("_n") - pages))
    chosen = F.when(F.size("_free") >= pages, F.slice("_free", at, F.lit(pages))).otherwise(F.sequence(start, _span(F.col("_n"), start, pages)))
    long = long.withColumn("_p", chosen)
    text = F.array_join(F.transform("_p", lambda i: F.get("pages", i - 1)), PAGE_BREAK)
    long = long.withColumn("_t", text)
    notes = (
        F.when(F.col("_t").rlike("(?i)table|figure|chart"), "Tables and figures, no act.").when(F.col("_t").rlike("(?i)appendix|annex"), "An appendix, no act.")
        .when(F.col("_t").rlike("(?i)forecast|projection|estimate"), "Projections, no enacted act.").otherwise("A general discussion, no act.")
    )
    nothing = F.struct(F.array().cast("array<string>").alias("acts"), F.lit(True).alias("no_acts_found"), notes.alias("extraction_notes"))
    no = long.select(F.lit("negative").alias("kind"), F.col("_doc").cast("string").alias("name"), *_example(_chunk_text(F.col("_doc"), F.col("_year"), F.array_min("_p"), F.array_max("_p"), F.col("_t")), nothing))
    return yes.unionByName(no)
