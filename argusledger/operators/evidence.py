"""How well a report's citations and claims are grounded in the case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusledger.functions.normalise import citations, round4, truncate, ws_trim


def cited(reports: DataFrame) -> DataFrame:
    """(report_id, id, times): distinct citations, upper case."""
    return reports.select("report_id", F.explode(citations(F.col("text"))).alias("id")).groupBy("report_id", F.upper("id").alias("id")).agg(F.count("*").alias("times"))


def traceability(reports: DataFrame, valid: DataFrame, gold: DataFrame | None) -> DataFrame:
    """Per report: counts, sorted lists (the gold ids that it doesn't cite among them), precision, recall and F1 (from the rounded two).

    ``valid`` (id) and ``gold`` (id) are the case's ids.  Null metrics: not evaluable.  The gold set is small by
    definition (annotations of one case) and is joined per report; reports are never paired with each other.
    """
    ids = cited(reports).join(valid.select(F.upper("id").alias("id"), F.lit(True).alias("ok")).distinct(), "id", "left")
    if gold is not None:
        ids = ids.join(gold.select(F.upper("id").alias("id"), F.lit(True).alias("is_gold")).distinct(), "id", "left")
    else:
        ids = ids.withColumn("is_gold", F.lit(None).cast("boolean"))
    listed = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("id")))), ",")
    ok, hit = F.col("ok").isNotNull(), F.col("ok").isNotNull() & F.col("is_gold").isNotNull()
    per = ids.groupBy("report_id").agg(F.sum("times").alias("cited_total"), F.count("*").alias("cited_distinct"), F.count_if(ok).alias("grounded"), F.count_if(~ok).alias("fabricated"), F.count_if(hit).alias("matched"), listed(~ok).alias("fabricated_ids"), listed(ok).alias("grounded_ids"), listed(hit).alias("matched_ids"))
    out = reports.select("report_id").join(per, "report_id", "left").na.fill(0).na.fill("")
    if gold is None:
        none = F.lit(None).cast("double")
        return out.withColumns({"gold_total": F.lit(None).cast("long"), "missing_ids": F.lit(""), "precision": none, "recall": none, "f1": none})
    every = F.sort_array(F.collect_set(F.upper("id")))
    out = out.crossJoin(F.broadcast(gold.agg(every.alias("_gold")).withColumn("gold_total", F.size("_gold").cast("long"))))  # one row
    out = out.withColumn("missing_ids", F.array_join(F.array_except("_gold", F.split("matched_ids", ",")), ",")).drop("_gold")
    out = out.withColumn("precision", F.when(F.col("grounded") > 0, round4(F.col("matched") / F.col("grounded")))).withColumn("recall", F.when(F.col("gold_total") > 0, round4(F.col("matched") / F.col("gold_total"))))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, round4(2 * F.col("precision") * F.col("recall") / total)))


def score_claims(claims: DataFrame, valid: DataFrame) -> DataFrame:
    """(report_id, claim_id, support) to the label that counts: an id outside the case makes a claim unsupported."""
    ids = claims.select("report_id", "claim_id", F.lower(ws_trim(F.coalesce("support", F.lit("unsupported")))).alias("label"), F.explode_outer("cited_ids").alias("id"))
    hit = ids.join(valid.select(F.upper("id").alias("_v")).distinct(), F.upper("id") == F.col("_v"), "left")
    bad = F.max(F.col("id").isNotNull() & F.col("_v").isNull())
    out = hit.groupBy("report_id", "claim_id", "label").agg(bad.alias("bad"))
    label = F.when(F.col("bad"), "unsupported").when(F.col("label").isin("supported", "unsupported", "contradicted"), F.col("label")).otherwise("unsupported")
    return out.select("report_id", "claim_id", label.alias("scored"))


def hallucination_rate(scored: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("scored") == k)
    out = scored.groupBy("report_id").agg(F.count("*").alias("claims"), n("supported").alias("supported"), n("unsupported").alias("unsupported"), n("contradicted").alias("contradicted"))
    return out.withColumn("eghr_rate", F.when(F.col("claims") == 0, F.lit(0.0)).otherwise(round4((F.col("unsupported") + F.col("contradicted")) / F.col("claims"))))


def rubric_totals(scores: DataFrame, threshold: float) -> DataFrame:
    """(run_id, dimension, score, max) to totals and verdict, recomputed from the parts."""
    out = scores.groupBy("run_id").agg(F.sum("score").alias("total"), F.sum("max").alias("maximum"))
    out = out.withColumn("percentage", F.when(F.col("maximum") > 0, round4(F.col("total") / F.col("maximum"))).otherwise(F.lit(0.0)))
    return out.withColumn("verdict", F.when(F.col("percentage") >= threshold, "PASS").otherwise("FAIL"))


def markdown_sections(docs: DataFrame, id_col: str, width: int = 90) -> DataFrame:
    """(id, place, section, content): headings name sections, list items and paragraphs are rows.  Native, one row per
    document until the final explode: a fold over the document's lines."""
    lines = F.filter(F.transform(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1), ws_trim), lambda x: x != "")
    row = "struct<section:string,content:string>"
    state = F.struct(F.lit("(intro)").alias("section"), F.lit("").alias("held"), F.array().cast(f"array<{row}>").alias("rows"))

    def flush(s):
        add = F.array(F.struct(s.section.alias("section"), truncate(ws_trim(s.held), width).alias("content")))
        return F.when(ws_trim(s.held) == "", s.rows).otherwise(F.concat(s.rows, add))

    def step(s, x):
        item = F.concat(flush(s), F.array(F.struct(s.section.alias("section"), truncate(ws_trim(F.substring(x, F.lit(3), F.length(x))), width).alias("content"))))
        head, is_item = x.startswith("#"), x.startswith("- ") | x.startswith("* ")
        section = F.when(head, ws_trim(F.regexp_replace(x, "^[# ]+", ""))).otherwise(s.section)
        held = F.when(head | is_item, F.lit("")).when(s.held == "", x).otherwise(F.concat(s.held, F.lit(" "), x))
        rows = F.when(head, flush(s)).when(is_item, item).otherwise(s.rows)
        return F.struct(section.alias("section"), held.alias("held"), rows.alias("rows"))

    folded = docs.select(id_col, F.aggregate(lines, state, step, flush).alias("rows"))
    return folded.select(id_col, F.posexplode("rows").alias("place", "row")).select(id_col, "place", "row.section", "row.content")
