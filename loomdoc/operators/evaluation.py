"""Quality audits of extracted documents, retrieval metrics, quizzes and latency roll-ups."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TYPES = ["heading", "paragraph", "list_item", "caption", "footer", "header", "footnote", "diagram", "blank_page"]

#: The rules of the whole audit, and the types that it takes for valid.
RULES = ["valid_json", "metadata_present", "non_empty_blocks", "page_numbers_valid", "block_types_valid", "non_empty_text", "boilerplate_tagged", "table_structure_valid", "ner_populated"]
AUDIT_TYPES = ("heading", "paragraph", "list_item", "caption", "footnote", "header", "footer", "table", "blank_page", "exercise_heading", "toc_page_number")


def audit(blocks: DataFrame) -> DataFrame:
    """(doc_id, rules about a document's blocks, one boolean each, and how many fail)."""
    t = F.trim("text")
    b = blocks.groupBy("doc_id").agg(
        (F.count("*") > 0).alias("has_blocks"),
        F.bool_and(F.col("page_num") >= 1).alias("pages_valid"),
        (F.count_if(t == "") == 0).alias("no_empty_text"),
        F.bool_and(F.col("type").isin(TYPES)).alias("types_valid"),
        (F.count_distinct("seq") == F.count("*")).alias("ids_unique"),
        (F.count_if(F.col("type") == "heading") > 0).alias("has_headings"),
    )
    rules = [c for c in b.columns if c != "doc_id"]
    return b.withColumn("failed", sum((F.when(F.col(c), 0).otherwise(1) for c in rules), F.lit(0)).cast("long"))


def nine_rules(extracted: DataFrame) -> DataFrame:
    """(doc_id, nine rules about an extracted document, one boolean each, and how many fail) from (doc_id, json). Without valid JSON all fail, without blocks those about blocks and tables."""

    def judge(text: str | None) -> list[bool]:
        try:
            data = json.loads(text)
        except (TypeError, ValueError):
            return [False] * len(RULES)
        data = data if isinstance(data, dict) else {}
        meta, bs, ts = (data.get(k) for k in ("document_metadata", "text_blocks", "tables"))
        meta = meta if isinstance(meta, dict) else {}
        told = bool(meta.get("file_name") and meta.get("extracted_at"))
        if not isinstance(bs, list) or not bs:
            return [True, told] + [False] * (len(RULES) - 2)
        bs = [b if isinstance(b, dict) else {} for b in bs]
        ts = [t if isinstance(t, dict) else {} for t in ts] if isinstance(ts, list) else []
        said = lambda b: isinstance(b.get("text"), str) and b["text"].strip() != ""
        return [
            True,
            told,
            True,
            all(isinstance(b.get("page_num"), int) and b["page_num"] >= 1 for b in bs),
            all(b.get("type") in AUDIT_TYPES for b in bs),
            all(b.get("type") == "blank_page" or said(b) for b in bs),
            all("is_boilerplate" in b for b in bs),
            all(isinstance(t.get("table_id"), str) and isinstance(t.get("rows"), list) for t in ts),
            all("entities" in b for b in bs),
        ]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *(r := judge(t)), len(r) - sum(r)) for i, t in zip(pdf["doc_id"], pdf["json"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *RULES, "failed"])

    return extracted.select("doc_id", "json").mapInPandas(read, f"doc_id bigint, {', '.join(f'{r} boolean' for r in RULES)}, failed bigint")


def coverage(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, coverage, coverage_capped, missing): pages found of those expected (doc_id, pages), in per cent, uncapped as it is reported; missing pages counted."""
    found = blocks.groupBy("doc_id").agg(F.count_distinct("page_num").alias("found"), F.collect_set("page_num").alias("ps"))
    j = expected.join(found, "doc_id", "left")
    share = F.round(100.0 * F.coalesce("found", F.lit(0)) / F.col("pages"), 2)
    missing = F.size(F.array_except(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long")), F.coalesce("ps", F.array().cast("array<bigint>"))))
    return j.select("doc_id", share.alias("coverage"), F.least(share, F.lit(100.0)).alias("coverage_capped"), missing.cast("long").alias("missing"))


def contamination(blocks: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, texts): longer texts that stand on several pages of a document."""
    t = blocks.where(F.length(F.trim("text")) > least).groupBy("doc_id", F.trim("text").alias("t")).agg(F.count_distinct("page_num").alias("n")).where("n > 1")
    return t.groupBy("doc_id").agg(F.count("*").alias("texts"))


def split_sentences(blocks: DataFrame) -> DataFrame:
    """(doc_id, n): neighbouring paragraphs, neither boilerplate, of which the first has no end and the second goes on in lower case."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    body = (F.col("type") == "paragraph") & ~F.col("is_boilerplate")
    t = F.regexp_replace("text", r"\A\s+|\s+\z", "")
    p = blocks.withColumns({"t": t, "body": body}).withColumns({"next": F.lead("t").over(w), "body2": F.lead("body").over(w)})
    cut = F.col("body") & F.col("body2") & (F.col("t") != "") & ~F.col("t").rlike('[.!?:"]$') & F.col("next").rlike("^[a-z]")
    return p.groupBy("doc_id").agg(F.count_if(cut).alias("n"))


def issues(blocks: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, critical, major, minor): kinds of issues that a document has. covered: (doc_id, missing).

    Critical: missing pages; no content. Major: recognition errors that are left; texts on several pages. Minor: split sentences; boxes that stand for the whole page.
    """
    left = F.contains("text", F.lit("monotheistsant")) | F.col("text").rlike(r"\b[A-Z]\s+ol\b") | F.col("text").rlike(r"\b[A-Z]\s+ork\b")
    b = blocks.groupBy("doc_id").agg(F.count_if(left).alias("errors"), F.count_if(F.col("bbox_approximate")).alias("boxes"), F.count_if(~F.col("is_boilerplate")).alias("content"))
    j = b.join(covered.select("doc_id", "missing"), "doc_id").join(contamination(blocks).withColumnRenamed("texts", "again"), "doc_id", "left").join(split_sentences(blocks), "doc_id")
    one = lambda c: F.when(c, 1).otherwise(0)
    return j.select("doc_id", (one(F.col("missing") > 0) + one(F.col("content") == 0)).alias("critical"), (one(F.col("errors") > 0) + one(F.coalesce("again", F.lit(0)) > 0)).alias("major"), (one(F.col("n") > 0) + one(F.col("boxes") > 0)).alias("minor"))


def score(audited: DataFrame, covered: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, score, rating): 100 less 0.3 for each missing per cent, 2.2 for each failed rule and 15, 5 or 2 for each issue, between 0 and 100, to one place."""
    j = audited.join(covered, "doc_id").join(issues, "doc_id", "left")
    s = 100 - 0.3 * (100 - F.col("coverage")) - 2.2 * F.col("failed") - 15 * F.coalesce("critical", F.lit(0)) - 5 * F.coalesce("major", F.lit(0)) - 2 * F.coalesce("minor", F.lit(0))
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(s, 1)))
    return j.select("doc_id", s.alias("score"), F.when(s >= 90, "Excellent").when(s >= 75, "Good").when(s >= 55, "Fair").otherwise("Poor").alias("rating"))


#: The least score of a document that can be asked about.
READY = 75.0


def readiness(scores: DataFrame, least: float = READY) -> DataFrame:
    """(doc_id, score, ready)."""
    return scores.select("doc_id", "score", (F.col("score") >= least).alias("ready"))


def ready_documents(scores: DataFrame, least: float = READY) -> DataFrame:
    """(documents, ready, mean_score, least_score) of all documents."""
    s = F.col("score")
    return scores.agg(F.count("*").alias("documents"), F.count_if(s >= least).alias("ready"), F.round(F.avg(s), 4).alias("mean_score"), F.min(s).alias("least_score"))


def roll_up(scores: DataFrame) -> DataFrame:
    return scores.groupBy("rating").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def ranking_metrics(ranks: DataFrame, by: str) -> DataFrame:
    """Mean reciprocal rank, nDCG@5 and recall at 1, 5 and 10 from the rank of each query's one relevant chunk (0: not found)."""
    r = F.col("rank")
    recall = lambda k: F.round(F.avg(F.when((r > 0) & (r <= k), 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return ranks.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.when(r > 0, 1 / r).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(F.when((r > 0) & (r <= 5), 1 / F.log2(r + 1)).otherwise(0.0)), 6).alias("ndcg_5"), recall(1), recall(5), recall(10))


def quiz_scores(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(quiz, total, correct, incorrect, unanswered, accuracy, tier) from (quiz, question, correct) and (quiz, question, selected); an empty selection is no answer."""
    j = questions.join(answers, ["quiz", "question"], "left").withColumn("said", F.col("selected").isNotNull() & (F.col("selected") >= 0))
    g = j.groupBy("quiz").agg(F.count("*").alias("total"), F.count_if(F.col("said") & (F.col("selected") == F.col("correct"))).alias("right"), F.count_if(~F.col("said")).alias("unanswered"))
    accuracy = F.round(100.0 * F.col("right") / F.col("total"), 1)
    return g.select("quiz", "total", F.col("right").alias("correct"), (F.col("total") - F.col("right") - F.col("unanswered")).alias("incorrect"), "unanswered", accuracy.alias("accuracy"), F.when(accuracy >= 80, "strong").when(accuracy >= 50, "fair").otherwise("weak").alias("tier"))


def latency(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.round(F.percentile("latency_ms", F.lit(0.5)), 4).alias("p50_ms"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("p95_ms"), F.max("latency_ms").alias("max_ms"))


#: How far a value of a sketch may be off, as a share of the value.
ACCURACY = 0.01


def latency_sketch(log: DataFrame, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """(by..., bucket, n, total, most): counts of latencies in buckets whose bounds grow by a constant factor.

    A sketch of bounded size (a value of a microsecond up to a day makes some 1,300 buckets), and one that merges by adding up: sketches of days give, added up, those of one pass.
    Latencies of zero or less have the bucket null.
    """
    ms = F.col("latency_ms").cast("double")
    bucket = F.when(ms > 0, F.ceil(F.log(ms) / F.lit(_growth(accuracy)))).cast("int")
    return log.where(ms.isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(ms).alias("total"), F.max(ms).alias("most"))


def _growth(accuracy: float) -> float:
    """The logarithm of the factor between bounds."""
    return math.log((1 + accuracy) / (1 - accuracy))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def sketch_latency(sketches: DataFrame, by: list[str], accuracy: float = ACCURACY, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by..., n, mean_ms, p50_ms, p95_ms, max_ms) from sketches; a percentile is the value of rank ceil(share * n), within ``accuracy`` of it."""
    w = Window.partitionBy(*by)
    s = sketches.withColumns({"upto": F.sum("n").over(w.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)), "of": F.sum("n").over(w)})
    g = _growth(accuracy)
    middle = F.coalesce(2 * F.exp(F.col("bucket") * F.lit(g)) / (1 + math.exp(g)), F.lit(0.0))
    at = [F.round(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("of")), middle)), 4).alias(f"p{round(100 * q)}_ms") for q in shares]
    return s.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean_ms"), *at, F.max("most").alias("max_ms"))
