"""Measures of retrieval and of classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, TOP_K = 0.45, 6


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, threshold: float = THRESHOLD, top_k: int = TOP_K) -> DataFrame:
    """(query_id, recall, mrr, precision, ndcg) of each query in relevant.

    hits: (query_id, page, score, rank); relevant: (query_id, pages array). Recall counts
    distinct relevant pages with a score of at least threshold; mrr the first relevant
    rank; precision and ndcg look at the first top_k ranks. Gains are per hit and the
    ideal per page, so ndcg may exceed 1. A query without hits scores 0; one without
    relevant pages has no recall.
    """
    r = relevant.select("query_id", F.array_distinct("pages").alias("pages"))
    x = r.join(hits, "query_id", "left").withColumn("rel", F.coalesce(F.array_contains("pages", F.col("page")), F.lit(False)))
    gain = F.when(F.col("rel") & (F.col("rank") <= top_k), 1.0).otherwise(0.0)
    m = x.groupBy("query_id").agg(
        F.first("pages").alias("pages"),
        F.countDistinct(F.when(F.col("rel") & (F.col("score") >= threshold), F.col("page"))).alias("found"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        F.sum(gain).alias("gains"),
        F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    n = F.size("pages")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(top_k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return m.select(
        "query_id",
        F.round(F.when(n > 0, F.col("found") / n), 4).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.col("gains") / top_k, 4).alias("precision"),
        F.round(F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 4).alias("ndcg"),
    )


def metric_report(metrics: DataFrame, kind: str, calibrated: str) -> DataFrame:
    """Means over all queries (kind null) and by kind, nulls skipped, with the numbers of queries and of calibrated ones."""
    names = ("recall", "mrr", "precision", "ndcg")
    out = metrics.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(*(F.round(F.avg(n), 4).alias(n) for n in names), F.count("*").alias("n_queries"), F.count_if(F.col(calibrated)).alias("n_calibrated"))
    return out


def citation_accuracy(answer, pages):
    """Share of the pages cited as [Page n] that are among pages; 1 without citation."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"(?i)\[Page (\d+)\]"), 1), lambda x: x.cast("int")))
    return F.round(F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, pages)) / F.size(cited)).otherwise(1.0), 4)


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every label that occurs; null labels are left out."""
    p = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    n = p.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    by_a = n.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_p = n.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    j = by_a.join(by_p, "label", "full")
    precision, recall = F.col("hit") / F.col("said"), F.col("hit") / F.col("support")
    zero = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return j.select("label", zero(precision).alias("precision"), zero(recall).alias("recall"), zero(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"), F.coalesce("support", F.lit(0)).alias("support"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """One row per actual label and one column per predicted label, zeros filled in."""
    return df.where(F.col(actual).isNotNull()).groupBy(F.col(actual).alias("actual")).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)


def markdown_lines(report: DataFrame, first: str, numbers: tuple[str, ...]) -> DataFrame:
    """(line): the rows of a report as a Markdown table's, numbers with four digits, nulls as -."""
    cells = [F.when(F.col(n).isNull(), "-").otherwise(F.format_string("%.4f", F.col(n).cast("double"))) for n in numbers]
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(first), *cells), F.lit(" |")).alias("line"))


def write_report(report: DataFrame, path: str, config: dict, first: str, numbers: tuple[str, ...]) -> None:
    """The report under path: its rows as JSON with the configuration beside them, and a Markdown table."""
    shown = report.withColumn("config", F.create_map(*(F.lit(str(x)) for kv in config.items() for x in kv)) if config else F.lit(None).cast("map<string,string>"))
    shown.write.mode("overwrite").json(f"{path}/json")
    head = report.sparkSession.createDataFrame([(0, "| " + " | ".join((first, *numbers)) + " |"), (1, "|" + "-|" * (1 + len(numbers)))], "at int, line string")
    body = markdown_lines(report, first, numbers).select(F.lit(2).alias("at"), "line")
    head.union(body).orderBy("at", "line").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")  # a row for each kind of query


def stripped(answer, query, prefixes: tuple[str, ...]):
    """answer without the preambles, and the query given back, that it begins with, in the order of prefixes."""
    out = answer
    for p in (*map(F.lit, prefixes[:3]), F.concat(F.lit("Question: "), query), *map(F.lit, prefixes[3:])):
        bare = F.ltrim(out)
        out = F.when(F.startswith(bare, p), F.regexp_replace(F.substring(bare, F.length(p) + 1, F.length(bare)), r"^[ \n.,]+", "")).otherwise(out)
    return out


# How a model's answer begins that repeats its instructions.
PREAMBLES = ("I'll follow the instructions to provide an accurate response.", "I will follow the instructions to provide an accurate response.", "Based on the provided passages,", "Student question:")
