"""A graph of concepts: extraction, co-occurrence and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import words

PER_CHUNK, MIN_LENGTH, PREVIEW = 5, 6, 200


def mentions(chunks: DataFrame, per_chunk: int = PER_CHUNK, min_length: int = MIN_LENGTH) -> DataFrame:
    """(chunk_id, concept, pos): the first distinct words of at least min_length letters of (chunk_id, text), as stand-in for a model."""
    found = F.slice(F.filter(F.array_distinct(words(F.col("text"))), lambda w: w.rlike(rf"^\p{{L}}{{{min_length},}}$")), 1, per_chunk)
    return chunks.select("chunk_id", F.posexplode(found).alias("pos", "concept"))


def co_occurrence(m: DataFrame) -> DataFrame:
    """(a, b, weight): in how many chunks two concepts occur together, a < b; a chunk has few concepts, so pairs stay few."""
    x, y = m.select("chunk_id", F.col("concept").alias("a")).distinct(), m.select("chunk_id", F.col("concept").alias("b")).distinct()
    return x.join(y, "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def search(queries: DataFrame, m: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, chunk_id, concepts, matched, rank): chunks (chunk_id, ...) that mention a query's concepts (query_id, concept), most concepts first."""
    hit = queries.distinct().join(m.select("chunk_id", "concept").distinct(), "concept").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    g = hit.groupBy("query_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ", ").alias("concepts"), F.countDistinct("concept").alias("matched"))
    by = Window.partitionBy("query_id").orderBy(F.desc("matched"), "chunk_id")
    return g.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def reachable(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(concept, hop): concepts within hops steps of the starts (concept) over the edges (a, b), each with its fewest steps."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    seen = starts.select("concept").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        near = seen.where(F.col("hop") == h - 1).join(both, F.col("concept") == F.col("a")).select(F.col("b").alias("concept")).distinct()
        seen = seen.union(near.join(seen, "concept", "left_anti").withColumn("hop", F.lit(h)))
    return seen
