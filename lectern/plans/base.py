"""The views that queries start from, and the registry of queries with their equals in SQL.

Repeated rows are full copies, so a view is the distinct rows of the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The tenant of queries that search for one.
TENANT = "tenant_4214"
#: Labelled queries, at every size of the tables.
QUERY_SET = 240


def query(sql: str | None = None):
    """Registers a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def view(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return table(spark, d, name).select(*columns).distinct()


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return view(spark, d, "text_chunks", "chunk_id", *columns)


def cards(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return view(spark, d, "cards", "card_id", *columns)


def vector_table(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """(id, v): the usable vectors of a table, one row per id."""
    t = table(spark, d, name).select(F.col(key).alias("id"), F.col("embedding").alias("v")).where(vectors.usable(F.col("v")))
    return t.groupBy("id").agg(F.min("v").alias("v"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_table(spark, d, "embedded_chunks", "chunk_id")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, n, query, query_type, relevant_pages, calibrated, passage): the labelled queries, their pages folded into the five that documents have."""
    q = view(spark, d, "eval_queries", "item_id", "query", "query_type", "relevant_pages", "calibrated", "passage").where("item_id not like '\\\\_%'")
    return q.select(F.col("item_id").alias("query_id"), F.substring("item_id", 4, 9).cast("bigint").alias("n"), "query", "query_type", F.transform("relevant_pages", lambda x: x % 5 + 1).alias("relevant_pages"), "calibrated", "passage")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, v): the vector that stands in for each labelled query's embedding: that of a chunk chosen by a hash of its id."""
    chosen = chunk_vectors(spark, d).orderBy(F.md5("id"), "id").limit(QUERY_SET)
    chosen = chosen.select("v", (F.row_number().over(Window.orderBy(F.md5("id"), "id")) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("of"))  # a fixed number of rows
    return queries(spark, d).crossJoin(F.broadcast(chosen)).where(F.col("n") % F.col("of") == F.col("at")).select("query_id", "v")


def texts_of(spark: SparkSession, d: str, ids: DataFrame) -> DataFrame:
    """(id, text) of the chunks in ids (id); only their texts are moved."""
    c = table(spark, d, "text_chunks").select(F.col("chunk_id").alias("id"), "text")
    return c.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def every_hundredth(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, v): the vectors whose id is divisible by 100, as queries."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


# The same views in SQL.
CHUNKS = "(SELECT DISTINCT chunk_id, document_id, tenant_id, chunk_index, text, char_start, char_end, token_count, page_number, version, is_active FROM text_chunks)"
CARDS = "(SELECT DISTINCT card_id, chunk_id, document_id, tenant_id, card_type, title, content, answer, metadata_json, version, is_active FROM cards)"
DOCS = "(SELECT DISTINCT document_id, tenant_id, filename, full_text, page_count, char_count, title, subject, language FROM parsed_documents)"
PAGES = "(SELECT DISTINCT page_id, document_id, page_number, text, tables FROM page_contents)"
NODES = "(SELECT DISTINCT node_id, document_id, tenant_id, level, cluster_id, summary, child_ids, parent_id, version, is_active FROM raptor_nodes)"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def vectors_sql(name: str, key: str) -> str:
    return f"(SELECT {key} AS id, min(CAST(embedding AS DOUBLE[])) AS v FROM {name} WHERE {_USABLE} GROUP BY {key})"


CHUNK_VECTORS = vectors_sql("embedded_chunks", "chunk_id")
HUNDREDTH = "(SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0)"
QUERY_VECTORS = f"""(SELECT i.item_id AS query_id, x.v FROM (SELECT DISTINCT item_id, CAST(substr(item_id, 4) AS BIGINT) AS n FROM eval_queries WHERE item_id NOT LIKE '\\_%' ESCAPE '\\') i
    JOIN (SELECT v, row_number() OVER (ORDER BY md5(id), id) - 1 AS at, least({QUERY_SET}, count(*) OVER ()) AS total FROM {CHUNK_VECTORS}) x ON i.n % x.total = x.at)"""
SCOPED_VECTORS = f"(SELECT * FROM {CHUNK_VECTORS} WHERE id IN (SELECT chunk_id FROM text_chunks WHERE tenant_id IN ('{TENANT}', 'global')))"
