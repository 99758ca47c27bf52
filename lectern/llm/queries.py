"""The queries of the training-data problems, and SQL for those that have an equal in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import leaks, neardup, neighbours, packing, pairs, residue, scans, split
from lectern.sources.tables import table

CARD_SHINGLE, CARD_THRESHOLD = 3, 0.5


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every parsed document and chunk of more than 512 tokens, or with a token of more than 10,000 characters."""
    docs = table(spark, d, "parsed_documents").select(F.lit("document").alias("item_kind"), F.col("document_id").alias("item_id"), F.col("full_text").alias("text"))
    chunks = table(spark, d, "text_chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    return split.split_oversized(docs.union(chunks), ["item_kind", "item_id"], "text", max_chars=split.MAX_CHARS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The items of more than 512 tokens: those whose first piece comes out, but for long tokens alone."""
    return p1_pieces(spark, d).where(f"piece_index = 0 and item_tokens > {split.MAX_TOKENS}").select("item_kind", "item_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(table(spark, d, "page_contents"), table(spark, d, "text_chunks"))[0]


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every page and chunk with its text and the repaired text."""
    return scans.repair(table(spark, d, "page_contents"), table(spark, d, "text_chunks"))


def _collection(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.collection((table(spark, d, "embedded_chunks"), "chunk_id", "embedding"), (table(spark, d, "raptor_nodes"), "node_id", "embedding"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other vectors of every usable vector."""
    return neighbours.most_similar(_collection(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbours(spark, d).select(F.least("id", "nb").alias("id_a"), F.greatest("id", "nb").alias("id_b")).distinct()


def _cards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return neardup.near_duplicates(table(spark, d, "cards"), "card_id", text, CARD_THRESHOLD, CARD_SHINGLE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*_cards(spark, d)).select(F.col("a").alias("card_id_a"), F.col("b").alias("card_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every card with at least 12 words, its class of equal texts, and to how many other classes that is similar."""
    c = neardup.classes(*_cards(spark, d))
    return c.select(F.col("id").alias("card_id"), F.col("class").alias("class_id"), "links")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The similar pairs of classes with their similarity: with p4_classes, all similar pairs of cards."""
    return neardup.class_links(*_cards(spark, d)).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("jaccard", 6).alias("jaccard"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every card with at least 12 words, its group, and whether it is the one to keep."""
    g = neardup.groups(*_cards(spark, d))
    return g.select(F.col("id").alias("card_id"), F.col("group").alias("group_id"), "links", (F.col("id") == F.col("group")).alias("keep"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "cards").where("card_type = 'question'").select(F.col("card_id").alias("record_id"), F.col("content").alias("question"), "answer")
    both = table(spark, d, "qa_pairs").select(F.col("pair_id").alias("record_id"), "question", "answer").union(cards)
    return pairs.find_defects(both, "record_id", "question", "answer")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, or its pieces, in containers of 2,048 tokens."""
    return packing.containers(table(spark, d, "documents"), "doc_id", "text")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of each document, with the number of its words that stand in leaked windows."""
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_queries"), "item_id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The residue records with the number of their residue passages and the highest log odds."""
    return residue.find_residue(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_pieces, p1_found, p2_found, p2_repaired, p3_neighbours, p3_found, p4_found, p4_classes, p4_links, p4_groups, p5_found, p6_containers, p7_leaks, p7_found, p8_scores, p8_found)}

_TOKENS = r"len(regexp_extract_all({}, '[^\t\n\x0B\f\r \x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'))"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_SETS = f"""words AS (SELECT DISTINCT card_id, {_WORDS.format("concat_ws(' ', coalesce(title, ''), coalesce(content, ''))")} AS w FROM cards),
        grams AS (SELECT DISTINCT card_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT card_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 12)),
        of AS (SELECT card_id, min(card_id) OVER (PARTITION BY s) AS class_id FROM (SELECT card_id, string_agg(g, '|' ORDER BY g) AS s FROM grams GROUP BY 1)),
        own AS (SELECT * FROM grams WHERE card_id IN (SELECT class_id FROM of)), sizes AS (SELECT card_id, count(*) AS n FROM own GROUP BY 1),
        shared AS (SELECT a.card_id AS x, b.card_id AS y, count(*) AS m FROM own a JOIN own b ON a.g = b.g AND a.card_id < b.card_id GROUP BY ALL),
        links AS (SELECT x, y, m / (s.n + t.n - m) AS jaccard FROM shared JOIN sizes s ON x = s.card_id JOIN sizes t ON y = t.card_id WHERE m >= 0.5 * (s.n + t.n - m)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), degree AS (SELECT x AS class_id, count(*) AS n FROM both_ways GROUP BY 1)"""

SQL = {
    "p1_found": f"""
        SELECT DISTINCT 'document' AS item_kind, document_id AS item_id FROM parsed_documents WHERE {_TOKENS.format("full_text")} > 512
        UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM text_chunks WHERE {_TOKENS.format("text")} > 512""",
    "p3_found": """
        WITH raw AS (SELECT chunk_id AS id, embedding AS v FROM embedded_chunks UNION ALL SELECT node_id, embedding FROM raptor_nodes),
        fine AS (SELECT id, min(CAST(v AS DOUBLE[])) AS v FROM raw
          WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY id),
        near AS (SELECT a.id AS id, b.id AS nb, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r FROM fine a JOIN fine b ON a.id <> b.id)
        SELECT DISTINCT least(id, nb) AS id_a, greatest(id, nb) AS id_b FROM near WHERE r <= 5""",
    "p4_found": f"""
        WITH words AS (SELECT DISTINCT card_id, {_WORDS.format("concat_ws(' ', coalesce(title, ''), coalesce(content, ''))")} AS w FROM cards),
        grams AS (SELECT DISTINCT card_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT card_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 12)),
        sizes AS (SELECT card_id, count(*) AS n FROM grams GROUP BY card_id),
        shared AS (SELECT a.card_id AS x, b.card_id AS y, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.card_id < b.card_id GROUP BY ALL)
        SELECT x AS card_id_a, y AS card_id_b FROM shared JOIN sizes s ON x = s.card_id JOIN sizes t ON y = t.card_id WHERE m >= 0.5 * (s.n + t.n - m)""",
    "p4_classes": f"WITH {_SETS} SELECT card_id, class_id, coalesce(n, 0) AS links FROM of LEFT JOIN degree USING (class_id)",
    "p4_links": f"WITH {_SETS} SELECT x AS class_a, y AS class_b, round(jaccard, 6) AS jaccard FROM links",
    "p4_groups": f"""
        WITH RECURSIVE {_SETS}, reach AS (SELECT DISTINCT class_id AS x, class_id AS y FROM of UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
        roots AS (SELECT x AS class_id, min(y) AS group_id FROM reach GROUP BY 1)
        SELECT card_id, group_id, coalesce(n, 0) AS links, card_id = group_id AS keep FROM of JOIN roots USING (class_id) LEFT JOIN degree USING (class_id)""",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        e AS (SELECT DISTINCT item_id, {_WORDS.format("passage")} AS w FROM eval_queries WHERE passage IS NOT NULL),
        dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
        ew AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
}
