"""Search lanes, their fusion, routing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.functions.lineage import cut
from lectern.functions.text import words
from lectern.operators import concepts, evaluation, ranking, scope
from lectern.operators.cards import ARTIFACT_TYPES, key_facts
from lectern.plans.base import CARDS, CHUNK_VECTORS, CHUNKS, HUNDREDTH, NODES, PAGES, QUERY_VECTORS, SCOPED_VECTORS, TENANT, cards, chunk_vectors, chunks, every_hundredth, queries, query, query_vectors, texts_of, vector_table, vectors_sql, view
from lectern.sources.tables import table

# Pool of the dense lane, what is kept of it, what is shown, and the limits of the other lanes.
POOL, FETCH, SHOWN, SUMMARIES, LINKED, NEAR_CONCEPTS = 50, 20, 6, 2, 3, 8
# Which lanes an intent uses (vector, raptor, graph, visual), and from which score on an intent counts.
ROUTES = {"factual": (True, False, False, False), "overview": (True, True, False, False), "multihop": (True, False, True, False), "visual": (False, False, False, True), "mixed": (True, True, True, False)}
INTENT_THRESHOLD = 0.30

_BLANK = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{_BLANK}|{_BLANK}$', '', 'g')"


_COS = "round(list_cosine_similarity(q.v, x.v), 9)"


def _knn_sql(source: str, queries_sql: str, k: int, where: str = "true") -> str:
    return f"""SELECT query_id, id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT query_id, x.id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank
        FROM {source} x, {queries_sql} q WHERE {where}) WHERE rank <= {k}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def _scoped_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d, "tenant_id").where(scope.in_scope(F.col("tenant_id"), None, TENANT)).select(F.col("chunk_id").alias("id"))
    return chunk_vectors(spark, d).join(own, "id", "left_semi")


@query(_knn_sql(CHUNK_VECTORS, HUNDREDTH, 10))
def jn_vec_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest chunks of every vector whose id is divisible by 100."""
    return _rounded(ranking.knn(chunk_vectors(spark, d), every_hundredth(spark, d), 10))


@query(_knn_sql(SCOPED_VECTORS, QUERY_VECTORS, 10))
def r_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest chunks in a tenant's scope for every labelled query."""
    return _rounded(ranking.knn(_scoped_vectors(spark, d), query_vectors(spark, d), 10))


@query(_knn_sql(vectors_sql("raptor_nodes", "node_id"), QUERY_VECTORS, SUMMARIES, f"x.id IN (SELECT node_id FROM {NODES} WHERE is_active AND tenant_id IN ('{TENANT}', 'global'))"))
def r_raptor(spark: SparkSession, d: str) -> DataFrame:
    """The nearest summaries in scope for every labelled query."""
    own = view(spark, d, "raptor_nodes", "node_id", "tenant_id", "is_active").where("is_active").where(scope.in_scope(F.col("tenant_id"), None, TENANT))
    v = vector_table(spark, d, "raptor_nodes", "node_id").join(own.select(F.col("node_id").alias("id")), "id", "left_semi")
    return _rounded(ranking.knn(v, query_vectors(spark, d), SUMMARIES))


@query(f"""SELECT c.chunk_id, coalesce(x.v IS NOT NULL, false) AS has_vector, round(coalesce(sqrt(list_dot_product(x.v, x.v)), 0), 4) AS norm FROM (SELECT DISTINCT chunk_id FROM text_chunks) c LEFT JOIN {CHUNK_VECTORS} x ON c.chunk_id = x.id""")
def jn_vec_attach(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its vector, or the zero vector where it has none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), vectors.DIM)
    j = chunks(spark, d).join(chunk_vectors(spark, d), F.col("chunk_id") == F.col("id"), "left")
    return j.select("chunk_id", F.col("v").isNotNull().alias("has_vector"), F.round(vectors.norm(F.coalesce("v", zero)), 4).alias("norm"))


@query(f"""SELECT label, count(*) AS n FROM (SELECT CASE WHEN s >= 0.65 THEN 'Very relevant' WHEN s >= 0.55 THEN 'Highly relevant' WHEN s >= 0.45 THEN 'Relevant' WHEN s >= 0.35 THEN 'Somewhat relevant' ELSE 'Loosely related' END AS label
    FROM (SELECT round({_COS}, 4) AS s FROM {CHUNK_VECTORS} x, {QUERY_VECTORS} q)) GROUP BY 1""")
def case_relevance(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of labelled query and chunk each step of relevance holds."""
    scores = ranking.score_counts(chunk_vectors(spark, d), query_vectors(spark, d), 4)
    return scores.groupBy(scope.relevance_label(F.col("score")).alias("label")).agg(F.sum("n").alias("n"))


def _query_terms(q: DataFrame) -> DataFrame:
    return q.select(F.col("query_id"), F.explode(words(F.col("query"))).alias("term")).distinct().withColumn("w", F.lit(1.0))


def _chunk_postings(spark: SparkSession, d: str) -> DataFrame:
    return ranking.postings(chunks(spark, d, "text").select(F.col("chunk_id").alias("id"), "text"), words(F.col("text")))


def _sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k chunks in scope of largest sparse product for every labelled query."""
    c = chunks(spark, d, "text", "tenant_id").where(scope.in_scope(F.col("tenant_id"), None, TENANT)).select(F.col("chunk_id").alias("id"), "text")
    return ranking.sparse_search(c, words(F.col("text")), _query_terms(queries(spark, d)), k)


_SPARSE = f"""t AS (SELECT chunk_id AS id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {CHUNKS} WHERE tenant_id IN ('{TENANT}', 'global')) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(DISTINCT chunk_id) AS n FROM text_chunks WHERE tenant_id IN ('{TENANT}', 'global')),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM eval_queries WHERE item_id NOT LIKE '\\_%' ESCAPE '\\'),
    sp AS (SELECT query_id, id, round(sum(ln(1 + tf) * ln(1 + n / df)), 6) AS score FROM qt JOIN t USING (term) JOIN df USING (term), n GROUP BY 1, 2),
    sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp)"""


@query(f"WITH {_SPARSE} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM sparse WHERE rank <= 10")
def r_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The 10 chunks in scope of largest sparse product for every labelled query."""
    return _sparse(spark, d, 10)


def _dense_and_sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    dense, sparse = ranking.knn(_scoped_vectors(spark, d), query_vectors(spark, d), k), _sparse(spark, d, k)
    columns = ("query_id", "id", "score", "rank")
    return dense.select(*columns).withColumn("list_no", F.lit(0)).unionByName(sparse.select(*columns).withColumn("list_no", F.lit(1)))


@query(f"""WITH {_SPARSE}, dense AS (SELECT query_id, x.id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {SCOPED_VECTORS} x, {QUERY_VECTORS} q),
    both_lists AS (SELECT query_id, id, rank, 0 AS l FROM dense WHERE rank <= 30 UNION ALL SELECT query_id, id, rank, 1 FROM sparse WHERE rank <= 30),
    fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, min(l * 1000 + rank) AS first FROM both_lists GROUP BY 1, 2)
    SELECT query_id, id, rrf_score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, id) AS r FROM fused) WHERE r <= 10""")
def r_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse lanes in scope, of three times the limit, fused by reciprocal rank."""
    return ranking.rrf(_dense_and_sparse(spark, d, 30)).where("rank <= 10").select("query_id", "id", "rrf_score", "rank")


@query(f"""WITH {_SPARSE} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS share FROM sparse WHERE rank <= 10""")
def agg_max_norm(spark: SparkSession, d: str) -> DataFrame:
    """Sparse scores as shares of each query's best."""
    hits = _sparse(spark, d, 10)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.select("query_id", "id", F.round(F.col("score") / F.coalesce(F.nullif(best, F.lit(0.0)), F.lit(1.0)), 4).alias("share"))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """(id, chunk_id, text): the cards of the artifact lane in a tenant's scope, with what of each is searched."""
    c = cards(spark, d, "chunk_id", "card_type", "tenant_id", "title", "content", "answer", "is_active").where("is_active").where(F.col("card_type").isin(*ARTIFACT_TYPES)).where(scope.in_scope(F.col("tenant_id"), None, TENANT))
    said = scope.embed_text(F.col("card_type"), F.col("title"), F.col("content"), F.col("answer"))
    return c.select(F.col("card_id").alias("id"), "chunk_id", said.alias("text"))


def artifact_hits(spark: SparkSession, d: str, shown: DataFrame, k: int) -> DataFrame:
    """The k cards of largest sparse product for every labelled query."""
    return ranking.sparse_search(shown, words(F.col("text")), _query_terms(queries(spark, d)), k)


def _tokens(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return texts_of(spark, d, hits).select("id", F.array_distinct(words(F.col("text"))).alias("tokens"))


def _diverse(spark: SparkSession, d: str) -> DataFrame:
    dense = cut(ranking.knn(_scoped_vectors(spark, d), query_vectors(spark, d), POOL))
    return ranking.mmr(dense.join(_tokens(spark, d, dense), "id").select("query_id", "id", "score", "rank", "tokens"), FETCH)


def _funnel(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, score, rank, lane): dense pool in scope, diversified, then new parents of artifact hits behind it."""
    hits = artifact_hits(spark, d, artifacts(spark, d), FETCH)
    more = ranking.parents(hits, cards(spark, d, "chunk_id").select(F.col("card_id").alias("id"), "chunk_id"), chunks(spark, d).select(F.col("chunk_id").alias("id")))
    return ranking.append_new(_diverse(spark, d), more)


def _shown(spark: SparkSession, d: str) -> DataFrame:
    f = cut(_funnel(spark, d))
    q = queries(spark, d).select("query_id", F.array_distinct(words(F.col("query"))).alias("q"))
    return ranking.rerank(f.join(q, "query_id").join(_tokens(spark, d, f), "id"), F.round(ranking.overlap(F.col("q"), F.col("tokens")), 6), SHOWN)


@query()
def r_funnel(spark: SparkSession, d: str) -> DataFrame:
    """The whole funnel: dense pool of 50, diversified to 20, parents of card hits appended, 6 left by token overlap with the query."""
    return _shown(spark, d).select("query_id", "id", F.round("score", 6).alias("score"), "rerank_score", "lane", "rank")


@query()
def itr_mmr(spark: SparkSession, d: str) -> DataFrame:
    """The diversified 20 of the dense pool of 50 in scope, for every labelled query."""
    return _rounded(_diverse(spark, d))


_HITS = f"""hits AS (SELECT query_id, x.id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {CHUNK_VECTORS} x, {QUERY_VECTORS} q),
    top AS (SELECT h.query_id, h.rank, h.score, c.page_number AS page FROM hits h JOIN (SELECT DISTINCT chunk_id, page_number FROM text_chunks) c ON h.id = c.chunk_id WHERE rank <= 20),
    rel AS (SELECT DISTINCT item_id AS query_id, query_type, calibrated, list_distinct(list_transform(relevant_pages, lambda x: x % 5 + 1)) AS pages FROM eval_queries WHERE query_type <> 'visual' AND relevant_pages IS NOT NULL AND item_id NOT LIKE '\\_%' ESCAPE '\\'),
    x AS (SELECT rel.*, top.rank, top.score, top.page, coalesce(list_contains(pages, page), false) AS hit FROM rel LEFT JOIN top USING (query_id)),
    m AS (SELECT query_id, any_value(query_type) AS query_type, any_value(calibrated) AS calibrated, len(any_value(pages)) AS n,
      round(count(DISTINCT page) FILTER (hit AND score >= 0.45) / len(any_value(pages)), 4) AS recall, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 4) AS mrr,
      round(count(*) FILTER (hit AND rank <= 6) / 6, 4) AS precision, round(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 6), 0) / any_value(list_sum(list_transform(range(1, least(len(pages), 6) + 1), lambda i: 1 / log2(i + 1)))), 4) AS ndcg FROM x GROUP BY 1)"""


def _metrics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = queries(spark, d).where("query_type != 'visual' and relevant_pages is not null")
    page = chunks(spark, d, "page_number").select(F.col("chunk_id").alias("id"), F.col("page_number").alias("page"))
    hits = ranking.knn(chunk_vectors(spark, d), query_vectors(spark, d), FETCH).join(page, "id").select("query_id", "page", "score", "rank")
    return evaluation.retrieval_metrics(hits, q.select("query_id", F.col("relevant_pages").alias("pages"))), q


@query(f"WITH {_HITS} SELECT query_id, recall, mrr, precision, ndcg FROM m")
def agg_ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, mrr, precision and ndcg of every labelled query with pages."""
    return _metrics(spark, d)[0]


@query(f"""WITH {_HITS} SELECT coalesce(query_type, 'overall') AS query_type, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(precision), 4) AS precision, round(avg(ndcg), 4) AS ndcg, count(*) AS n_queries, count(*) FILTER (calibrated) AS n_calibrated
    FROM m GROUP BY GROUPING SETS ((), (query_type))""")
def agg_metric_report(spark: SparkSession, d: str) -> DataFrame:
    """The measures' means, overall and by type of query."""
    m, q = _metrics(spark, d)
    return evaluation.metric_report(m.join(q.select("query_id", "query_type", "calibrated"), "query_id"), "query_type", "calibrated").withColumn("query_type", F.coalesce("query_type", F.lit("overall")))


_REPORT = ("recall", "mrr", "precision", "ndcg", "n_queries", "n_calibrated")


@query(f"""WITH {_HITS}, r AS (SELECT coalesce(query_type, 'overall') AS query_type, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(precision), 4) AS precision, round(avg(ndcg), 4) AS ndcg, count(*) AS n_queries, count(*) FILTER (calibrated) AS n_calibrated FROM m GROUP BY GROUPING SETS ((), (query_type)))
    SELECT '| ' || query_type || ' | ' || {" || ' | ' || ".join(f"coalesce(printf('%.4f', CAST({n} AS DOUBLE)), '-')" for n in _REPORT)} || ' |' AS line FROM r""")
def snk_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the evaluation report's Markdown table (see evaluation.write_report)."""
    return evaluation.markdown_lines(agg_metric_report(spark, d), "query_type", _REPORT)


@query(f"""SELECT h.query_id, round(list_sum(list_transform(q.v, lambda a: list_max(list_transform(h.patches, lambda p: list_dot_product(a, p))))), 3) AS score, h.document_id, h.page_number FROM
    (SELECT 0 AS query_id, document_id, page_number, list(v ORDER BY chunk_id) AS patches FROM {CHUNKS} c JOIN {CHUNK_VECTORS} x ON c.chunk_id = x.id WHERE page_number IS NOT NULL GROUP BY 2, 3) h,
    (SELECT list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS v FROM embeddings WHERE vec_id % 100 = 0 AND vec_id < 3200) q""")
def jn_maxsim(spark: SparkSession, d: str) -> DataFrame:
    """Late interaction: the score of every page, as the set of its chunks' vectors, for one query, a matrix of at most 32 vectors."""
    c = chunks(spark, d, "document_id", "page_number").where("page_number is not null").join(chunk_vectors(spark, d), F.col("chunk_id") == F.col("id"))
    pages = c.groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "v"))), lambda x: x["v"]).alias("patches"))
    q = every_hundredth(spark, d).where("query_id < 3200").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "v"))), lambda x: x["v"]).alias("q"))  # one row of 32 vectors
    return pages.crossJoin(F.broadcast(q)).select(F.lit(0).alias("query_id"), F.round(vectors.maxsim(F.col("q"), F.col("patches")), 3).alias("score"), "document_id", "page_number")


@query(f"""SELECT vec_id, CASE WHEN score > {INTENT_THRESHOLD} THEN intent ELSE 'mixed' END AS intent, round(score, 4) AS score FROM (SELECT vec_id, intent, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, o) AS n FROM
    (SELECT e.vec_id, p.label AS o, ['factual', 'overview', 'multihop', 'visual'][p.label + 1] AS intent, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) AS score FROM embeddings e,
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE label < 4) WHERE n <= 8) p GROUP BY ALL)) WHERE n = 1""")
def r_route(spark: SparkSession, d: str) -> DataFrame:
    """The intent of every vector: the one of its nearest prototype, or mixed below the threshold."""
    e = table(spark, d, "embeddings")
    p = e.where("label < 4").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 8").select("label", F.col("embedding").alias("p"))
    s = e.select("vec_id", "embedding").crossJoin(F.broadcast(p)).groupBy("vec_id", "label").agg(F.max(vectors.cosine(F.col("embedding"), F.col("p"))).alias("score"))  # 32 prototypes
    best = s.groupBy("vec_id").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("o"), F.max("score").alias("score"))
    names = F.array(*map(F.lit, list(ROUTES)[:4]))
    return best.select("vec_id", F.when(F.col("score") > INTENT_THRESHOLD, F.get(names, F.col("o"))).otherwise("mixed").alias("intent"), F.round("score", 4).alias("score"))


@query(f"""SELECT vec_id, label, use_vector, use_raptor FROM (SELECT vec_id, label, label % 5 <> 3 AS use_vector, label % 5 IN (1, 4) AS use_raptor FROM embeddings)""")
def r_routemap(spark: SparkSession, d: str) -> DataFrame:
    """Which lanes each vector's intent (its label, modulo 5) would use."""
    m = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(r).alias("r")) for v, r, _, _ in ROUTES.values()))
    return table(spark, d, "embeddings").withColumn("x", F.get(m, F.col("label") % 5)).select("vec_id", "label", F.col("x.v").alias("use_vector"), F.col("x.r").alias("use_raptor"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return concepts.mentions(chunks(spark, d, "text"))


_MENTIONS = f"""men AS (SELECT chunk_id, unnest(l) AS concept, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT chunk_id, (list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}{{6,}}')))[1:5] AS l FROM
    (SELECT chunk_id, list_transform(list_filter(list_transform(t, lambda x, i: [x, CAST(list_position(t, x) = i AS VARCHAR)]), lambda p: p[2] = 'true'), lambda p: p[1]) AS w FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {CHUNKS}))))"""


def typed_concepts(spark: SparkSession, d: str) -> DataFrame:
    """(concept, type, mentions): every concept with the type of its first mention, topic where it begins a chunk, else term."""
    kind = F.when(F.col("pos") == 0, "topic").otherwise("term")
    return _mentions(spark, d).groupBy("concept").agg(F.min_by(kind, F.struct("chunk_id", "pos")).alias("type"), F.count("*").alias("mentions"))


@query(f"WITH {_MENTIONS} SELECT concept, arg_min(CASE WHEN pos = 0 THEN 'topic' ELSE 'term' END, (chunk_id, pos)) AS type, count(*) AS mentions FROM men GROUP BY 1")
def agg_concept_unique(spark: SparkSession, d: str) -> DataFrame:
    """The concepts, the first type of each, and in how many chunks it is mentioned."""
    return typed_concepts(spark, d)


@query(f"WITH {_MENTIONS} SELECT x.concept AS a, y.concept AS b, count(*) AS weight FROM men x JOIN men y ON x.chunk_id = y.chunk_id AND x.concept < y.concept GROUP BY 1, 2")
def agg_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    """The co-occurrence edges of the concept graph."""
    return concepts.co_occurrence(_mentions(spark, d))


@query(f"""WITH {_MENTIONS} SELECT (SELECT count(DISTINCT document_id) FROM text_chunks) AS n_docs, (SELECT count(DISTINCT chunk_id) FROM text_chunks) AS n_chunks, (SELECT count(*) FROM men) AS n_concepts,
    (SELECT count(*) FROM men) + (SELECT 2 * count(DISTINCT chunk_id) - count(DISTINCT chunk_id) FILTER (page_number IS NULL) FROM text_chunks) + (SELECT count(*) FROM men x JOIN men y ON x.chunk_id = y.chunk_id AND x.concept < y.concept) AS n_edges""")
def agg_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """How much is merged into the graph: concepts and edges count mentions and merges, not what is left of them."""
    t = chunks(spark, d, "document_id", "page_number")
    c = t.agg(F.countDistinct("document_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.count_if(F.col("page_number").isNotNull()).alias("paged"))
    m = _mentions(spark, d).agg(F.count("*").alias("n_concepts"))
    pairs = concepts.co_occurrence(_mentions(spark, d)).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("merges"))
    return c.crossJoin(m).crossJoin(pairs).select("n_docs", "n_chunks", "n_concepts", (F.col("n_concepts") + F.col("n_chunks") + F.col("paged") + F.col("merges")).alias("n_edges"))  # one row each


def _near_concepts(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, concept, score, rank): the eight concepts nearest to every labelled query; a concept's vector is the mean over its chunks."""
    m = _mentions(spark, d).join(chunk_vectors(spark, d), F.col("chunk_id") == F.col("id")).groupBy("concept").agg(vectors.mean_vector(F.col("v")).alias("v"))
    near = ranking.knn(m.select(F.col("concept").alias("id"), "v").where(vectors.norm(F.col("v")) > 0), query_vectors(spark, d), NEAR_CONCEPTS)
    return near.select("query_id", F.col("id").alias("concept"), F.round("score", 4).alias("score"), "rank")


_CONCEPTS = f"""{_MENTIONS}, mv AS (SELECT concept, list(x ORDER BY i) AS v FROM (SELECT concept, i, avg(v[i]) AS x FROM (SELECT concept, v, unnest(range(1, 65)) AS i FROM men JOIN {CHUNK_VECTORS} cv ON men.chunk_id = cv.id) GROUP BY 1, 2) GROUP BY 1),
    tc AS (SELECT query_id, concept, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept) AS rank FROM
      (SELECT query_id, concept, {_COS} AS score FROM mv x, {QUERY_VECTORS} q) WHERE score IS NOT NULL) WHERE rank <= {NEAR_CONCEPTS})"""


@query(f"WITH {_CONCEPTS} SELECT * FROM tc")
def top_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The eight concepts nearest to every labelled query."""
    return _near_concepts(spark, d)


@query(f"""WITH {_CONCEPTS}, g AS (SELECT query_id, chunk_id, string_agg(DISTINCT concept, ', ' ORDER BY concept) AS concepts, count(DISTINCT concept) AS matched FROM tc JOIN men USING (concept) JOIN {CHUNKS} c USING (chunk_id) WHERE c.tenant_id IN ('{TENANT}', 'global') GROUP BY 1, 2)
    SELECT query_id, chunk_id, concepts, matched, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, chunk_id) AS rank FROM g) WHERE rank <= 5""")
def r_graph(spark: SparkSession, d: str) -> DataFrame:
    """The chunks in scope that mention most of the eight concepts nearest to a query."""
    c = chunks(spark, d, "tenant_id").where(scope.in_scope(F.col("tenant_id"), None, TENANT))
    return concepts.search(_near_concepts(spark, d).select("query_id", "concept"), _mentions(spark, d), c)


@query(f"""WITH hits AS (SELECT * FROM (SELECT query_id, x.id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {SCOPED_VECTORS} x, {QUERY_VECTORS} q) WHERE rank <= {SHOWN}),
    c AS (SELECT query_id, card_id, content, row_number() OVER (PARTITION BY query_id ORDER BY rank, card_id) AS n FROM hits JOIN (SELECT card_id, chunk_id, content FROM {CARDS} WHERE is_active AND card_type IN ('definition', 'factoid', 'formula')) k ON hits.id = k.chunk_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(lower({_strip("content")}), 1, 200) ORDER BY n) AS nth FROM c WHERE n <= 16 AND lower({_strip("content")}) NOT IN ('n/a', 'none', 'not applicable', 'null', ''))
    SELECT query_id, card_id, content, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) AS INT) AS rank FROM f WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n) <= 8""")
def r_keyfacts(spark: SparkSession, d: str) -> DataFrame:
    """Key facts for the first six chunks in scope of every labelled query."""
    hits = ranking.knn(_scoped_vectors(spark, d), query_vectors(spark, d), SHOWN)
    return key_facts(hits, cards(spark, d, "chunk_id", "card_type", "content", "is_active").where("is_active"))


@query(f"""SELECT query_id, p.page_id FROM (SELECT query_id, document_id, page_number FROM (SELECT query_id, x.id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {CHUNK_VECTORS} x, {QUERY_VECTORS} q) h
    JOIN {CHUNKS} c ON h.id = c.chunk_id WHERE rank <= 5 AND page_number IS NOT NULL GROUP BY ALL) JOIN (SELECT DISTINCT page_id, document_id, page_number FROM {PAGES}) p USING (document_id, page_number)""")
def jn_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that the first five chunks of every labelled query stand on."""
    hits = ranking.knn(chunk_vectors(spark, d), query_vectors(spark, d), 5).join(chunks(spark, d, "document_id", "page_number"), F.col("id") == F.col("chunk_id")).select("query_id", "document_id", "page_number").distinct()
    return hits.join(view(spark, d, "page_contents", "page_id", "document_id", "page_number"), ["document_id", "page_number"]).select("query_id", "page_id")


@query()
def r_ask(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, lane, id, rank): the passages of every labelled query, from the lanes its kind of question uses."""
    lanes = queries(spark, d).select("query_id", F.get(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("v", "r", "g"), flags))) for flags in ROUTES.values())), F.coalesce(F.array_position(F.array(*map(F.lit, ROUTES)), F.col("query_type")).cast("int") - 1, F.lit(4))).alias("use"))
    funnel = _shown(spark, d).select("query_id", F.lit("chunk").alias("lane"), "id", "rank")
    raptor = r_raptor(spark, d).join(lanes, "query_id").where("use.r").select("query_id", F.lit("summary"), "id", "rank")
    graph = r_graph(spark, d).where(F.col("rank") <= LINKED).join(lanes, "query_id").where("use.g").select("query_id", F.lit("concept"), F.col("chunk_id"), "rank")
    return funnel.union(raptor).union(graph)
