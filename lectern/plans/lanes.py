"""The steps inside the search lanes: artifact parents, claims, concepts, ranks and late interaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.functions.lineage import cut
from lectern.functions.text import words
from lectern.operators import concepts, ranking, scope
from lectern.operators.cards import ARTIFACT_TYPES
from lectern.plans import retrieval
from lectern.plans.base import CARDS, CHUNK_VECTORS, CHUNKS, PAGES, QUERY_VECTORS, SCOPED_VECTORS, SQL, TENANT, cards, chunk_vectors, chunks, queries, query, query_vectors, view
from lectern.plans.retrieval import _CONCEPTS, _COS, _HITS, _MENTIONS, _SPARSE, FETCH, LINKED, SHOWN, SUMMARIES, _knn_sql, _rounded
from lectern.sources.tables import table

#: From which share of a claim's words on a passage supports it, in the stand-in for a model's verdict.
SUPPORTED = 0.5

_W = r"'[\p{L}\p{N}]+'"
_ARTIFACTS = f"""shown AS (SELECT card_id AS id, chunk_id, CASE WHEN card_type = 'question' THEN concat_ws(chr(10), content, answer) ELSE coalesce(title, '') || ': ' || coalesce(content, '') END AS text
      FROM {CARDS} WHERE is_active AND tenant_id IN ('{TENANT}', 'global') AND card_type IN ({", ".join(f"'{t}'" for t in ARTIFACT_TYPES)})),
    t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM shown) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM shown),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(query), {_W})) AS term FROM eval_queries WHERE item_id NOT LIKE '\\_%' ESCAPE '\\'),
    sp AS (SELECT query_id, id, round(sum(ln(1 + tf) * ln(1 + n / df)), 6) AS score FROM qt JOIN t USING (term) JOIN df USING (term), n GROUP BY 1, 2),
    da AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM sp) WHERE rank <= {FETCH}),
    known AS (SELECT query_id, da.id AS card_id, chunk_id AS id, score, rank FROM da JOIN shown USING (id) WHERE chunk_id IN (SELECT chunk_id FROM text_chunks))"""


@query(f"WITH {_ARTIFACTS} SELECT query_id, id, score, rank FROM da")
def r_da(spark: SparkSession, d: str) -> DataFrame:
    """The artifact lane: the 20 cards in scope nearest to every labelled query."""
    return retrieval.artifact_hits(spark, d, retrieval.artifacts(spark, d), FETCH)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    shown = retrieval.artifacts(spark, d)
    hits = retrieval.artifact_hits(spark, d, shown, FETCH).withColumnRenamed("id", "card_id")
    j = hits.join(shown.select(F.col("id").alias("card_id"), F.col("chunk_id").alias("id")), "card_id")
    return j.join(chunks(spark, d).select(F.col("chunk_id").alias("id")), "id", "left_semi").select("query_id", "card_id", "id", "score", "rank")


@query(f"WITH {_ARTIFACTS} SELECT * FROM known")
def jn_da_parent(spark: SparkSession, d: str) -> DataFrame:
    """Every artifact hit with its parent chunk, in the order of the hits; unknown parents drop out, a chunk may repeat."""
    return _parents(spark, d)


@query(f"""WITH {_ARTIFACTS}, dense AS (SELECT query_id, x.id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS r FROM {SCOPED_VECTORS} x, {QUERY_VECTORS} q),
    firsts AS (SELECT query_id, id, min(rank) AS hit FROM known GROUP BY 1, 2)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit, id) AS INT) AS behind FROM firsts WHERE (query_id, id) NOT IN (SELECT query_id, id FROM dense WHERE r <= {FETCH})""")
def jn_da_expand(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the artifact lane adds behind the 20 dense hits, each by its first hit."""
    first = _parents(spark, d).groupBy("query_id", "id").agg(F.min("rank").alias("hit"))
    dense = ranking.knn(retrieval._scoped_vectors(spark, d), query_vectors(spark, d), FETCH)
    return ranking.ranked(first.join(dense, ["query_id", "id"], "left_anti"), "hit", "id", name="behind").drop("hit")


@query(f"""WITH {_SPARSE}, dense AS (SELECT query_id, x.id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {SCOPED_VECTORS} x, {QUERY_VECTORS} q)
    SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, round(max(score), 6) AS score, count(*) AS lists FROM (SELECT query_id, id, rank, score FROM dense WHERE rank <= {FETCH} UNION ALL SELECT query_id, id, rank, score FROM sparse WHERE rank <= {FETCH}) GROUP BY 1, 2""")
def agg_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of the dense and the sparse 20, with the best score and the number of lists of each chunk."""
    fused = ranking.rrf(retrieval._dense_and_sparse(spark, d, FETCH))
    return fused.select("query_id", "id", "rrf_score", F.round("score", 6).alias("score"), "lists")


@query(f"SELECT * FROM ({_knn_sql(CHUNK_VECTORS, QUERY_VECTORS, FETCH)}) WHERE score >= 0.45")
def flt_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The hits that count for recall: those of the dense 20 with a score of at least 0.45."""
    return _rounded(ranking.knn(chunk_vectors(spark, d), query_vectors(spark, d), FETCH)).where("score >= 0.45")


@query(_knn_sql(CHUNK_VECTORS, QUERY_VECTORS, 10, "query_id IN (SELECT item_id FROM eval_queries WHERE NOT calibrated AND query_type <> 'visual')"))
def r_calibrate(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest chunks of every labelled query whose pages are still to be confirmed."""
    open_ones = queries(spark, d).where("not calibrated and query_type != 'visual'").select("query_id")
    return _rounded(ranking.knn(chunk_vectors(spark, d), query_vectors(spark, d).join(open_ones, "query_id", "left_semi"), 10))


@query(f"""WITH hits AS (SELECT query_id, x.id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {SCOPED_VECTORS} x, {QUERY_VECTORS} q),
    q AS (SELECT DISTINCT item_id AS query_id, list_distinct(regexp_extract_all(lower(query), {_W})) AS qw FROM eval_queries), c AS (SELECT chunk_id AS id, list_distinct(regexp_extract_all(lower(text), {_W})) AS cw FROM {CHUNKS}),
    s AS (SELECT query_id, id, rank, round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw)) / len(qw) ELSE 0 END, 6) AS rerank_score FROM hits JOIN q USING (query_id) JOIN c USING (id) WHERE rank <= {FETCH})
    SELECT query_id, id, rerank_score, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS n FROM s) WHERE n <= {SHOWN}""")
def r_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The dense 20 in scope of every labelled query cut to 6 by token overlap, the stand-in for a cross encoder."""
    hits = cut(ranking.knn(retrieval._scoped_vectors(spark, d), query_vectors(spark, d), FETCH))
    q = queries(spark, d).select("query_id", F.array_distinct(words(F.col("query"))).alias("qw"))
    return ranking.rerank(hits.join(q, "query_id").join(retrieval._tokens(spark, d, hits), "id"), F.round(ranking.overlap(F.col("qw"), F.col("tokens")), 6), SHOWN).select("query_id", "id", "rerank_score", "rank")


@query(f"SELECT query_id, id, score, rank FROM ({_knn_sql(SCOPED_VECTORS, QUERY_VECTORS, FETCH)}) WHERE rank <= {SHOWN}")
def top_stub_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in without a model: the first 6 of the dense 20 as they are."""
    return ranking.first_of(_rounded(ranking.knn(retrieval._scoped_vectors(spark, d), query_vectors(spark, d), FETCH)), SHOWN)


def _relevance(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, pages, page, rank, hit): the dense 20 of every labelled query with pages, and whether each is relevant."""
    q = queries(spark, d).where("query_type != 'visual' and relevant_pages is not null").select("query_id", F.array_distinct("relevant_pages").alias("pages"))
    page = chunks(spark, d, "page_number").select(F.col("chunk_id").alias("id"), F.col("page_number").alias("page"))
    hits = ranking.knn(chunk_vectors(spark, d), query_vectors(spark, d), FETCH).join(page, "id").select("query_id", "page", "rank")
    return q.join(hits, "query_id", "left").withColumn("hit", F.coalesce(F.array_contains("pages", F.col("page")), F.lit(False)))


@query(f"WITH {_HITS} SELECT query_id, CAST(coalesce(min(rank) FILTER (hit), 0) AS INT) AS first_rank FROM x GROUP BY 1")
def win_first_rel(spark: SparkSession, d: str) -> DataFrame:
    """The rank of each labelled query's first relevant hit, 0 without one."""
    return _relevance(spark, d).groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0)).alias("first_rank"))


@query(f"WITH {_HITS} SELECT query_id, round(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 6), 0), 4) AS dcg FROM x GROUP BY 1")
def win_dcg(spark: SparkSession, d: str) -> DataFrame:
    """The discounted gain of each labelled query's first six hits."""
    gain = F.when(F.col("hit") & (F.col("rank") <= SHOWN), 1.0 / F.log2(F.col("rank") + 1.0))
    return _relevance(spark, d).groupBy("query_id").agg(F.round(F.coalesce(F.sum(gain), F.lit(0.0)), 4).alias("dcg"))


@query(f"WITH {_HITS} SELECT query_id, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (hit)), ','), '') AS found, len(any_value(pages)) AS wanted FROM x GROUP BY 1")
def set_intersect_pages(spark: SparkSession, d: str) -> DataFrame:
    """The relevant pages among the hits of each labelled query, and how many are wanted."""
    found = F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("page")))).cast("array<string>"), ",")
    return _relevance(spark, d).groupBy("query_id").agg(found.alias("found"), F.max(F.size("pages")).cast("bigint").alias("wanted"))


@query(f"""SELECT query_id, 0 AS lane, id, rank FROM ({SQL["r_search"]}) WHERE rank <= {SHOWN} UNION ALL SELECT query_id, 1, id, rank FROM ({SQL["r_raptor"]}) WHERE rank <= {SUMMARIES}
    UNION ALL SELECT query_id, 2, chunk_id, rank FROM ({SQL["r_graph"]}) WHERE rank <= {LINKED}""")
def set_append(spark: SparkSession, d: str) -> DataFrame:
    """The lanes one behind the other: chunks, summaries, concept-linked chunks."""
    lane = lambda t, n, key, k: t.where(F.col("rank") <= k).select("query_id", F.lit(n).alias("lane"), F.col(key).alias("id"), "rank")
    return lane(retrieval.r_search(spark, d), 0, "id", SHOWN).union(lane(retrieval.r_raptor(spark, d), 1, "id", SUMMARIES)).union(lane(retrieval.r_graph(spark, d), 2, "chunk_id", LINKED))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d, "tenant_id").where(scope.in_scope(F.col("tenant_id"), None, TENANT))
    return retrieval._near_concepts(spark, d).select("query_id", "concept").join(retrieval._mentions(spark, d), "concept").join(own, "chunk_id", "left_semi").select("query_id", "chunk_id", "concept")


_MATCHED = f"""{_CONCEPTS}, g AS (SELECT query_id, chunk_id, concept FROM tc JOIN men USING (concept) JOIN {CHUNKS} c USING (chunk_id) WHERE c.tenant_id IN ('{TENANT}', 'global'))"""


@query(f"WITH {_MATCHED} SELECT * FROM g")
def jn_graph_match(spark: SparkSession, d: str) -> DataFrame:
    """The edges from every labelled query over the eight concepts nearest to it to the chunks in scope that mention them."""
    return _matched(spark, d)


@query(f"WITH {_MATCHED} SELECT query_id, chunk_id, string_agg(concept, ' > ' ORDER BY concept) AS path FROM g GROUP BY 1, 2")
def agg_concept_path(spark: SparkSession, d: str) -> DataFrame:
    """The concepts that link a query to a chunk, as one line."""
    return _matched(spark, d).groupBy("query_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_list("concept")), " > ").alias("path"))


@query(f"WITH {_MENTIONS} SELECT x.chunk_id, x.concept AS a, y.concept AS b FROM men x JOIN men y ON x.chunk_id = y.chunk_id AND x.concept < y.concept")
def jn_cooccur(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of concepts of every chunk; a chunk has five at most."""
    m = retrieval._mentions(spark, d).groupBy("chunk_id").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return m.select("chunk_id", F.explode(pairs).alias("p")).select("chunk_id", "p.a", "p.b")


_FIRST = r"regexp_extract(lower({}), '\p{{L}}{{6,}}')"


@query(f"""WITH {_MENTIONS}, e AS (SELECT DISTINCT {_FIRST.format("title")} AS a, {_FIRST.format("content")} AS b FROM {CARDS} WHERE card_type = 'definition')
    SELECT a, b FROM e WHERE a <> b AND a IN (SELECT concept FROM men) AND b IN (SELECT concept FROM men)""")
def jn_prereq(spark: SparkSession, d: str) -> DataFrame:
    """Prerequisite edges, from the first long word of a definition's title to that of its content, where the graph holds both ends."""
    first = lambda c: F.regexp_extract(F.lower(c), r"\p{L}{6,}", 0)
    e = cards(spark, d, "card_type", "title", "content").where("card_type = 'definition'").select(first("title").alias("a"), first("content").alias("b")).where("a != b").distinct()
    known = retrieval._mentions(spark, d).select("concept").distinct()
    return e.join(known.withColumnRenamed("concept", "a"), "a", "left_semi").join(known.withColumnRenamed("concept", "b"), "b", "left_semi")


@query("""SELECT vec_id, ['factual', 'overview', 'multihop', 'visual'][o + 1] AS intent, round(s, 4) + CAST(0 AS DOUBLE) AS score FROM (SELECT e.vec_id, p.label AS o, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) AS s
    FROM embeddings e, (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE label < 4) WHERE n <= 8) p GROUP BY 1, 2)""")
def jn_proto(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's best score against the eight prototypes of each of four intents."""
    e = table(spark, d, "embeddings")
    p = e.where("label < 4").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 8").select("label", F.col("embedding").alias("p"))
    s = e.select("vec_id", "embedding").crossJoin(F.broadcast(p)).groupBy("vec_id", "label").agg(F.max(vectors.cosine(F.col("embedding"), F.col("p"))).alias("s"))  # 32 prototypes
    return s.select("vec_id", F.get(F.array(*map(F.lit, list(retrieval.ROUTES)[:4])), F.col("label")).alias("intent"), F.round("s", 4).alias("score"))


_CLAIMS = f"""pr AS (SELECT DISTINCT pair_id, chunk_id, answer FROM qa_pairs WHERE answer IS NOT NULL), ch AS (SELECT document_id, chunk_index, chunk_id, regexp_extract_all(lower(text), {_W}) AS w FROM {CHUNKS}),
    near AS (SELECT a.chunk_id, b.w FROM ch a JOIN ch b ON a.document_id = b.document_id AND b.chunk_index BETWEEN a.chunk_index AND a.chunk_index + 1),
    cl AS (SELECT pair_id, chunk_id, i AS claim_no, list_distinct(regexp_extract_all(lower(c[i + 1]), {_W})) AS cw FROM (SELECT *, unnest(range(len(c))) AS i FROM (SELECT pair_id, chunk_id, regexp_extract_all(answer, '[^.!?]+') AS c FROM pr))),
    sup AS (SELECT pair_id, CAST(claim_no AS INT) AS claim_no, bool_or(coalesce(len(list_intersect(cw, w)) / len(cw) >= {SUPPORTED}, false)) AS supported FROM cl LEFT JOIN near USING (chunk_id) WHERE len(cw) > 0 GROUP BY 1, 2)"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, claim_no, supported): the sentences of every answer, held against the pair's chunk and the one behind it."""
    c = view(spark, d, "qa_pairs", "pair_id", "chunk_id", "answer").where("answer is not null")
    c = c.select("pair_id", "chunk_id", F.posexplode(F.regexp_extract_all("answer", F.lit("[^.!?]+"), 0)).alias("claim_no", "claim"))
    c = c.select("pair_id", "chunk_id", "claim_no", F.array_distinct(words(F.col("claim"))).alias("cw")).where("size(cw) > 0")
    ch = chunks(spark, d, "document_id", "chunk_index", "text").select("chunk_id", "document_id", "chunk_index", words(F.col("text")).alias("w"))
    at = ch.select("chunk_id", "document_id", F.explode(F.array("chunk_index", F.col("chunk_index") + 1)).alias("chunk_index"))
    near = at.join(ch.select("document_id", "chunk_index", "w"), ["document_id", "chunk_index"]).select("chunk_id", "w")
    return c.join(near, "chunk_id", "left").groupBy("pair_id", "claim_no").agg(F.bool_or(F.coalesce(ranking.overlap(F.col("cw"), F.col("w")) >= SUPPORTED, F.lit(False))).alias("supported"))


@query(f"WITH {_CLAIMS} SELECT * FROM sup")
def jn_claim_passage(spark: SparkSession, d: str) -> DataFrame:
    """Every claim of an answer, and whether a passage supports it."""
    return _claims(spark, d)


@query(f"WITH {_CLAIMS} SELECT pair_id, coalesce(any_value(f), 1.0) AS faithfulness FROM pr LEFT JOIN (SELECT pair_id, round(avg(CAST(supported AS INT)), 4) AS f FROM sup GROUP BY 1) USING (pair_id) GROUP BY 1")
def agg_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """The share of supported claims of every answer, 1 without claims."""
    f = _claims(spark, d).groupBy("pair_id").agg(F.round(F.avg(F.col("supported").cast("int")), 4).alias("f"))
    p = view(spark, d, "qa_pairs", "pair_id", "answer").where("answer is not null").select("pair_id").distinct()
    return p.join(f, "pair_id", "left").select("pair_id", F.coalesce("f", F.lit(1.0)).alias("faithfulness"))


@query("SELECT pair_id, round(coalesce(CAST(nullif(regexp_extract(answer, '[0-9]'), '') AS INT) / 3, 0), 4) AS relevance FROM (SELECT DISTINCT pair_id, answer FROM qa_pairs)")
def agg_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The first digit of a judge's reply (here the answer) over 3, 0 without one."""
    digit = F.nullif(F.regexp_extract("answer", "[0-9]", 0), F.lit("")).cast("int")
    return view(spark, d, "qa_pairs", "pair_id", "answer").select("pair_id", F.round(F.coalesce(digit / 3, F.lit(0.0)), 4).alias("relevance"))


@query(f"""SELECT tenant_id, count(*) FILTER (yes) AS accepted, count(*) FILTER (NOT yes) AS rejected, round(100 * avg(CAST(yes AS INT)), 2) AS percent
    FROM (SELECT tenant_id, coalesce(len(list_distinct(regexp_extract_all(lower(answer), {_W}))) >= 5, false) AS yes FROM (SELECT DISTINCT pair_id, tenant_id, answer FROM qa_pairs)) GROUP BY 1""")
def agg_judge_accept(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by tenant; the stand-in for a judge accepts an answer of five different words."""
    p = view(spark, d, "qa_pairs", "pair_id", "tenant_id", "answer").withColumn("yes", F.coalesce(F.size(F.array_distinct(words(F.col("answer")))) >= 5, F.lit(False)))
    return p.groupBy("tenant_id").agg(F.count_if("yes").alias("accepted"), F.count_if(~F.col("yes")).alias("rejected"), F.round(100 * F.avg(F.col("yes").cast("int")), 2).alias("percent"))


@query("SELECT query_type, count(*) AS n, count(*) FILTER (calibrated) AS n_calibrated, count(*) FILTER (query_type <> 'visual' AND relevant_pages IS NOT NULL) AS in_scope FROM (SELECT DISTINCT item_id, query_type, calibrated, relevant_pages FROM eval_queries) WHERE item_id NOT LIKE '\\_%' ESCAPE '\\' GROUP BY 1")
def agg_intent_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled queries by type: all, the calibrated ones, and those that are measured."""
    measured = (F.col("query_type") != "visual") & F.col("relevant_pages").isNotNull()
    return queries(spark, d).groupBy("query_type").agg(F.count("*").alias("n"), F.count_if("calibrated").alias("n_calibrated"), F.count_if(measured).alias("in_scope"))


@query(f"""SELECT document_id, CAST(i - 1 AS INT) AS term, round(max(ln(1 + greatest(v[i], 0))), 6) AS weight FROM (SELECT c.document_id, x.v, unnest(range(1, 65)) AS i FROM {CHUNKS} c JOIN {CHUNK_VECTORS} x ON c.chunk_id = x.id) GROUP BY 1, 2 HAVING max(v[i]) > 0""")
def agg_splade_pool(spark: SparkSession, d: str) -> DataFrame:
    """A document's sparse vector: over its chunks, the largest log(1 + relu(x)) of each element above 0."""
    x = chunks(spark, d, "document_id").join(chunk_vectors(spark, d), F.col("chunk_id") == F.col("id")).select("document_id", F.posexplode("v").alias("term", "x")).where("x > 0")
    return x.groupBy("document_id", "term").agg(F.round(F.max(F.log1p(F.col("x").cast("double"))), 6).alias("weight"))


_PAGE_SCORES = f"""ps AS (SELECT score, document_id, page_number, CAST(row_number() OVER (ORDER BY score DESC, document_id, page_number) AS INT) AS rank FROM ({SQL["jn_maxsim"]})
    WHERE document_id IN (SELECT document_id FROM parsed_documents WHERE tenant_id IN ('{TENANT}', 'global'))), best AS (SELECT * FROM ps WHERE rank <= 5)"""


def _visual(spark: SparkSession, d: str) -> DataFrame:
    own = view(spark, d, "parsed_documents", "document_id", "tenant_id").where(scope.in_scope(F.col("tenant_id"), None, TENANT))
    hits = retrieval.jn_maxsim(spark, d).join(own, "document_id", "left_semi").orderBy(F.desc("score"), "document_id", "page_number").limit(5)  # the top of one query
    return ranking.ranked(hits, F.desc("score"), "document_id", "page_number").select("score", "document_id", "page_number", "rank")


@query(f"WITH {_PAGE_SCORES} SELECT * FROM best")
def r_visual(spark: SparkSession, d: str) -> DataFrame:
    """The five pages in scope of the best late-interaction score."""
    return _visual(spark, d)


_CONTEXT = f"{_PAGE_SCORES}, seen AS (SELECT * FROM (SELECT DISTINCT document_id FROM best), (SELECT DISTINCT page_number FROM best))"


def _context(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, page_number): the pages of all five hits, in every document hit."""
    hits = _visual(spark, d)
    return F.broadcast(hits.select("document_id").distinct().crossJoin(hits.select("page_number").distinct()))  # 25 rows at most


@query(f"WITH {_CONTEXT} SELECT document_id || '/page_' || lpad(CAST(page_number AS VARCHAR), 4, '0') || '.png' AS image_key, page_id FROM seen JOIN (SELECT DISTINCT page_id, document_id, page_number FROM {PAGES}) USING (document_id, page_number)")
def jn_visual_context(spark: SparkSession, d: str) -> DataFrame:
    """The page numbers found by late interaction in every document found, with the key of their image."""
    p = view(spark, d, "page_contents", "page_id", "document_id", "page_number")
    return p.join(_context(spark, d), ["document_id", "page_number"]).select(F.format_string("%s/page_%04d.png", "document_id", "page_number").alias("image_key"), "page_id")


@query(f"""WITH {_CONTEXT}, c AS (SELECT chunk_id, '[Page ' || page_number || '] ' || text AS passage, row_number() OVER (PARTITION BY document_id, page_number ORDER BY chunk_index, chunk_id) AS n FROM seen JOIN {CHUNKS} USING (document_id, page_number))
    SELECT CAST(n AS INT) AS n, chunk_id, passage FROM c WHERE n <= 2""")
def r_visual_answer(spark: SparkSession, d: str) -> DataFrame:
    """At most two passages of each page of the visual context."""
    c = chunks(spark, d, "document_id", "page_number", "chunk_index", "text").join(_context(spark, d), ["document_id", "page_number"])
    by = Window.partitionBy("document_id", "page_number").orderBy("chunk_index", "chunk_id")
    return c.withColumn("n", F.row_number().over(by)).where("n <= 2").select("n", "chunk_id", F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("] "), "text").alias("passage"))


@query(f"""SELECT query_id, chunk_id, CAST(n AS INT) AS n FROM (SELECT h.query_id, c.chunk_id, row_number() OVER (PARTITION BY h.query_id, c.document_id, c.page_number ORDER BY c.chunk_index, c.chunk_id) AS n
    FROM (SELECT DISTINCT query_id, document_id, page_number FROM ({SQL["jn_pages"]}) JOIN {PAGES} USING (page_id)) h JOIN {CHUNKS} c USING (document_id, page_number)) WHERE n <= 2""")
def r_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """At most two chunks of every page that a labelled query's first five hits stand on."""
    hit = retrieval.jn_pages(spark, d).join(view(spark, d, "page_contents", "page_id", "document_id", "page_number"), "page_id").select("query_id", "document_id", "page_number").distinct()
    c = chunks(spark, d, "document_id", "page_number", "chunk_index").join(hit, ["document_id", "page_number"])
    by = Window.partitionBy("query_id", "document_id", "page_number").orderBy("chunk_index", "chunk_id")
    return c.withColumn("n", F.row_number().over(by)).where("n <= 2").select("query_id", "chunk_id", "n")


# The funnel in SQL: the greedy steps as a recursion whose rows are the candidates, each with its likeness to the nearest chosen one.
_DIVERSE = f"""pool AS (SELECT * FROM (SELECT query_id, x.id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, x.id) AS rank FROM {SCOPED_VECTORS} x, {QUERY_VECTORS} q) WHERE rank <= {retrieval.POOL}),
    tk AS (SELECT chunk_id AS id, list_distinct(regexp_extract_all(lower(text), {_W})) AS w FROM {CHUNKS} WHERE chunk_id IN (SELECT id FROM pool)),
    sim AS (SELECT a.query_id, a.rank AS x, b.rank AS y, coalesce(len(list_intersect(s.w, t.w)) / nullif(len(s.w) + len(t.w) - len(list_intersect(s.w, t.w)), 0), 0) AS j FROM pool a JOIN pool b ON a.query_id = b.query_id JOIN tk s ON a.id = s.id JOIN tk t ON b.id = t.id),
    walk AS (SELECT query_id, 0 AS n, rank, score / max(score) OVER (PARTITION BY query_id) AS rel, CAST(0 AS DOUBLE) AS nearest, CAST(NULL AS INT) AS taken FROM pool UNION ALL
      SELECT p.query_id, p.n + 1, p.rank, p.rel, greatest(p.nearest, sim.j), CASE WHEN p.rank = p.pick THEN p.n + 1 ELSE p.taken END FROM
        (SELECT *, first_value(rank) OVER (PARTITION BY query_id ORDER BY (taken IS NOT NULL), CAST(0.7 AS DOUBLE) * rel - (1 - CAST(0.7 AS DOUBLE)) * nearest DESC, rank) AS pick FROM walk WHERE n < {FETCH}) p
        JOIN sim ON sim.query_id = p.query_id AND sim.x = p.rank AND sim.y = p.pick),
    size AS (SELECT query_id, count(*) AS c FROM pool GROUP BY 1),
    diverse AS (SELECT pool.query_id, pool.id, pool.score, CASE WHEN c <= {FETCH} THEN pool.rank ELSE taken END AS rank FROM walk JOIN pool ON walk.query_id = pool.query_id AND walk.rank = pool.rank JOIN size ON size.query_id = pool.query_id WHERE n = {FETCH} AND (taken IS NOT NULL OR c <= {FETCH}))"""
SQL["itr_mmr"] = f"WITH RECURSIVE {_DIVERSE} SELECT query_id, id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM diverse"
_FUNNEL = f"""{_DIVERSE}, {_ARTIFACTS}, led AS (SELECT query_id, id, arg_min(score, rank) AS score, min(rank) AS hit FROM known GROUP BY 1, 2),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit, id) AS r FROM led WHERE (query_id, id) NOT IN (SELECT query_id, id FROM diverse)),
    both_lanes AS (SELECT query_id, id, score, rank, 'dense' AS lane FROM diverse UNION ALL SELECT f.query_id, id, score, coalesce(l, 0) + r, 'artifact' FROM fresh f LEFT JOIN (SELECT query_id, max(rank) AS l FROM diverse GROUP BY 1) USING (query_id)),
    asked AS (SELECT DISTINCT item_id AS query_id, list_distinct(regexp_extract_all(lower(query), {_W})) AS qw FROM eval_queries), said AS (SELECT chunk_id AS id, list_distinct(regexp_extract_all(lower(text), {_W})) AS cw FROM {CHUNKS}),
    judged AS (SELECT b.*, round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw)) / len(qw) ELSE 0 END, 6) AS rerank_score FROM both_lanes b JOIN asked USING (query_id) JOIN said USING (id)),
    funnel AS (SELECT query_id, id, round(score, 6) AS score, rerank_score, lane, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS n FROM judged) WHERE n <= {SHOWN})"""
SQL["r_funnel"] = f"WITH RECURSIVE {_FUNNEL} SELECT * FROM funnel"
_LANES = "(SELECT DISTINCT item_id AS query_id, query_type FROM eval_queries)"
SQL["r_ask"] = f"""WITH RECURSIVE {_FUNNEL} SELECT query_id, 'chunk' AS lane, id, rank FROM funnel UNION ALL SELECT query_id, 'summary', id, rank FROM ({SQL["r_raptor"]}) JOIN {_LANES} USING (query_id) WHERE query_type IN ('overview') OR query_type NOT IN ('factual', 'multihop', 'visual')
    UNION ALL SELECT query_id, 'concept', chunk_id, rank FROM ({SQL["r_graph"]}) JOIN {_LANES} USING (query_id) WHERE rank <= {LINKED} AND (query_type = 'multihop' OR query_type NOT IN ('factual', 'overview', 'visual'))"""
