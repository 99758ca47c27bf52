"""What is built from documents: sources and keyed sinks, cards from replies, the graph, stand-in models and the tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.functions.text import decoded, strip, token_count, token_set, words
from lectern.operators import chunking, scope, store
from lectern.operators.cards import ARTIFACT_TYPES, CARD_TYPES, cards_from_replies
from lectern.operators.tree import build_tree
from lectern.plans import retrieval
from lectern.plans.base import CARDS, CHUNK_VECTORS, CHUNKS, DOCS, NODES, PAGES, TENANT, cards, chunk_vectors, chunks, queries, query, vector_table, vectors_sql, view
from lectern.plans.relational import _BLANK, _list, _strip
from lectern.plans.retrieval import _MENTIONS
from lectern.plans.text import _starts
from lectern.sources.tables import table

_W = r"'[\p{L}\p{N}]+'"
_LINE_END = r"\r\n|\n|\r"


@query("SELECT DISTINCT item_id AS query_id, query_type, len(query) AS n_chars FROM eval_queries WHERE item_id NOT LIKE '\\_%' ESCAPE '\\'")
def src_json_queries(spark: SparkSession, d: str) -> DataFrame:
    """The labelled queries; ids that begin with an underscore are notes."""
    return queries(spark, d).select("query_id", "query_type", F.length("query").cast("bigint").alias("n_chars"))


@query(f"""SELECT document_id, CASE WHEN own IS NOT NULL THEN 'text' WHEN pages IS NOT NULL THEN 'pages' ELSE 'bytes' END AS source, length(coalesce(own, pages, title, '')) AS n_chars FROM
    (SELECT document_id, title, CASE WHEN page_count >= 3 THEN nullif({_strip("full_text")}, '') END AS own FROM {DOCS})
    LEFT JOIN (SELECT document_id, string_agg(text, chr(10) ORDER BY page_number, page_id) AS pages FROM {PAGES} WHERE text <> '' AND page_number % 2 = 0 GROUP BY 1) USING (document_id)""")
def src_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text from the first source that has one: its own (here where it has three pages or more), its even pages, the bytes of its title."""
    p = view(spark, d, "page_contents", "page_id", "document_id", "page_number", "text").where("text != '' and page_number % 2 = 0").groupBy("document_id")
    p = p.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "text"))), lambda x: x["text"]), "\n").alias("pages"))
    j = view(spark, d, "parsed_documents", "document_id", "full_text", "title", "tenant_id", "filename", "page_count", "char_count", "subject", "language").join(p, "document_id", "left")
    own = F.when(F.col("page_count") >= 3, F.nullif(strip(F.col("full_text")), F.lit("")))
    source = F.when(own.isNotNull(), "text").when(F.col("pages").isNotNull(), "pages").otherwise("bytes")
    return j.select("document_id", source.alias("source"), F.length(F.coalesce(own, "pages", decoded(F.encode("title", "UTF-8")), F.lit(""))).cast("bigint").alias("n_chars"))


@query(f"SELECT id, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM {CHUNK_VECTORS} WHERE id IN (SELECT chunk_id FROM cards WHERE is_active AND card_type = 'question')")
def scan_vectors_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the chunks that have a question card."""
    ids = table(spark, d, "cards").where("is_active and card_type = 'question'").select(F.col("chunk_id").alias("id"))
    return chunk_vectors(spark, d).join(ids, "id", "left_semi").select("id", F.round(vectors.norm(F.col("v")), 4).alias("norm"))


@query("SELECT p.*, coalesce(n, 0) AS n_chunks FROM (SELECT document_id, arg_max(page_count, created_at) AS page_count, count(*) AS writes FROM parsed_documents GROUP BY 1) p LEFT JOIN (SELECT document_id, count(DISTINCT chunk_id) AS n FROM text_chunks GROUP BY 1) USING (document_id)")
def snk_document(spark: SparkSession, d: str) -> DataFrame:
    """The documents as repeated writes leave them: the last one of a key stays, how many there were, and the chunks that were appended."""
    t = table(spark, d, "parsed_documents").select("document_id", "page_count", "created_at")
    n = table(spark, d, "text_chunks").groupBy("document_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    out = store.latest(t, ["document_id"], "created_at").join(t.groupBy("document_id").agg(F.count("*").alias("writes")), "document_id").join(n, "document_id", "left")
    return out.select("document_id", "page_count", "writes", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query(f"""SELECT id, kind, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM (SELECT id, 'chunk' AS kind, v FROM {CHUNK_VECTORS} WHERE id NOT IN (SELECT node_id FROM raptor_nodes) UNION ALL SELECT id, 'summary', v FROM {vectors_sql("raptor_nodes", "node_id")})""")
def snk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The one collection of chunk and summary vectors after the summaries were upserted into it."""
    old, new = chunk_vectors(spark, d).withColumn("kind", F.lit("chunk")), vector_table(spark, d, "raptor_nodes", "node_id").withColumn("kind", F.lit("summary"))
    return store.upsert(old, new, ["id"]).select("id", "kind", F.round(vectors.norm(F.col("v")), 4).alias("norm"))


@query(f"SELECT document_id, page_number, count(*) AS patches FROM {CHUNKS} c JOIN {CHUNK_VECTORS} x ON c.chunk_id = x.id WHERE page_number IS NOT NULL GROUP BY 1, 2")
def snk_patches(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors each page's patch matrix holds; pages without one are left out."""
    return chunks(spark, d, "document_id", "page_number").where("page_number is not null").join(chunk_vectors(spark, d).select("id"), F.col("chunk_id") == F.col("id"), "left_semi").groupBy("document_id", "page_number").agg(F.count("*").alias("patches"))


@query(f"WITH {_MENTIONS} SELECT DISTINCT sha256('concept:' || concept) AS concept_id, concept FROM men")
def snk_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts under a key made of their name, so that writing again changes nothing."""
    return retrieval._mentions(spark, d).select("concept").distinct().select(F.sha2(F.concat(F.lit("concept:"), "concept"), 256).alias("concept_id"), "concept")


@query(f"""WITH {_MENTIONS} SELECT chunk_id AS src, 'PART_OF' AS kind, document_id AS dst, CAST(1 AS BIGINT) AS weight FROM {CHUNKS} UNION ALL SELECT chunk_id, 'ON_PAGE', document_id || '/' || page_number, 1 FROM {CHUNKS} WHERE page_number IS NOT NULL
    UNION ALL SELECT DISTINCT document_id || '/' || page_number, 'PART_OF', document_id, 1 FROM {CHUNKS} WHERE page_number IS NOT NULL UNION ALL SELECT chunk_id, 'MENTIONS', concept, 1 FROM men
    UNION ALL SELECT x.concept, 'RELATES_TO', y.concept, count(*) FROM men x JOIN men y ON x.chunk_id = y.chunk_id AND x.concept < y.concept GROUP BY 1, 3""")
def p_graph(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge graph's edges (src, kind, dst, weight): chunks in documents and on pages, mentions, concepts that occur together."""
    c, m = chunks(spark, d, "document_id", "page_number"), retrieval._mentions(spark, d)
    page, paged = F.concat_ws("/", "document_id", F.col("page_number").cast("string")), c.where("page_number is not null")
    edge = lambda t, src, kind, dst, weight=None: t.select(F.col(src).alias("src") if isinstance(src, str) else src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"), (F.lit(1).cast("bigint") if weight is None else F.col(weight)).alias("weight"))
    edges = [edge(c, "chunk_id", "PART_OF", F.col("document_id")), edge(paged, "chunk_id", "ON_PAGE", page), edge(paged.select("document_id", "page_number").distinct(), page, "PART_OF", F.col("document_id")), edge(m, "chunk_id", "MENTIONS", F.col("concept")), edge(retrieval.concepts.co_occurrence(m), "a", "RELATES_TO", F.col("b"), "weight")]
    return reduce(DataFrame.union, edges)


_TYPED = f"typed AS (SELECT concept, arg_min(CASE WHEN pos = 0 THEN 'topic' ELSE 'term' END, (chunk_id, pos)) AS type, count(*) AS mentions FROM men GROUP BY 1)"


@query(f"""WITH {_MENTIONS}, {_TYPED} SELECT DISTINCT document_id AS node, 'Document' AS label, CAST(NULL AS VARCHAR) AS type FROM {CHUNKS} UNION ALL SELECT DISTINCT document_id || '/' || page_number, 'Page', NULL FROM {CHUNKS} WHERE page_number IS NOT NULL
    UNION ALL SELECT chunk_id, 'Chunk', NULL FROM {CHUNKS} UNION ALL SELECT concept, 'Concept', type FROM typed""")
def snk_graph(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge graph's nodes, each key once; a concept has the type of its first mention (topic where it begins a chunk)."""
    c = chunks(spark, d, "document_id", "page_number")
    none = F.lit(None).cast("string")
    page = c.where("page_number is not null").select(F.concat_ws("/", "document_id", F.col("page_number").cast("string")).alias("node")).distinct()
    nodes = [c.select(F.col("document_id").alias("node")).distinct().select("node", F.lit("Document").alias("label"), none.alias("type")), page.select("node", F.lit("Page"), none), c.select("chunk_id", F.lit("Chunk"), none), retrieval.typed_concepts(spark, d).select("concept", F.lit("Concept"), "type")]
    return reduce(DataFrame.union, nodes)


@query(f"SELECT chunk_id, 'stub_concept_' || i AS concept FROM {CHUNKS}, (SELECT unnest(range(3)) AS i)")
def m_graph_stub(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for a model's concepts: three fixed ones for every chunk."""
    return chunks(spark, d).select("chunk_id", F.explode(F.array(*(F.lit(f"stub_concept_{i}") for i in range(3)))).alias("concept"))


@query(f"""SELECT page_id, count(DISTINCT i) AS patches, count(DISTINCT j) AS dims, CAST(sum(CAST('0x' || substr(md5(page_id || '-' || i || '-' || j), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM (SELECT DISTINCT page_id FROM page_contents), (SELECT unnest(range(32)) AS i), (SELECT unnest(range(128)) AS j) GROUP BY 1""")
def m_patches_stub(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for a page's patch matrix: 32 rows of 128 numbers made of a hash, here as its size and sum."""
    number = lambda i, j: F.conv(F.substring(F.md5(F.concat_ws("-", "page_id", i.cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("bigint")
    m = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda j: number(i, j)))
    x = view(spark, d, "page_contents", "page_id").select("page_id", m.alias("m"))
    return x.select("page_id", F.size("m").cast("bigint").alias("patches"), F.size(F.get("m", F.lit(0))).cast("bigint").alias("dims"), F.aggregate(F.flatten("m"), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("checksum"))


@query(f"""SELECT document_id, filename, coalesce(min(CASE WHEN f.tenant_id = p.tenant_id THEN f.tenant_id END), min(CASE WHEN f.tenant_id = 'global' THEN f.tenant_id END), min(f.tenant_id)) || '/' || filename AS path FROM (SELECT DISTINCT document_id, tenant_id, filename FROM parsed_documents) p
    LEFT JOIN (SELECT DISTINCT tenant_id, filename FROM documents) f USING (filename) GROUP BY document_id, filename, p.tenant_id""")
def jn_pdf_path(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's file lies: in its own tenant's folder, else in the global one, else in the first that holds a file of that name; null if none does."""
    files = table(spark, d, "documents").select(F.col("tenant_id").alias("folder"), "filename").where("filename is not null").distinct()
    docs = view(spark, d, "parsed_documents", "document_id", "tenant_id", "filename")
    at = docs.join(files, "filename", "left").groupBy("document_id", "filename").agg(F.min(F.when(F.col("folder") == F.col("tenant_id"), F.col("folder"))).alias("own"), F.min(F.when(F.col("folder") == "global", F.col("folder"))).alias("base"), F.min("folder").alias("any"))
    return at.select("document_id", "filename", F.concat(F.coalesce("own", "base", "any"), F.lit("/"), "filename").alias("path"))


@query(f"SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS INT) AS pos, CAST((row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1) // 32 AS BIGINT) AS batch, chunk_id FROM {CHUNKS} WHERE is_active AND length({_strip('text')}) > 0")
def win_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """A document's active chunks with text, numbered without gaps from 0, and the batch of 32 each falls into."""
    c = chunks(spark, d, "document_id", "chunk_index", "text", "is_active").where("is_active").where(F.length(strip(F.col("text"))) > 0)
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")) - 1
    return c.select("document_id", pos.alias("pos"), "chunk_id").select("document_id", "pos", F.floor(F.col("pos") / 32).alias("batch"), "chunk_id")


@query(f"""SELECT document_id, CAST(pos AS INT) AS pos, chunk_id, node_id FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS pos FROM {CHUNKS})
    JOIN (SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY level, cluster_id, node_id) AS pos FROM {NODES}) USING (document_id, pos)""")
def jn_zip(spark: SparkSession, d: str) -> DataFrame:
    """A document's chunks and tree nodes paired by position; what the shorter list lacks drops out."""
    at = lambda t, *order: t.withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))
    c = at(chunks(spark, d, "document_id", "chunk_index"), "chunk_index", "chunk_id").select("document_id", "pos", "chunk_id")
    n = at(view(spark, d, "raptor_nodes", "node_id", "document_id", "level", "cluster_id"), "level", "cluster_id", "node_id").select("document_id", "pos", "node_id")
    return c.join(n, ["document_id", "pos"])


@query(f"""SELECT chunk_id, content FROM (SELECT DISTINCT card_id, chunk_id, content FROM {CARDS} WHERE card_type = 'factoid' AND content IS NOT NULL) WHERE lower({_strip("content")}) NOT IN ({_list(scope.EMPTY_CARD)})""")
def json_factoids(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's factoids, written as one reply and read again as cards."""
    c = cards(spark, d, "chunk_id", "card_type", "content").where("card_type = 'factoid' and content is not null")
    reply = c.groupBy("chunk_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("card_id", "content"))), lambda x: x["content"])).alias("reply"))
    return cards_from_replies(reply.select("chunk_id", F.lit("factoid").alias("card_type"), "reply")).select("chunk_id", "content")


@query(f"""SELECT chunk_id, title, content FROM (SELECT chunk_id, 'Summary' AS title, {_strip("content")} AS content FROM {CARDS} WHERE card_type = 'summary' AND content IS NOT NULL) WHERE lower(content) NOT IN ('null', '')""")
def json_plain(spark: SparkSession, d: str) -> DataFrame:
    """Summaries as fenced prose, read again as cards; null and nothing give none."""
    c = cards(spark, d, "chunk_id", "card_type", "content").where("card_type = 'summary' and content is not null")
    reply = F.concat(F.lit("```\n"), "content", F.lit("\n```"))
    return cards_from_replies(c.select("card_id", "chunk_id", "card_type", reply.alias("reply")).select("chunk_id", "card_type", "reply")).select("chunk_id", "title", "content")


@query(f"WITH {_MENTIONS} SELECT chunk_id, concept AS name, 'term' AS type FROM men")
def json_concepts(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's concepts, written as a model's reply and read again; what can't be read has none."""
    m = retrieval._mentions(spark, d).groupBy("chunk_id").agg(F.collect_list(F.struct(F.col("concept").alias("name"), F.lit("term").alias("type"))).alias("concepts"))
    back = m.select("chunk_id", F.from_json(F.to_json(F.struct("concepts")), "struct<concepts: array<struct<name: string, type: string>>>").alias("x"))
    return back.select("chunk_id", F.explode("x.concepts").alias("c")).select("chunk_id", "c.name", "c.type")


@query(f"""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')) AS wordcount, len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BLANK}'), lambda x: x <> ''))) AS tokens,
    len(regexp_split_to_array(coalesce(text, ''), '{_LINE_END}')) AS lines, len(regexp_extract_all(coalesce(text, ''), '(?i)\\[Page ([0-9]+)\\]', 1)) AS cites, regexp_extract(coalesce(text, ''), '(?s)\\[.*\\]') AS sliced,
    coalesce(source, '') || '/page_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.png' AS key, length(regexp_replace(coalesce(text, ''), '```(json)?', '', 'g')) AS unfenced, 'Title: ' || coalesce(title, '-') || ' (' || coalesce(subject, '-') || ')' AS template, replace(left(coalesce(text, ''), greatest(length(coalesce(text, '')) - 1, 0)), chr(65533), '') AS decoded FROM documents""")
def str_columns(spark: SparkSession, d: str) -> DataFrame:
    """Word and token counts, lines, citations, the outermost bracket, keys, fences, a template, and the text decoded without its last byte, over all documents."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        "doc_id", token_count(t).cast("bigint").alias("wordcount"), F.size(token_set(t)).cast("bigint").alias("tokens"), F.size(F.split(t, _LINE_END)).cast("bigint").alias("lines"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?i)\[Page ([0-9]+)\]"), 1)).cast("bigint").alias("cites"), F.regexp_extract(t, r"(?s)\[.*\]", 0).alias("sliced"),
        F.format_string("%s/page_%08d.png", F.coalesce("source", F.lit("")), "doc_id").alias("key"), F.length(F.regexp_replace(t, "```(json)?", "")).cast("bigint").alias("unfenced"),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("-")), F.lit(" ("), F.coalesce("subject", F.lit("-")), F.lit(")")).alias("template"),
        decoded(F.expr("substring(encode(coalesce(text, ''), 'UTF-8'), 1, octet_length(coalesce(text, '')) - 1)")).alias("decoded"),
    )


@query("""SELECT vec_id, round(sqrt(list_dot_product(v, v)) + 1e-9, 4) AS norm, round(list_dot_product(v, list_reverse(v)), 4) + CAST(0 AS DOUBLE) AS dot, round(list_cosine_similarity(v, list_reverse(v)), 4) + CAST(0 AS DOUBLE) AS cosine,
    round(ln(1 + greatest(v[1], 0)), 6) AS activated, round(log2(vec_id + 2), 6) AS discount, vec_id // 7 AS part FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def num_columns(spark: SparkSession, d: str) -> DataFrame:
    """Norm, products, activation, discount and whole division over all vectors."""
    v, r = F.col("embedding"), F.reverse("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(vectors.norm(v) + 1e-9, 4).alias("norm"), F.round(vectors.dot(v, r), 4).alias("dot"), F.round(vectors.cosine(v, r), 4).alias("cosine"),
        F.round(F.log1p(F.greatest(F.get(v, F.lit(0)).cast("double"), F.lit(0.0))), 6).alias("activated"), F.round(F.log2(F.col("vec_id") + 2.0), 6).alias("discount"), F.expr("vec_id div 7").alias("part"),
    )


@query(f"""WITH b AS (SELECT chunk_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {_W})) AS w FROM {CHUNKS}) GROUP BY 1, 2)
    SELECT chunk_id, CAST(dim AS INT) AS dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS x FROM b""")
def m_dense(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for a dense model: each chunk's words hashed into 64 elements, of length 1; elements of 0 are left out."""
    w = chunks(spark, d, "text").select("chunk_id", F.explode(words(F.col("text"))).alias("w"))
    dim = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % 64).cast("int")
    b = w.groupBy("chunk_id", dim.alias("dim")).agg(F.count("*").alias("n"))
    return b.select("chunk_id", "dim", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("chunk_id"))), 6).alias("x"))


@query(f"""WITH t AS (SELECT chunk_id AS id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM {CHUNKS}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(DISTINCT chunk_id) AS n FROM text_chunks)
    SELECT id, term, round(ln(1 + tf) * ln(1 + n / df), 6) AS w FROM t JOIN df USING (term), n""")
def m_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for a sparse model: weighted terms of every chunk."""
    return retrieval._chunk_postings(spark, d).select("id", "term", F.round("w", 6).alias("w"))


_NOT_CHAPTER = " OR ".join(f"contains(substr(lower(c.text), 1, 500), '{k}')".replace("\n", "' || chr(10) || '") for k in scope.NOT_CHAPTER)


@query(f"""SELECT k.card_id, k.chunk_id, k.card_type, CASE WHEN card_type = 'question' THEN concat_ws(chr(10), content, answer) ELSE coalesce(title, '') || ': ' || coalesce(content, '') END AS embed_text FROM {CARDS} k JOIN {CHUNKS} c USING (chunk_id)
    WHERE k.is_active AND k.card_type IN ({_list(ARTIFACT_TYPES)}) AND NOT ({_NOT_CHAPTER})""")
def p_da_index(spark: SparkSession, d: str) -> DataFrame:
    """The artifact index: the active cards of chapter chunks with what of each is searched and the chunk it leads to."""
    k = cards(spark, d, "chunk_id", "card_type", "title", "content", "answer", "is_active").where("is_active").where(F.col("card_type").isin(*ARTIFACT_TYPES))
    c = chunks(spark, d, "text").where(scope.is_chapter(F.col("text"))).select("chunk_id")
    return k.join(c, "chunk_id", "left_semi").select("card_id", "chunk_id", "card_type", scope.embed_text(F.col("card_type"), F.col("title"), F.col("content"), F.col("answer")).alias("embed_text"))


def stub_replies(c: DataFrame) -> DataFrame:
    """(chunk_id, card_type, reply): what a model might reply for each of the eight types, made of the chunk's id."""
    x = c.select("chunk_id", F.explode(F.array(*map(F.lit, CARD_TYPES))).alias("card_type"))
    said = F.concat_ws(" ", "card_type", F.lit("of"), "chunk_id")
    reply = F.when(F.col("card_type") == "question", F.to_json(F.array(F.struct(said.alias("question"), F.concat(F.lit("answer of "), "chunk_id").alias("answer"))))).when(F.col("card_type") == "factoid", F.to_json(F.array(said)))
    return x.select("chunk_id", "card_type", reply.when(F.col("card_type") == "summary", said).otherwise(F.to_json(F.struct(said.alias("content")))).alias("reply"))


@query(f"""SELECT chunk_id, t AS card_type, CASE t WHEN 'question' THEN 'question of ' || chunk_id ELSE upper(substr(t, 1, 1)) || substr(t, 2) END AS title, t || ' of ' || chunk_id AS content, CASE t WHEN 'question' THEN 'answer of ' || chunk_id END AS answer
    FROM {CHUNKS} c, (SELECT unnest([{_list(CARD_TYPES)}]) AS t) WHERE NOT ({_NOT_CHAPTER})""")
def p_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all eight types for every chapter chunk, read from (stand-in) replies."""
    c = chunks(spark, d, "text").where(scope.is_chapter(F.col("text")))
    return cards_from_replies(stub_replies(c)).select("chunk_id", "card_type", "title", "content", "answer")


@query()
def p_phase2(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, cards, nodes, levels): cards of a document's chapter chunks, and the tree over all its chunks."""
    of = chunks(spark, d, "document_id")
    n_cards = p_cards(spark, d).join(of, "chunk_id").groupBy("document_id").agg(F.count("*").alias("cards"))
    tree = p_tree(spark, d).groupBy("document_id").agg(F.countDistinct("parent").alias("nodes"), F.max("level").alias("levels"))
    return of.select("document_id").distinct().join(n_cards, "document_id", "left").join(tree, "document_id", "left").na.fill(0, ["cards", "nodes", "levels"])


@query(f"""WITH {_MENTIONS}, p AS (SELECT document_id, count(*) AS patches FROM {CHUNKS} c JOIN {CHUNK_VECTORS} x ON c.chunk_id = x.id WHERE page_number IS NOT NULL GROUP BY 1), g AS (SELECT document_id, count(DISTINCT concept) AS concepts FROM men JOIN {CHUNKS} USING (chunk_id) GROUP BY 1)
    SELECT document_id, coalesce(patches, 0) AS patches, coalesce(concepts, 0) AS concepts, CASE WHEN r.document_id IS NOT NULL THEN 'skipped' WHEN patches > 0 AND concepts > 0 THEN 'ready' ELSE 'failed' END AS status FROM (SELECT DISTINCT document_id FROM parsed_documents)
    LEFT JOIN p USING (document_id) LEFT JOIN g USING (document_id) LEFT JOIN (SELECT DISTINCT document_id FROM raptor_nodes WHERE is_active AND level = 2) r USING (document_id)""")
def p_phase3(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, patches, concepts, status): what the visual and the graph step give; skipped where a resumed run has it already, failed where either gives nothing."""
    c = chunks(spark, d, "document_id", "page_number")
    p = c.where("page_number is not null").join(chunk_vectors(spark, d).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("patches"))
    g = retrieval._mentions(spark, d).join(c.select("chunk_id", "document_id"), "chunk_id").groupBy("document_id").agg(F.countDistinct("concept").alias("concepts"))
    had = table(spark, d, "raptor_nodes").where("is_active and level = 2").select("document_id").distinct().withColumn("had", F.lit(True))
    j = view(spark, d, "parsed_documents", "document_id").join(p, "document_id", "left").join(g, "document_id", "left").join(had, "document_id", "left").na.fill(0, ["patches", "concepts"])
    status = F.when(F.col("had"), "skipped").when((F.col("patches") > 0) & (F.col("concepts") > 0), "ready").otherwise("failed")
    return j.select("document_id", "patches", "concepts", status.alias("status"))


_STATUS = f"""st AS (SELECT document_id, tenant_id, CASE WHEN n_pages >= page_count AND page_count > 0 THEN 'ready' WHEN n_pages > 0 THEN 'processing' ELSE 'pending' END AS status
    FROM (SELECT document_id, min(tenant_id) AS tenant_id, max(coalesce(page_count, 0)) AS page_count FROM parsed_documents GROUP BY 1) LEFT JOIN (SELECT document_id, count(DISTINCT page_number) AS n_pages FROM page_contents WHERE text <> '' GROUP BY 1) USING (document_id))"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "parsed_documents").groupBy("document_id").agg(F.min("tenant_id").alias("tenant_id"), F.max(F.coalesce("page_count", F.lit(0))).alias("page_count"))
    n = table(spark, d, "page_contents").where("text != ''").groupBy("document_id").agg(F.countDistinct("page_number").alias("n_pages"))
    status = F.when((F.col("n_pages") >= F.col("page_count")) & (F.col("page_count") > 0), "ready").when(F.col("n_pages") > 0, "processing").otherwise("pending")
    return docs.join(n, "document_id", "left").select("document_id", "tenant_id", status.alias("status"))


@query(f"WITH {_STATUS} SELECT * FROM st")
def dml_status(spark: SparkSession, d: str) -> DataFrame:
    """The documents with their state set anew: ready once all their pages have text, processing with some, else pending."""
    return _status(spark, d)


@query(f"WITH {_STATUS} SELECT document_id, status FROM st WHERE tenant_id IN ('{TENANT}', 'global') AND status IN ('ready', 'processing')")
def flt_visual_ready(spark: SparkSession, d: str) -> DataFrame:
    """The documents in a tenant's scope whose pages can be searched, wholly or in part."""
    return _status(spark, d).where(scope.in_scope(F.col("tenant_id"), None, TENANT)).where("status in ('ready', 'processing')").select("document_id", "status")


@query("SELECT DISTINCT document_id, document_id IN (SELECT document_id FROM raptor_nodes WHERE is_active AND document_id IS NOT NULL) AS has_tree, document_id IN (SELECT document_id FROM cards WHERE is_active AND document_id IS NOT NULL) AS has_cards FROM parsed_documents")
def agg_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether anything was derived from a document."""
    has = lambda name, flag: table(spark, d, name).where("is_active").select("document_id").distinct().withColumn(flag, F.lit(True))
    return view(spark, d, "parsed_documents", "document_id").join(has("raptor_nodes", "has_tree"), "document_id", "left").join(has("cards", "has_cards"), "document_id", "left").na.fill(False)


@query(f"SELECT chunk_id AS id, 0 AS level, coalesce(page_number, -1) AS page_number, 'pending' AS status FROM {CHUNKS} UNION ALL SELECT node_id, level, -1, 'pending' FROM {NODES}")
def ddl_evolve(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an older and a newer form in one table: columns that a form lacks take their defaults."""
    old = chunks(spark, d, "page_number", "document_id", "tenant_id", "chunk_index", "text", "char_start", "char_end", "token_count", "version", "is_active").select(F.col("chunk_id").alias("id"), "page_number")
    new = view(spark, d, "raptor_nodes", "node_id", "document_id", "tenant_id", "level", "cluster_id", "summary", "child_ids", "parent_id", "version", "is_active").select(F.col("node_id").alias("id"), "level")
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select("id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("page_number", F.lit(-1)).alias("page_number"), F.lit("pending").alias("status"))


@query()
def p_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The whole ingestion: documents cut into chunks of sentences, small ones joined, numbered and put on their page."""
    return chunking.ingest(view(spark, d, "parsed_documents", "document_id", F.col("full_text").alias("text")).groupBy("document_id").agg(F.min("text").alias("text")), _starts(spark, d))


@query()
def p_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of clusters over each document's chunk vectors: every node under its cluster one level up."""
    own = chunks(spark, d, "document_id").select(F.col("chunk_id").alias("id"), "document_id")
    return build_tree(chunk_vectors(spark, d).join(own, "id"))
