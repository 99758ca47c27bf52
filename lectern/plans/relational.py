"""Scans, filters, joins, aggregates and writes over the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import squeeze, strip
from lectern.operators import scope, store
from lectern.operators.cards import ARTIFACT_TYPES, CARD_TYPES, FACT_TYPES, first_of_content
from lectern.operators.tree import parents_of, summary_stub
from lectern.plans.base import CARDS, CHUNKS, DOCS, NODES, PAGES, TENANT, cards, chunks, query, view
from lectern.plans.retrieval import _BLANK, _strip
from lectern.sources.tables import table

def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query("SELECT doc_id, tenant_id, title FROM documents WHERE is_active")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """Active documents."""
    return table(spark, d, "documents").where("is_active").select("doc_id", "tenant_id", "title")


@query(f"SELECT card_id, document_id, title FROM {CARDS} WHERE is_active AND card_type = 'definition'")
def scan_cards(spark: SparkSession, d: str) -> DataFrame:
    """Active cards of one type."""
    return cards(spark, d, "document_id", "title", "card_type", "is_active").where("is_active and card_type = 'definition'").select("card_id", "document_id", "title")


@query(f"SELECT node_id, document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY level, cluster_id, node_id) AS INT) AS pos FROM {NODES} WHERE is_active")
def scan_raptor(spark: SparkSession, d: str) -> DataFrame:
    """A document's active tree nodes in the order of level and cluster, as a position."""
    n = view(spark, d, "raptor_nodes", "node_id", "document_id", "level", "cluster_id", "is_active").where("is_active")
    return n.select("node_id", "document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("level", "cluster_id", "node_id")).alias("pos"))


@query(f"SELECT page_id, document_id, page_number, len(tables) AS n_tables FROM {PAGES} WHERE len(tables) > 0")
def scan_page_images(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold something besides text (here their tables), with the number of it."""
    return view(spark, d, "page_contents", "page_id", "document_id", "page_number", "tables").where("size(tables) > 0").select("page_id", "document_id", "page_number", F.size("tables").cast("bigint").alias("n_tables"))


@query(f"""SELECT 'all' AS mode, chunk_id FROM {CHUNKS} WHERE tenant_id IN ('{TENANT}', 'global') UNION ALL
    SELECT 'base_textbook', chunk_id FROM {CHUNKS} WHERE tenant_id = 'global' UNION ALL SELECT 'user_upload', chunk_id FROM {CHUNKS} WHERE tenant_id = '{TENANT}'""")
def flt_study_mode(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that each of the three study modes sees."""
    c = chunks(spark, d, "tenant_id")
    seen = [F.when(scope.in_scope(F.col("tenant_id"), None if m == "all" else m, TENANT), m) for m in ("all", "base_textbook", "user_upload")]
    return c.select(F.explode(F.array_compact(F.array(*seen))).alias("mode"), "chunk_id")


@query(f"SELECT node_id, level FROM {NODES} WHERE tenant_id IN ('{TENANT}', 'global') AND is_active")
def flt_raptor(spark: SparkSession, d: str) -> DataFrame:
    """The summaries a tenant sees."""
    return view(spark, d, "raptor_nodes", "node_id", "level", "tenant_id", "is_active").where("is_active").where(scope.in_scope(F.col("tenant_id"), None, TENANT)).select("node_id", "level")


@query(f"SELECT card_id, card_type FROM {CARDS} WHERE tenant_id IN ('{TENANT}', 'global') AND card_type IN ({_list(ARTIFACT_TYPES)}) AND is_active")
def flt_da(spark: SparkSession, d: str) -> DataFrame:
    """The cards of the artifact lane that a tenant sees."""
    c = cards(spark, d, "card_type", "tenant_id", "is_active").where("is_active").where(F.col("card_type").isin(*ARTIFACT_TYPES))
    return c.where(scope.in_scope(F.col("tenant_id"), None, TENANT)).select("card_id", "card_type")


@query(f"SELECT p.page_id, p.page_number FROM {PAGES} p JOIN {DOCS} d USING (document_id) WHERE d.tenant_id = '{TENANT}'")
def flt_visual(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a tenant's own documents."""
    docs = view(spark, d, "parsed_documents", "document_id", "tenant_id").where(scope.in_scope(F.col("tenant_id"), "user_upload", TENANT))
    return view(spark, d, "page_contents", "page_id", "document_id", "page_number").join(docs, "document_id", "left_semi").select("page_id", "page_number")


@query("SELECT doc_id FROM documents WHERE NOT (" + " OR ".join(f"contains(substr(lower(coalesce(text, '')), 1, 500), '{k}')".replace("\n", "' || chr(10) || '") for k in scope.NOT_CHAPTER) + ")")
def flt_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that don't begin as front or back matter."""
    return table(spark, d, "documents").where(scope.is_chapter(F.col("text"))).select("doc_id")


@query(f"SELECT card_id FROM {CARDS} WHERE lower({_strip('content')}) NOT IN ({_list(scope.EMPTY_CARD)})")
def flt_skip_values(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose content says something."""
    return cards(spark, d, "content").where(scope.says_something(F.col("content"))).select("card_id")


@query(f"SELECT card_id, card_type FROM {CARDS} WHERE card_type IN ({_list(FACT_TYPES)}) AND lower({_strip('content')}) NOT IN ({_list(scope.EMPTY_FACT)})")
def flt_keyfact_junk(spark: SparkSession, d: str) -> DataFrame:
    """Cards that may be shown as key facts."""
    return cards(spark, d, "content", "card_type").where(F.col("card_type").isin(*FACT_TYPES)).where(scope.says_something(F.col("content"), scope.EMPTY_FACT)).select("card_id", "card_type")


@query(f"SELECT page_id FROM {PAGES} WHERE length({_strip('text')}) > 0")
def flt_empty_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages with text."""
    return view(spark, d, "page_contents", "page_id", "text").where(F.length(strip(F.col("text"))) > 0).select("page_id")


@query(f"SELECT document_id FROM {DOCS} WHERE document_id NOT IN (SELECT document_id FROM raptor_nodes WHERE document_id IS NOT NULL)")
def flt_resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose tree is still to be built."""
    return view(spark, d, "parsed_documents", "document_id").join(table(spark, d, "raptor_nodes").select("document_id"), "document_id", "left_anti")


@query(f"""SELECT document_id, CASE WHEN n > 0 AND page_count > 0 THEN 'Visual ready' WHEN page_count > 0 THEN 'Visual pending' ELSE 'unknown' END AS badge
    FROM (SELECT document_id, max(page_count) AS page_count FROM parsed_documents GROUP BY 1) LEFT JOIN (SELECT document_id, count(*) AS n FROM {PAGES} GROUP BY 1) USING (document_id)""")
def case_status(spark: SparkSession, d: str) -> DataFrame:
    """Each document's processing badge, from its pages."""
    docs = table(spark, d, "parsed_documents").groupBy("document_id").agg(F.max("page_count").alias("page_count"))
    n = view(spark, d, "page_contents", "page_id", "document_id").groupBy("document_id").agg(F.count("*").alias("n"))
    state = F.when((F.col("n") > 0) & (F.col("page_count") > 0), "ready").when(F.col("page_count") > 0, "pending").otherwise("unknown")
    return docs.join(n, "document_id", "left").select("document_id", scope.status_badge(state).alias("badge"))


@query(f"""SELECT card_id, CASE WHEN card_type = 'question' THEN concat_ws(chr(10), content, answer) ELSE coalesce(title, '') || ': ' || coalesce(content, '') END AS embed_text
    FROM {CARDS} WHERE card_type IN ({_list(ARTIFACT_TYPES)}) AND is_active""")
def prj_embed_text(spark: SparkSession, d: str) -> DataFrame:
    """What of each card would be embedded."""
    c = cards(spark, d, "card_type", "title", "content", "answer", "is_active").where("is_active").where(F.col("card_type").isin(*ARTIFACT_TYPES))
    return c.select("card_id", scope.embed_text(F.col("card_type"), F.col("title"), F.col("content"), F.col("answer")).alias("embed_text"))


@query(f"""SELECT chunk_id, tenant_id, CASE WHEN tenant_id = 'global' THEN 'base_textbook' ELSE 'user_upload' END AS source_type, tenant_id = 'global' AS is_global_baseline, document_id, chunk_index,
    coalesce(page_number, -1) AS page_number, title, subject, char_start, char_end FROM {CHUNKS} JOIN (SELECT DISTINCT document_id, title, subject FROM parsed_documents) USING (document_id)""")
def prj_payload(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with what is stored beside its vector."""
    c = chunks(spark, d, "tenant_id", "document_id", "chunk_index", "page_number", "char_start", "char_end")
    own = F.when(F.col("tenant_id") == "global", "base_textbook").otherwise("user_upload")
    docs = view(spark, d, "parsed_documents", "document_id", "title", "subject")
    return c.join(docs, "document_id").select("chunk_id", "tenant_id", own.alias("source_type"), (F.col("tenant_id") == "global").alias("is_global_baseline"), "document_id", "chunk_index", F.coalesce("page_number", F.lit(-1)).alias("page_number"), "title", "subject", "char_start", "char_end")


@query(f"SELECT chunk_id, '[Page ' || coalesce(CAST(page_number AS VARCHAR), '?') || '] ' || substr(text, 1, 150) AS passage FROM {CHUNKS} WHERE is_active UNION ALL SELECT node_id, '[Summary] ' || substr(summary, 1, 150) FROM {NODES} WHERE is_active")
def prj_passage(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and summaries as the passages of a prompt."""
    c = chunks(spark, d, "page_number", "text", "is_active").where("is_active")
    page = F.coalesce(F.col("page_number").cast("string"), F.lit("?"))
    n = view(spark, d, "raptor_nodes", "node_id", "summary", "is_active").where("is_active")
    return c.select("chunk_id", F.concat(F.lit("[Page "), page, F.lit("] "), F.substring("text", 1, 150)).alias("passage")).union(n.select("node_id", F.concat(F.lit("[Summary] "), F.substring("summary", 1, 150))))


@query(f"SELECT card_id, chunk_id, card_type, coalesce(page_number, -1) AS page_number FROM {CARDS} c JOIN (SELECT DISTINCT chunk_id, page_number FROM text_chunks) USING (chunk_id) WHERE c.is_active")
def jn_card_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Active cards with their chunk's page."""
    return cards(spark, d, "chunk_id", "card_type", "is_active").where("is_active").join(chunks(spark, d, "page_number"), "chunk_id").select("card_id", "chunk_id", "card_type", F.coalesce("page_number", F.lit(-1)).alias("page_number"))


@query(f"""SELECT chunk_id, card_id, CAST(n AS INT) AS n FROM (SELECT chunk_id, card_id, row_number() OVER (PARTITION BY chunk_id ORDER BY card_id) AS n FROM {CARDS} WHERE is_active AND card_type IN ({_list(FACT_TYPES)})) WHERE n <= 2""")
def jn_cards_for_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first two key-fact cards of every chunk."""
    c = cards(spark, d, "chunk_id", "card_type", "is_active").where("is_active").where(F.col("card_type").isin(*FACT_TYPES))
    return c.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("card_id"))).where("n <= 2").select("chunk_id", "card_id", "n")


@query(f"SELECT n.node_id, p.parent FROM (SELECT DISTINCT node_id FROM raptor_nodes) n LEFT JOIN (SELECT child, min(node_id) AS parent FROM (SELECT node_id, unnest(child_ids) AS child FROM {NODES}) GROUP BY 1) p ON n.node_id = p.child")
def jn_tree_parent(spark: SparkSession, d: str) -> DataFrame:
    """Each tree node with the node above it."""
    return parents_of(view(spark, d, "raptor_nodes", "node_id", "child_ids"))


@query(f"""SELECT document_id, tenant_id FROM (SELECT document_id, tenant_id, row_number() OVER (PARTITION BY document_id ORDER BY o, tenant_id) AS n
    FROM (SELECT document_id, tenant_id, 0 AS o FROM {DOCS} WHERE tenant_id = '{TENANT}' UNION ALL SELECT document_id, tenant_id, 1 FROM {DOCS} WHERE tenant_id = 'global')) WHERE n = 1""")
def jn_docs_union(spark: SparkSession, d: str) -> DataFrame:
    """A tenant's documents and the global ones, each once."""
    docs = view(spark, d, "parsed_documents", "document_id", "tenant_id")
    both = docs.where(F.col("tenant_id") == TENANT).withColumn("o", F.lit(0)).union(docs.where("tenant_id = 'global'").withColumn("o", F.lit(1)))
    return both.groupBy("document_id").agg(F.min_by("tenant_id", F.struct("o", "tenant_id")).alias("tenant_id"))


@query(f"SELECT document_id FROM (SELECT DISTINCT document_id FROM parsed_documents) WHERE document_id IN (SELECT document_id FROM cards WHERE is_active AND card_type IN ('summary', 'definition'))")
def jn_docs_with_cards(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a summary or definition card."""
    c = table(spark, d, "cards").where("is_active and card_type in ('summary', 'definition')").select("document_id")
    return view(spark, d, "parsed_documents", "document_id").join(c, "document_id", "left_semi")


@query(f"""SELECT document_id, coalesce(c, 0) AS n_cards, coalesce(r, 0) AS n_nodes, coalesce(p, 0) AS n_pages FROM (SELECT DISTINCT document_id FROM parsed_documents)
    LEFT JOIN (SELECT document_id, count(*) AS c FROM {CARDS} WHERE is_active GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS r FROM {NODES} WHERE is_active GROUP BY 1) USING (document_id)
    LEFT JOIN (SELECT document_id, count(*) AS p FROM {PAGES} GROUP BY 1) USING (document_id)""")
def jn_status(spark: SparkSession, d: str) -> DataFrame:
    """Each document with what was derived from it."""
    n = lambda t, key, name: (t.groupBy("document_id").agg(F.count(key).alias(name)))
    c = n(cards(spark, d, "document_id", "is_active").where("is_active"), "card_id", "n_cards")
    r = n(view(spark, d, "raptor_nodes", "node_id", "document_id", "is_active").where("is_active"), "node_id", "n_nodes")
    p = n(view(spark, d, "page_contents", "page_id", "document_id"), "page_id", "n_pages")
    out = view(spark, d, "parsed_documents", "document_id")
    for t in (c, r, p):
        out = out.join(t, "document_id", "left")
    return out.na.fill(0)


@query(f"""SELECT tenant_id = 'global' AS is_global, count(*) AS n_docs, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS pages, count(*) FILTER (title IS NULL) AS untitled
    FROM (SELECT DISTINCT document_id, tenant_id, page_count, title FROM parsed_documents) GROUP BY 1""")
def agg_status_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the documents, the global ones apart."""
    docs = view(spark, d, "parsed_documents", "document_id", "tenant_id", "page_count", "title")
    return docs.groupBy((F.col("tenant_id") == "global").alias("is_global")).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"), F.count_if(F.col("title").isNull()).alias("untitled"))


@query(f"SELECT coalesce(card_type, 'total') AS card_type, count(*) AS n FROM {CARDS} WHERE is_active AND card_type IN ({_list(ARTIFACT_TYPES)}) GROUP BY ROLLUP (card_type)")
def agg_da_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Cards of the artifact lane by type, and in total."""
    c = cards(spark, d, "card_type", "is_active").where("is_active").where(F.col("card_type").isin(*ARTIFACT_TYPES))
    return c.rollup("card_type").agg(F.count("*").alias("n")).select(F.coalesce("card_type", F.lit("total")).alias("card_type"), "n")


@query(f"""SELECT document_id, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages, count(DISTINCT page_number) AS n, max(title) AS title FROM {CHUNKS} LEFT JOIN (SELECT document_id, max(title) AS title FROM parsed_documents GROUP BY 1) USING (document_id) WHERE page_number IS NOT NULL GROUP BY 1""")
def agg_citation_line(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pages that hold chunks, in their order, as one line, and its title."""
    c = table(spark, d, "text_chunks").select("document_id", "page_number").where("page_number is not null")
    pages = c.groupBy("document_id").agg(F.array_sort(F.collect_set("page_number")).alias("p"))
    title = table(spark, d, "parsed_documents").groupBy("document_id").agg(F.max("title").alias("title"))
    return pages.join(title, "document_id", "left").select("document_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"), F.size("p").cast("bigint").alias("n"), "title")


@query(f"SELECT document_id, array_to_string(list_sort(list(DISTINCT level)), ',') AS levels FROM {NODES} GROUP BY 1")
def agg_levels(spark: SparkSession, d: str) -> DataFrame:
    """The levels of each document's tree."""
    return table(spark, d, "raptor_nodes").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("level")).cast("array<string>"), ",").alias("levels"))


@query(f"""SELECT n.node_id, count(*) AS members, '[stub summary] ' || array_to_string((list(substr(c.text, 1, 40) ORDER BY c.chunk_index, c.chunk_id))[1:3], ' | ') AS summary
    FROM (SELECT node_id, unnest(child_ids) AS chunk_id FROM {NODES} WHERE level = 1) n JOIN {CHUNKS} c USING (chunk_id) GROUP BY 1""")
def agg_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """Each level-1 node with the number of its chunks and a summary made of their beginnings."""
    n = view(spark, d, "raptor_nodes", "node_id", "child_ids", "level").where("level = 1").select("node_id", F.explode("child_ids").alias("chunk_id"))
    g = n.join(chunks(spark, d, "chunk_index", "text"), "chunk_id").groupBy("node_id").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.substring("text", 1, 40).alias("s")))).alias("a"))
    return g.select("node_id", "members", summary_stub(F.transform("a", lambda x: x["s"])).alias("summary"))


@query(f"""SELECT document_id, coalesce(page_number, 0) AS page, chunk_id, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY document_id, coalesce(page_number, 0) ORDER BY chunk_index, chunk_id) AS n FROM {CHUNKS}) WHERE n <= 2""")
def win_cap_per_page(spark: SparkSession, d: str) -> DataFrame:
    """At most two chunks of every page."""
    c = chunks(spark, d, "document_id", "page_number", "chunk_index").withColumn("page", F.coalesce("page_number", F.lit(0)))
    return c.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "page").orderBy("chunk_index", "chunk_id"))).where("n <= 2").select("document_id", "page", "chunk_id", "n")


@query(f"""SELECT card_id, document_id FROM (SELECT card_id, document_id, row_number() OVER (PARTITION BY document_id, substr(lower({_strip('content')}), 1, 200) ORDER BY card_id) AS n FROM {CARDS} WHERE is_active AND content IS NOT NULL) WHERE n = 1""")
def win_dedup_content(spark: SparkSession, d: str) -> DataFrame:
    """A document's cards without those that begin like an earlier one."""
    c = cards(spark, d, "document_id", "content", "is_active").where("is_active and content is not null")
    return first_of_content(c, "document_id", "card_id").select("card_id", "document_id")


@query(f"""SELECT document_id, card_type, card_id, CAST(n AS INT) AS n, total FROM (SELECT document_id, card_type, card_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY document_id, card_type) AS total FROM
    (SELECT *, row_number() OVER (PARTITION BY document_id, card_type, substr(lower({_strip('content')}), 1, 200) ORDER BY card_id) AS nth FROM {CARDS} WHERE is_active AND content IS NOT NULL) WHERE nth = 1 WINDOW w AS (PARTITION BY document_id, card_type ORDER BY card_id)) WHERE n <= 50""")
def lim_display(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty cards of each type of a document, of those that say something new, with the number of all of these."""
    by = Window.partitionBy("document_id", "card_type")
    c = cards(spark, d, "document_id", "card_type", "content", "is_active").where("is_active and content is not null").withColumn("of", F.struct("document_id", "card_type"))
    c = first_of_content(c, "of", "card_id")
    return c.withColumn("n", F.row_number().over(by.orderBy("card_id"))).withColumn("total", F.count("*").over(by)).where("n <= 50").select("document_id", "card_type", "card_id", "n", "total")


@query(f"SELECT chunk_id, substr(text, 1, 150) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n FROM {CHUNKS}) WHERE n <= 3")
def lim_preview(spark: SparkSession, d: str) -> DataFrame:
    """The beginnings of each document's first three chunks."""
    c = chunks(spark, d, "document_id", "chunk_index", "text")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))).where("n <= 3").select("chunk_id", F.substring("text", 1, 150).alias("preview"))


@query(f"""SELECT x.chunk_id AS a, y.chunk_id AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard
    FROM (SELECT chunk_id, document_id, chunk_index, list_distinct(list_filter(regexp_split_to_array(lower(text), '{_BLANK}'), lambda x: x <> '')) AS t FROM {CHUNKS}) x
    JOIN (SELECT chunk_id, document_id, chunk_index, list_distinct(list_filter(regexp_split_to_array(lower(text), '{_BLANK}'), lambda x: x <> '')) AS t FROM {CHUNKS}) y ON x.document_id = y.document_id AND y.chunk_index = x.chunk_index + 1
    WHERE len(x.t) + len(y.t) > 0""")
def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Token similarity of neighbouring chunks."""
    t = F.array_distinct(F.filter(F.split(F.lower("text"), _BLANK), lambda x: x != ""))
    c = chunks(spark, d, "document_id", "chunk_index", "text").select("chunk_id", "document_id", "chunk_index", t.alias("t"))
    y = c.select(F.col("chunk_id").alias("b"), "document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("t").alias("u"))
    j = F.round(F.size(F.array_intersect("t", "u")) / F.size(F.array_union("t", "u")), 6)
    return c.join(y, ["document_id", "chunk_index"]).where(F.size("t") + F.size("u") > 0).select(F.col("chunk_id").alias("a"), "b", j.alias("jaccard"))


@query(f"SELECT chunk_id FROM {CHUNKS} WHERE chunk_id NOT IN (SELECT chunk_id FROM cards WHERE chunk_id IS NOT NULL)")
def set_except_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without cards."""
    return chunks(spark, d).join(table(spark, d, "cards").select("chunk_id"), "chunk_id", "left_anti")


@query("SELECT document_id FROM parsed_documents INTERSECT SELECT document_id FROM cards")
def set_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents that cards exist for."""
    return table(spark, d, "parsed_documents").select("document_id").intersect(table(spark, d, "cards").select("document_id"))


@query(f"""SELECT card_id, json_extract_string(m, '$.model') AS model, coalesce(CAST(json_extract_string(m, '$.retries') AS INT), -1) AS retries
    FROM (SELECT card_id, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m FROM {CARDS})""")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What can be read of the cards' metadata; cut documents read as null and -1."""
    m = F.from_json("metadata_json", "struct<model:string,retries:int,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    c = cards(spark, d, "metadata_json").withColumn("m", m).withColumn("ok", F.col("m._bad").isNull())
    return c.select("card_id", F.when(F.col("ok"), F.col("m.model")).alias("model"), F.coalesce(F.when(F.col("ok"), F.col("m.retries")), F.lit(-1)).alias("retries"))


@query(f"SELECT node_id, CAST(to_json(child_ids) AS VARCHAR) AS child_ids_json, len(child_ids) AS n FROM {NODES}")
def json_child_ids(spark: SparkSession, d: str) -> DataFrame:
    """Child ids as JSON text."""
    return view(spark, d, "raptor_nodes", "node_id", "child_ids").select("node_id", F.to_json("child_ids").alias("child_ids_json"), F.when(F.col("child_ids").isNotNull(), F.size("child_ids")).cast("bigint").alias("n"))


@query(f"""SELECT card_id, version, is_active AND document_id NOT IN (SELECT document_id FROM cards WHERE NOT is_active AND document_id IS NOT NULL) AS is_active FROM {CARDS}
    UNION ALL SELECT card_id || '-new', version + 1, true FROM {CARDS} WHERE NOT is_active""")
def snk_cards(spark: SparkSession, d: str) -> DataFrame:
    """The cards when the inactive ones are written again as a new version: those their documents had are deactivated, the new ones stand behind."""
    old = cards(spark, d, "document_id", "version", "is_active")
    new = old.where("not is_active").select(F.concat("card_id", F.lit("-new")).alias("card_id"), "document_id", (F.col("version") + 1).alias("version"), F.lit(True).alias("is_active"))
    return store.replace_of(old, new, "document_id").select("card_id", "version", "is_active")


@query(f"SELECT card_id, is_active AND document_id NOT IN (SELECT document_id FROM parsed_documents WHERE page_count = 0) AS is_active FROM {CARDS}")
def dml_softdelete(spark: SparkSession, d: str) -> DataFrame:
    """Cards after those of documents without pages were deactivated."""
    gone = table(spark, d, "parsed_documents").where("page_count = 0")
    return store.deactivate(cards(spark, d, "document_id", "is_active"), gone, ["document_id"]).select("card_id", "is_active")


_GONE = "(SELECT document_id FROM parsed_documents WHERE tenant_id = 'global')"


@query(f"""SELECT 'documents' AS kind, count(*) AS n FROM {DOCS} WHERE document_id NOT IN {_GONE} UNION ALL SELECT 'chunks', count(*) FROM {CHUNKS} WHERE document_id NOT IN {_GONE} UNION ALL SELECT 'cards', count(*) FROM {CARDS} WHERE document_id NOT IN {_GONE}
    UNION ALL SELECT 'nodes', count(*) FROM {NODES} WHERE document_id NOT IN {_GONE} UNION ALL SELECT 'pages', count(*) FROM {PAGES} WHERE document_id NOT IN {_GONE}
    UNION ALL SELECT 'vectors', count(DISTINCT chunk_id) FROM embedded_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM text_chunks WHERE document_id IN {_GONE})
    UNION ALL SELECT 'tree vectors', count(DISTINCT node_id) FROM raptor_nodes WHERE embedding IS NOT NULL AND node_id NOT IN (SELECT node_id FROM raptor_nodes WHERE document_id IN {_GONE})""")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    """What each of the seven places still holds after the global documents and all that hangs on them were deleted."""
    gone = table(spark, d, "parsed_documents").where("tenant_id = 'global'").select("document_id").distinct()
    docs = view(spark, d, "parsed_documents", "document_id")
    c, n, p = (view(spark, d, t, k, "document_id") for t, k in (("text_chunks", "chunk_id"), ("raptor_nodes", "node_id"), ("page_contents", "page_id")))
    kept = {"documents": (docs, gone, "document_id"), "chunks": (c, gone, "document_id"), "cards": (cards(spark, d, "document_id"), gone, "document_id"), "nodes": (n, gone, "document_id"), "pages": (p, gone, "document_id")}
    kept["vectors"] = view(spark, d, "embedded_chunks", "chunk_id"), c.join(gone, "document_id", "left_semi"), "chunk_id"
    kept["tree vectors"] = table(spark, d, "raptor_nodes").where("embedding is not null").select("node_id").distinct(), n.join(gone, "document_id", "left_semi"), "node_id"
    return reduce(DataFrame.union, [store.delete(t, g, [k]).agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, (t, g, k) in kept.items()])


@query(f"""SELECT document_id, max(page_count) AS page_count, coalesce(max(n), 0) AS actual_chunks FROM parsed_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM {CHUNKS} WHERE is_active GROUP BY 1) USING (document_id) GROUP BY 1""")
def dml_stats(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the chunks it really has."""
    n = chunks(spark, d, "document_id", "is_active").where("is_active").groupBy("document_id").agg(F.count("*").alias("n"))
    docs = table(spark, d, "parsed_documents").groupBy("document_id").agg(F.max("page_count").alias("page_count"))
    return docs.join(n, "document_id", "left").select("document_id", "page_count", F.coalesce("n", F.lit(0)).alias("actual_chunks"))


@query(f"""SELECT chunk_id, t AS card_type, CASE t WHEN 'question' THEN 'answer of ' || chunk_id END AS answer FROM {CHUNKS}, (SELECT unnest([{_list(CARD_TYPES)}]) AS t)""")
def m_card_stub(spark: SparkSession, d: str) -> DataFrame:
    """Eight stand-in cards for each chunk; only the question has an answer."""
    c = chunks(spark, d).withColumn("card_type", F.explode(F.array(*map(F.lit, CARD_TYPES))))
    return c.select("chunk_id", "card_type", F.when(F.col("card_type") == "question", F.concat(F.lit("answer of "), F.col("chunk_id"))).alias("answer"))


@query(f"""SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 60)), '{_BLANK}', ' ', 'g')) AS head, upper(substr(title, 1, 1)) || lower(substr(title, 2)) AS title,
    regexp_extract(text, '[0-9]') AS digit, contains(text, 'the') AS has_the, instr(text, 'of') AS of_at, starts_with(text, 'A ') AS starts_a, CAST(length(text) // 4 AS BIGINT) AS rough_tokens FROM documents""")
def str_functions(spark: SparkSession, d: str) -> DataFrame:
    """The string functions in use, over all documents."""
    t, title = F.col("text"), F.col("title")
    return table(spark, d, "documents").select(
        "doc_id", squeeze(F.lower(F.substring(t, 1, 60))).alias("head"), F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.substring(title, 2, F.length(title)))).alias("title"), F.regexp_extract(t, "[0-9]", 0).alias("digit"),
        F.contains(t, F.lit("the")).alias("has_the"), F.instr(t, "of").cast("bigint").alias("of_at"), F.startswith(t, F.lit("A ")).alias("starts_a"), F.floor(F.length(t) / 4).alias("rough_tokens"),
    )
