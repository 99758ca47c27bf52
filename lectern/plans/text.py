"""Chunking, page attribution, model fitting and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import token_count
from lectern.operators import chunking, classify, evaluation
from lectern.operators.cards import cards_from_replies
from lectern.operators.tree import cluster_count, gaussian_clusters
from lectern.plans.base import CARDS, CHUNKS, DOCS, PAGES, cards, chunk_vectors, chunks, query, view
from lectern.plans.relational import _BLANK, _strip
from lectern.sources.tables import table

_COUNT = f"len(list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> ''))"


@query(f"""WITH RECURSIVE parts AS (SELECT document_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT document_id, list_filter(list_transform(string_split(regexp_replace(full_text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS l FROM (SELECT DISTINCT document_id, full_text FROM parsed_documents))),
    sized AS (SELECT document_id, i, s, {_COUNT.replace("text", "s")} AS n FROM parts), sent AS (SELECT *, sum(n) OVER (PARTITION BY document_id ORDER BY i) AS upto FROM sized),
    looked AS (SELECT a.document_id, a.i, any_value(a.upto) AS upto, count(b.i) AS back FROM sent a LEFT JOIN sent b ON a.document_id = b.document_id AND b.i < a.i AND (a.upto - a.n) - (b.upto - b.n) <= {chunking.OVERLAP} AND a.upto - (b.upto - b.n) <= {chunking.CHUNK_TOKENS} GROUP BY 1, 2),
    fold AS (SELECT document_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS first, 0 AS pos FROM sent WHERE i = 0 UNION ALL
      SELECT f.document_id, e.i, CASE WHEN e.upto - (b.upto - b.n) > {chunking.CHUNK_TOKENS} THEN e.i - least(e.back, e.i - f.first - 1) ELSE f.first END, f.pos + CAST(e.upto - (b.upto - b.n) > {chunking.CHUNK_TOKENS} AS INT)
      FROM fold f JOIN looked e ON e.document_id = f.document_id AND e.i = f.i + 1 JOIN sent b ON b.document_id = f.document_id AND b.i = f.first),
    spans AS (SELECT document_id, pos, min(first) AS a, max(i) AS b FROM fold GROUP BY 1, 2)
    SELECT p.document_id, CAST(pos AS INT) AS pos, string_agg(s, ' ' ORDER BY i) AS text, CAST(sum(n) AS BIGINT) AS token_count FROM spans p JOIN sent ON p.document_id = sent.document_id AND i BETWEEN a AND b GROUP BY 1, 2""")
def win_sentence_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of whole sentences."""
    docs = view(spark, d, "parsed_documents", "document_id", F.col("full_text").alias("text"))
    return chunking.sentence_chunks(docs)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "chunk_index", "text", "char_start", "char_end")
    return c.select("document_id", F.col("chunk_index").alias("pos"), "text", "char_start", "char_end", token_count(F.col("text")).alias("token_count"))


@query(f"""SELECT document_id, CAST(g - 1 AS INT) AS chunk_index, CAST(sum(n) AS BIGINT) AS token_count, min(char_start) AS char_start FROM (SELECT *, sum(CASE WHEN r = 1 OR n >= 32 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY chunk_index) AS g
    FROM (SELECT *, {_COUNT} AS n, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM {CHUNKS} WHERE length(regexp_replace(text, '{_BLANK}', '', 'g')) > 0)) GROUP BY document_id, g""")
def win_micro_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the small ones joined to those before, numbered anew."""
    return chunking.merge_micro(_counted(spark, d)).select("document_id", "chunk_index", "token_count", "char_start")


def _starts(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "parsed_documents", "document_id", "full_text").groupBy("document_id").agg(F.min("full_text").alias("full_text"))
    return chunking.page_offsets(docs, view(spark, d, "page_contents", "document_id", "page_number", "text"))


_LOCATED = f"""pg AS (SELECT document_id, page_number, substr(text, 1, 100) AS s, row_number() OVER (PARTITION BY document_id ORDER BY page_number, substr(text, 1, 100)) AS rn FROM
      (SELECT DISTINCT document_id, page_number, text FROM page_contents WHERE text IS NOT NULL AND text <> '')),
    tx AS (SELECT document_id, min(full_text) AS t FROM parsed_documents GROUP BY 1),
    walk AS (SELECT document_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS INT) AS page_number, CAST(0 AS BIGINT) AS start FROM tx
      UNION ALL SELECT w.document_id, pg.rn, CASE WHEN strpos(substr(t, cursor + 1), s) > 0 THEN cursor + strpos(substr(t, cursor + 1), s) - 1 + length(s) ELSE cursor END,
        CASE WHEN strpos(substr(t, cursor + 1), s) > 0 THEN pg.page_number END, cursor + strpos(substr(t, cursor + 1), s) - 1 FROM walk w JOIN pg ON w.document_id = pg.document_id AND pg.rn = w.rn + 1 JOIN tx ON w.document_id = tx.document_id),
    located AS (SELECT document_id, page_number, CAST(start AS INT) AS start FROM walk WHERE page_number IS NOT NULL)"""


@query(f"WITH RECURSIVE {_LOCATED} SELECT * FROM located")
def jn_page_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where each page begins in its document's text."""
    return _starts(spark, d)


@query(f"""WITH RECURSIVE {_LOCATED}, c AS (SELECT DISTINCT chunk_id, document_id, char_start FROM text_chunks)
    SELECT c.chunk_id, c.document_id, c.char_start, arg_max(l.page_number, (l.start, l.page_number)) AS page_number FROM c LEFT JOIN located l ON c.document_id = l.document_id AND l.start <= c.char_start GROUP BY 1, 2, 3""")
def jn_page_asof(spark: SparkSession, d: str) -> DataFrame:
    """The page of each chunk by its first character."""
    return chunking.page_as_of(chunks(spark, d, "document_id", "char_start"), _starts(spark, d))


@query(f"""WITH RECURSIVE c AS (SELECT chunk_id, document_id, CASE WHEN token_count > 0 THEN token_count ELSE {_COUNT} END AS n, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS rn FROM (SELECT DISTINCT chunk_id, document_id, chunk_index, token_count, text FROM text_chunks)),
    w AS (SELECT chunk_id, document_id, rn, 0 AS win, CAST(n AS BIGINT) AS s FROM c WHERE rn = 1 UNION ALL
      SELECT c.chunk_id, c.document_id, c.rn, CASE WHEN w.s + c.n <= {chunking.WINDOW_TOKENS} OR w.s = 0 THEN w.win ELSE w.win + 1 END, CASE WHEN w.s + c.n <= {chunking.WINDOW_TOKENS} OR w.s = 0 THEN w.s + c.n ELSE c.n END FROM w JOIN c ON w.document_id = c.document_id AND c.rn = w.rn + 1)
    SELECT chunk_id, document_id, win AS "window" FROM w""")
def win_ctx_pack(spark: SparkSession, d: str) -> DataFrame:
    """Chunks filled into context windows."""
    c = chunks(spark, d, "document_id", "chunk_index", "token_count", "text")
    n = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(token_count(F.col("text"))).cast("bigint")
    return chunking.context_windows(c.select("chunk_id", "document_id", "chunk_index", n.alias("n")))


@query(f"""SELECT document_id, string_agg(text, chr(10) ORDER BY page_number, page_id) AS text, count(*) AS n FROM {PAGES} WHERE text IS NOT NULL AND text <> '' GROUP BY 1""")
def src_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents put together from their pages."""
    p = view(spark, d, "page_contents", "page_id", "document_id", "page_number", "text").where("text is not null and text != ''")
    a = F.array_sort(F.collect_list(F.struct("page_number", "page_id", "text")))
    return p.groupBy("document_id").agg(F.array_join(F.transform(a, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n"))


@query("""SELECT document_id, page_number, text FROM (SELECT document_id, CAST(p AS INT) AS page_number, array_to_string(CASE WHEN whole THEN l ELSE l[(p - 1) * (len(l) // page_count) + 1:p * (len(l) // page_count)] END, chr(10)) AS text
    FROM (SELECT *, unnest(range(1, CASE WHEN whole THEN 2 ELSE page_count + 1 END)) AS p FROM (SELECT document_id, coalesce(page_count, 0) AS page_count, string_split(full_text, chr(10)) AS l, coalesce(page_count, 0) < 1 OR len(string_split(full_text, chr(10))) < coalesce(page_count, 0) AS whole FROM (SELECT DISTINCT document_id, page_count, full_text FROM parsed_documents))))
    WHERE length(""" + _strip("text") + """) > 0""")
def src_even_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents without page marks: their lines in even pages, what is left over dropped."""
    return chunking.even_pages(view(spark, d, "parsed_documents", "document_id", F.col("full_text").alias("text"), "page_count"))


@query("SELECT doc_id, substr(nullif(regexp_extract(text, '(?m)^# +([^\\r\\n]+)', 1), ''), 1, 200) AS title FROM documents")
def src_title(spark: SparkSession, d: str) -> DataFrame:
    """The first heading of the first level of each document, null without one."""
    t = F.nullif(F.regexp_extract("text", r"(?m)^# +([^\r\n]+)", 1), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.substring(t, 1, 200).alias("title"))


@query(f"""SELECT chunk_id, card_type, coalesce({_strip('title')}, upper(substr(card_type, 1, 1)) || substr(card_type, 2)) AS title, {_strip('content')} AS content FROM {CARDS} WHERE card_type NOT IN ('question', 'factoid', 'summary') AND content IS NOT NULL AND lower({_strip('content')}) NOT IN ('n/a', 'none', 'not applicable', 'no formula', 'null', '')""")
def json_single(spark: SparkSession, d: str) -> DataFrame:
    """Cards written as a model's reply and read again; those that say nothing are gone."""
    c = cards(spark, d, "chunk_id", "card_type", "title", "content")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("title", "content")), F.lit("\n```"))
    back = cards_from_replies(c.select("card_id", "chunk_id", "card_type", reply.alias("reply")).where("card_type not in ('question', 'factoid', 'summary')").select("chunk_id", "card_type", "reply"))
    return back.select("chunk_id", "card_type", "title", "content")


@query("""SELECT chunk_id, CAST(ord AS INT) AS ord, substr(question, 1, 120) AS title, answer FROM (SELECT chunk_id, question, answer, row_number() OVER (PARTITION BY chunk_id ORDER BY pair_id, question, answer) - 1 AS ord FROM (SELECT DISTINCT pair_id, chunk_id, question, answer FROM qa_pairs))
    WHERE """ + _strip("question") + " <> '' AND " + _strip("answer") + " <> ''")
def json_qa(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's questions and answers, written as one reply and read again as cards."""
    c = view(spark, d, "qa_pairs", "pair_id", "chunk_id", "question", "answer").groupBy("chunk_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "question", "answer"))), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))).alias("reply"))
    return cards_from_replies(c.select("chunk_id", F.lit("question").alias("card_type"), "reply")).select("chunk_id", "ord", "title", "answer")


_CITING = """(SELECT pair_id, document_id, 'See [Page ' || (length(question) % 5 + 1) || '] and [page ' || (length(answer) % 7 + 1) || '] of ' || document_id AS answer FROM (SELECT DISTINCT pair_id, document_id, question, answer FROM qa_pairs WHERE answer IS NOT NULL))"""


def _citing(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, document_id, answer): answers that cite two pages, derived from the lengths of question and answer."""
    q = view(spark, d, "qa_pairs", "pair_id", "document_id", "question", "answer").where("answer is not null")
    return q.select("pair_id", "document_id", F.concat(F.lit("See [Page "), (F.length("question") % 5 + 1).cast("string"), F.lit("] and [page "), (F.length("answer") % 7 + 1).cast("string"), F.lit("] of "), "document_id").alias("answer"))


@query(f"""SELECT pair_id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, coalesce(p, []))) / len(c) ELSE 1 END, 4) AS accuracy FROM (SELECT q.pair_id, list_distinct(list_transform(regexp_extract_all(q.answer, '(?i)\\[Page (\\d+)\\]', 1), lambda x: CAST(x AS INT))) AS c, d.p
    FROM {_CITING} q LEFT JOIN (SELECT document_id, list(DISTINCT page_number) AS p FROM page_contents GROUP BY 1) d USING (document_id))""")
def agg_citation_acc(spark: SparkSession, d: str) -> DataFrame:
    """Share of the pages an answer cites that its document has."""
    p = table(spark, d, "page_contents").groupBy("document_id").agg(F.collect_set("page_number").alias("p"))
    return _citing(spark, d).join(p, "document_id", "left").select("pair_id", evaluation.citation_accuracy(F.col("answer"), F.coalesce("p", F.array().cast("array<int>"))).alias("accuracy"))


@query(f"""SELECT q.pair_id, CAST(page AS INT) AS page FROM (SELECT DISTINCT pair_id, document_id, CAST(unnest(regexp_extract_all(answer, '(?i)\\[Page (\\d+)\\]', 1)) AS INT) AS page FROM {_CITING}) q JOIN (SELECT DISTINCT document_id, page_number FROM page_contents) p ON q.document_id = p.document_id AND q.page = p.page_number""")
def jn_citation(spark: SparkSession, d: str) -> DataFrame:
    """The pages that answers cite and their documents have."""
    cited = _citing(spark, d).select("pair_id", "document_id", F.explode(F.regexp_extract_all("answer", F.lit(r"(?i)\[Page (\d+)\]"), 1)).alias("page")).select("pair_id", "document_id", F.col("page").cast("int").alias("page")).distinct()
    have = table(spark, d, "page_contents").select("document_id", F.col("page_number").alias("page")).distinct()
    return cited.join(have, ["document_id", "page"]).select("pair_id", "page")


@query(f"""SELECT document_id, CAST(greatest(1, least(ceil(sqrt(n)), n // 2)) AS INT) AS k FROM (SELECT document_id, count(*) AS n FROM {CHUNKS} WHERE is_active GROUP BY 1)""")
def num_sqrt_ceil(spark: SparkSession, d: str) -> DataFrame:
    """Into how many clusters each document's chunks would go."""
    return chunks(spark, d, "document_id", "is_active").where("is_active").groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", cluster_count(F.col("n")).alias("k"))


@query()
def m_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The chunk vectors in eight Gaussian clusters."""
    return gaussian_clusters(chunk_vectors(spark, d), 8)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return classify.featured(classify.stratified(e, "vec_id", "label"), "label", "embedding")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, predicted): the held-out fifth of the vectors of each label, judged by a model of the others."""
    rows = _rows(spark, d)
    return classify.predicted(classify.fit(rows.where("not held")), rows.where("held")).select("vec_id", F.col("label").cast("int").alias("label"), "predicted")


@query()
def m_classify(spark: SparkSession, d: str) -> DataFrame:
    """The intent of every vector by the fitted model; labels beyond the four intents are mixed."""
    rows = _rows(spark, d)
    names = F.array(*map(F.lit, ("factual", "overview", "multihop", "visual")))
    return classify.route(classify.fit(rows.where("not held")), rows, names, F.lit("mixed")).select("vec_id", "predicted", "intent")


@query()
def p_train(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of each label on held-out vectors."""
    return evaluation.class_report(_predicted(spark, d), "label", "predicted")


@query()
def agg_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Actual against predicted labels on held-out vectors."""
    return evaluation.confusion(_predicted(spark, d), "label", "predicted", list(range(10)))
