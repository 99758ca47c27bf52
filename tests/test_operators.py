"""Operators on small tables: expectations, edge cases and brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text, vectors
from lectern.functions.lineage import cut
from lectern.functions.skew import salted_join
from lectern.operators import cards, chunking, classify, concepts, evaluation, ranking, scope, store, tree
from lectern.operators.components import connected_components


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens_know_all_white_space(spark):
    df = spark.createDataFrame([("a b　c\td",), ("",), (None,), (" \n",)], "t string")
    assert [r[0] for r in df.select(text.token_count(F.col("t"))).collect()] == [4, 0, 0, 0]
    assert spark.createDataFrame([("  x  ",)], "t string").select(text.strip(F.col("t"))).first()[0] == "x"


def test_usable_vectors(spark):
    ok, bad = [0.0] * 63 + [2.0], [[1.0], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, None, [None] * 64]
    df = spark.createDataFrame([(v,) for v in [ok, *bad]], "v array<float>")
    assert [r[0] for r in df.select(vectors.usable(F.col("v"))).collect()] == [True] + [False] * 6


def test_knn_is_exact_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[7] = 2 * x[3]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>").repartition(5)
    q = v.where("id < 10").select(F.col("id").alias("query_id"), "v")
    got = ranking.knn(v, q, 4).toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit[:10] @ unit.T, 12)
    for i in range(10):
        want = sorted(range(300), key=lambda j: (-s[i, j], j))[:4]
        assert got[got.query_id == i].sort_values("rank")["id"].tolist() == want
    assert ranking.knn(v.limit(0), q, 4).count() == 0
    assert ranking.knn(v, q.limit(0), 4).count() == 0


def test_rrf(spark):
    lists = spark.createDataFrame([("q", 0, "a", 0.9, 1), ("q", 0, "b", 0.8, 2), ("q", 1, "b", 0.7, 1), ("q", 1, None, 0.5, 2)], "query_id string, list_no int, id string, score double, rank int")
    got = ranking.rrf(lists).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a"]
    assert got[0]["rrf_score"] == round(1 / 62 + 1 / 61, 6) and got[0]["score"] == 0.8
    assert [r["id"] for r in ranking.rrf(lists.where("list_no = 0")).orderBy("rank").collect()] == ["a", "b"]


def test_mmr_prefers_the_different_one(spark):
    c = spark.createDataFrame([("q", "x", 1.0, 1, ["a", "b"]), ("q", "y", 0.99, 2, ["a", "b"]), ("q", "z", 0.8, 3, ["c"])], "query_id string, id string, score double, rank int, tokens array<string>")
    assert rows(ranking.mmr(c, 2, 0.5), "rank", "id") == [(1, "x"), (2, "z")]
    assert rows(ranking.mmr(c, 3, 0.5), "rank", "id") == [(1, "x"), (2, "y"), (3, "z")]
    assert ranking.mmr(c.limit(0), 2).count() == 0


def test_parents_and_append(spark):
    hits = spark.createDataFrame([("q", "k1", 0.9, 1), ("q", "k2", 0.8, 2), ("q", "k3", 0.7, 3)], "query_id string, id string, score double, rank int")
    art = spark.createDataFrame([("k1", "c1"), ("k2", "gone"), ("k3", "c2")], "id string, chunk_id string")
    chunks = spark.createDataFrame([("c1",), ("c2",)], "id string")
    p = ranking.parents(hits, art, chunks)
    assert rows(p, "rank", "id") == [(1, "c1"), (2, "c2")]
    dense = spark.createDataFrame([("q", "c1", 1.0, 1)], "query_id string, id string, score double, rank int")
    assert rows(ranking.append_new(dense, p), "rank", "id", "lane") == [(1, "c1", "dense"), (2, "c2", "artifact")]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 5, 0.3, 2), ("q", 5, 0.2, 3)], "query_id string, page int, score double, rank int")
    rel = spark.createDataFrame([("q", [5, 7]), ("none", [3]), ("empty", [])], "query_id string, pages array<int>")
    m = {r["query_id"]: r for r in evaluation.retrieval_metrics(hits, rel).collect()}
    assert (m["q"]["recall"], m["q"]["mrr"], m["q"]["precision"]) == (0.0, 0.5, round(2 / 6, 4))
    assert m["q"]["ndcg"] == round((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)), 4)
    assert (m["none"]["recall"], m["none"]["mrr"], m["none"]["ndcg"]) == (0.0, 0.0, 0.0)
    assert m["empty"]["recall"] is None


def test_class_report_and_citations(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (None, 1)], "a int, p int")
    got = {r["label"]: tuple(r)[1:] for r in evaluation.class_report(df, "a", "p").collect()}
    assert got == {0: (1.0, 0.5, 0.6667, 2), 1: (0.5, 1.0, 0.6667, 1)}
    c = spark.createDataFrame([("see [Page 3] and [page 4]", [3]), ("none", [1])], "t string, p array<int>")
    assert [r[0] for r in c.select(evaluation.citation_accuracy(F.col("t"), F.col("p"))).collect()] == [0.5, 1.0]


def test_sentence_chunks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = {f"d{i}": [" ".join(["w"] * int(n - 1) + ["end."]) for n in rng.integers(1, 30, rng.integers(1, 40))] for i in range(20)}
    got = chunking.sentence_chunks(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [("blank", "  "), ("null", None)], "document_id string, text string"), 50, 10)
    found = {(r["document_id"], r["pos"]): r["token_count"] for r in got.collect()}
    for k, v in docs.items():
        n = [len(s.split()) for s in v]
        first, out, i = 0, [], 0
        for i in range(len(n)):
            if sum(n[first : i + 1]) > 50 and i > first:
                out.append(sum(n[first:i]))
                back = 0
                while i - back - 1 > first and sum(n[i - back - 1 : i]) <= 10 and sum(n[i - back - 1 : i + 1]) <= 50:
                    back += 1
                first = i - back
        out.append(sum(n[first:]))
        assert [found[k, p] for p in range(len(out))] == out and (k, len(out)) not in found
    assert not any(k[0] in ("blank", "null") for k in found)


def test_micro_merge(spark):
    df = spark.createDataFrame([("d", 0, "a", 0, 1, 5), ("d", 1, "b", 1, 2, 40), ("d", 2, " ", 2, 3, 0), ("d", 3, "c", 3, 4, 3)], "document_id string, pos int, text string, char_start int, char_end int, token_count int")
    assert rows(chunking.merge_micro(df), "chunk_index", "text", "char_end", "token_count") == [(0, "a", 1, 5), (1, "b c", 4, 43)]


def test_pages(spark):
    docs = spark.createDataFrame([("d", "one\n\ntwo\n\none")], "document_id string, full_text string")
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, None), ("d", 3, "two"), ("d", 4, "one"), ("d", 5, "missing")], "document_id string, page_number int, text string")
    o = chunking.page_offsets(docs, pages)
    assert rows(o, "page_number", "start") == [(1, 0), (3, 5), (4, 10)]
    c = spark.createDataFrame([("x", "d", 4), ("y", "d", 10), ("z", "other", 1)], "chunk_id string, document_id string, char_start int")
    assert rows(chunking.page_as_of(c, o), "chunk_id", "page_number") == [("x", 1), ("y", 4), ("z", None)]


def test_context_windows(spark):
    c = spark.createDataFrame([("a", "d", 0, 6), ("b", "d", 1, 5), ("c", "d", 2, 4), ("e", "d", 3, 99)], "chunk_id string, document_id string, chunk_index int, n bigint")
    assert rows(chunking.context_windows(c, 10), "chunk_id", "window") == [("a", 0), ("b", 1), ("c", 1), ("e", 2)]


def test_replies(spark):
    r = [("c", "definition", '```json\n{"title": "T", "content": "x"}\n```'), ("c", "formula", '{"content": "No formula"}'), ("c", "example", "null"), ("c", "objective", '{"content": "y"}'), ("c", "misconception", "{bad"),
         ("c", "question", '[{"question": "q", "answer": "a"}, {"question": "q2"}]'), ("c", "factoid", '["f", "none"]'), ("c", "summary", "prose"), ("c", "definition", None)]
    got = cards.cards_from_replies(spark.createDataFrame(r, "chunk_id string, card_type string, reply string"))
    assert rows(got, "card_type", "title", "content") == [("definition", "T", "x"), ("factoid", "Factoid", "f"), ("objective", "Objective", "y"), ("question", "q", "q"), ("summary", "Summary", "prose")]


def test_scope_and_labels(spark):
    df = spark.createDataFrame([("t",), ("global",), ("u",), (None,)], "tenant string")
    seen = lambda m: [r[0] for r in df.select(scope.in_scope(F.col("tenant"), m, "t")).collect()]
    assert seen(None) == [True, True, False, False] and seen("base_textbook") == [False, True, False, False] and seen("user_upload") == [True, False, False, False]
    t = spark.createDataFrame([("## Preface\nx",), ("The chapter",), (None,)], "t string")
    assert [r[0] for r in t.select(scope.is_chapter(F.col("t"))).collect()] == [False, True, True]
    s = spark.createDataFrame([(0.65,), (0.449,), (0.1,)], "s double")
    assert [r[0] for r in s.select(scope.relevance_label(F.col("s"))).collect()] == ["Very relevant", "Somewhat relevant", "Loosely related"]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(500, 500), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in e:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(e, "a int, b int"), "a", "b"), "node", "component"))
    assert got == {x: find(x) for x in {*root, 3}}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_store(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True)], "k int, v string, is_active boolean")
    new = spark.createDataFrame([(2, "c", True), (3, "d", True)], "k int, v string, is_active boolean")
    assert rows(store.upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.deactivate(old, new, ["k"]), "k", "is_active") == [(1, True), (2, False)]
    assert rows(store.delete(old, new, ["k"]), "k") == [(1,)]
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2)], "k int, v string, t int")
    assert rows(store.latest(twice, ["k"], "t"), "k", "v") == [(1, "b")]


def test_concepts(spark):
    m = concepts.mentions(spark.createDataFrame([("c", "Spectral motion of spectral bodies"), ("e", None)], "chunk_id string, text string"))
    assert rows(m, "pos", "concept") == [(0, "spectral"), (1, "motion"), (2, "bodies")]
    assert rows(concepts.co_occurrence(m), "a", "b", "weight") == [("bodies", "motion", 1), ("bodies", "spectral", 1), ("motion", "spectral", 1)]
    start, edges = spark.createDataFrame([("a",)], "concept string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert rows(concepts.reachable(start, edges), "concept", "hop") == [("a", 0), ("b", 1), ("c", 2)]


def test_tree(spark):
    n = spark.createDataFrame([("r", ["a", "b"]), ("a", None), ("b", [])], "node_id string, child_ids array<string>")
    assert rows(tree.parents_of(n), "node_id", "parent") == [("a", "r"), ("b", "r"), ("r", None)]
    k = spark.range(0, 30).select(tree.cluster_count(F.col("id"))).collect()
    assert k[1][0] == 1 and k[9][0] == 3 and k[29][0] == 6


def test_built_tree(spark):
    rng = np.random.default_rng(4)
    leaves = [(f"c{i:03}", "hot" if i < 60 else "small", rng.normal(size=64).tolist()) for i in range(63)] + [("lone", "single", [1.0] * 64)]
    df = spark.createDataFrame(leaves, "id string, document_id string, v array<double>")
    e = tree.build_tree(df).toPandas()
    first = e[e.level == 1]
    assert sorted(first["id"]) == sorted(i for i, d, _ in leaves if d != "single")  # every leaf once; a document of one node has no tree
    assert 1 < first[first.document_id == "hot"]["parent"].nunique() < 30
    for level in (2, 3):
        below, here = e[e.level == level - 1], e[e.level == level]
        assert set(here["id"]) <= set(below["parent"]) and here["id"].is_unique
    assert tree.build_tree(df.limit(0)).count() == 0


def test_ingest_finds_places_and_pages(spark):
    one = " ".join(f"Sentence {i} says that value {i}.{i} is held by the spring." for i in range(120))
    two = "A short page."
    docs = spark.createDataFrame([("d", one + "\n\n" + two), ("blank", " \n"), ("null", None)], "document_id string, text string")
    pages = spark.createDataFrame([("d", 1, one), ("d", 2, two)], "document_id string, page_number int, text string")
    offsets = chunking.page_offsets(docs.withColumnRenamed("text", "full_text"), pages)
    got = chunking.ingest(docs, offsets).orderBy("chunk_index").collect()
    assert {r["document_id"] for r in got} == {"d"} and [r["chunk_index"] for r in got] == list(range(len(got))) and len(got) > 1
    starts = [r["char_start"] for r in got]
    assert starts == sorted(starts) and starts[0] == 0 and all(one.startswith(r["text"][:20], r["char_start"]) for r in got)
    assert all(r["page_number"] == 1 for r in got)
    assert chunking.ingest(docs.limit(0), offsets).count() == 0


def test_sparse_search_against_postings(spark):
    rng = np.random.default_rng(7)
    docs = [(f"d{i:03d}", list(rng.choice(list("abcdefgh"), rng.integers(0, 9), p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]))) for i in range(200)] + [("null", None)]
    df = spark.createDataFrame(docs, "id string, t array<string>").repartition(4)
    q = spark.createDataFrame([("q1", "a", 1.0), ("q1", "e", 1.0), ("q2", "h", 2.0), ("q3", "zz", 1.0)], "query_id string, term string, w double")
    got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in ranking.sparse_search(df, F.col("t"), q, 7).orderBy("query_id", "rank").collect()]
    p = ranking.postings(df, F.col("t")).join(q.select("query_id", "term", F.col("w").alias("wq")), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))
    want = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in ranking.ranked(p, F.desc("score"), "id").where("rank <= 7").orderBy("query_id", "rank").collect()]
    assert got == want and len(got) == 14
    assert ranking.sparse_search(df.limit(0), F.col("t"), q, 7).count() == 0 and ranking.sparse_search(df, F.col("t"), q.limit(0), 7).count() == 0


def test_many_queries_come_in_portions(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(60, 6)))], "id int, v array<double>")
    q = v.where("id < 20").select(F.col("id").alias("query_id"), "v")
    d = spark.createDataFrame([(f"d{i}", list(rng.choice(list("abcdef"), 5))) for i in range(40)], "id string, t array<string>")
    terms = spark.createDataFrame([(i, t, 1.0) for i in range(20) for t in rng.choice(list("abcdef"), 2, replace=False).tolist()], "query_id int, term string, w double")
    once = [rows(ranking.knn(v, q, 3), "query_id", "rank", "id"), rows(ranking.sparse_search(d, F.col("t"), terms, 3), "query_id", "rank", "id", "score"), rows(ranking.score_counts(v, q, 1), "score", "n")]
    monkeypatch.setattr(ranking, "QUERIES_AT_ONCE", 1)
    few = q.where("query_id < 6")
    assert rows(ranking.knn(v, few, 3), "query_id", "rank", "id") == [r for r in once[0] if r[0] < 6]
    assert rows(ranking.sparse_search(d, F.col("t"), terms.where("query_id < 4"), 3), "query_id", "rank", "id", "score") == [r for r in once[1] if r[0] < 4]
    monkeypatch.setattr(ranking, "QUERIES_AT_ONCE", 7)
    assert rows(ranking.score_counts(v, q, 1), "score", "n") == once[2]


def test_score_counts(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    q = v.where("id < 3").select(F.col("id").alias("query_id"), "v")
    assert rows(ranking.score_counts(v, q, 2), "score", "n") == [(0.0, 2), (0.71, 2), (1.0, 2)]
    assert ranking.score_counts(v.limit(0), q, 2).count() == ranking.score_counts(v, q.limit(0), 2).count() == 0


def test_salted_join_splits_heavy_keys(spark):
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id int, k string")
    one = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), (None, 4)], "k string, x int")
    for how in ("inner", "left"):
        want = rows(many.join(one, ["k"], how).na.fill("-").na.fill(-1), "id", "k", "x")
        assert rows(salted_join(many, one, ["k"], "id", how, heavy=50).na.fill("-").na.fill(-1), "id", "k", "x") == want
        assert rows(salted_join(many, one, ["k"], "id", how).na.fill("-").na.fill(-1), "id", "k", "x") == want


def test_cut_reads_what_it_wrote(spark):
    df = cut(spark.range(10).withColumn("r", F.rand()))
    assert df.collect() == df.collect() and spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_even_pages(spark):
    docs = spark.createDataFrame([("a", "1\n2\n3\n4\n5", 2), ("b", "1\n2", 5), ("c", "x", None), ("d", None, 1), ("e", "1\n \n3", 3)], "document_id string, text string, page_count int")
    assert rows(chunking.even_pages(docs), "document_id", "page_number", "text") == [("a", 1, "1\n2"), ("a", 2, "3\n4"), ("b", 1, "1\n2"), ("c", 1, "x"), ("e", 1, "1"), ("e", 3, "3")]


def test_a_saved_model_routes_as_before(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, i % 4, (rng.normal(size=8) * 0.3 + 2 * np.eye(8)[i % 4]).tolist()) for i in range(200)]
    r = classify.stratified(spark.createDataFrame(data, "key int, label int, v array<double>"), "key", "label")
    assert rows(r.groupBy("label", "held").count(), "label", "held", "count") == [(x, h, n) for x in range(4) for h, n in ((False, 40), (True, 10))]
    x = classify.featured(r, "label", "v")
    model = classify.fit(x.where("not held"))
    names = F.array(*map(F.lit, ("factual", "overview", "multihop")))
    before = rows(classify.route(model, x, names, F.lit("mixed")), "key", "intent")
    classify.save(model, str(tmp_path / "model"))
    assert rows(classify.route(classify.load(str(tmp_path / "model")), x, names, F.lit("mixed")), "key", "intent") == before
    assert np.mean([i == ("factual", "overview", "multihop", "mixed")[k % 4] for k, i in before]) > 0.95
    assert {i for _, i in rows(classify.route(None, x, names, F.lit("mixed")), "key", "intent")} == {"mixed"}


def test_report_is_written(spark, tmp_path):
    report = spark.createDataFrame([("overall", 0.25, 4), ("factual", None, 1)], "kind string, mrr double, n bigint")
    evaluation.write_report(report, str(tmp_path), {"k": 20}, "kind", ("mrr", "n"))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/markdown").collect()] == ["| kind | mrr | n |", "|-|-|-|", "| factual | - | 1.0000 |", "| overall | 0.2500 | 4.0000 |"]
    assert {r["config"]["k"] for r in spark.read.json(f"{tmp_path}/json").collect()} == {"20"}


def test_preambles_go(spark):
    said = [("Based on the provided passages,  it falls.", "q", "it falls."), ("Question: why?\n.It falls.", "why?", "It falls."), ("It falls.", "q", "It falls."), (None, "q", None)]
    df = spark.createDataFrame(said, "a string, q string, want string")
    assert all(r[0] == r[1] for r in df.select(evaluation.stripped(F.col("a"), F.col("q"), evaluation.PREAMBLES), "want").collect())


def test_tables_are_created_once(spark, tmp_path):
    for _ in range(2):
        assert store.create_tables(spark, {"lectern_notes": "id bigint, text string"}, str(tmp_path)) == ["lectern_notes"]
    assert spark.table("lectern_notes").count() == 0
    spark.sql("DROP TABLE lectern_notes")


def test_new_rows_replace_those_of_their_document(spark):
    old = spark.createDataFrame([("a", "d1", True), ("b", "d2", True)], "card string, doc string, is_active boolean")
    new = spark.createDataFrame([("c", "d1", True)], "card string, doc string, is_active boolean")
    assert rows(store.replace_of(old, new, "doc"), "card", "is_active") == [("a", False), ("b", True), ("c", True)]


def test_decoding_leaves_out_what_it_cannot_read(spark):
    df = spark.createDataFrame([(bytearray("aé".encode()[:-1] + b"b\xff"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(text.decoded(F.col("b"))).collect()] == ["ab", "", None]
