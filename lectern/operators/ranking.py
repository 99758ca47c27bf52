"""Scoring, fusing, diversifying and extending ranked lists.

A ranked list is a table with query_id, an id, a score and a rank that starts at 1; the
rank is data, and every order ends with the id, so that ties have one outcome.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent to the executors at once; more come in portions of this size, each with its own scan.
QUERIES_AT_ONCE = 4096
RRF_K, MMR_LAMBDA = 60, 0.7
#: Digits to which cosines are rounded before they are ordered, so that equal directions tie.
DIGITS = 9


def ranked(df: DataFrame, *order, by: str = "query_id", name: str = "rank") -> DataFrame:
    """df with its rank within by, from 1, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def _portions(queries: DataFrame, *columns: str, each: int = 1) -> Iterator[list]:
    """The rows of queries, about each for a query, in portions of about QUERIES_AT_ONCE queries; few queries are read once."""
    q = queries.select("query_id", *columns)
    few = q.limit(QUERIES_AT_ONCE * each + 1).collect()
    if len(few) <= QUERIES_AT_ONCE * each:
        yield few
        return
    n = -(-q.select("query_id").distinct().count() // QUERIES_AT_ONCE)
    for p in range(n):
        yield q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == p).collect()


def knn(vectors: DataFrame, queries: DataFrame, k: int, spread: int = 0) -> DataFrame:
    """(query_id, id, score, rank): the k vectors (id, v) of highest cosine for every query (query_id, v), exactly.

    Blocks of vectors meet the matrix of one portion of queries inside the tasks, which
    hold the k best of all blocks so far and give them out once at their end; a window
    merges the tasks. All vectors need one length and a norm above 0 (see vectors.usable).
    No vectors or no queries give no rows. spread: partitions to scan in, where the input
    lies in fewer.
    """
    kind, of = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    scan = vectors.select("id", "v")
    scan = scan.repartition(spread) if spread else scan

    def best(held):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, unit = held.value
            row, score, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
            floor = np.full(len(names), -np.inf)  # of each query the k-th best so far
            for b in batches:
                if not len(b) or not len(names):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in b["v"]])
                s = unit @ (x / np.sqrt((x * x).sum(1))[:, None]).T
                if s.shape[1] > k:
                    cutoff = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                else:
                    cutoff = floor
                rows, cols = np.nonzero(s >= cutoff[:, None] - 10.0**-DIGITS)  # ties at the cut stay
                row, score, ids = np.concatenate([row, rows]), np.concatenate([score, np.round(s[rows, cols], DIGITS)]), np.concatenate([ids, b["id"].to_numpy(object)[cols]])
                by = np.lexsort((-score, row))
                row, score, ids = row[by], score[by], ids[by]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                at = nth == k - 1
                floor[row[at]] = score[at]
                keep = score >= floor[row]
                row, score, ids = row[keep], score[keep], ids[keep]
            if len(row):
                yield pd.DataFrame({"query_id": names[row], "id": ids, "score": score}).astype({"id": b["id"].dtype})

        return run

    parts = []
    for rows in _portions(queries, "v"):
        m = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))
        unit = m / np.sqrt((m * m).sum(1))[:, None] if len(rows) else m
        held = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), unit))
        parts.append(scan.mapInPandas(best(held), f"query_id {of}, id {kind}, score double"))
    return ranked(reduce(DataFrame.union, parts), F.desc("score"), "id").where(F.col("rank") <= k)


def score_counts(vectors: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """(score, n): how many pairs of query (query_id, v) and vector (id, v) have each cosine, rounded; counted inside the tasks, portion by portion of the queries."""

    def count(held):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                if len(b) and len(held.value):
                    x = np.stack([np.asarray(v, np.float64) for v in b["v"]])
                    s = np.round(np.round(held.value @ (x / np.sqrt((x * x).sum(1))[:, None]).T, DIGITS), digits) + 0.0
                    seen.update(dict(zip(*(a.tolist() for a in np.unique(s, return_counts=True)))))
            yield pd.DataFrame(list(seen.items()), columns=["score", "n"])

        return run

    parts = []
    for rows in _portions(queries, "v"):
        m = np.array([r["v"] for r in rows], np.float64)
        held = vectors.sparkSession.sparkContext.broadcast(m / np.sqrt((m * m).sum(1))[:, None] if len(m) else m)
        parts.append(vectors.select("v").mapInPandas(count(held), "score double, n bigint"))
    return reduce(DataFrame.union, parts).groupBy("score").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms) -> DataFrame:
    """(id, term, w): weight log(1 + tf) * idf of each term of (id, ...); terms is an array expression. Null arrays give no rows."""
    t = docs.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.countDistinct("id").alias("n"))
    return t.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", (F.log1p("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("w"))  # n is one row


def sparse_search(docs: DataFrame, terms, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k docs of largest sparse product (log(1 + tf) * idf, see postings) with each query (query_id, term, w).

    The number of documents of each term is counted over all docs, but only for terms that
    a portion of queries asks for; those are looked up in the tasks, so no posting list is
    gathered anywhere, and a task gives out the k best of each query alone.
    """
    words = docs.select("id", terms.alias("t")).where("t is not null")
    total = docs.agg(F.countDistinct("id").alias("n")).first()["n"]
    kind, of = docs.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    context = docs.sparkSession.sparkContext

    def count(held):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for t in b["t"]:
                    seen.update(held.value.keys() & set(t))
            yield pd.DataFrame(list(seen.items()), columns=["term", "df"])

        return run

    def best(held, idf):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top: dict = {}
            for b in batches:
                for i, t in zip(b["id"], b["t"]):
                    tf, score = Counter(t), {}
                    for term in held.value.keys() & tf.keys():
                        w = math.log1p(tf[term]) * idf.value[term]
                        for q, wq in held.value[term]:
                            score[q] = score.get(q, 0.0) + w * wq
                    for q, s in score.items():
                        heap = top.setdefault(q, [])
                        entry = (round(s, 6), _Last(i))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
            yield pd.DataFrame([(q, i.id, s) for q, heap in top.items() for s, i in heap], columns=["query_id", "id", "score"])

        return run

    parts = []
    for rows in _portions(queries, "term", "w", each=32):
        by_term: dict = {}
        for q, term, w in rows:
            by_term.setdefault(term, []).append((q, w))
        held = context.broadcast(by_term)
        df = {r["term"]: r["df"] for r in words.mapInPandas(count(held), "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the portion's terms
        idf = context.broadcast({t: math.log(1 + total / n) for t, n in df.items()})
        parts.append(words.mapInPandas(best(held, idf), f"query_id {of}, id {kind}, score double"))
    return ranked(reduce(DataFrame.union, parts), F.desc("score"), "id").where(F.col("rank") <= k)


class _Last:
    """An id that counts the more the smaller it is, for ties in a heap."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other) -> bool:
        return self.id > other.id

    def __eq__(self, other) -> bool:
        return self.id == other.id


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf_score, score, lists, rank): reciprocal rank fusion of (query_id, list_no, id, score, rank); rows without id are left out.

    score is the best one the id has in any list, lists the number of lists it is in.
    """
    fused = lists.where("id is not null").groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf_score"), F.max("score").alias("score"), F.count("*").alias("lists"), F.min(F.struct("list_no", "rank")).alias("first"))
    return ranked(fused, F.desc("rrf_score"), "first", "id").drop("first")


def mmr(candidates: DataFrame, top_k: int, lam: float = MMR_LAMBDA) -> DataFrame:
    """candidates (query_id, id, score, rank, tokens) cut to top_k by maximal marginal relevance, with the new rank in rank.

    Greedy: lam * score / best score - (1 - lam) * largest token Jaccard with a chosen one;
    the earlier candidate wins a tie. A query with at most top_k keeps its order. The
    candidates of a query are a bounded pool, which one group holds.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema.fields)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        if len(pdf) <= top_k:
            return pdf.assign(rank=np.arange(1, len(pdf) + 1))
        best = pdf["score"].max() or 1.0
        rel, sets = (pdf["score"] / best).to_numpy(), [frozenset(t) for t in pdf["tokens"]]
        nearest, chosen, left = np.zeros(len(pdf)), [], np.ones(len(pdf), bool)
        for _ in range(top_k):
            value = np.where(left, lam * rel - (1 - lam) * nearest, -np.inf)
            i = int(value.argmax())
            chosen.append(i)
            left[i] = False
            for j in np.flatnonzero(left):
                union = len(sets[i] | sets[j])
                nearest[j] = max(nearest[j], len(sets[i] & sets[j]) / union if union else 0.0)
        return pdf.loc[chosen].assign(rank=np.arange(1, top_k + 1))

    return candidates.groupBy("query_id").applyInPandas(select, fields)


def parents(hits: DataFrame, artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits on artifacts as hits on their parent chunks; unknown parents drop out, and each chunk keeps its first hit."""
    known = hits.join(artifacts.select(F.col("id").alias("artifact"), F.col("chunk_id").alias("parent")), F.col("id") == F.col("artifact")).join(chunks.select(F.col("id").alias("chunk")), F.col("parent") == F.col("chunk"))
    first = known.groupBy("query_id", "parent").agg(F.min(F.struct("rank", "score")).alias("h"))
    return ranked(first.select("query_id", F.col("parent").alias("id"), "h.score", F.col("h.rank").alias("hit")), "hit", "id").drop("hit")


def append_new(first: DataFrame, more: DataFrame) -> DataFrame:
    """first, then what more adds: ids that a query hasn't yet, ranked behind."""
    new = more.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    last = first.groupBy("query_id").agg(F.max("rank").alias("last"))
    behind = ranked(new, "rank", "id", name="r").join(last, "query_id", "left").select("query_id", "id", "score", (F.coalesce("last", F.lit(0)) + F.col("r")).alias("rank"), F.lit("artifact").alias("lane"))
    return first.select("query_id", "id", "score", "rank", F.lit("dense").alias("lane")).union(behind)


def overlap(a, b):
    """Share of the tokens of a that b has; 0 where a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def first_of(hits: DataFrame, k: int) -> DataFrame:
    """The stand-in for reranking: the first k hits as they are."""
    return hits.where(F.col("rank") <= k)


def rerank(hits: DataFrame, score, k: int) -> DataFrame:
    """The k hits of highest score (any column expression over hits), ties in the old order."""
    return ranked(hits.withColumn("rerank_score", score), F.desc("rerank_score"), "rank", "id", name="new").where(F.col("new") <= k).drop("rank").withColumnRenamed("new", "rank")
