"""A tree of cluster summaries over the vectors of a document."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.functions.lineage import cut
from lectern.functions.skew import salted_join


def cluster_count(n: Column, least: int = 2) -> Column:
    """About the square root of n clusters, each of at least least members, and one at least."""
    return F.greatest(F.lit(1), F.least(F.ceil(F.sqrt(n)), F.floor(n / max(least, 1)))).cast("int")


def gaussian_clusters(vectors: DataFrame, k: int, dims: int = 10, seed: int = 42) -> DataFrame:
    """(id, cluster) of (id, v): a Gaussian mixture over the first dims principal components, one label per id."""
    x = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    reduced = PCA(k=dims, inputCol="features", outputCol="p").fit(x).transform(x)
    model = GaussianMixture(k=k, seed=seed, maxIter=200, featuresCol="p", predictionCol="cluster").fit(reduced)
    return model.transform(reduced).select("id", "cluster")


def parents_of(nodes: DataFrame) -> DataFrame:
    """(node_id, parent): the node whose child_ids name it, null for roots; among several the smallest."""
    up = nodes.select(F.col("node_id").alias("parent"), F.explode("child_ids").alias("child")).groupBy("child").agg(F.min("parent").alias("parent"))
    return nodes.select("node_id").join(up, F.col("node_id") == F.col("child"), "left").select("node_id", "parent")


def summary_stub(texts: Column) -> Column:
    """The stand-in for a model's summary: the beginnings of the first three texts."""
    return F.concat(F.lit("[stub summary] "), F.array_join(F.transform(F.slice(texts, 1, 3), lambda t: F.substring(t, 1, 40)), " | "))


def build_tree(leaves: DataFrame, levels: int = 3, least: int = 2) -> DataFrame:
    """(document_id, level, id, parent): each node of a document's tree under its cluster one level up.

    leaves: (id, document_id, v) with usable vectors. At each level about the square root
    of a document's nodes, chosen by a hash, are seeds; a node goes to the seed of highest
    cosine, the smaller id in a tie, and a cluster's vector is the mean of its members'. A
    document stops at fewer than least nodes, at one cluster, or after levels. Sizes and
    means are combined before the shuffle, and a heavy document's nodes meet its seeds in
    parts, so that no task holds a document.
    """
    nodes, out = cut(leaves.select("id", "document_id", "v")), None
    for level in range(1, levels + 1):
        size = nodes.groupBy("document_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
        sized = nodes.join(size, "document_id")
        stride = F.ceil(F.col("n") / cluster_count(F.col("n"), least))
        seeds = sized.where((F.pmod(F.xxhash64("id"), stride) == 0) | (F.col("id") == F.col("first"))).select("document_id", F.col("id").alias("seed"), F.col("v").alias("s"))
        near = salted_join(sized, seeds, ["document_id"], "id").select("document_id", "id", "seed", F.coalesce(vectors.cosine(F.col("v"), F.col("s")), F.lit(-1.0)).alias("c"))
        best = near.groupBy("document_id", "id").agg(F.min_by("seed", F.struct(-F.col("c"), "seed")).alias("seed"))
        placed = cut(best.select("document_id", "id", F.concat(F.lit(f"L{level}-"), "seed").alias("parent")))
        edges = placed.select("document_id", F.lit(level).alias("level"), "id", "parent")
        out = edges if out is None else out.union(edges)
        up = placed.join(nodes.select("id", "document_id", "v"), ["document_id", "id"]).groupBy("document_id", "parent").agg(vectors.mean_vector(F.col("v")).alias("v"))
        nodes = cut(up.select(F.col("parent").alias("id"), "document_id", "v"))
    return out
