"""Problem 6: filling containers of fixed capacity with texts.

Method: lexical retrieval packing. Texts that share a characteristic word go to one shard;
over each shard a BM25 inverted index returns, for the largest text left, its unused
neighbours, which fill the container greedily; the last gap takes the longest unused text
that fits. What the shards leave in poorly filled containers is packed once more across
shards.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.lineage import cut, spread
from lectern.functions.text import WORD_PY

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which that tokenizer cuts texts before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of a shard; from which gap on the longest text that fits is taken; the fill under which a container is packed again.
SHARD, CLOSING, REPACK = 2000, 600, 0.97
K1, B = 1.2, 0.75
_TERMS = 1 << 22
#: A term in more than this share of the texts is too common to name a shard.
COMMON = 0.01

ITEM = "d string, piece int, start int, size int, terms binary"
PLACED = "container string, unused int, position int, gain double, d string, piece int, start int, size int, terms binary"


@functools.cache
def tokenizer(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """One row per item: a text, or what is left of a text above the capacity after full pieces (size = capacity); the last of a text has its terms."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, ids = tokenizer(path).encode_ordinary, {}
        for batch in batches:
            out = []
            for d, t in zip(batch["d"], batch["t"]):
                n, tf = len(encode(t)), Counter(WORD_PY.findall(t.lower()))
                for w in tf:
                    if w not in ids:
                        ids[w] = zlib.crc32(w.encode()) % _TERMS
                if len(ids) > 300_000:
                    keep, ids = {w: ids[w] for w in tf}, {}
                    ids.update(keep)
                terms = np.array([ids[w] << 8 | min(c, 255) for w, c in tf.items()], np.uint32).tobytes()
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    out.append((d, piece, start, size, terms if start + size == n else b""))
            yield pd.DataFrame(out, columns=["d", "piece", "start", "size", "terms"])

    rows = spread(docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).where("t is not null and t != ''"))
    return rows.mapInPandas(measure, ITEM)


class Index:
    """BM25 over the items of a shard."""

    def __init__(self, terms: list[bytes]):
        packed = [np.frombuffer(t, np.uint32) for t in terms]
        lengths = np.array([len(p) for p in packed])
        flat = np.concatenate(packed) if packed else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(len(packed), dtype=np.int32), lengths)
        tf = (flat & 255).astype(np.float32)
        names, self.term = np.unique(flat >> 8, return_inverse=True)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        dl = np.bincount(doc, tf, len(packed))
        df = np.bincount(self.term, minlength=len(names))
        idf = np.log1p((len(packed) - df + 0.5) / (df + 0.5))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / max(dl.mean(), 1e-9)))
        by = np.argsort(self.term, kind="stable")
        self.posting, self.weight = doc[by], weight[by].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.n = len(packed)

    def scores(self, item: int) -> np.ndarray:
        """The score of every item for the terms of one."""
        mine = self.term[self.offsets[item] : self.offsets[item + 1]]
        if not len(mine):
            return np.zeros(self.n)
        at = [slice(self.starts[t], self.starts[t + 1]) for t in mine]
        return np.bincount(np.concatenate([self.posting[s] for s in at]), np.concatenate([self.weight[s] for s in at]), self.n)


def pack(sizes: np.ndarray, terms: list[bytes], capacity: int = CAPACITY, closing: int = CLOSING) -> list[list[int]]:
    """Containers of positions: each holds a seed, the largest item left, and its best-scoring unused neighbours that fit."""
    index, free = Index(terms), np.ones(len(sizes), bool)
    out = []
    for seed in np.argsort(-sizes, kind="stable"):
        if not free[seed]:
            continue
        free[seed] = False
        held, room, scores = [int(seed)], capacity - int(sizes[seed]), None
        while room > 0:
            fits = free & (sizes <= room)
            if not fits.any():
                break
            if room <= closing:
                best = int(np.argmax(np.where(fits, sizes, -1)))
            else:
                scores = index.scores(seed) if scores is None else scores
                best = int(np.argmax(np.where(fits, scores, -1.0)))
            free[best] = False
            held.append(best)
            room -= int(sizes[best])
        out.append(held)
    return out


def shared(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' terms; 0 where one has none."""
    x, y = np.frombuffer(a, np.uint32) >> 8, np.frombuffer(b, np.uint32) >> 8
    both = len(np.intersect1d(x, y))
    return both / max(len(x) + len(y) - both, 1)


def _packed(capacity: int, name: str):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["d", "piece"], ignore_index=True)
        sizes, terms, rows = items["size"].to_numpy(), items["terms"].to_list(), []
        for k, held in enumerate(pack(sizes, terms, capacity)):
            unused = capacity - int(sizes[held].sum())
            rows += [(f"{name}-{key[0]}-{k}", unused, p, shared(terms[held[0]], terms[i]) if p else None, i) for p, i in enumerate(held)]
        got = pd.DataFrame(rows, columns=["container", "unused", "position", "gain", "i"])
        return pd.concat([got.drop(columns="i"), items.loc[got["i"], ["d", "piece", "start", "size", "terms"]].reset_index(drop=True)], axis=1)

    return run


def _flat(terms: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms one after another, and the position of the text of each."""
    sizes = terms.map(len).to_numpy() // 4
    return (np.frombuffer(b"".join(terms), np.uint32) >> 8).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _common_terms(items: DataFrame) -> set[int]:
    """Hashed terms of more than COMMON of the texts, over all of them; at most the mean number of terms / COMMON are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(_TERMS, np.int64)
        for big in batches:
            for at in range(0, len(big), 1000):  # bounds the memory of a step
                t, of = _flat(big["terms"].iloc[at : at + 1000])
                np.add.at(seen, np.unique(of * _TERMS + t) % _TERMS, 1)  # words of one hash count once in a text
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"t": some, "n": seen[some]})

    texts = items.where("piece = 0").count()
    counts = items.select("terms").mapInPandas(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    return {r["t"] for r in counts.where(F.col("n") > COMMON * texts).select("t").collect()}


def _keyed(items: DataFrame, terms: set[int]) -> DataFrame:
    """items with key: the least term, in the order of a hash, of those that aren't common; similar texts often have the same (one minhash), texts without get their own id's hash."""
    common = items.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = np.zeros(_TERMS, bool)
        usual[list(common.value)] = True
        for big in batches:
            for at in range(0, len(big), 1000):
                b = big.iloc[at : at + 1000]
                t, of = _flat(b["terms"])
                t, of = t[~usual[t]], of[~usual[t]]
                has, starts = np.unique(of, return_index=True)
                keys = np.array([-1 - zlib.crc32(d.encode()) for d in b["d"]], np.int64)
                if len(t):
                    keys[has] = np.minimum.reduceat(t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20), starts).astype(np.int64)
                yield b.assign(key=keys)

    return items.mapInPandas(run, f"{ITEM}, key bigint")


def _in_shards(items: DataFrame, shard: Column, capacity: int, name: str) -> DataFrame:
    return items.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(_packed(capacity, name), PLACED)


def containers(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(container, position, doc_id, piece, token_start, tokens, unused, gain): every text in a container of capacity tokens.

    Texts stay whole but for those above the capacity, which are cut into full pieces and
    a rest that is packed like a text. unused is the container's; gain is the similarity
    of a text's words to those of its container's first text, null for that one. Null and
    empty texts have no tokens and don't come out; rows that repeat a doc_id are packed
    each. Texts of one key form groups that fill shards of SHARD texts; a group larger
    than half of that is split by the id. path: the tokenizer's file, which every executor
    must have.
    """
    kind = docs.schema[doc_id].dataType
    n = docs.count()
    whole = cut(sized(docs, doc_id, text, capacity, path))
    terms = F.when(F.col("size") < capacity, F.col("terms")).otherwise(F.lit(b""))  # an item that fills a container has no neighbours
    items = _keyed(whole.withColumn("terms", terms), _common_terms(whole))
    groups = items.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > SHARD // 2).select("key", F.ceil(F.col("rows") / (SHARD // 2)).alias("parts"))  # few: each has many texts
    keyed = items.join(F.broadcast(groups), "key", "left")
    part = F.pmod(F.xxhash64("d", "piece"), F.coalesce("parts", F.lit(1)))
    shard = F.pmod(F.xxhash64("key", part), F.lit(max(1, -(-n // SHARD))))
    first = cut(_in_shards(keyed.withColumn("shard", shard).drop("key", "parts"), F.col("shard"), capacity, "a"))
    poor = F.col("unused") > (1 - REPACK) * capacity
    left = first.where(poor).select("d", "piece", "start", "size", "terms")
    again = cut(_in_shards(left, F.pmod(F.xxhash64("d", "piece", F.lit("b")), F.lit(max(1, -(-left.count() // SHARD)))), capacity, "b"))
    kept = first.where(~poor).drop("terms").unionByName(again.drop("terms"))
    return kept.select("container", "position", F.col("d").cast(kind).alias(doc_id), "piece", F.col("start").alias("token_start"), F.col("size").alias("tokens"), "unused", F.round("gain", 4).alias("gain"))
