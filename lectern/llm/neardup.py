"""Problem 4: records that share most of their content but differ by small edits.

Method: prefix filtering, which loses no pair. In an order of all shingles, rare ones first,
two sets of the wanted similarity share one of their first shingles; the sets that share one
are paired, what their sizes, the place of that shingle and bitmaps of the sets rule out is
left, and the rest is compared on the shingle sets themselves.

Equal sets form a class first, so copies meet in no bucket. All columns that are joined
or grouped are numbers: a class goes by a hash of its set until its members are needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.lineage import cut
from lectern.functions.skew import SALTS, salted_join
from lectern.functions.text import WORD_PY
from lectern.operators.components import connected_components

SHINGLE, THRESHOLD, LEAST_WORDS = 5, 0.8, 12
#: The order of the shingles is by counts in 2^ORDER_BITS buckets, which go by parts of PART buckets; any counts give all pairs, good ones give few candidates.
ORDER_BITS, PART = 20, 4096
#: Hashes compared in one step, and steps.
BATCH, BATCHES = 32, 4
#: Classes of a bucket that are paired at once; the pairs of a larger bucket are made block by block, each pair of blocks in its own group.
BLOCK = 400


def _mixed(flat: np.ndarray) -> np.ndarray:
    h = flat * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def least_matches(threshold: float, miss: float, batch: int = BATCH, batches: int = BATCHES) -> list[int]:
    """After each batch, the fewest equal hashes at which P(similarity >= threshold | matches) is at least miss.

    Flat prior on the similarity; hashes are compared by one byte, so two different ones
    agree with probability 1/256. For callers that may lose pairs; near_duplicates drops none by it.
    """
    s = (np.arange(2000) + 0.5) / 2000
    log_p, log_q = np.log(s + (1 - s) / 256), np.log1p(-(s + (1 - s) / 256))
    out = []
    for n in range(batch, batch * batches + 1, batch):
        for m in range(n + 1):
            post = np.exp(m * log_p + (n - m) * log_q - (m * log_p + (n - m) * log_q).max())
            if post[s >= threshold].sum() >= miss * post.sum():
                break
        out.append(m)
    return out


def _lower(text: str) -> str:
    """In lower case letter by letter, as in SQL: a sigma at the end of a word is like any other, a dotted capital I gives one letter."""
    return (text.replace("İ", "i").replace("Σ", "σ") if "İ" in text or "Σ" in text else text).lower()


def _sets(texts: list[Sequence[str]], hashes: dict[str, int], shingle: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, flat, starts): positions that have a text with enough words, and the sorted sets of shingle hashes of their texts with enough words, one after another."""
    found = [(i, w) for i, own in enumerate(texts) for t in own if len(w := WORD_PY.findall(_lower(t))) >= max(least_words, shingle)]
    kept, owner = np.unique(np.array([i for i, _ in found], np.int64), return_inverse=True)
    if not len(kept):
        return kept, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.array([hashes[x] for _, words in found for x in words], np.uint64)
    n = np.array([len(words) for _, words in found])
    h = np.zeros(len(w) - shingle + 1, np.uint64)
    for j in range(shingle):
        h = (h ^ w[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    of = np.repeat(np.arange(len(n)), n)[: len(h)]
    inside = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)[: len(h)] <= n[of] - shingle  # no shingle runs over the end of its text
    of, h = owner[of[inside]], h[inside]
    by = np.lexsort((h, of))
    of, h = of[by], h[by]
    first = np.ones(len(h), bool)
    first[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    of, h = of[first], h[first]
    return kept, h, np.searchsorted(of, np.arange(len(kept)))


class _Hashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


def _shingled(shingle: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for big in batches:
            for at in range(0, len(big), 1000):  # bounds the memory of a step
                part = big.iloc[at : at + 1000]
                kept, flat, starts = _sets(part["t"].to_list(), hashes, shingle, least_words)
                if len(kept):
                    ends = np.append(starts[1:], len(flat))
                    mixed = (flat ^ (flat >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                    cls = np.add.reduceat(mixed ^ (mixed >> np.uint64(33)), starts)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[kept], "s": [flat[a:b].tobytes() for a, b in zip(starts, ends)], "cls": cls.view(np.int64)})

    return run


def shingled(df: DataFrame, key: str, text, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, s, cls): the sorted set of 64-bit hashes of shingle consecutive words of each id with enough words, packed, and a hash of that set.

    Ids with different texts have the shingles of all of those with enough words; null ids and texts take no part.
    """
    t = df.select(F.col(key).alias("id"), text.alias("t")).where("id is not null and t is not null").groupBy("id").agg(F.collect_set("t").alias("t"))
    return t.mapInPandas(_shingled(shingle, least_words), f"id {df.schema[key].dataType.simpleString()}, s binary, cls bigint")


def _flat(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Packed sets one after another, and where each begins."""
    sizes = sets.map(len).to_numpy() // 8
    return np.frombuffer(b"".join(sets), np.uint64), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _levels(sets: DataFrame) -> np.ndarray:
    """For each bucket of shingles, how often they occur, as a level."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << ORDER_BITS, np.int64)
        for big in batches:
            for at in range(0, len(big), 2000):  # bounds the memory of a step
                flat, _ = _flat(big["s"].iloc[at : at + 2000])
                n += np.bincount((_mixed(flat) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(n))
        parts = n.reshape(-1, PART)
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"part": some.astype(np.int32), "n": [parts[i].astype(np.uint32).tobytes() for i in some]})

    def total(p: pd.DataFrame) -> pd.DataFrame:
        n = np.frombuffer(b"".join(p["n"]), np.uint32).reshape(-1, PART).sum(0, dtype=np.int64)
        return pd.DataFrame({"part": p["part"].iloc[:1], "n": [np.round(4 * np.log2(1 + n)).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << ORDER_BITS, np.uint8).reshape(-1, PART)
    for r in sets.select("s").mapInPandas(count, "part int, n binary").groupBy("part").applyInPandas(total, "part int, n binary").collect():  # of a fixed size, a byte for each bucket
        out[r["part"]] = np.frombuffer(r["n"], np.uint8)
    return out.ravel()


def _keys(threshold: float, levels):
    """(key, cls, size, pos, lo, hi): the first shingles of the classes of a batch, each class once, with their places in the order, the size of the set and its bitmap.

    A bit of the bitmap is the parity of the shingles that fall on it, so the bitmaps of two sets differ in at most as many bits as the sets in shingles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = levels.value
        for big in batches:
            big = big.drop_duplicates("cls")
            for at in range(0, len(big), 2000):  # bounds the memory of a step
                part = big.iloc[at : at + 2000]
                flat, starts = _flat(part["s"])
                size = np.diff(np.append(starts, len(flat)))
                of, mixed = np.repeat(np.arange(len(size)), size), _mixed(flat)
                bit = np.uint64(1) << (mixed & np.uint64(63))
                high = (mixed & np.uint64(64)) > 0
                lo, hi = (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), starts).view(np.int64) for x in (~high, high))
                rank = level[(mixed >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mixed >> np.uint64(8)
                by = np.lexsort((rank, of))  # stable: equal ranks stay in the order of the shingles
                pos = np.arange(len(flat)) - starts[of]
                first = pos <= (size - np.ceil(threshold * size - 1e-9))[of]  # of and pos are the same in this order
                of, pos = of[first], pos[first]
                yield pd.DataFrame({"key": flat[by][first].view(np.int64), "cls": part["cls"].to_numpy()[of], "size": size[of].astype(np.int32), "pos": pos.astype(np.int32), "lo": lo[of], "hi": hi[of]})

    return run


def _may_be_similar(threshold: float):
    """Of pairs of rows as _keys gives them, the positions of those that may be similar, by an upper bound of what they share."""

    def run(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = c["size"][x], c["size"][y]
        least = threshold / (1 + threshold) * (n + m) - 1e-6
        at = np.flatnonzero(np.minimum(n - c["pos"][x], m - c["pos"][y]) >= least)  # at their first common shingle, no earlier one is shared
        x, y = x[at], y[at]
        apart = sum(np.bitwise_count((c[k][x] ^ c[k][y]).view(np.uint64)).astype(np.int32) for k in ("lo", "hi"))
        return at[(n + m)[at] - apart >= 2 * least[at]]

    return run


def _paired(block: int, fitting=None):
    """Of rows (key, cls, ...) in the order of key: the pairs (a, b) of each bucket of at most block classes, and (a, key, nth, ...) for the members of larger ones, where one may come again.

    fitting: gives of pairs of rows the positions of those to keep.
    """

    def pairs(rows: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> pd.DataFrame | None:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(sizes[sizes > 1]):
            at = starts[sizes == n][:, None] + np.arange(n)
            i, j = np.triu_indices(n, 1)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            if fitting:
                fit = fitting(rows, x, y)
                x, y = x[fit], y[fit]
            a.append(rows["cls"][x])
            b.append(rows["cls"][y])
        x, y = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "key": 0, "nth": -1} | {c: 0 for c in rows if c not in ("key", "cls")}) if len(x) else None

    def members(rows: dict[str, np.ndarray], nth: int) -> pd.DataFrame | None:
        n = len(rows["cls"])
        return pd.DataFrame({"a": rows["cls"], "b": np.zeros(n, np.int64), "key": rows["key"], "nth": np.arange(nth, nth + n, dtype=np.int64)} | {c: v for c, v in rows.items() if c not in ("key", "cls")}) if n else None

    def closed(rows: dict[str, np.ndarray], nth: int) -> pd.DataFrame | None:
        return members(rows, nth) if nth else pairs(rows, np.zeros(1, np.int64), np.array([len(rows["cls"])]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_key, nth = None, None, 0  # the open bucket: its members while they are few, and how many were passed on
        for batch in batches:
            if not len(batch):
                continue
            key, cls = batch["key"].to_numpy(), batch["cls"].to_numpy()
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            fresh = np.ones(len(key), bool)  # copies come from several batches
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            rows = {c: batch[c].to_numpy()[order[fresh]] for c in batch.columns}
            key = rows["key"]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            first = 0
            if held is not None:
                if key[0] == held_key:
                    both = {c: np.concatenate([v, rows[c][: ends[0]]]) for c, v in held.items()}
                    _, once = np.unique(both["cls"], return_index=True)
                    held, first = {c: v[once] for c, v in both.items()}, 1
                if len(starts) > first:  # the open bucket ends here
                    if (out := closed(held, nth)) is not None:
                        yield out
                    held, nth = None, 0
            last = len(starts) - 1
            if last >= first:
                sizes = (ends - starts)[first:last]
                small = sizes <= block
                if (out := pairs(rows, starts[first:last][small], sizes[small])) is not None:
                    yield out
                for s, n in zip(starts[first:last][~small], sizes[~small]):
                    yield members({c: v[s : s + n] for c, v in rows.items()}, 0)
                held, held_key, nth = {c: v[starts[last] :] for c, v in rows.items()}, key[-1], 0
            if len(held["cls"]) > block or nth:  # keeps what is held bounded; a class may then come twice
                if (out := members(held, nth)) is not None:
                    yield out
                held, nth = {c: v[:0] for c, v in held.items()}, nth + len(held["cls"])
        if held is not None and (out := closed(held, nth)) is not None:
            yield out

    return run


def similar_classes(sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, jaccard) for all pairs of different sets, a < b, with a similarity of at least threshold.

    sets: (s, cls) as shingled gives them, rows of one cls hold one set. All pairs that share one of
    their first shingles are looked at, however many share it: the classes of a crowded bucket meet block by block.
    """
    levels, fitting = sets.sparkSession.sparkContext.broadcast(_levels(sets)), _may_be_similar(threshold)
    shared = sets.select("s", "cls").mapInPandas(_keys(threshold, levels), "key bigint, cls bigint, size int, pos int, lo bigint, hi bigint").repartition("key").sortWithinPartitions("key")
    found = cut(shared.mapInPandas(_paired(block, fitting), "a bigint, b bigint, key bigint, nth bigint, size int, pos int, lo bigint, hi bigint"))
    crowded = found.where("nth >= 0").select("key", F.col("a").alias("cls"), F.floor(F.col("nth") / block).cast("int").alias("blk"), "size", "pos", "lo", "hi")

    def compare_blocks(key, p: pd.DataFrame) -> pd.DataFrame:
        rows = {c: p[c].to_numpy() for c in p.columns}
        cls, blk = rows["cls"], rows["blk"]
        i, j = np.triu_indices(len(p), 1) if key[1] == key[2] else (x.ravel() for x in np.meshgrid(np.flatnonzero(blk == key[1]), np.flatnonzero(blk == key[2]), indexing="ij"))
        i, j = i[cls[i] != cls[j]], j[cls[i] != cls[j]]
        at = fitting(rows, i, j)
        x, y = cls[i[at]], cls[j[at]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    likely = found.where("nth < 0").select("a", "b")
    if not crowded.isEmpty():
        blocks = crowded.groupBy("key").agg(F.max("blk").alias("last"))
        met = salted_join(crowded, blocks, ["key"], "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        met = met.select("key", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "cls", "blk", "size", "pos", "lo", "hi")
        likely = likely.union(met.groupBy("key", "p", "q").applyInPandas(compare_blocks, "a bigint, b bigint"))
    likely = cut(likely.distinct())
    asked = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    own = cut(sets.select("cls", "s").join(asked, "cls", "left_semi").groupBy("cls").agg(F.first("s").alias("s")))
    both = likely.join(own.withColumnsRenamed({"cls": "a", "s": "x"}), "a").join(own.withColumnsRenamed({"cls": "b", "s": "y"}), "b")
    return both.mapInPandas(_verified(threshold), "a bigint, b bigint, jaccard double")


def _verified(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for a, b, x, y in zip(p["a"], p["b"], p["x"], p["y"]):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                out.append((a, b, both / (len(u) + len(v) - both)))
            out = pd.DataFrame(out, columns=["a", "b", "jaccard"])
            yield out[out["jaccard"] >= threshold]

    return run


def near_duplicates(df: DataFrame, key: str, text, threshold: float = THRESHOLD, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(links, members): similar pairs of classes (a, b, jaccard), and each id's class (id, cls).

    Similarity is the Jaccard of the sets of shingle consecutive lower-case words. Equal
    sets form a class, named by a hash of the set, so copies cost nothing but their
    membership. Texts of fewer than least_words words, null texts and null ids take no
    part; repeated ids count once, with the shingles of all their texts. An empty table gives no rows.
    """
    sets = cut(shingled(df, key, text, shingle, least_words))
    return cut(similar_classes(sets, threshold)), sets.select("id", "cls")


def anchors_of(members: DataFrame, anchors: int | None = None) -> DataFrame:
    """(cls, anchor): the first members of each class, in two steps so that a large class is cut down part by part; all of them for None."""
    if anchors is None:
        return members.select("cls", F.col("id").alias("anchor"))
    part = Window.partitionBy("cls", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    few = members.withColumn("n", F.row_number().over(part)).where(F.col("n") <= anchors)
    return few.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("n") <= anchors).select("cls", F.col("id").alias("anchor"))


def all_pairs(links: DataFrame, members: DataFrame, anchors: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of similar ids.

    They grow with the square of a class's members. With a number of anchors only those
    of which one at least is among the first so many of its class.
    """
    several = cut(members.join(members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"), "cls", "left_semi"))
    within = salted_join(several, anchors_of(several, anchors), ["cls"], "id").where("id != anchor" if anchors else "id < anchor").select("id", "anchor")
    to = links.select(F.col("a").alias("cls"), F.col("b").alias("other"))
    back = links.select(F.col("b").alias("cls"), F.col("a").alias("other"))
    linked = cut(members.join(to.union(back).select("cls").distinct(), "cls", "left_semi"))
    met = (to.union(back) if anchors else to).join(anchors_of(linked, anchors).withColumnRenamed("cls", "other"), "other").select("cls", "anchor")
    across = salted_join(linked, met, ["cls"], "id").select("id", "anchor")
    pairs = within.union(across).select(F.least("id", "anchor").alias("a"), F.greatest("id", "anchor").alias("b"))
    return pairs.distinct() if anchors else pairs  # all pairs come once each


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, links): every id with its class, named by its smallest id, and the number of other classes that are similar to it."""
    first = members.groupBy("cls").agg(F.min("id").alias("class"))
    degree = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    named = first.join(degree, "cls", "left").select("cls", "class", F.coalesce("links", F.lit(0)).alias("links"))
    return salted_join(members, named, ["cls"], "id").select("id", "class", "links")


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b: the similar pairs of classes, each named by its smallest id."""
    first = cut(members.groupBy("cls").agg(F.min("id").alias("first")))
    x = links.join(first.withColumnsRenamed({"cls": "a", "first": "x"}), "a").join(first.withColumnsRenamed({"cls": "b", "first": "y"}), "b")
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group, links): every id with its group, named by the smallest id, and the number of other classes its class is linked to."""
    of = cut(classes(links, members))
    found = connected_components(class_links(links, members), "a", "b").withColumnsRenamed({"node": "class", "component": "g"})
    return salted_join(of, found, ["class"], "id", "left").select("id", F.coalesce("g", "class").alias("group"), "links")
