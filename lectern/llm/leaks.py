"""Problem 7: passages of evaluation items inside a corpus.

Method: Wu-Manber search for many patterns at once, over words. The patterns are all
windows of 12 consecutive words of the passages. A table of block shifts says how far
the search may jump from a block of three words; blocks that end a pattern lead to a
bucket by the hash of that suffix, split by the pattern's first block, and a direct
comparison of the whole window confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.lineage import spread
from lectern.functions.text import WORD_PY

WINDOW, BLOCK = 12, 3
#: Characters of passages whose tables are sent to the executors at once; the tables take some 30 times as much.
PORTION = 1 << 20


class Patterns:
    """Shift table and suffix buckets of all windows of some passages."""

    def __init__(self, passages: list[tuple[str, str]], window: int = WINDOW, block: int = BLOCK):
        self.window, self.block, self.reach = window, block, window - block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, dict[tuple, list[str]]]] = {}
        for item, passage in passages:
            w = WORD_PY.findall(passage.lower())
            for i in range(len(w) - window + 1):
                pattern = tuple(w[i : i + window])
                for j in range(block, window + 1):
                    key = pattern[j - block : j]
                    if self.shift.get(key, self.reach) > window - j:
                        self.shift[key] = window - j
                same = self.bucket.setdefault(pattern[-block:], {}).setdefault(pattern[:block], {}).setdefault(pattern, [])
                if item not in same:
                    same.append(item)

    def search(self, text: str) -> dict[str, int]:
        """Items found in a text, with how many of its words stand in leaked windows."""
        w = WORD_PY.findall(text.lower())
        found: dict[str, list[int]] = {}
        window, block, reach, shift = self.window, self.block, self.reach, self.shift
        end, n = window, len(w)
        while end <= n:
            key = tuple(w[end - block : end])
            step = shift.get(key, reach)
            if step:
                end += step
                continue
            starts = self.bucket[key].get(tuple(w[end - window : end - window + block]))
            if starts:
                for item in starts.get(tuple(w[end - window : end]), ()):
                    seen = found.setdefault(item, [0, 0])  # words, end of the last window
                    seen[0] += end - max(end - window, seen[1])
                    seen[1] = end
            end += 1
        return {item: seen[0] for item, seen in found.items()}


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, window: int = WINDOW, portion: int = PORTION) -> DataFrame:
    """(doc_id, item_id, leaked_words) for each text that shares window consecutive words with an item's passage.

    Words are runs of letters or digits in lower case. Every text is searched whole.
    Null and short texts or passages match nothing, repeated rows count once, and a
    document with a null id is reported with that null. The passages are sent to the
    executors in portions of about PORTION characters; each portion is one more pass.
    """
    known = items.select(F.col(item_id).cast("string").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null").distinct()
    portions = max(1, -(-(known.agg(F.sum(F.length("p"))).first()[0] or 0) // portion))
    known = known.withColumn("portion", F.pmod(F.xxhash64("i"), F.lit(portions)))
    kind = corpus.schema[doc_id].dataType.simpleString()
    docs = spread(corpus.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null"))

    def search_with(patterns):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = patterns.value.search
            for batch in batches:
                hits = [(d, i, n) for d, t in zip(batch["d"], batch["t"]) for i, n in find(t).items()]
                yield pd.DataFrame(hits, columns=["d", "i", "n"])

        return search

    out = None
    for k in range(portions):
        rows = known.where(F.col("portion") == k).select("i", "p").collect()  # one bounded portion
        patterns = corpus.sparkSession.sparkContext.broadcast(Patterns([tuple(r) for r in rows], window))
        found = docs.mapInPandas(search_with(patterns), f"d {kind}, i string, n int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("d", "i").agg(F.max("n").alias("n")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), F.col("n").alias("leaked_words"))
