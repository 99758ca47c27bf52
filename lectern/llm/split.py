"""Problem 1: cutting items above a token limit at natural boundaries.

Method: a hierarchy of separators (section, paragraph, sentence, word, character);
pieces are packed greedily up to the limit, each ending at the last boundary of the
coarsest kind that leaves it well filled, and the next one begins with a fixed number
of tokens of its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, TOKEN_PY, token_count

MAX_TOKENS, OVERLAP = 512, 64
#: A token of more characters than this is cut into parts of so many.
MAX_CHARS = 10_000
#: A piece that ends at a section or paragraph holds at least this share of the limit.
FILL = 0.5

PIECES = "piece_index int, char_start int, char_end int, token_count int, item_tokens int, text string"

_SENTENCE_END = re.compile("[.!?…。！？][\"'”’»)\\]]*$")
_SECTION = re.compile(r"#{1,6}\s|(?i:chapter|section|unit|lesson|part|kapitel|chapitre|cap[ií]tulo)\s+\d")
_LINE_ENDS = re.compile("\r\n|[\n\r\x0b\x0c" + chr(0x2028) + chr(0x2029) + "]")


def _gap_rank(gap: str, before: str, after: str) -> int:
    """How natural a cut between two tokens is: 3 section, 2 paragraph, 1 sentence, 0 word."""
    lines = len(_LINE_ENDS.findall(gap))
    if lines and ("\x0c" in gap or lines > 2 or _SECTION.match(after)):
        return 3
    if lines > 1:
        return 2
    return int(bool(_SENTENCE_END.search(before)))


def cut_points(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, max_chars: int = 0) -> list[tuple[int, int, int]]:
    """(char_start, char_end, tokens) of each piece of one text.

    A piece has at most max_tokens tokens; neighbours share overlap tokens. With
    max_chars above 0, a token longer than that many characters is cut by itself, into
    pieces of so many characters that share overlap / max_tokens of them, each counted
    as one token. White space around pieces belongs to none.
    """
    spans, out = [m.span() for m in TOKEN_PY.finditer(text)], []
    first = 0
    for i, (a, b) in enumerate(spans):
        if max_chars and b - a > max_chars:
            out += _packed(text, spans[first:i], max_tokens, overlap)
            step = max(1, max_chars - max_chars * overlap // max_tokens)
            out += [(c, min(c + max_chars, b), 1) for c in range(a, b - (max_chars - step), step)]
            first = i + 1
    return out + _packed(text, spans[first:], max_tokens, overlap)


def _packed(text: str, spans: list[tuple[int, int]], max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of a run of tokens."""
    n = len(spans)
    if n <= max_tokens:
        return [(spans[0][0], spans[-1][1], n)] if n else []
    rank = [0] * (n + 1)
    for i in range(1, n):
        a, b = spans[i - 1][1], spans[i][0]
        if a < b:
            following = text[b : b + 40]
            rank[i] = _gap_rank(text[a:b], text[max(spans[i - 1][0], a - 8) : a], following)
    out, start = [], 0
    while True:
        end = start + max_tokens
        if end >= n:
            out.append((spans[start][0], spans[n - 1][1], n - start))
            return out
        lowest = start + overlap + 1
        for kind, least in ((3, FILL), (2, FILL), (1, 0.0)):
            first = max(lowest, start + int(least * max_tokens))
            at = next((i for i in range(end, first - 1, -1) if rank[i] >= kind), 0)
            if at:
                end = at
                break
        out.append((spans[start][0], spans[end - 1][1], end - start))
        start = end - overlap


def split_oversized(df: DataFrame, keys: list[str], text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, max_chars: int = 0) -> DataFrame:
    """Pieces of every item of df with more than max_tokens tokens.

    keys: columns that name an item. Repeated rows of an item count once. Out come the
    keys, piece_index from 0, char_start and char_end (0-based, end exclusive),
    token_count, the item's item_tokens, and text. With max_chars above 0, an item that
    holds a token longer than that is cut too (see cut_points). Null and empty texts and those within the limit give no row;
    a null key is an item of its own; other columns are not looked at. Items are found
    by counting tokens on the JVM side, so only oversized ones reach Python.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and less than max_tokens")
    item = df.select(*(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    long = F.length("text") > (min(2 * max_tokens, max_chars) if max_chars else 2 * max_tokens)
    counted = token_count(F.col("text")) > max_tokens
    if max_chars:
        counted = counted | F.exists(F.split("text", f"[{SPACE}]+"), lambda t: F.length(t) > max_chars)
    names = [f"k{i}" for i in range(len(keys))]
    item = item.where(long).where(counted).dropDuplicates(names)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, whole in batch[[*names, "text"]].itertuples(index=False, name=None):
                cut = cut_points(whole, max_tokens, overlap, max_chars)
                if len(cut) > 1:
                    n = sum(1 for _ in TOKEN_PY.finditer(whole))
                    rows += [(*key, i, a, b, c, n, whole[a:b]) for i, (a, b, c) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=[*names, "piece_index", "char_start", "char_end", "token_count", "item_tokens", "text"])

    out = item.mapInPandas(pieces, "".join(f"{k} string, " for k in names) + PIECES)
    return out.withColumnsRenamed(dict(zip(names, keys)))
