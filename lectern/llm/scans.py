"""Problem 2: noise in text from scanned pages.

Method: words are grouped by the skeleton of their confusable glyphs, and rare forms give
way to the frequent form that the neighbouring words support, occurrence by occurrence; lines at the edges of pages
are compared within a document with their digits masked, which finds running headers,
and page numbers by their even step; SQL windows reflow the lines into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.lineage import cut
from lectern.functions.text import squeeze

# Glyphs that are mistaken for each other, one by one and as strokes.
SINGLE = ("0@5†961!|lerty", "oastgbiiiicitv")
STROKES = (("d", "ci"), ("m", "iii"), ("[nuh]", "ii"), ("w", "vv"))
#: Hyphens that break words: hyphen-minus, soft hyphen, not sign, hyphen, en dash.
HYPHENS = "\\-\\x{AD}\\x{AC}\\x{2010}\\x{2013}"
#: How much more frequent the right form is than a misread one; where a symbol stands in the word it need only be as frequent.
RATIO = 20
#: Words on either side that are asked where the direct neighbours are silent, and the share of them that must be seen as near the right form.
REACH, NEAR = 3, 0.3
#: Bytes of words up to which a table is sent to every task; beyond, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Characters of texts that are taken apart together and share one list of words.
BLOCK_CHARS = 4 << 20
#: Lines looked at from each edge of a page; while all of them are printed, as many more.
DEPTH = 2

# Section headings of the body that stand at page edges.
HEADINGS = {"answers", "summary", "exercises", "worked example", "worked examples", "notes", "solutions", "references", "questions", "review", "contents"}

_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_NUMBER = r"\d{1,4}|[ivxlc]{1,9}|[IVXLC]{1,9}"
_PURE = re.compile(rf"(?P<pre>(?:(?:page|pagina|página|seite|pág|pag|p|s)\b\.?\s*)?[-–—|\[(~*=·•<]*)\s*(?P<n>{_NUMBER})\s*(?P<of>(?:/|of|von|de|sur)\s*\d{{1,4}})?\s*(?P<post>[-–—|\])~*=·•>]*)", re.I)
_FIRST = re.compile(rf"(?P<n>{_NUMBER})(?P<gap>\s*\|?\s+|\s*[-–—·]\s*)(?P<rest>\S.*)")
_LAST = re.compile(rf"(?P<rest>.*\S)(?P<gap>\s+\|?\s*|\s*[-–—·]\s*)(?P<n>{_NUMBER})")
_TABLE = str.maketrans(*SINGLE)
_NUMERAL = frozenset("0123456789ivxlcIVXLC")
_STROKES = [(re.compile(glyph), strokes) for glyph, strokes in STROKES]
_DIGITS = re.compile(r"\b\d+\b")


def skeleton(word: Column) -> Column:
    """Forms that differ only in confusable glyphs have one skeleton."""
    out = F.translate(F.lower(word), *SINGLE)
    for glyph, strokes in STROKES:
        out = F.regexp_replace(out, glyph, strokes)
    return out


def _skeleton(text: str) -> str:
    out = text.lower().translate(_TABLE)
    for glyph, strokes in _STROKES:
        out = glyph.sub(strokes, out)
    return out


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _roman(text: str) -> int | None:
    if not _ROMAN.fullmatch(text):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text.lower()]
    return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def _value(text: str) -> int | None:
    return int(text) if text.isdigit() else _roman(text)


def edge_line(line: str) -> tuple[int | None, bool, str]:
    """(number at an end of the line, whether it is surely printed as a page number, key of the rest with digits masked)."""
    bare = line.strip()
    pure = _PURE.fullmatch(bare)
    if pure and (n := _value(pure["n"])) is not None:
        sure = bool(pure["of"] or pure["pre"].strip() or pure["post"].strip()) or line.startswith("     ")
        return n, sure and pure["n"].isdigit(), ""
    number, rest = None, bare
    for form, at in ((_FIRST, 0), (_LAST, -1)):
        m = form.fullmatch(bare) if bare and bare[at] in _NUMERAL else None
        if m and (n := _value(m["n"])) is not None and (m["n"].isdigit() or len(m["gap"]) > 2):
            number, rest = n, m["rest"]
            break
    return number, False, rest


def _key(text: str) -> str:
    return " ".join(_skeleton(_DIGITS.sub("#", text.strip(" |\t"))).split())


def _may_head(text: str) -> bool:
    """Whether a line can be a running header by its form."""
    bare = text.strip()
    if sum(1 for _ in islice(filter(str.isalpha, bare), 4)) < 4 or bare[0] in "#-•$>" or bare.startswith("* ") or bare.count("|") > 2 or re.match(r"\d+[.)]\s", bare):
        return False
    return not (re.search(r"[.;,:?!]$", bare) and not bare.endswith("...")) and bare.lower() not in HEADINGS


def _styled(text: str) -> bool:
    """Whether a line is set like a running header: capitals, rules, leaders, two columns, a numbered part."""
    bare = text.strip()
    return bare.isupper() or (bare.startswith("|") and bare.endswith("|")) or bare.endswith("...") or " * " in bare or "    " in bare


def _edges(first: int):
    """The lines from the first on, counted from each edge of a page, that may be printed around the body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, doc, no, text in zip(b["page_id"], b["document_id"], b["page_number"], b["text"]):
                lines = _lines(text)
                full = [i for i, x in enumerate(lines) if x.strip()]
                top, bottom = full[first : first + DEPTH], full[max(len(full) - first - DEPTH, first + DEPTH) : max(len(full) - first, 0)]
                for i in (*top, *bottom):
                    line = lines[i]
                    number, sure, rest = edge_line(line)
                    apart = (i == full[0] or i == full[-1]) and len(full) > 1 and not (lines[i + 1].strip() if i == full[0] else lines[i - 1].strip())
                    head = bool(rest) and _may_head(rest)
                    if number is not None or head:
                        offset = None if number is None or no is None or pd.isna(no) else number - int(no)
                        whole = _key(line) if _may_head(line) else None
                        out.append((page, doc, i in top, " ".join(line.split()), offset, sure, _key(rest) if head else None, whole, apart and _styled(rest)))
            yield pd.DataFrame(out, columns=["page_id", "document_id", "top", "line", "offset", "sure", "key", "whole", "styled"])

    return run


def _printed(pages: DataFrame, first: int) -> DataFrame:
    schema = "page_id string, document_id string, top boolean, line string, offset int, sure boolean, key string, whole string, styled boolean"
    e = cut(pages.mapInPandas(_edges(first), schema))
    steady = e.where("offset is not null").groupBy("document_id", "offset").agg(F.countDistinct("page_id").alias("n")).where("n > 1").select("document_id", "offset", F.lit(True).alias("steady"))
    e = e.join(steady, ["document_id", "offset"], "left").withColumn("number", F.coalesce("steady", F.lit(False)) | F.col("sure"))
    e = e.withColumn("head", F.when(F.col("number") | F.col("offset").isNull(), F.col("key")).otherwise(F.col("whole")))
    often = e.where("head is not null").groupBy("document_id", "head").agg(F.countDistinct("page_id").alias("n"), F.max("styled").alias("set")).where("n > 1 or set").select("document_id", "head", F.lit(True).alias("header"))
    e = e.join(often, ["document_id", "head"], "left").withColumn("header", F.coalesce("header", F.lit(False)))
    return cut(e.where("number or header").select("page_id", "document_id", "top", "line", "number", "header"))


def printed_lines(pages: DataFrame) -> DataFrame:
    """(page_id, document_id, line, number, header): lines at page edges that are printed around the body, white space squeezed.

    pages: (page_id, document_id, page_number, text). A number is a page number if it
    keeps its distance to page_number on at least two pages, or is dressed as one. The
    rest of a line is a running header if it stands at the edges of two pages of the
    document, digits masked and confusable glyphs alike. Pages are looked into from each
    edge DEPTH lines at a time, as long as all of these are printed.
    """
    p, out, first = pages.where("text is not null"), None, 0
    while True:
        found = _printed(p, first)
        out = found if out is None else out.union(found)
        on = found.groupBy("page_id", "top").agg(F.count("*").alias("n")).where(F.col("n") >= DEPTH).select("page_id").distinct()
        if on.isEmpty():
            return out.drop("top").distinct()
        p, first = p.join(cut(on), "page_id", "left_semi"), first + DEPTH


class _Blank(dict):
    """For str.translate: what stands in no token becomes a blank."""

    def __missing__(self, c: int) -> int:
        x = chr(c)
        self[c] = c if x in "@†!|'’-" or unicodedata.category(x)[0] in "LMN" else 32
        return self[c]


_BLANKS = _Blank()
_JOIN = re.compile("[-\xad\xac\u2010\u2013][ \t]*\r?\n[ \t]*")
_OUTER = re.compile(r"^[^\w@†!]+|[^\w@†]+$")
_BEFORE, _AFTER = regex.compile(r"[\p{L}\p{M}0-9@†!'’]+(?:-\p{L}+)*$"), regex.compile(r"\p{Ll}[\p{L}\p{M}0-9@†!]*")


def _breaks(text: str, joins: Iterable[re.Match]) -> list[str]:
    out = []
    for m in joins:
        b = _AFTER.match(text, m.end())
        if b:
            token = text[max(text.rfind(c, 0, m.start()) for c in " \t\n\r") + 1 : m.start()]
            a = _BEFORE.search(token)
            if a:
                out.append(f"{a[0].lower()} {b[0].lower()}")
    return list(dict.fromkeys(out))


def breaks_of(text: str) -> list[str]:
    """The words broken over two lines, in lower case, as what stands before and behind the break with a blank between."""
    return _breaks(text, _JOIN.finditer(text))


def _line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


_KNOWN = np.zeros(0x110000, np.uint32)  # by code point what _BLANKS makes of it, 0 if not yet asked


def _blanked(text: str) -> str:
    """As text.translate(_BLANKS), for long texts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _KNOWN[points]
    if not out.all():
        for c in set(points[out == 0].tolist()):
            _KNOWN[c] = _BLANKS[c]
        out = _KNOWN[points]
    return out.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def _coded(texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """The distinct words of texts, "" first; the number of each word in their order, REACH times 0 around each text; the words in each text.

    Words are lower-case word-like runs, with the symbols that misread letters become;
    what is no word at its ends is taken off each distinct run once.
    """
    low = [t.lower() for t in texts]
    flat, at, runs, sizes = _blanked("".join(low)), 0, [], []
    for t in low:
        found = flat[at : at + len(t)].split()
        at += len(t)
        runs += found
        sizes.append(len(found))
    ids: dict[str, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(ids.__getitem__, runs), np.int64, len(runs))
    words = {"": 0}
    clean = np.fromiter((words.setdefault(t if t.isalnum() else _OUTER.sub("", t), len(words)) for t in ids), np.int64, len(ids))
    out = np.zeros(len(runs) + REACH * (len(texts) + 1), np.int64)
    out[np.arange(len(runs)) + REACH * np.repeat(np.arange(1, len(texts) + 1), sizes)] = clean[codes]
    return list(words), out, sizes


_unpack = zstandard.ZstdDecompressor().decompress


def _code_type(words: list[str]) -> str:
    return "<u2" if len(words) <= 1 << 16 else "<u4"


def _opened(words: bytes, codes: bytes) -> tuple[list[str], np.ndarray]:
    w = _unpack(words).decode().split("\n")
    return w, np.frombuffer(_unpack(codes), _code_type(w))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=1).compress
    columns = ["record_id", "document_id", "page", "breaks", "lines", "records", "documents", "sizes", "words", "codes"]
    for b in batches:
        joined, own = [], []
        for record, doc, page, text in zip(b["record_id"], b["document_id"], b["page"], b["text"]):
            joins = list(_JOIN.finditer(text))
            breaks = _breaks(text, joins) if joins else []
            lines = [] if page else list({_line_hash(" ".join(x.split())) for x in _lines(text) if x and not x.isspace()})
            if breaks or lines:
                own.append((record, doc, page, breaks, lines, None, None, None, None, None))
            joined.append("".join([text[i:j] for i, j in zip([0, *(m.end() for m in joins)], [*(m.start() for m in joins), len(text)])]) if joins else text)
        for (page, _), at in b.groupby([b["page"], np.cumsum([len(t) for t in joined]) // BLOCK_CHARS]).indices.items():
            words, codes, sizes = _coded([joined[i] for i in at])
            own.append((None, None, page, None, None, b["record_id"].iloc[at].tolist(), b["document_id"].iloc[at].tolist(), sizes, pack("\n".join(words).encode()), pack(codes.astype(_code_type(words)).tobytes())))
        yield pd.DataFrame(own, columns=columns)


def token_table(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both tables, taken apart once, in two kinds of rows.

    (record_id, document_id, page, breaks, lines) of a record with any: its broken words,
    and of chunks the hashes of the lines. (page, records, documents, sizes, words, codes)
    of a block of records: their ids and numbers of words, the distinct words of all, and
    which of them follow each other (see _coded), both packed.
    """
    p = pages.select(F.col("page_id").alias("record_id"), "document_id", F.lit(True).alias("page"), "text")
    c = chunks.select(F.col("chunk_id").alias("record_id"), "document_id", F.lit(False), "text")
    schema = "record_id string, document_id string, page boolean, breaks array<string>, lines array<bigint>, records array<string>, documents array<string>, sizes array<int>, words binary, codes binary"
    return p.union(c).where("record_id is not null and text is not null").mapInPandas(_packed, schema)


def _blocks(tokens: DataFrame, *more: str) -> DataFrame:
    return tokens.where("words is not null").select("words", "codes", *more)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for page, packed, codes in zip(b["page"], b["words"], b["codes"]):
            words, codes = _opened(packed, codes)
            n = np.bincount(codes, minlength=len(words))
            yield pd.DataFrame({"word": words, "pages": n * bool(page), "chunks": n * (not page)})


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(word, n) of token_table. Chunks repeat what pages hold, so n is the count in the table that has more."""
    counts = _blocks(tokens, "page").mapInPandas(_counted, "word string, pages bigint, chunks bigint").where(F.length("word") > 1)
    return counts.groupBy("word").agg(F.greatest(F.sum("pages"), F.sum("chunks")).alias("n"))


def misread_forms(words: DataFrame) -> DataFrame:
    """(bad, good, n): rare forms and the frequent forms of their skeleton, by frequency n; several where more than one may be meant."""
    odd = F.col("word").rlike(r"[0-9@†!|]")
    forms = words.where(F.length("word") > 2).where(F.col("word").rlike(r"\p{L}")).withColumn("odd", odd).withColumn("k", skeleton(F.col("word")))
    right = forms.where(~F.col("odd"))
    top = right.groupBy("k").agg(F.max("n").alias("top"))
    bad = forms.join(top, "k").where(F.when(F.col("odd"), (F.col("n") <= F.col("top")) & F.col("word").rlike(r"\p{L}.*\p{L}")).otherwise(F.col("n") * RATIO <= F.col("top")))
    good = right.join(top, "k").where(F.col("n") * RATIO > F.col("top")).select("k", F.col("word").alias("good"), F.col("n").alias("m"))
    return bad.select("k", F.col("word").alias("bad")).join(good, "k").where("bad != good").select("bad", "good", F.col("m").alias("n"))


#: A symbol or digit between the letters of a word that no known word explains, as in names.
STRAY = r"^\p{L}{2,}[0156@†!9]\p{L}{2,}$|^\p{L}{5,}[05@†]$|^[@†!]\p{L}{4,}$"


def _small(df: DataFrame) -> bool:
    """Whether the words of df are few enough to be sent to every task; df should be cut."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) + 50 for c, t in df.dtypes if t == "string"), F.lit(0)))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def _few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if its size is bounded; else as it is."""
    return F.broadcast(df) if _small(df) else df


def _sent(df: DataFrame, form: Callable[[list[tuple]], object]) -> Broadcast | None:
    """What form makes of the rows of df, for every task if their size is bounded."""
    return df.sparkSession.sparkContext.broadcast(form([tuple(r) for r in df.collect()])) if _small(df) else None


def _masked(words: list[str]) -> list[str]:
    return ["#" if w.isdigit() else w for w in words]


def occurrences(tokens: DataFrame, sought: DataFrame) -> DataFrame:
    """(record_id, document_id, word, left, right, around): where the words of sought (word) stand, digits of the neighbours masked."""
    sent = _sent(sought, lambda rows: {w for (w,) in rows})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = None if sent is None else sent.value
        for b in batches:
            for packed, codes, records, docs, sizes in zip(b["words"], b["codes"], b["records"], b["documents"], b["sizes"]):
                words, codes = _opened(packed, codes)
                masked, out = _masked(words), []
                hit = np.fromiter((bool(w) and (wanted is None or w in wanted) for w in words), bool, len(words))
                at = np.flatnonzero(hit[codes])
                of = np.searchsorted(np.cumsum(np.asarray(sizes) + REACH), at, "right")  # in which record
                near = codes[at[:, None] + np.arange(-REACH, REACH + 1)]
                for r, c in zip(of.tolist(), near.tolist()):
                    around = {masked[x] for x in (*c[:REACH], *c[REACH + 1 :])} - {""}
                    out.append((records[r], docs[r], words[c[REACH]], masked[c[REACH - 1]], masked[c[REACH + 1]], sorted(around)))
                yield pd.DataFrame(out, columns=["record_id", "document_id", "word", "left", "right", "around"])

    found = _blocks(tokens, "records", "documents", "sizes").mapInPandas(find, "record_id string, document_id string, word string, left string, right string, around array<string>")
    return (found if sent else found.join(sought, "word", "left_semi").select("record_id", "document_id", "word", "left", "right", "around")).distinct()


def _keyed(pairs: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """The words of pairs, and as sorted numbers the pairs: place of the first word times (number of words + 1), plus that of the second."""
    words = sorted({w for p in pairs for w in p})
    at = {w: i for i, w in enumerate(words)}
    return words, np.unique(np.fromiter((at[a] * (len(words) + 1) + at[b] for a, b in pairs), np.int64, len(pairs)))


def _finder(words: list[str], keys: np.ndarray) -> Callable[[list[str], np.ndarray, Iterable[int]], Iterator[np.ndarray]]:
    """Of pairs (see _keyed) a function that gives for a block and each of some distances the places in keys of the pairs that stand so far apart, once for each occurrence.

    Two marks of the words, put together, point to a place in a table that says no to most
    of the other pairs; what is left is looked up in keys.
    """
    n, at = len(words) + 1, {w: i for i, w in enumerate(words)}
    size = 1 << max(10, (16 * len(keys)).bit_length())
    first, second = np.random.default_rng(0).integers(0, size, (2, n), np.uint32)
    some = np.zeros(size, bool)
    some[first[keys // n] ^ second[keys % n]] = True

    def find(block: list[str], codes: np.ndarray, distances: Iterable[int]) -> Iterator[np.ndarray]:
        own = np.fromiter((at.get(w, n - 1) for w in _masked(block)), np.int64, len(block))
        a, b = first[own][codes], second[own][codes]
        for d in distances:
            i, j = max(0, -d), max(0, d)
            hit = np.flatnonzero(some[a[i : len(a) - j] ^ b[j : len(b) - i]])
            key = own[codes[hit + i]] * n + own[codes[hit + j]]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            yield place[keys[place] == key]

    return find


def _pairs_at(tokens: DataFrame, asked: DataFrame, distances: tuple[int, ...]) -> DataFrame:
    """(a, b, m): how often the second word of the pairs of asked (a, b), none of them empty, stands at one of distances from the first, digits masked; several rows of a pair."""
    sent = _sent(asked, _keyed)

    def count_asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, keys = sent.value
        find, n = _finder(words, keys), np.zeros(len(keys), np.int64)
        for b in batches if len(keys) else ():
            for packed, codes in zip(b["words"], b["codes"]):
                for places in find(*_opened(packed, codes), distances):
                    n += np.bincount(places, minlength=len(keys))
        some = np.flatnonzero(n)
        first, second = np.divmod(keys[some], len(words) + 1)
        names = np.array(words, object)
        yield pd.DataFrame({"a": names[first], "b": names[second], "m": n[some]})

    def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed, codes in zip(b["words"], b["codes"]):
                words, codes = _opened(packed, codes)
                codes, keys = codes.astype(np.int64), []
                for d in distances:
                    first, second = codes[max(0, -d) : len(codes) - max(0, d)], codes[max(0, d) : len(codes) - max(0, -d)]
                    keys.append((first * len(words) + second)[(first > 0) & (second > 0)])
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                first, second = np.divmod(found, len(words))
                names = np.array(_masked(words), object)
                yield pd.DataFrame({"a": names[first], "b": names[second], "m": n})

    schema = "a string, b string, m bigint"
    return _blocks(tokens).mapInPandas(count_asked, schema) if sent else _blocks(tokens).mapInPandas(count_all, schema).join(asked, ["a", "b"], "left_semi")


def pair_counts(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, m): how often the word pairs of asked (a, b) stand side by side, digits masked."""
    return _pairs_at(tokens, asked, (1,)).groupBy("a", "b").agg(F.sum("m").alias("m"))


def seen_near(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked (good, x) for which x stands within REACH words of good in a record."""
    found = _pairs_at(tokens, asked.select(F.col("good").alias("a"), F.col("x").alias("b")), (*range(-REACH, 0), *range(1, REACH + 1)))
    return found.select(F.col("a").alias("good"), F.col("b").alias("x")).distinct()


def char_errors(tokens: DataFrame, words: DataFrame, bad: DataFrame) -> DataFrame:
    """(record_id, word, left, right, good): the occurrences of misread words, with the form to put there.

    Each occurrence of a form in bad (bad, good, n) is judged by its neighbours. A side
    speaks for the form itself if the form has that neighbour in further documents too,
    and in more than twice as many as misreading one in RATIO of the right form would give
    (for a symbol in the word, in more than the right form has it); one such side, and the
    occurrence stays.
    Else a side where the right form has that neighbour makes it misread. If both are
    silent, NEAR of the words around must be seen as near the right form; a symbol in the
    word needs no such support. Symbols in words that are like no known one (STRAY) are
    misread anyway.
    """
    stray = cut(words.where(F.length("word") > 2).where(F.col("word").rlike(STRAY)).select("word"))
    occ = cut(occurrences(tokens, cut(stray.union(bad.select("bad")).distinct())))
    doc = F.coalesce("document_id", "record_id")
    own = [occ.groupBy("word", side).agg((F.countDistinct(doc) - 1).alias(f"own_{side}")) for side in ("left", "right")]
    c = occ.join(_few(bad.withColumnRenamed("bad", "word")), "word").join(own[0], ["word", "left"]).join(own[1], ["word", "right"])
    c = cut(c.select("record_id", "word", "left", "right", "around", "good", "n", *(F.when(F.col(s) == "", 0).otherwise(F.col(f"own_{s}")).alias(f"own_{s}") for s in ("left", "right"))))
    asked = c.select(F.col("left").alias("a"), F.col("good").alias("b")).union(c.select("good", "right")).where("a != '' and b != ''").distinct()
    support = cut(pair_counts(tokens, cut(asked)))
    c = c.join(support.select(F.col("a").alias("left"), F.col("b").alias("good"), F.col("m").alias("good_left")), ["left", "good"], "left")
    c = c.join(support.select(F.col("a").alias("good"), F.col("b").alias("right"), F.col("m").alias("good_right")), ["good", "right"], "left").fillna(0, ["good_left", "good_right"])
    odd = F.col("word").rlike(r"[0-9@†!|]")
    rate = F.when(odd, 1.0).otherwise(2 / RATIO)
    kept = (F.col("own_left") > rate * F.col("good_left")) | (F.col("own_right") > rate * F.col("good_right"))
    c = cut(c.withColumn("kept", kept).withColumn("support", F.col("good_left") + F.col("good_right")))
    silent = c.where(~F.col("kept") & (F.col("support") == 0) & ~odd).select("record_id", "word", "left", "right", "good", "n", "around", F.explode("around").alias("x"))
    near = seen_near(tokens, cut(silent.select("good", "x").distinct())).withColumn("near", F.lit(1))
    wide = silent.join(near, ["good", "x"], "left").groupBy("record_id", "word", "left", "right", "around", "good", "n").agg(F.sum(F.coalesce("near", F.lit(0))).alias("near"))
    misread = c.where(~F.col("kept") & ((F.col("support") > 0) | odd)).select("record_id", "word", "left", "right", "good", "n", "support")
    misread = misread.union(wide.where(F.col("near") >= NEAR * F.size("around")).select("record_id", "word", "left", "right", "good", "n", F.lit(0)))
    # The form itself counts nothing where a symbol stands in a word: the likeliest form is put there, else what the symbol looks like.
    plain = F.translate(F.col("word"), "0156@†!9", "olsbatig")
    likely = c.join(_few(stray), "word", "left_semi").select("record_id", "word", "left", "right", "good", "n", "support")
    alone = occ.join(_few(stray), "word", "left_semi").select("record_id", "word", "left", "right", plain.alias("good"), F.lit(-1), F.lit(-1))
    by = F.struct("support", "n", "good")
    return misread.union(likely).union(alone).groupBy("record_id", "word", "left", "right").agg(F.max_by("good", by).alias("good"))


def broken_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(record_id, a, b, compound): words broken over two lines; compound where they broke at their own hyphen.

    The joined and the hyphenated form are looked up in the vocabulary; if it has
    neither, two known words make a compound and all else is a broken word.
    """
    found = tokens.where(F.size("breaks") > 0).select("record_id", F.explode("breaks").alias("m"))
    found = cut(found.select("record_id", F.substring_index("m", " ", 1).alias("a"), F.substring_index("m", " ", -1).alias("b")).distinct())
    ab = cut(found.select("a", "b").distinct())
    asked = ab.select("a", "b", F.explode(F.array(*(F.struct(F.lit(k).alias("as"), w.alias("word")) for k, w in (("j", F.concat("a", "b")), ("h", F.concat_ws("-", "a", "b")), ("a", F.element_at(F.split("a", "-"), -1)), ("b", F.col("b")))))).alias("x"))
    hits = asked.select("a", "b", "x.*").join(words, "word", "left")
    count = {k: F.coalesce(F.max(F.when(F.col("as") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in "jhab"}
    seen = hits.groupBy("a", "b").agg(*count.values())
    compound = (F.col("n_h") > F.col("n_j")) | ((F.col("n_h") == 0) & (F.col("n_j") <= 1) & (F.least("n_a", "n_b") > 20))
    return found.join(seen.select("a", "b", compound.alias("compound")), ["a", "b"])


def records_of(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_id, text) of both tables; rows with a null id or text are left out, repeated rows stay."""
    p = pages.select(F.col("page_id").alias("record_id"), "text")
    return p.union(chunks.select(F.col("chunk_id").alias("record_id"), "text")).where("record_id is not null and text is not null")


def find_noise(pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(record_id, noise_kind) once each, and the tables it rests on: printed, breaks, errors, records, tokens.

    pages needs page_id, document_id, page_number, text; chunks chunk_id, document_id,
    text. What is printed around pages is learnt from pages and sought in both. Null and
    blank texts hold no noise; pages without a number can't show an even step; an empty
    table adds nothing.
    """
    p = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("document_id").cast("string").alias("document_id"), "page_number", "text").where("page_id is not null and text is not null")
    tokens = cut(token_table(p, chunks))
    words = cut(vocabulary(tokens))
    bad = cut(misread_forms(words))
    edges = cut(printed_lines(p))
    breaks = cut(broken_words(tokens, words))
    errors = cut(char_errors(tokens, words, bad))
    lines = edges.groupBy("document_id", "line").agg(F.max("number").alias("number"), F.max("header").alias("header")).mapInPandas(_hashed_lines, "document_id string, line string, h bigint, number boolean, header boolean")
    in_chunks = tokens.where("not page and size(lines) > 0").select("record_id", "document_id", F.explode("lines").alias("h"))
    hits = in_chunks.join(lines, ["document_id", "h"]).select("record_id", "line", "number", "header")
    printed = cut(hits.union(edges.select(F.col("page_id").alias("record_id"), "line", "number", "header")))
    kinds = printed.select("record_id", F.explode(F.array_compact(F.array(F.when(F.col("number"), "page_number"), F.when(F.col("header"), "running_header")))).alias("noise_kind"))
    found = kinds.union(breaks.where("not compound").select("record_id", F.lit("hyphenation"))).union(errors.select("record_id", F.lit("char_error"))).distinct()
    return found, {"printed": printed, "breaks": breaks, "errors": errors, "records": records_of(p, chunks), "tokens": tokens}


def _hashed_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(h=np.array([_line_hash(x) for x in b["line"]], np.int64))[["document_id", "line", "h", "number", "header"]]


def _chosen(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_id, fixes): each record's misread words with the form to put there; with the neighbours where not every occurrence in the record gets that form."""
    errors = tables["errors"]
    sought = cut(errors.select("word").distinct())
    each = occurrences(tables["tokens"], sought).join(errors, ["record_id", "word", "left", "right"], "left")
    forms = each.groupBy("record_id", "word").agg(F.countDistinct(F.coalesce("good", F.col("word"))).alias("forms"))
    fix = errors.join(forms, ["record_id", "word"]).withColumn("apart", F.col("forms") > 1)
    fix = fix.select("record_id", F.struct(F.col("word").alias("bad"), "good", *(F.when(F.col("apart"), F.col(x)).alias(x) for x in ("left", "right"))).alias("fix")).distinct()
    return fix.groupBy("record_id").agg(F.sort_array(F.collect_list("fix")).alias("fixes"))


_TOKEN = re.compile(r"\S+")


def mended(text: str, fixes: dict[str, list[tuple[str, str | None, str | None]]]) -> str:
    """text with each misread word replaced, in its case, in one pass over its words; fixes: of a bad form (good, left, right), the neighbours None where any will do."""
    spans = []
    for m in _TOKEN.finditer(text.translate(_BLANKS)):
        a, b = m.span()
        token = m[0]
        if not token.isalnum():
            inner = _OUTER.sub("", token)
            a += token.find(inner)
            b = a + len(inner)
        if a < b:
            spans.append((a, b))
    words = [text[a:b].lower() for a, b in spans]
    if fixes.keys().isdisjoint(words):
        return text
    masked, out, at = _masked(words), [], 0
    for i, w in enumerate(words):
        for good, left, right in fixes.get(w, ()):
            if (left is None or left == (masked[i - 1] if i else "")) and (right is None or right == (masked[i + 1] if i + 1 < len(words) else "")):
                a, b = spans[i]
                was = text[a:b]
                out += [text[at:a], good.upper() if was.isupper() and len(was) > 1 else good[:1].upper() + good[1:] if was[:1].isupper() else good]
                at = b
                break
    return "".join([*out, text[at:]])


def _mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for flow, fixes in zip(b["flow"], b["fixes"]):
            known: dict[str, list] = {}
            for f in fixes if fixes is not None else ():
                known.setdefault(f["bad"], []).append((f["good"], f["left"], f["right"]))
            out.append(mended(flow, known) if known else flow)
        yield pd.DataFrame({"record_id": b["record_id"], "text": b["text"], "repaired": out})


def repair(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_id, text, repaired): every record once; clean ones keep their text as it is.

    In the others, printed lines go, lines join into paragraphs (a blank line or an
    indented line begins one), broken words are joined, compounds keep their hyphen, and
    misread words get their right form. What is known of a record comes to it as arrays,
    so that its text is moved once.
    """
    found, tables = find_noise(pages, chunks)
    noisy = found.select("record_id").distinct()
    printed = tables["printed"].groupBy("record_id").agg(F.collect_set("line").alias("printed"))
    broken = tables["breaks"].groupBy("record_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "a", "b"), "compound"))).alias("broken"))
    known = cut(noisy.join(printed, "record_id", "left").join(broken, "record_id", "left").join(_chosen(tables), "record_id", "left"))
    records = tables["records"].groupBy("record_id").agg(F.min("text").alias("text")).join(known.withColumn("noisy", F.lit(True)), "record_id", "left")
    clean = records.where("noisy is null").select("record_id", "text", F.col("text").alias("repaired"))
    lines = records.where("noisy").select("record_id", "printed", "broken", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line")).withColumn("bare", squeeze(F.col("line")))
    body = lines.where(~F.coalesce(F.array_contains("printed", F.col("bare")), F.lit(False)))
    body = body.select("record_id", "pos", "line", "bare", F.when(F.col("bare").rlike(f"[{HYPHENS}]$"), F.col("broken")).alias("broken"))  # only such lines carry it on
    by = Window.partitionBy("record_id").orderBy("pos")
    starts = (F.col("bare") == "") | F.col("line").rlike(r"^[ \t]{3,}\S")
    body = body.withColumn("par", F.sum(starts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("bare != ''")
    body = body.withColumn("next", F.lead("bare").over(by)).withColumn("next_par", F.lead("par").over(by))
    tail, head = F.regexp_extract(F.lower("bare"), rf"([\p{{L}}\p{{M}}0-9@†!'’]++(?:-\p{{L}}++)*)[{HYPHENS}]$", 1), F.lower(F.regexp_extract("next", r"^(\p{Ll}[\p{L}\p{M}0-9@†!]*)", 1))
    compound = F.try_element_at("broken", F.when(F.col("par") == F.col("next_par"), F.concat_ws(" ", tail, head)))
    body = body.withColumn("compound", compound)
    piece = F.when(~F.col("compound"), F.regexp_replace("bare", f"[{HYPHENS}]$", "")).otherwise(F.col("bare"))
    gap = F.when(F.col("next").isNull() | F.col("compound").isNotNull(), "").when(F.col("par") != F.col("next_par"), "\n\n").otherwise(" ")
    flowed = body.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(piece, gap).alias("x")))), lambda s: s["x"]), "").alias("flow"))
    out = records.where("noisy").join(flowed, "record_id", "left").select("record_id", "text", F.coalesce("flow", F.lit("")).alias("flow"), "fixes")
    return out.mapInPandas(_mend, "record_id string, text string, repaired string").union(clean)
