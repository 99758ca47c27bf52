"""Problem 8: template residue and system messages in place of content.

Method: positive-unlabelled naive Bayes fitted by expectation-maximization. Passages
that carry a trusted mark (a placeholder alone in its line, the opening of a well-known
message or filler) are the positives, all others are unlabelled. The model then scores
every passage of every record, and a record is residue if one passage is.

A passage is a sentence of a line (one of a single word belongs to the next: "Oops! ..."),
or one placeholder-like span with what is glued to it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.lineage import cut, spread

#: Records the model is fitted on, at most about; the scores cover every record.
FIT_RECORDS = 20_000
#: Buckets of the hashed features, so that the model has a fixed size.
BUCKETS = 1 << 18
#: Rounds of expectation-maximization, pseudo-count of the background in the positives, bounds of one feature's weight.
ROUNDS, PSEUDO, LOW, HIGH = 3, 300.0, -4.0, 7.0
#: Log odds from which a passage counts as residue (a posterior of 0.95).
DECIDE = 3.0

# The syntaxes of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|(?:\{%[^\n]*?%\}\s*)+(?<!\s)|\$\{[^{}\n]*\}|\{[^{}\n]{1,40}\}|<%[^\n]*?%>|<<[^<>\n]+>>|<[A-Za-z][^<>\n]{1,40}>|\[\[[^\[\]\n]+\]\]|\[[^\[\]\n]{2,60}\]"
    r"|\$[A-Z][A-Z_]{2,}\b|%[A-Z][A-Z_]{2,}%|@@\w+@@|#[A-Z][A-Z_]{2,}#|__[A-Z][A-Z_]+__|\bX{4,}\b|\?{4,}|\bTBD\b(?: - [a-z ]{3,30})?|\bTODO\b"
)
_MAYBE = re.compile(r"[{}<>\[\]$%@#?]|__[A-Z]|XXXX|TBD|TODO")
_TAG = re.compile(r"</?(?:html|body|head|h[1-6]|p|div|span|br|title|main|b|i)\s*/?>", re.I)
_ALONE = re.compile(r"\s*(?:[-#*>•]+\s*|[^\W\d_][\w ]{0,20}:\s*)?\x00\s*[.,]?\s*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+")
# How trusted messages, notices and fillers begin.
TRUSTED = re.compile(
    r"""\s*["'(]*(?:
    lorem\s+ipsum\b | (\w+)(?:\s+\1){4,} | this\s+is\s+(?:a\s+)?(?:placeholder|dummy|sample)\b | (?:type|enter|write|insert|paste)\s+your\s+\w+\s+(?:in|into)\s+this\b | (?:\w+\s+)?coming\s+soon\b
    | (?:\w+\s+)?to\s+be\s+(?:written|added|completed|supplied)\s*[.!]?$ | replace\s+this\s+\w+ | this\s+(?:page|section|chapter|lesson)\s+is\s+under\s+construction | nothing\s+here\s+yet | sample\s+paragraph | (?:body|your|sample|dummy|placeholder)\s+(?:text|copy|content|entry)\b | content\s+will\s+be\s+added | draft\s+heading
    | (?:first|second|third|next)\s+paragraph\s+of\s+sample | (?:http\s+)?(?:error\s+)?(?:40[0-9]|41[0-9]|429|50[0-9])\s+(?:not\s+found|forbidden|bad|internal|service|gateway|unauthorized|gone)
    | error\s+\d+\s*[:-] | erreur\s+\d+ | fehler\s+\d+ | error\s+\d+ : | internal\s+(?:server\s+)?error\b | the\s+page\s+you\s+(?:were|are)\s+looking | access\s+denied | acc[eè]s\s+refus | zugriff\s+verweigert
    | acceso\s+denegado | database\s+connection\s+failed | request\s+timed\s+out | too\s+many\s+requests | your\s+session\s+has | traceback\s+\(most | keyerror: | file\s+"[\w./]+\.py",\s+line
    | the\s+(?:upstream\s+)?(?:server|service)\s+(?:sent|is\s+down|is\s+temporarily|is\s+currently) | oops\b | we.{0,6}sorry\s+but\s+th | (?:please\s+)?(?:enable|activate|turn\s+on|allow)\s+(?:java)?script
    | javascript\s+is\s+(?:disabled|required|off) | scripts?\s+(?:are|is)\s+(?:blocked|disabled|required) | you\s+need\s+to\s+(?:enable|activate)\s+(?:java)?script | this\s+\w+\s+(?:\w+\s+)?needs\s+scripts
    | your\s+browser\s+(?:is\s+not|does\s+not) | loading\.\.\. | (?:veuillez\s+)?activer?\s+javascript | bitte\s+aktivieren | active\s+javascript | (?:por\s+favor,?\s+)?activ[ae]\s+javascript | habilite\s+javascript
    | les\s+scripts\s+sont | ohne\s+skripte | los\s+scripts\s+est | sin\s+scripts | sans\s+scripts | service\s+(?:momentan|temporarily|unavailable) | der\s+dienst\s+ist | die\s+seite\s+(?:wurde|konnte|existiert) | diese\s+seite
    | el\s+servicio\s+no | la\s+p[aá]gina\s+(?:solicitada|que\s+busca|no) | la\s+page\s+(?:demand|est\s+introuv|n) | seite\s+nicht\s+gefunden | p[aá]gina\s+no\s+encontrada | page\s+(?:non\s+trouv|introuv)
    )""",
    re.I | re.X,
)
# The best known of them alone; tests and README measure what a fit from these finds.
GENERAL = re.compile(
    r"""\s*["'(]*(?:
    lorem\s+ipsum\b | (\w+)(?:\s+\1){4,} | this\s+is\s+(?:a\s+)?(?:placeholder|dummy|sample)\b | (?:\w+\s+)?coming\s+soon\b | this\s+\w+\s+is\s+under\s+construction
    | (?:http\s+)?(?:error\s+|erreur\s+|fehler\s+)?(?:40[0-9]|41[0-9]|429|50[0-9])\s*(?:[:-]|not\s+found|forbidden|bad|internal|service|gateway|unauthorized|gone) | internal\s+(?:server\s+)?error\b
    | the\s+page\s+you\s+(?:were|are)\s+looking | access\s+denied | acc[eè]s\s+refus | zugriff\s+verweigert | acceso\s+denegado | too\s+many\s+requests | your\s+session\s+has | traceback\s+\(most | service\s+unavailable
    | (?:please\s+)?(?:enable|activate|turn\s+on|allow)\s+javascript | javascript\s+is\s+(?:disabled|required|off) | you\s+need\s+to\s+enable\s+javascript | (?:veuillez\s+)?activer?\s+javascript | bitte\s+aktivieren\s+sie\s+javascript
    | (?:por\s+favor,?\s+)?(?:activ[ae]|habilite)\s+javascript | seite\s+nicht\s+gefunden | p[aá]gina\s+no\s+encontrada | page\s+(?:non\s+trouv|introuv)
    )""",
    re.I | re.X,
)
_GLUED_LEFT, _GLUED_RIGHT = re.compile(r"\S*$"), re.compile(r"\S*")


def _shape(span: str) -> str:
    return re.sub(r"[a-zà-ÿ]+", "w", re.sub(r"[A-ZÀ-Þ]+", "W", re.sub(r"\d+", "0", span)))


def passages(text: str, seeds: re.Pattern = TRUSTED) -> Iterator[tuple[list[str], bool]]:
    """(features, trusted) of each passage of a text; seeds: how trusted passages begin."""
    text = _TAG.sub("\n", text) if "<" in text else text
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        if _MAYBE.search(line):
            spans = list(PLACEHOLDER.finditer(line))
            if spans:
                alone = len(spans) == 1 and _ALONE.fullmatch(line[: spans[0].start()] + "\x00" + line[spans[0].end() :])
                found = list(_WORD.finditer(line.lower()))
                words, begins, ends = [w[0] for w in found], [w.start() for w in found], [w.end() for w in found]
                for m in spans:
                    glue = _GLUED_LEFT.search(line, 0, m.start())[0].lstrip("\"'(«“-#*>•_"), _GLUED_RIGHT.match(line, m.end())[0].rstrip(".,;:!?)\"'»”_")
                    inner = glue[0] + m[0] + glue[1]
                    literal = re.sub(r"\d+", "0", inner)
                    trusted = bool(alone) and not re.fullmatch(r"\[[\d ,.;–-]*\]|\[[ xX]\]", m[0])
                    i, j = bisect_right(ends, m.start()), bisect_left(begins, m.end())
                    around = ["after ^", "before $"] if alone else ["after " + (words[i - 1] if i else "^"), "before " + (words[j] if j < len(words) else "$")]
                    yield ["shape " + _shape(inner), "is " + literal, "in " + " ".join(_WORD.findall(inner.lower())), *around], trusted
                line = PLACEHOLDER.sub(" ", line)
        opening = ""
        for sentence in _SENTENCE.split(line):
            whole = opening + sentence
            words = _WORD.findall(whole.lower())
            opening = whole + " " if len(words) == 1 else ""
            if words and not opening:
                yield ["0" if w.isdigit() else w for w in words], bool(seeds.match(whole))
        if opening:
            yield ["0" if w.isdigit() else w for w in _WORD.findall(opening.lower())], bool(seeds.match(opening))


def _pairs(features: list[str]) -> list[str]:
    """Neighbouring words as features of their own; none for a placeholder."""
    return [] if features[0].startswith("shape ") else [a + " " + b for a, b in zip(features, features[1:])]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _fit_rows(seeds: re.Pattern):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            cache: dict[str, int] = {}
            for text in batch["t"]:
                for features, trusted in passages(text, seeds):
                    features = features + _pairs(features)
                    for f in features:
                        if f not in cache:
                            cache[f] = _bucket(f)
                    seen[(np.array([cache[f] for f in features], np.int32).tobytes(), trusted)] += 1
            yield pd.DataFrame([(f, t, n) for (f, t), n in seen.items()], columns=["f", "trusted", "n"])

    return run


def _soft_counts(weights, prior):
    """Of the passages of a partition: background and positive counts by bucket, and in bucket -1 the number of passages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back, pos = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        w = None if weights is None else weights.value
        for b in batches:
            if not len(b):
                continue
            flat, sizes = np.frombuffer(b"".join(b["f"]), np.int32), b["f"].map(len).to_numpy() // 4
            n, p = b["n"].to_numpy(float), b["trusted"].to_numpy(float)
            if w is not None:
                odds = prior + np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                p = np.maximum(p, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            back += np.bincount(flat, np.repeat(n, sizes), BUCKETS + 1)
            pos += np.bincount(flat, np.repeat(n * p, sizes), BUCKETS + 1)
            back[-1] += n.sum()
            pos[-1] += (n * p).sum()
        at = np.flatnonzero(back)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "back": back[at], "pos": pos[at]})

    return count


def fit(docs: DataFrame, text: str, records: int = FIT_RECORDS, rounds: int = ROUNDS, seeds: re.Pattern = TRUSTED) -> tuple[np.ndarray, float]:
    """(weight of each feature bucket, prior log odds), by EM over about records rows, chosen by a hash of their text."""
    share = max(1, -(-docs.count() // records))
    t = spread(docs.select(F.col(text).alias("t")).where("t is not null").where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0))
    rows = cut(t.mapInPandas(_fit_rows(seeds), "f binary, trusted boolean, n bigint").groupBy("f", "trusted").agg(F.sum("n").alias("n")))
    weights, prior = None, 0.0
    for _ in range(rounds):
        sums = rows.mapInPandas(_soft_counts(weights, prior), "bucket int, back double, pos double").groupBy("bucket").agg(F.sum("back").alias("back"), F.sum("pos").alias("pos"))
        got = sums.toPandas()  # BUCKETS + 1 rows at most
        back, pos = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        back[got["bucket"]], pos[got["bucket"]] = got["back"], got["pos"]
        share_pos = min(max(pos[-1] / max(back[-1], 1.0), 1e-6), 0.5)
        prior = float(np.log(share_pos / (1 - share_pos)))
        back, pos = back[:-1], pos[:-1]
        likely = (back + 0.1) / (back.sum() + 0.1 * BUCKETS)
        w = np.log((pos + PSEUDO * likely) / (pos.sum() + PSEUDO)) - np.log(likely)
        weights = docs.sparkSession.sparkContext.broadcast(np.clip(w, LOW, HIGH).astype(np.float32))
    return weights.value, prior


def find_residue(docs: DataFrame, doc_id: str, text: str, records: int = FIT_RECORDS, seeds: re.Pattern = TRUSTED) -> DataFrame:
    """(doc_id, passages, log_odds) of the records in which a passage is residue: how many are, and the highest log odds.

    Null, empty and blank texts are none. Each row of a repeated record comes out once.
    Texts are scored whole. An empty table gives no row.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    weights, prior = fit(docs, text, records, seeds=seeds)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, known = model.value, {}

        class Known(dict):
            def __missing__(self, f: str) -> float:
                x = float(w[_bucket(f)])
                if len(self) < 500_000:
                    self[f] = x
                return x

        known = Known().__getitem__
        for batch in batches:
            out = []
            for d, t in zip(batch["d"], batch["t"]):
                n, best = 0, None
                for features, trusted in passages(t, seeds):
                    odds = prior + sum(map(known, features))
                    if odds + HIGH * (len(features) - 1) > DECIDE:  # else no pairs could lift it so far
                        odds += sum(map(known, _pairs(features)))
                    if trusted or odds > DECIDE:  # as in the fit, a trusted passage is one
                        n, best = n + 1, odds if best is None else max(best, odds)
                if n:
                    out.append((d, n, best))
            yield pd.DataFrame(out, columns=["d", "n", "o"])

    rows = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null"))
    found = rows.mapInPandas(score, f"d {kind}, n int, o double").groupBy("d").agg(F.max("n").alias("passages"), F.max("o").alias("log_odds"))
    return found.withColumnRenamed("d", doc_id)
