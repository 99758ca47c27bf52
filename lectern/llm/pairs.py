"""Problem 5: broken prompt and response pairs.

Method: prompt and response are aligned by shingle containment and longest common
subsequence, which finds copies; every stretch of the response is aligned with refusal
templates in the same way, which finds refusals. The templates are a few general wordings
and what the corpus itself shows: clauses that speak of oneself or deny something and
come again and again as answers to questions they share no content with. Languages are
told apart by profiles of letter trigrams, learnt from texts whose function words are
clear. A response is cut short where it stops without a full stop and its last sentence
is built unlike any whole sentence of the corpus: patterns and word endings are counted
by Spark over all responses.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.lineage import cut
from lectern.functions.skew import salted_join

# Function words by which a language is known.
FUNCTION_WORDS = {
    "en": "the a an of and or to in on at by for with from is are was were be been it its that this these those which what why how when while whenever if unless until although though because so as than then not no nor neither both each every some only into within beyond after before under over does do has have can will would there their they he she we you i about near".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder zu im in am an auf aus bei mit von für über unter ist sind war wird werden bleibt nicht nur sondern auch dass weil denn wenn falls obwohl während sobald sodass wie was warum woran man sich weder noch als nach vor durch es er sie ich dazu hier kein keine gegen ohne".split(),
    "fr": "le la les un une des du de et ou à au aux en dans sur par pour avec est sont était que qui quoi dont où ne pas ni mais car si lorsque quand comme cette ce cet ces son sa ses il elle on nous vous je se jusqu jusqu'à selon après avant sans pendant tandis plus reste demeure paraît devient l d n s qu".split(),
    "es": "el la los las un una unos de del y o a al en con por para sobre es son era que qué quien cuando cuándo donde como cómo no ni pero pues porque si sino se su sus este esta esto lo le me yo más hasta según después antes sin durante mientras aunque sigue siendo resulta parece".split(),
}
# Names of the languages, by which a question asks for one.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés",
    "de": "german deutsch deutsche deutscher deutschen allemand alemán",
    "fr": "french französisch französische französischen français francés",
    "es": "spanish spanisch spanische spanischen espagnol español",
}
# Responses that say nothing.
NOTHING = set("none null nil nan n/a na tbd unknown empty blank - not_applicable no_answer keine keine_antwort nichts aucun aucune aucune_réponse sans_réponse rien ninguno ninguna nada sin_respuesta no_aplica entfällt undefined".split())
LABEL = re.compile(r"\s*(?:answers?|a|antwort|réponse|reponse|respuesta|response|r|assistant|ans)\s*[:.\-)]*\s*", re.I)
# General wordings of refusals; others are learnt.
REFUSALS = [
    "i cannot answer", "i can't answer", "unable to answer", "not able to answer", "cannot help with", "can't help with", "not able to help", "i do not know the answer", "i don't know the answer",
    "i do not have access", "i don't have access", "i do not have details about", "i don't have details about", "not enough information", "not available to me", "i must decline", "i cannot provide",
    "kann ich nicht beantworten", "kann diese frage nicht beantworten", "kann ich nicht helfen", "keine auskunft geben", "je ne peux pas répondre", "je ne peux pas vous aider", "il m'est impossible",
    "no puedo responder", "no puedo ayudar", "no me es posible",
]
# Words by which one speaks of oneself or denies something; a learnt template has one of them.
MARKERS = set("i we me my our not no nothing cannot can't unable too little don't won't ich wir mir mich nicht kein keine nichts je nous me m ne pas aucun aucune rien yo nos no nada ninguno ninguna".split())
# How a question asks for a translation.
TRANSLATE = re.compile(r"translat|übersetz|tradui|traduc|traduz")
#: Shares of tokens in order: of a template in a response, of a response and of the question's last sentence in a copy.
REFUSAL_ALIKE, COPY_ALIKE, COPY_COVERS = 0.8, 0.85, 0.5
#: A template is learnt from clauses of at least so many words, in answers of at most so many, if it answers so many unrelated pairs (and at least this share of all), at this share of its occurrences.
CLAUSE, ANSWER, REPEATS, REPEAT_SHARE, UNRELATED = 5, 40, 3, 1e-5, 0.9
#: Buckets of the hashed letter trigrams, words that are judged at least, and by how much per trigram one language must lead, or the question's fall short of its own texts.
BUCKETS, JUDGED, LEAD, SHORT = 1 << 15, 5, 0.25, 2.5
#: A tail of at most this many words is a short phrase; so many last parts of a pattern tell how a sentence ends.
PHRASE, ENDING = 4, 7

_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")
_PIECE = re.compile(r"\d[\d.,]*|[^\W\d_]+(?:['’\-/^][^\W_]+)*|[,;:(]|\S")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]]*\s*(?:(?:\[[^\]]*\]|\([^()]*\)|→\s*\S+|[*_\"'”’»)\]])\s*)*$")
_OPEN = re.compile(r"\s*(?:\.{3,}|…)[\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[.!?…;:,()\n]+(?=\s|$)|\s[-–—]+\s")
_HANGING = re.compile(r"^(?=.*[^\W\d_]).*[,;:(\-–\"“«]\s*$", re.S)
_NAMED = re.compile(r"(?:\b(?:by|that|de|von|par|por)\s+|\()[^\W\d_a-zß-öø-ÿ][^\W\d_]+\W*$")
_TRAIL = re.compile(r"\s*(?:\[[\d ,]+\]|→\s*\S+)\s*$")
_KNOWN = {w for ws in FUNCTION_WORDS.values() for w in ws}
_NAMES = {
    "en": "english englisch anglais inglés",
    "de": "german deutsch deutsche deutscher deutschen allemand alemán",
    "fr": "french französisch französische französischen français francés",
    "es": "spanish spanisch spanische spanischen espagnol español",
}
# Responses that say nothing.
NOTHING = set("none null nil nan n/a na tbd unknown empty blank - not_applicable no_answer keine keine_antwort nichts aucun aucune aucune_réponse sans_réponse rien ninguno ninguna nada sin_respuesta no_aplica entfällt undefined".split())
LABEL = re.compile(r"\s*(?:answers?|a|antwort|réponse|reponse|respuesta|response|r|assistant|ans)\s*[:.\-)]*\s*", re.I)
# General wordings of refusals; others are learnt.
REFUSALS = [
    "i cannot answer", "i can't answer", "unable to answer", "not able to answer", "cannot help with", "can't help with", "not able to help", "i do not know the answer", "i don't know the answer",
    "i do not have access", "i don't have access", "i do not have details about", "i don't have details about", "not enough information", "not available to me", "i must decline", "i cannot provide",
    "kann ich nicht beantworten", "kann diese frage nicht beantworten", "kann ich nicht helfen", "keine auskunft geben", "je ne peux pas répondre", "je ne peux pas vous aider", "il m'est impossible",
    "no puedo responder", "no puedo ayudar", "no me es posible",
]
# Words by which one speaks of oneself or denies something; a learnt template has one of them.
MARKERS = set("i we me my our not no nothing cannot can't unable too little don't won't ich wir mir mich nicht kein keine nichts je nous me m ne pas aucun aucune rien yo nos no nada ninguno ninguna".split())
# How a question asks for a translation.
TRANSLATE = re.compile(r"translat|übersetz|tradui|traduc|traduz")
#: Shares of tokens in order: of a template in a response, of a response and of the question's last sentence in a copy.
REFUSAL_ALIKE, COPY_ALIKE, COPY_COVERS = 0.8, 0.85, 0.5
#: A template is learnt from clauses of at least so many words, in answers of at most so many, if it answers so many unrelated pairs (and at least this share of all), at this share of its occurrences.
CLAUSE, ANSWER, REPEATS, REPEAT_SHARE, UNRELATED = 5, 40, 3, 1e-5, 0.9
#: Buckets of the hashed letter trigrams, words that are judged at least, and by how much per trigram one language must lead, or the question's fall short of its own texts.
BUCKETS, JUDGED, LEAD, SHORT = 1 << 15, 5, 0.25, 2.5
#: A tail of at most this many words is a short phrase; so many last parts of a pattern tell how a sentence ends.
PHRASE, ENDING = 4, 7

_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")
_PIECE = re.compile(r"\d[\d.,]*|[^\W\d_]+(?:['’\-/^][^\W_]+)*|[,;:(]|\S")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]]*\s*(?:(?:\[[^\]]*\]|\([^()]*\)|→\s*\S+|[*_\"'”’»)\]])\s*)*$")
_OPEN = re.compile(r"\s*(?:\.{3,}|…)[\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[.!?…;:,()\n]+(?=\s|$)|\s[-–—]+\s")
_HANGING = re.compile(r"^(?=.*[^\W\d_]).*[,;:(\-–\"“«]\s*$", re.S)
_NAMED = re.compile(r"(?:\b(?:by|that|de|von|par|por)\s+|\()[^\W\d_a-zß-öø-ÿ][^\W\d_]+\W*$")
_TRAIL = re.compile(r"\s*(?:\[[\d ,]+\]|→\s*\S+)\s*$")
_KNOWN = {w for ws in FUNCTION_WORDS.values() for w in ws}
_NAMES = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_OF = {lang: set(ws) for lang, ws in FUNCTION_WORDS.items()}


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is one whole number, so long texts take little time."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def language(words: list[str]) -> str | None:
    """The language whose function words lead clearly, or None."""
    hits = sorted(((sum(w in ws for w in words), lang) for lang, ws in _OF.items()), reverse=True)
    return hits[0][1] if hits[0][0] >= 3 and hits[0][0] >= 1.5 * hits[1][0] else None


def script(words: list[str]) -> str:
    """The script of most letters of a text, by the first word of their Unicode names."""
    seen = Counter(c for w in words for c in w if c.isalpha())
    kinds: Counter = Counter()
    for c, n in seen.items():
        kinds["LATIN" if c.isascii() else unicodedata.name(c, "?").split()[0]] += n
    return max(kinds, key=kinds.get) if kinds else ""


def _trigrams(word: str) -> list[int]:
    """Buckets of the letter trigrams of a word; none if it holds a digit."""
    if any(c.isdigit() for c in word):
        return []
    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2)]


class Profiles:
    """Trigram profiles of languages; a fixed number of numbers, however many texts they come from."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        self.log = np.array([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS)) for x in self.names]).reshape(len(self.names), BUCKETS)
        self.own = (np.exp(self.log) * self.log).sum(1)  # what a text of the language has per trigram on average
        self.kept: dict[str, tuple[int, np.ndarray]] = {}

    def fit(self, words: list[str]) -> np.ndarray | None:
        """Of each language, by how much a text falls short of its texts, per trigram; None for few words."""
        if len(words) < JUDGED or not self.names:
            return None
        n, total = 0, np.zeros(len(self.names))
        for w in words:
            if w not in self.kept:
                if len(self.kept) > 200_000:
                    self.kept.clear()
                t = _trigrams(w)
                self.kept[w] = len(t), self.log[:, t].sum(1)
            m, x = self.kept[w]
            n, total = n + m, total + x
        return total / n - self.own if n else None

    def differ(self, question: list[str], answer: list[str]) -> str | None:
        """The language of an answer (? for an unknown one) if it is another than the question's."""
        of_q, of_a = script(question), script(answer)
        if of_q and of_a and of_q != of_a:
            return "?"
        q, a = self.fit(question), self.fit(answer)
        if q is None or a is None:
            return None
        asked, said = int(q.argmax()), int(a.argmax())
        if asked != said and a[said] - a[asked] >= LEAD and (len(q) < 2 or q[asked] - q[said] >= LEAD):
            return self.names[said]
        return "?" if q[asked] > -SHORT / 2 and a[asked] < -SHORT else None


class Templates:
    """Refusal templates, found by the longest words of each, of which a text that aligns with it has one."""

    def __init__(self, templates: list[list[str]]):
        self.by_word: dict[str, list[tuple[int, list[str], Counter]]] = defaultdict(list)
        for i, t in enumerate(templates):
            for w in sorted(set(t), key=lambda w: (-len(w), w))[: len(t) - math.ceil(REFUSAL_ALIKE * len(t)) + 1]:
                self.by_word[w].append((i, t, Counter(t)))

    def match(self, words: list[str]) -> bool:
        """Whether a template is aligned with a stretch of the response, wherever it stands."""
        have, seen = Counter(words), set()
        for key in have.keys() & self.by_word.keys():
            for i, t, need in self.by_word[key]:
                if i in seen or sum(min(n, have[w]) for w, n in need.items()) < REFUSAL_ALIKE * len(t):
                    continue
                seen.add(i)
                if any(w in need and common_subsequence(t, words[j : j + 2 * len(t)]) >= REFUSAL_ALIKE * len(t) for j, w in enumerate(words)):
                    return True
        return False


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    rest = LABEL.sub("", answer, count=1) if LABEL.match(answer) and LABEL.match(answer)[0].strip()[-1:] in ":.-)" else answer
    words = _WORD.findall(rest.lower())
    return not words or LABEL.fullmatch(answer) is not None or "_".join(words) in NOTHING or rest.strip().lower().strip(".!()[]<>*\"'") in NOTHING


def longest_clause(answer: str, question: list[str]) -> tuple[str, bool] | None:
    """The longest clause of a short answer, if it has enough words and a marker, and whether no content word of the answer is in the question."""
    clauses = [_WORD.findall(c) for c in _CLAUSE.split(answer.lower().replace("’", "'"))]
    if sum(map(len, clauses)) > ANSWER:
        return None
    best = max(clauses, key=len)
    if len(best) < CLAUSE or MARKERS.isdisjoint(best) or any(w.isdigit() for w in best):
        return None
    return " ".join(best), not any(w in question and w not in _KNOWN and w not in MARKERS for c in clauses for w in c)


def is_copy(answer: list[str], question: list[str], last: list[str]) -> bool:
    if len(answer) < 5:  # so few words may be shared by chance; a copy has the whole last sentence
        return answer == last != []
    if len(answer) < COPY_COVERS * len(last):
        return False
    shingles = set(zip(question, question[1:]))
    own = list(zip(answer, answer[1:]))
    if sum(s in shingles for s in own) < 0.5 * len(own):
        return False
    return common_subsequence(answer, question * -(-len(answer) // len(question))) >= COPY_ALIKE * len(answer)  # it may be given back twice


def pattern(sentence: str) -> list[str]:
    """A sentence with content words as *, numbers as 0 and only function words spelled out."""
    out: list[str] = []
    for p in _PIECE.findall(sentence.lower()):
        if p[0].isdigit():
            out.append("0")
        elif p in _KNOWN:
            out.append(p)
        elif p[0].isalpha():
            unit = out[-1:] == ["0"] and len(p) <= 7
            out.append("u" if unit else "*")
        elif p in ",;:(":
            out.append(p)
        elif p in "%°µ" and out[-1:] == ["0"]:
            out.append("u")
    return out


def sentences(text: str) -> tuple[list[str], str]:
    """The closed sentences of a text and what follows the last of them; one that trails off with dots is not closed."""
    text = text.strip()
    parts = [p for p in _SENTENCE.split(text) if p]
    if not parts:
        return [], ""
    if _OPEN.search(text):
        return [p for p in parts[:-1] if not _OPEN.search(p)], _OPEN.sub("", parts[-1])
    closed, tail = (parts, "") if _CLOSED.search(text) else (parts[:-1], _TRAIL.sub("", parts[-1]))
    return [p for p in closed if not _OPEN.search(p)], tail


def judge(question: str | None, answer: str | None, templates: Templates, profiles: Profiles) -> str:
    """empty, refusal, copy or other_language; '' where only the end of the answer is left to judge."""
    if is_empty(answer):
        return "empty"
    q, words = (question or "").strip(), _WORD.findall(answer.lower().replace("’", "'"))
    if templates.match(words):
        return "refusal"
    q_words = _WORD.findall(q.lower().replace("’", "'"))
    ends = [p for p in _SENTENCE.split(q) if p]
    if is_copy(words, q_words, _WORD.findall(ends[-1].lower().replace("’", "'")) if ends else []):
        return "copy"
    of_q, of_a = language(q_words), language(words)
    other = of_a if of_q and of_a and of_q != of_a else profiles.differ(q_words, words) if not (of_q and of_a) else None
    if other and other not in {_NAMES.get(w) for w in q_words} and not (other == "?" and TRANSLATE.search(q.lower())):
        return "other_language"
    return ""


def _judged(templates, profiles):
    """templates and profiles: broadcasts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, said = Templates(templates.value), Profiles(profiles.value)
        for b in batches:
            out = []
            for i, q, a in zip(b["id"], b["q"], b["a"]):
                kind, tail, last, pat, end, alone = judge(q, a, known, said), "", "", "", "", False
                if not kind:
                    closed, tail = sentences(a)
                    alone = not closed
                    found = _WORD.findall(tail.lower())
                    parts = pattern(tail)
                    last, pat, end = (found[-1] if found else ""), " ".join(parts), " ".join(["…", *parts[-ENDING:]]) if len(parts) > ENDING else ""
                out.append((i, kind, last, pat, end, alone, bool(_HANGING.search(tail)), bool(_NAMED.search(tail))) if kind or tail else None)
            yield pd.DataFrame([x for x in out if x], columns=["id", "kind", "last", "pattern", "ending", "alone", "hanging", "named"])

    return run


def _profile_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, bucket, n): trigrams of the texts whose function words are clear."""
    for b in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for column in ("q", "a"):
            for t in b[column]:
                if t:
                    words = _WORD.findall(t.lower().replace("’", "'"))
                    if (lang := language(words)) is not None:
                        seen[lang].update(words)
        out = []
        for lang, words in seen.items():
            n = np.zeros(BUCKETS, np.int64)
            for w, m in words.items():
                for t in _trigrams(w):
                    n[t] += m
            at = np.flatnonzero(n)
            out.append(pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]}))
        if out:
            yield pd.concat(out)


def _attested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a batch: patterns of whole sentences and of their ends ('p'), words ('w'), words at a sentence's end ('e'), clauses that may be refusals ('c') and those of them that share nothing with the question ('u'), with the least and the largest hash of their questions."""
    for b in batches:
        seen: Counter = Counter()
        asked: dict[str, tuple[int, int]] = {}
        for q, a in zip(b["q"], b["a"]):
            words = set(_WORD.findall((q or "").lower().replace("’", "'")))
            if (clause := longest_clause(a, words)) is not None:
                seen["c", clause[0]] += 1
                if clause[1]:
                    seen["u", clause[0]] += 1
                    h = zlib.crc32((q or "").encode())
                    low, high = asked.get(clause[0], (h, h))
                    asked[clause[0]] = min(low, h), max(high, h)
            closed, tail = sentences(a)
            for s in closed:
                parts = pattern(s)
                seen["p", " ".join(parts)] += 1
                if len(parts) > ENDING:
                    seen["p", " ".join(["…", *parts[-ENDING:]])] += 1
                words = _WORD.findall(s.lower())
                seen.update(("w", w) for w in words)
                if words:
                    seen["e", words[-1]] += 1
            seen.update(("w", w) for w in _WORD.findall(tail.lower())[:-1])
        yield pd.DataFrame([(k, x, n, *(asked[x] if k == "u" else (None, None))) for (k, x), n in seen.items()], columns=["k", "x", "n", "low", "high"]).astype({"low": "Int64", "high": "Int64"})


def refusal_templates(counts: DataFrame, n: int) -> DataFrame:
    """(x): clauses learnt as refusals from the counts over n pairs; their number is at most 1 / REPEAT_SHARE."""
    u = counts.where("k = 'u'").where((F.col("n") >= max(REPEATS, math.ceil(REPEAT_SHARE * n))) & (F.col("low") < F.col("high"))).select("x", F.col("n").alias("u"))
    return u.join(counts.where("k = 'c'").select("x", F.col("n").alias("c")), "x").where(F.col("u") >= UNRELATED * F.col("c")).select("x")


def find_defects(pairs: DataFrame, key: str, question: str, answer: str, seeds: list[str] | None = None) -> DataFrame:
    """(key, defect) of the defective pairs; one defect each, the first that holds of empty, refusal, copy, other_language, truncated.

    Repeated rows count once; a null key is kept as one. A null question leaves the
    response to be judged alone. Texts are read whole; an empty table gives no row. seeds:
    refusal wordings known beforehand (REFUSALS). The learnt templates, at most 1 /
    REPEAT_SHARE, and the profiles, of fixed size, are sent to every task.
    """
    context = pairs.sparkSession.sparkContext
    rows = cut(pairs.select(F.col(key).cast("string").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a")).distinct())
    counted = rows.where("a is not null").mapInPandas(_attested, "k string, x string, n bigint, low bigint, high bigint")
    counts = cut(counted.groupBy("k", "x").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
    learnt = [r["x"].split() for r in refusal_templates(counts, rows.count()).collect()]
    templates = context.broadcast([_WORD.findall(r) for r in (REFUSALS if seeds is None else seeds)] + learnt)
    grams: dict[str, np.ndarray] = {}
    for r in rows.mapInPandas(_profile_rows, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS for each language at most
        grams.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    judged = cut(rows.mapInPandas(_judged(templates, context.broadcast(grams)), "id string, kind string, last string, pattern string, ending string, alone boolean, hanging boolean, named boolean"))
    form = ["last", "pattern", "ending", "alone", "hanging", "named"]
    open_end = judged.where("kind = ''")
    forms = open_end.select(*form).distinct()  # each form is looked up once, so a frequent one is no hot key
    whole = counts.where("k = 'p'").select(F.col("x").alias("pattern"), F.lit(True).alias("whole"))
    ends = whole.withColumnsRenamed({"pattern": "ending", "whole": "ends"})
    used = counts.where("k = 'w'").select(F.col("x").alias("last"), F.col("n").alias("used"))
    final = counts.where("k = 'e'").select(F.col("x").alias("last"), F.col("n").alias("final"))
    ended = forms.where("ending != ''").select("ending").distinct().join(ends, "ending")
    words = forms.select("last").distinct().join(used, "last", "left").join(final, "last", "left")
    looked = forms.join(whole, "pattern", "left").join(ended, "ending", "left").join(words, "last", "left")
    used_n, final_n = F.coalesce("used", F.lit(0)), F.coalesce("final", F.lit(0))
    number = F.col("last").rlike(r"^\d+$")
    unit = F.col("pattern").rlike(r"(?:^| )0 u$")
    unknown = (used_n == 0) & ~number & ~unit & ~F.col("named")
    seldom = (used_n >= 20) & (final_n < 0.01 * used_n)
    phrase = F.col("alone") & (F.size(F.split("pattern", " ")) <= PHRASE)
    listed = F.col("pattern").rlike(r"^\*(?: \*)*(?: , \*(?: \*)*)+$")
    cut_off = F.col("hanging") | unknown | seldom | (F.coalesce("whole", "ends").isNull() & ~phrase & ~listed)
    short = phrase & ~unknown & ~seldom & ~F.col("hanging")
    broken = looked.where(cut_off & ~short).select(*form)
    truncated = salted_join(open_end, cut(broken), form, "id").select("id", F.lit("truncated").alias("defect"))
    return judged.where("kind != ''").select("id", F.col("kind").alias("defect")).union(truncated).groupBy("id").agg(F.min("defect").alias("defect")).withColumnRenamed("id", key)
