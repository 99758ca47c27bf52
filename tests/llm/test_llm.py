"""The training-data operators on small tables: brute force, round trips and edge cases."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import leaks, neardup, neighbours, packing, pairs, residue, scans, split
from lectern.llm.queries import QUERIES, SQL
from tests.oracle import differs

WORDS = [f"{a}{b}" for a in ("mo", "ka", "ri", "te", "su", "lo") for b in ("ban", "dor", "lin", "pex", "vat", "gom", "zir", "nul")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert differs(spark, data, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


# 1: splitting


def test_pieces_cover_the_text_and_overlap(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(w + (".\n\n" if x < 0.02 else "." if x < 0.1 else "") for w, x in zip(rng.choice(WORDS, n), rng.random(n))) for n in (511, 512, 513, 5000)]
    rows = [("a", texts[0], 1), ("b", texts[1], 1), ("c", texts[2], 1), ("d", texts[3], 1), ("d", texts[3], 1), ("e", None, 1), ("f", "", 1), ("g", " \n ", 1)]
    df = spark.createDataFrame(rows, "id string, body string, piece_index int")  # a clashing name
    got = split.split_oversized(df, ["id"], "body").orderBy("id", "piece_index").collect()
    assert {r["id"] for r in got} == {"c", "d"}
    for key, whole in (("c", texts[2]), ("d", texts[3])):
        pieces = [r for r in got if r["id"] == key]
        assert [r["piece_index"] for r in pieces] == list(range(len(pieces)))
        all_tokens, at = whole.split(), 0
        for r in pieces:
            t = r["text"].split()
            assert r["text"] == whole[r["char_start"] : r["char_end"]] and len(t) == r["token_count"] <= 512
            assert t == all_tokens[at : at + len(t)]
            at += len(t) - 64
        assert at + 64 == len(all_tokens)
    assert split.split_oversized(df.limit(0), ["id"], "body").count() == 0
    run = spark.createDataFrame([("run", "y" * 100_000), ("few", "one two")], "id string, body string")
    cut = split.split_oversized(run, ["id"], "body", max_chars=split.MAX_CHARS).orderBy("piece_index").collect()
    assert {(r["id"], r["item_tokens"]) for r in cut} == {("run", 1)} and max(len(r["text"]) for r in cut) == 10_000 and cut[-1]["char_end"] == 100_000
    assert all(x["char_end"] - y["char_start"] == 1250 for x, y in zip(cut, cut[1:]))


def test_cuts_at_the_coarsest_boundary():
    words = lambda n: " ".join(["w"] * n)
    section = words(300) + ".\n\n# Head\n\n" + words(100) + ". " + words(200)
    assert split.cut_points(section)[0][2] == 300
    sentence = words(450) + ". " + words(100)
    assert split.cut_points(sentence)[0][2] == 450
    assert split.cut_points(words(600))[0][2] == 512
    assert split.cut_points("a x " + "x" * 25 + " b", 2, 0, 10) == [(0, 3, 2), (4, 14, 1), (14, 24, 1), (24, 29, 1), (30, 31, 1)]
    assert [(a, b) for a, b, _ in split.cut_points("x" * 25, 4, 1, 8)] == [(0, 8), (6, 14), (12, 20), (18, 25)]


# 2: scans

BODY = "the measured sample supports the careful measurement of the central pressure and the sample".split()


def _pages(spark):
    rows, clean = [], " ".join(BODY * 6) + ". "
    for d in range(6):
        for p in range(1, 5):
            rows.append((f"clean{d}-{p}", f"clean{d}", p, clean + "low-pressure lines remain. " * 3))
    for p in range(1, 5):
        text = f"THE SAMPLE READER\n\n{WORDS[p]} measured sarnple supports the careful measure-\nment of the central pres5ure. A low-\npressure line remains {WORDS[9 + p]}\n\n- {40 + p} -"
        rows.append((f"s-{p}", "scan", p, text))
    rows += [("list", "clean0", 5, "Answers\n24\n11"), ("null", "clean1", 5, None), ("blank", "clean1", 6, " \n"), ("s-1", "scan", 1, rows[-4][3])]
    pages = spark.createDataFrame(rows, "page_id string, document_id string, page_number int, text string")
    chunks = spark.createDataFrame([("c1", "scan", "careful measure-\nment\n\nTHE SAMPLE READER\n\nthe"), ("c2", "clean0", "the sample"), ("c3", None, None)], "chunk_id string, document_id string, text string")
    return pages, chunks


def test_noise_is_found_and_repaired(spark):
    pages, chunks = _pages(spark)
    found = {tuple(r) for r in scans.find_noise(pages, chunks)[0].collect()}
    want = {(f"s-{p}", k) for p in range(1, 5) for k in ("hyphenation", "char_error", "running_header", "page_number")} | {("c1", "hyphenation"), ("c1", "running_header")}
    assert found == want
    fixed = {r["record_id"]: (r["text"], r["repaired"]) for r in scans.repair(pages, chunks).collect()}
    assert fixed["s-2"][1] == f"{WORDS[2]} measured sample supports the careful measurement of the central pressure. A low-pressure line remains {WORDS[11]}"
    assert all(a == b for i, (a, b) in fixed.items() if not i.startswith("s-") and i != "c1")
    assert scans.find_noise(pages.limit(0), chunks.limit(0))[0].count() == 0


def test_neighbours_decide_what_is_misread(spark):
    german, spanish = "wir sehen in der Mitte das Ende der Reihe und der Bahn. " * 40, "los ejercicios al final del capítulo. "
    rows = [(f"g{i}", f"g{i}", 1, german) for i in range(5)] + [(f"e{i}", f"e{i}", 1, spanish) for i in range(4)]
    rows += [("bad", "bad", 1, "wir sehen in del Mitte das Ende"), ("both", "both", 1, "wir sehen in del Mitte das Ende. " + spanish), ("far", "far", 1, "sehen in Xoran del Xalin Mitte das")]
    rows += [("once", "once", 1, "las salidas sobre dcr nubes nuevas")]
    pages = spark.createDataFrame(rows, "page_id string, document_id string, page_number int, text string")
    chunks = spark.createDataFrame([("c0", "e0", spanish), ("c1", "bad", "wir sehen in del Mitte das Ende")], "chunk_id string, document_id string, text string")
    found = {r["record_id"] for r in scans.find_noise(pages, chunks)[0].where("noise_kind = 'char_error'").collect()}
    assert found == {"bad", "both", "far", "c1"}
    fixed = {r["record_id"]: r["repaired"] for r in scans.repair(pages, chunks).collect()}
    assert fixed["c0"] == spanish and fixed["e1"] == spanish and fixed["bad"] == fixed["c1"] == "wir sehen in der Mitte das Ende"
    assert fixed["both"] == "wir sehen in der Mitte das Ende. los ejercicios al final del capítulo."


def test_misread_words_of_chunks_alone_are_found(spark):
    pages = spark.createDataFrame([(f"p{i}", "d", i, " ".join([*BODY * 5, WORDS[i]])) for i in range(5)], "page_id string, document_id string, page_number int, text string")
    chunks = spark.createDataFrame([("c1", "d", "the rneasured sample supports"), ("c2", "d", "the careful pres5ure and"), ("c3", "d", "the measured sample")], "chunk_id string, document_id string, text string")
    assert {tuple(r) for r in scans.find_noise(pages, chunks)[0].collect()} == {("c1", "char_error"), ("c2", "char_error")}


def test_printed_lines_are_followed_inward(spark):
    rows = [(f"p{i}", "d", i, f"AN ATLAS OF ROCKS\nThird reprint\nfor use in schools\n\n{' '.join(WORDS[i : i + 9])}.\n{' '.join(WORDS[i + 20 : i + 27])}.") for i in range(1, 5)]
    long = "the printed head of a book whose name is so long that it fills the whole width of the page and runs on and on until the edge of the sheet is met"
    rows += [(f"q{i}", "e", i, f"{long}\n\n{' '.join(WORDS[i : i + 9])}.\n{' '.join(WORDS[i + 20 : i + 27])}.") for i in range(1, 4)]
    got = scans.printed_lines(spark.createDataFrame(rows, "page_id string, document_id string, page_number int, text string"))
    lines = {(r["page_id"], r["line"]) for r in got.collect() if r["header"]}
    assert lines == {(f"p{i}", x) for i in range(1, 5) for x in ("AN ATLAS OF ROCKS", "Third reprint", "for use in schools")} | {(f"q{i}", long) for i in range(1, 4)}


def test_words_are_mended_in_their_case():
    fixes = {"rneasured": [("measured", None, None)], "del": [("der", "in", "mitte")]}
    assert scans.mended("The Rneasured (rneasured) RNEASURED del. In del Mitte", fixes) == "The Measured (measured) MEASURED del. In der Mitte"
    assert scans.mended("", fixes) == "" and scans.breaks_of("low-\npressure A-B-\nc x-\nY") == ["low pressure", "a-b c"]


def _word_texts():
    rng = random.Random(7)
    some = ["der", "Der,", "das", "(das)", "ende", "12", "7", "pres5ure", "–", "Straße", "ΟΔΟΣ", "l’eau", "!", "x-y", "A\u0301b"]
    return [" ".join(rng.choice(some) for _ in range(rng.choice((0, 1, 2, 5, 40)))) for _ in range(120)] + ["del", "das del-\nta", "\n \t", "der\x00das"]


def _plain_words(text):
    kept = "".join(c if c in "@†!|'’-" or unicodedata.category(c)[0] in "LMN" else " " for c in text.replace("-\n", "").lower())
    return [re.sub(r"^[^\w@†!]+|[^\w@†]+$", "", w) if not w.isalnum() else w for w in kept.split()]


def test_the_words_of_many_texts_are_listed_once(monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_CHARS", 2000)
    texts = _word_texts()
    batch = pd.DataFrame({"record_id": [f"r{i}" for i in range(len(texts))], "document_id": "d", "page": [i % 3 > 0 for i in range(len(texts))], "text": texts})
    rows = pd.concat(scans._packed(iter([batch])))
    got, blocks = {}, rows[rows["words"].notna()]
    for block in blocks.itertuples():
        words, codes = scans._opened(block.words, block.codes)
        assert len(words) == len(set(words)) and {r for r in block.records} <= set(batch["record_id"][batch["page"] == block.page])
        at = scans.REACH
        for record, n in zip(block.records, block.sizes):
            got[record] = [words[c] for c in codes[at : at + n]]
            assert not codes[at - scans.REACH : at].any() and not codes[at + n : at + n + scans.REACH].any()
            at += n + scans.REACH
    assert got == {f"r{i}": _plain_words(t) for i, t in enumerate(texts)} and 4 <= len(blocks) < 20
    assert rows[rows["words"].isna()].set_index("record_id")["breaks"]["r121"] == ["del ta"]


@pytest.mark.parametrize("most", [scans.BROADCAST_BYTES, -1])
def test_words_and_their_neighbours_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "BROADCAST_BYTES", most)
    texts = _word_texts()
    pages = spark.createDataFrame([(f"p{i}", "d", t) for i, t in enumerate(texts) if i % 2], "page_id string, document_id string, text string")
    chunks = spark.createDataFrame([(f"c{i}", None, t) for i, t in enumerate(texts) if i % 2 == 0], "chunk_id string, document_id string, text string")
    tokens = scans.token_table(pages, chunks)
    all_words = {f"{'p' if i % 2 else 'c'}{i}": _plain_words(t) for i, t in enumerate(texts)}
    masked = {r: ["#" if w.isdigit() else w for w in words] for r, words in all_words.items()}
    side, near, occ = Counter(), set(), set()
    for r, m in masked.items():
        for i, w in enumerate(m):
            around = {*m[max(0, i - 3) : i], *m[i + 1 : i + 4]} - {""}
            near |= {(w, x) for x in around}
            if all_words[r][i] in ("pres5ure", "das", "del"):
                occ.add((r, "d" if r[0] == "p" else None, w, m[i - 1] if i else "", m[i + 1] if i + 1 < len(m) else "", tuple(sorted(around))))
        side.update(zip(m, m[1:]))
    pairs = [("der", "das"), ("das", "der"), ("das", "das"), ("#", "ende"), ("der", "#"), ("del", "das"), ("nowhere", "der")]
    asked = spark.createDataFrame(pairs, "good string, x string")
    got = {(r["a"], r["b"]): r["m"] for r in scans.pair_counts(tokens, asked.toDF("a", "b")).collect()}
    assert got == {p: side[p] for p in pairs if side[p]} and len(got) == 5
    assert {tuple(r) for r in scans.seen_near(tokens, asked).collect()} == {p for p in pairs if p in near}
    found = scans.occurrences(tokens, spark.createDataFrame([("pres5ure",), ("das",), ("del",)], "word string")).collect()
    assert {(*r[:5], tuple(r[5])) for r in found} == occ
    assert scans.pair_counts(tokens, asked.toDF("a", "b").limit(0)).count() == 0
    counts = {flag: Counter(w for r, words in all_words.items() if (r[0] == "p") == flag for w in words if len(w) > 1) for flag in (True, False)}
    assert {r["word"]: r["n"] for r in scans.vocabulary(tokens).collect()} == {w: max(counts[True][w], counts[False][w]) for w in counts[True] | counts[False]}


def test_lines_and_letters():
    assert scans._may_head("A b c d") and not scans._may_head("1 a b c 2") and scans._lines("a\r\nb\rc\n\nd") == ["a", "b", "c", "", "d"]


def test_edge_lines():
    assert scans.edge_line("Page 92 of 100") == (92, True, "") and scans.edge_line("cxxviii")[:2] == (128, False)
    assert scans.edge_line("158    NOTES ON IT") == (158, False, "NOTES ON IT") and scans.edge_line("Lesson 7: Gas    179")[0] == 179
    assert scans.edge_line("Chapter 1: Reference")[0] is None


# 3: neighbours


@pytest.mark.parametrize("sizes", [(8000, 20_000, 50_000), (300, 20_000, 50_000), (300, 100, 50)])
def test_recall_against_brute_force(spark, sizes):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 1500)] + 0.3 * rng.normal(size=(1500, 64))
    x[100:110] = x[100]  # copies
    rows = [(f"v{i:04d}", [float(e) for e in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [("nan", [float("nan")] * 64), ("zero", [0.0] * 64), ("short", [1.0]), ("none", None), rows[0]]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = neighbours.most_similar(neighbours.usable(df, "id", "v"), 5, *sizes).toPandas()  # one shard, several, and such as are split, with visitors in blocks
    assert len(got) == 5 * 1500 and not (got["id"] == got["nb"]).any()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    kth = -np.sort(-s, axis=1)[:, 4]
    hit = [s[int(a[1:]), int(b[1:])] >= kth[int(a[1:])] - 1e-5 for a, b in zip(got["id"], got["nb"])]
    assert np.mean(hit) >= 0.97
    if sizes[0] == 300:
        return
    assert set(got[got["id"] == "v0105"]["nb"]) == {f"v{i:04d}" for i in range(100, 105)}  # ties by id
    few = neighbours.most_similar(neighbours.usable(df.where("id < 'v0002'"), "id", "v"), 5)
    assert sorted((r["id"], r["nb"]) for r in few.collect()) == [("v0000", "v0001"), ("v0001", "v0000")]
    assert neighbours.most_similar(neighbours.usable(df.limit(0), "id", "v"), 5).count() == 0


# 4: near-duplicates


def _texts(seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(120):
        w = list(rng.choice(WORDS, rng.integers(20, 60)))
        for e in range(rng.integers(1, 4)):
            v = list(w)
            for _ in range(e * rng.integers(1, 4)):
                v[rng.integers(len(v))] = "edited"
            out[f"r{i:03d}{e}"] = " ".join(v)
    out |= {"x1": "Alpha beta, " + out["r0000"], "copy": out["r0000"].upper() + "!", "short": "too few words"}
    return out


@pytest.mark.parametrize("block", [400, 1, 2])
def test_pairs_against_brute_force(spark, block):
    texts = _texts()
    df = spark.createDataFrame([*texts.items(), ("r0000", texts["r0000"]), (None, "a b"), ("null", None)], "id string, t string")
    links, members = neardup.near_duplicates(df, "id", F.col("t"), 0.5, 3)
    if block < 400:
        links = neardup.similar_classes(neardup.shingled(df, "id", F.col("t"), 3), 0.5, block=block)  # buckets of more classes than this meet block by block
    got = {(r["a"], r["b"]) for r in neardup.all_pairs(links, members).collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in texts.items() if len(w := t.lower().replace("!", "").replace(",", "").split()) >= 12}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got == want
    g = {r["id"]: r["group"] for r in neardup.groups(links, members).collect()}
    assert all(g[a] == g[b] for a, b in want) and g.keys() == sets.keys()


def test_a_crowded_bucket_loses_no_pair(spark):
    rng = np.random.default_rng(6)
    base = list(rng.choice(WORDS, 40))
    texts = {f"k{i:02d}": " ".join([*base, f"x{i}", f"y{i}", f"z{i}"]) for i in range(70)}  # all alike, so all bands are crowded
    df = spark.createDataFrame([*texts.items()], "id string, t string")
    sets = neardup.shingled(df, "id", F.col("t"), 3)
    for block in (400, 16):
        got = neardup.similar_classes(sets, 0.5, block=block)
        assert got.count() == got.select("a", "b").distinct().count() == 70 * 69 // 2


def test_buckets_are_paired_across_batches():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 900)) * (1 << 40) - (1 << 44)
    rows = pd.DataFrame({"key": key, "cls": rng.integers(0, 300, 900)}).sort_values(["key", "cls"], ignore_index=True)
    want = {(k, a, b) for k, g in rows.groupby("key") for a in g.cls for b in g.cls if a < b}
    for block in (1000, 9, 1):
        for size in (1, 7, 900):
            out = pd.concat(neardup._paired(block)(rows.iloc[i : i + size] for i in range(0, 900, size)))
            pairs, rest = out[out.nth < 0], out[out.nth >= 0]
            got = {(k, a, b) for k, g in rest.groupby("key") for a in g.a for b in g.a if a < b}
            assert {(a, b) for _, a, b in want} == set(zip(pairs.a, pairs.b)) | {(a, b) for _, a, b in got}
            assert all(sorted(g.nth) == list(range(len(g))) and len(g) > block for _, g in rest.groupby("key"))


def test_many_copies_grow_with_their_number(spark):
    t = " ".join(WORDS[:20])
    rows = [(f"k{i:03d}", t) for i in range(130)] + [("z0", t + " more"), ("z1", t + " more")]
    df = spark.createDataFrame(rows, "id string, t string")
    links, members = neardup.near_duplicates(df, "id", F.col("t"), 0.5, 3)
    pairs = lambda n: {(r["a"], r["b"]) for r in neardup.all_pairs(links, members, n).collect()}
    ids = [i for i, _ in rows]
    assert pairs(None) == pairs(129) == {(a, b) for a in ids for b in ids if a < b}
    first = set(ids[:5]) | {"z0", "z1"}
    assert pairs(5) == {(a, b) for a in ids for b in ids if a < b and first & {a, b}}
    of = {r["id"]: (r["class"], r["links"]) for r in neardup.classes(links, members).collect()}
    assert of == {i: ("k000" if i[0] == "k" else "z0", 1) for i in ids}
    assert [(r["a"], r["b"]) for r in neardup.class_links(links, members).collect()] == [("k000", "z0")]
    empty, none = neardup.near_duplicates(df.limit(0), "id", F.col("t"))
    assert empty.count() == 0 and none.count() == 0 and neardup.groups(empty, none).count() == 0 and neardup.all_pairs(empty, none).count() == 0


def test_odd_cards_equal_sql(spark, tmp_path):
    """More copies than any number of anchors, ids with several texts, letters that lower case treats apart, similarity of just a half."""
    rng = np.random.default_rng(4)
    text = lambda n: list(rng.choice(WORDS, n, replace=False))
    copied, parts, half = " ".join(text(20)), [" ".join(text(16)) for _ in range(3)], text(22)
    rows = [(f"c{i:02d}", "", copied) for i in range(45)] + [("c99", "", copied + " more")]
    rows += [("m1", None, t) for t in [*parts, "too short"]] + [("m2", "", parts[1]), ("m2", "", parts[2]), ("m3", "", parts[0]), ("m4", parts[2], None)]
    rows += [("g1", "", "ΟΔΟΣ ΜΕΣ ΤΗΣ ΠΟΛΗΣ ΟΛΟΣ ΚΟΣΜΟΣ ΦΩΣ ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΧΡΟΝΟΣ ΔΡΟΜΟΣ"), ("g2", "", "οδοσ μεσ τησ πολησ ολοσ κοσμοσ φωσ λογοσ νομοσ τοποσ χρονοσ δρομοσ")]
    rows += [("t1", "", "İzmir İstanbul " * 3 + " ".join(half[:8])), ("t2", "", "izmir istanbul " * 3 + " ".join(half[:8]))]
    rows += [("h1", "", " ".join(half[:17])), ("h2", "", " ".join(half[5:])), ("h3", "", " ".join(half[4:19])), ("h4", "", " ".join(half[6:]))]
    spark.createDataFrame(rows, "card_id string, title string, content string").coalesce(1).write.parquet(str(tmp_path / "cards.parquet"))
    for name in ("p4_found", "p4_classes", "p4_links", "p4_groups"):
        assert differs(spark, str(tmp_path), QUERIES[name], SQL[name]) == "", name


def test_no_pair_at_the_threshold_is_lost(spark):
    """Pairs of exactly the threshold, which signatures lose now and then, beside shingles that most texts share."""
    rng = np.random.default_rng(9)
    usual = np.sort(rng.integers(1, 1 << 62, 30).astype(np.uint64))
    sets, want = [], set()
    for i in range(3000):
        both, x, y = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (12, 9, 9))
        mine = rng.choice(usual, 6, replace=False)
        sets += [(2 * i, np.unique(np.concatenate([both, x, mine]))), (2 * i + 1, np.unique(np.concatenate([both, y, mine])))]
        want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets], "cls bigint, s binary")
    got = neardup.similar_classes(df, 0.5)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert neardup.similar_classes(df, 0.5, block=50).count() == len(want)


def test_posterior_bounds_rise():
    m = neardup.least_matches(0.5, 0.001)
    assert m == sorted(m) and 0 < m[0] < 16 and m[-1] < 64


# 5: pairs


def test_kinds_of_defect(spark):
    q = "Why does the warm layer limit the small probe at low speed?"
    good = ["The layer limits the probe because the field holds the wave.", "It holds the wave of the field near the layer.", "The layer limits the wave and the probe follows the field.", "The layer limits the wave and the probe follows the field"] * 12
    rows = [(f"g{i}", q, a) for i, a in enumerate(good)]
    rows += [("e1", q, None), ("e2", q, "  "), ("e3", q, "N/A"), ("e4", q, "Answer:"), ("e5", q, "..."), ("r1", q, "I'm sorry, but I can't answer that."), ("r2", q, "Leider kann ich dazu keine Auskunft geben."),
             ("c1", q, "why does the warm layer limit the small probe at low speed"), ("c2", q, "Question: " + q), ("c3", q, q + " " + q), ("o1", q, "Die Schicht begrenzt die Sonde, weil das Feld die Welle hält und nicht der Kern."),
             ("n1", q + " Answer in German.", "Die Schicht begrenzt die Sonde, weil das Feld die Welle hält und nicht der Kern."), ("n2", q, "The layer"), ("n3", q, "5.4 kg"), ("n4", q, "wave, probe, layer"), ("n5", None, "The field holds the wave."),
             ("t1", q, "The layer limits the probe because the"), ("t2", q, "It holds the wave of the field near the lay"), ("t3", q, "The layer limits,"), ("t3", q, "The layer limits,"), ("t4", q, "It holds the wave of the ..."), ("t5", q, "The layer limits the probe because…")]
    df = spark.createDataFrame(rows, "record_id string, question string, answer string")
    got = {r["record_id"]: r["defect"] for r in pairs.find_defects(df, "record_id", "question", "answer").collect()}
    kinds = {"e": "empty", "r": "refusal", "c": "copy", "o": "other_language", "t": "truncated"}
    assert got == {i: kinds[i[0]] for i, *_ in rows if i[0] in kinds}
    assert pairs.find_defects(df.limit(0), "record_id", "question", "answer").count() == 0


def test_refusals_stand_anywhere():
    known = pairs.Templates([pairs._WORD.findall(r) for r in pairs.REFUSALS] + ["this is nothing that we may decide here".split()])
    before = "the warm layer holds the wave of the field near the small probe and the slow core follows " * 4
    for refusal in ("but i can't answer that", "leider darf ich dazu keine auskunft geben", "so this is nothing we may decide right here"):
        assert known.match((before + refusal).split()) and known.match((refusal + " " + before).split())
    assert not known.match(before.split())
    assert not known.match("we are here and the layer is slow but some are unable and have to wait before they process the long and old questions of this or that kind".split())


def test_refusals_are_learnt(spark):
    subjects = ["layer", "probe", "field", "wave", "core", "lens", "valve", "coil"]
    q = {s: f"Why does the {s} hold the {t}?" for s, t in zip(subjects, subjects[1:] + subjects[:1])}
    rows = [(f"g{s}{i}", q[s], f"Because in a warm room the {s} is not as slow as number {i} of the others.") for s in subjects for i in range(9)]
    rows += [(f"r{s}", q[s], o + "that is not among the matters we look into." + e) for s, o, e in zip(subjects, ["", "Sorry, ", "Well; ", "", "Alas, "] * 2, ["", " Ask again."] * 4)]
    rows += [("copies1", q["lens"], "We did not find out anything about it."), ("copies2", q["lens"], "We did not find out anything about it, alas."), ("copies3", q["lens"], "Oh, we did not find out anything about it.")]  # always the same question
    df = spark.createDataFrame(rows, "record_id string, question string, answer string")
    got = {r["record_id"] for r in pairs.find_defects(df, "record_id", "question", "answer").where("defect = 'refusal'").collect()}
    assert got == {f"r{s}" for s in subjects}


def test_languages_outside_any_list(spark):
    rng = np.random.default_rng(8)
    english = "the of and layer which field holds near wave with that because probe inner from slow this core warm small moves over into each other when surface light".split()
    text = lambda n: " ".join(rng.choice(english, n)).capitalize() + "."
    rows = [(f"g{i}", text(12), text(14)) for i in range(300)]
    rows += [("polish", text(12), "Warstwa ogranicza sondę, ponieważ pole utrzymuje falę w pobliżu jądra przez cały czas."), ("chinese", text(12), "该层限制探针,因为场保持波在核心附近。"), ("greek", text(12), "Το στρώμα περιορίζει τον αισθητήρα επειδή το πεδίο κρατά το κύμα."),
             ("asked", "Translate this: the layer which holds the field near that wave", "Warstwa ogranicza sondę, ponieważ pole utrzymuje falę w pobliżu jądra przez cały czas."), ("names", text(12), "The Korvadrim layer of the Selumquist field holds the Wilenorrum wave near the core.")]
    df = spark.createDataFrame(rows, "record_id string, question string, answer string")
    got = {r["record_id"] for r in pairs.find_defects(df, "record_id", "question", "answer").where("defect = 'other_language'").collect()}
    assert got == {"polish", "chinese", "greek"}


def test_short_questions_given_back_are_copies():
    none = pairs.Templates([]), pairs.Profiles({})
    judge = lambda q, a: pairs.judge(q, a, *none)
    assert judge("What is osmosis?", "what is osmosis") == "copy" and judge("Look at the layer. What’s a probe?", "What's a probe?") == "copy"
    assert judge("What is osmosis?", "Osmosis") == judge("Is it a wave or field?", "a wave") == judge("", "The layer") == ""


def test_common_subsequence():
    assert pairs.common_subsequence("a b c d".split(), "a x c d".split()) == 3 and pairs.common_subsequence([], ["a"]) == 0 and pairs.common_subsequence(["a"], []) == 0
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = list(rng.choice(list("abcd"), rng.integers(1, 90))), list(rng.choice(list("abcd"), rng.integers(1, 90)))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert pairs.common_subsequence(a, b) == t[-1, -1]


# 6: packing


def test_containers_are_full_and_whole(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(WORDS, n)) for n in [*rng.integers(1, 700, 400), 5000]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0)], "doc_id bigint, text string, size int")
    got = packing.containers(df, "doc_id", "text").toPandas()
    encode = packing.tokenizer().encode_ordinary
    n = {i: len(encode(t)) for i, t in enumerate(texts)}
    assert got.groupby("doc_id")["tokens"].sum().to_dict() == n
    used = got.groupby("container").agg(t=("tokens", "sum"), u=("unused", "first"))
    assert (used.t + used.u == 2048).all() and used.t.sum() / 2048 / len(used) > 0.97
    whole = got[got.doc_id.map(n) <= 2048]
    assert whole.doc_id.is_unique and (whole.token_start == 0).all()
    assert packing.containers(df.limit(0), "doc_id", "text").count() == 0


def test_common_words_are_counted_over_all_texts(spark, monkeypatch):
    """A word of texts that a hash sample of half of the table leaves out, in texts that fill a container."""
    terms, capacity = [], len(packing.tokenizer().encode_ordinary("zebra quilt"))
    text = F.expr("if(pmod(xxhash64(doc_id, 'common'), 2) = 1 and doc_id % 25 = 0, 'zebra quilt', if(doc_id % 400 = 0, 'rare', 'plain'))")
    df = spark.range(40_000).withColumnRenamed("id", "doc_id").withColumn("text", text)

    def keyed(items, common):
        terms.append(common)
        raise StopIteration

    monkeypatch.setattr(packing, "_keyed", keyed)
    with pytest.raises(StopIteration):
        packing.containers(df, "doc_id", "text", capacity)
    assert terms == [{zlib.crc32(w.encode()) % packing._TERMS for w in ("zebra", "quilt", "plain")}]


def test_neighbours_share_a_container():
    sizes = np.array([1000, 900, 900])
    terms = [np.array([t << 8 | 1 for t in ts], np.uint32).tobytes() for ts in ((1, 2, 3), (7, 8, 9), (1, 2, 4))]
    assert packing.pack(sizes, terms, 2048)[0] == [0, 2]


# 7: leaks


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(f"i{k}", " ".join(rng.choice(WORDS, 40))) for k in range(15)]
    docs = []
    for k in range(200):
        w = list(rng.choice(WORDS, rng.integers(0, 80)))
        if k % 3 == 0:
            p, n = items[k % 15][1].split(), int(rng.integers(10, 16))
            a = int(rng.integers(0, len(p) - n))
            w[3:3] = [x.upper() + "," for x in p[a : a + n]]
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame([*docs, (999, None), docs[0]], "doc_id bigint, text string")
    ev = spark.createDataFrame([*items, ("none", None), ("short", "a b"), items[0]], "item_id string, passage string")
    got = {(r["doc_id"], r["item_id"]): r["leaked_words"] for r in leaks.find_leaks(df, "doc_id", "text", ev, "item_id", "passage").collect()}
    grams = {}
    for i, p in items:
        w = p.split()
        for a in range(len(w) - 11):
            grams.setdefault(tuple(w[a : a + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [t.lower().replace(",", "").split()] for a in range(len(w) - 11) for i in grams.get(tuple(w[a : a + 12]), ())}
    assert got.keys() == want and min(got.values()) >= 12
    several = leaks.find_leaks(df, "doc_id", "text", ev, "item_id", "passage", portion=600)  # some three passages at once
    assert {(r["doc_id"], r["item_id"]): r["leaked_words"] for r in several.collect()} == got
    assert leaks.find_leaks(df.limit(0), "doc_id", "text", ev, "item_id", "passage").count() == 0
    assert leaks.find_leaks(df, "doc_id", "text", ev.limit(0), "item_id", "passage").count() == 0


# 8: residue


def test_residue_is_told_from_talk_about_it(spark):
    rng = np.random.default_rng(4)
    plain = [" ".join(rng.choice(WORDS, 14)) + "." for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(1000 + i, "Title: {{course.title}}\n" + plain[i]) for i in range(10)] + [(1100 + i, "Please enable JavaScript to view this page.") for i in range(10)]
    rows += [(1200, plain[0] + " " + plain[1][:-1] + " {{course.title}} " + plain[2])]
    talk = [(1300, "Explain why a page of " + " ".join(WORDS[:12]) + " shows JavaScript."), (1301, 'The loop prints f"{name} has {score} points" for each ' + WORDS[0] + "."), (1302, " "), (1303, None), (1304, "")]
    df = spark.createDataFrame(rows + talk, "doc_id bigint, text string")
    got = {r["doc_id"] for r in residue.find_residue(df, "doc_id", "text").collect()}
    assert got == {i for i, _ in rows if i >= 1000}
    assert residue.find_residue(df.limit(0), "doc_id", "text").count() == 0


def test_trusted_messages_outside_the_sample_are_found(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(WORDS, 14)) + ".") for i in range(300)] + [(400 + i, m) for i, m in enumerate(("Access denied. Ask the office.", "Traceback (most recent call last)", "Lorem ipsum dolor sit amet " + " ".join(rng.choice(WORDS, 200))))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in residue.find_residue(df, "doc_id", "text", records=1).collect()}
    assert got == {400, 401, 402}


def test_one_word_sentences_belong_to_the_next():
    found = list(residue.passages("Oops! We lost that chapter. No. Then it ends.\nFine"))
    assert [f for f, _ in found] == [["oops", "we", "lost", "that", "chapter"], ["no", "then", "it", "ends"], ["fine"]]
    assert [t for _, t in found] == [True, False, False]
