"""The llm operators against brute force and on odd tables: nulls anywhere, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karst.llm import _text as T
from karst.llm import bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_join, quality_model, quality_rules, sharding, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(60, 160)) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        out.append((100 + i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    passage = sentence(rng, 60)
    for i in range(6):
        out.append((200 + i, f"{sentence(rng, 30)}\n{passage} {sentence(rng, 40)}"))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "one two"), (305, "one two three"), (306, "a b c d e"), (307, "A b c\td e"), (308, sentence(rng, 30_000)), (None, base[0]), (309, base[1]), (309, base[1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows beside columns named as the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("sig", "n", "bits", "line", "pos", "row", "key", "bucket", "words", "score", "ids", "shard_bits", "component", "batch", "hash")})


# ---------------------------------------------------------------- words and shingles


def test_words_match_the_pattern():
    texts = ["A b\tc", None, "", " x ", "é ü\x0bñ  q", "end "]
    for a, b, data, offs in T.slices(pa.array(texts)):
        w = T.Words(data, offs)
        got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[w.row[i] : w.row[i + 1]], w.end[w.row[i] : w.row[i + 1]])] for i in range(b - a)]
        assert got == [words(t) for t in texts[a:b]]


def test_slices_keep_every_row():
    column = pa.array(["x" * 10] * 5 + ["y" * 5000] + [None] * 3)
    assert [r for a, b, _, _ in T.slices(column, 16) for r in range(a, b)] == list(range(9))


# ---------------------------------------------------------------- 7: Jaccard join


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_of(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).update({("row", *[]) for _ in ()})
            sets[i] = shingles(t)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("small", [8, 2])
def test_jaccard_components(monkeypatch, docs, rows, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 1024 if small == 2 else 1 << 19)
    want, sets = components_of(rows)
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id]))


def family(rng, members, length, edits):
    """Copies of one text, each with some of its words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(members):
        w = list(base)
        for k in rng.sample(range(length), rng.randint(1, edits)):
            w[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1 << 19, 1 << 14])
def test_jaccard_of_a_large_family(spark, monkeypatch, block):
    """Near copies around the bound, some linked and some not: all pairs are compared by a matrix product."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    length, edits = 800, 60
    texts = family(random.Random(block), 600, length, edits)
    rows = list(enumerate(texts, 1))
    sets = [shingles(t) for t in texts]
    index = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(texts), len(index)), np.float32)
    for i, s in enumerate(sets):
        has[i, [index[g] for g in s]] = 1
    both = has @ has.T
    size = np.array([len(s) for s in sets])
    link = 100 * both >= 75 * (size[:, None] + size - both)
    label = np.arange(len(texts))
    while True:
        new = np.where(link, label, len(texts)).min(1)
        if (new == label).all():
            break
        label = new
    assert 1 < len(set(label.tolist())) < len(texts)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i + 1: int(x) + 1 for i, x in enumerate(label)}


def test_no_block_pair_is_large(spark, monkeypatch):
    """Parts of a family hold two blocks at most, and every pair of members of different components shares one."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16 * 256)
    rows = [(0, 7, i, 1 if i < 300 else i, 10) for i in range(400)]
    parts = ngram_join._parts(spark.createDataFrame(rows, "kind int, family long, sig long, label long, n long")).collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r.part, []).append((r.side, r.sig))
    assert max(map(len, by_part.values())) <= 80
    met = set()
    for members in by_part.values():
        for x, i in members:
            met |= {(min(i, j), max(i, j)) for y, j in members if (x != 1 and y == 1) or (x == y == 2 and i != j)}
    assert met == {(i, j) for i in range(400) for j in range(max(i + 1, 300), 400)}
    assert len(parts) < 400 * 40


def test_jaccard_odd_tables(none, clashing, docs):
    assert ngram_join.jaccard_components(none).collect() == []
    key = lambda df: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())
    assert key(ngram_join.jaccard_components(clashing)) == key(ngram_join.jaccard_components(docs))


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(3)
    for n in (10, 100, 700):
        a, b = (np.unique(rng.integers(0, 3 * n, n).astype(np.uint64)) for _ in range(2))
        a, b = T.mix(a), T.mix(b)
        a.sort(), b.sort()
        x, y = (np.frombuffer(ngram_join._bitmap(v), np.uint8)[None, :] for v in (a, b))
        w = 8 * min(x.shape[1], y.shape[1])
        bound = ngram_join.overlap_bound(len(a), len(b), ngram_join._fold(x, w), ngram_join._fold(y, w))[0]
        assert bound >= len(np.intersect1d(a, b))


# ---------------------------------------------------------------- 1: substring dedup


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for _ in range(150):
        sizes = rng.integers(0, 40, 4)
        bound = np.concatenate([[0], np.cumsum(sizes)])
        h = rng.integers(0, 1 << 60 if rng.random() < 0.5 else 12, bound[-1]).astype(np.uint64)
        t = int(rng.integers(2, 9))
        v, g, left, c, r = substring_dedup.compact_windows(h, bound, t)
        want = set()
        for k in range(4):
            x = h[bound[k] : bound[k + 1]].tolist()
            for s in range(len(x) - t + 1):
                low, a, b = min(x[s : s + t]), s, s + t - 1
                while a > 0 and x[a - 1] >= low:
                    a -= 1
                while b < len(x) - 1 and x[b + 1] >= low:
                    b += 1
                want.add((k, low, a, b))
        assert sorted(zip(g.tolist(), v.tolist(), left.tolist(), r.tolist())) == sorted(want)


def test_repeated_passages(docs, rows, none, clashing):
    seen = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                seen[tuple(w[k : k + 50])].add(i)
    want = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    got = substring_dedup.repeated_passages(docs).collect()
    assert want <= {r.doc_id for r in got}
    own = {r.doc_id for r in got}
    assert not own & {300, 301, 302, 303, 304, 305, 306, 307, 308}
    passage = [r for r in got if r.doc_id in range(200, 206)]
    assert len(passage) == 6 and {r.class_id for r in passage} == {200}
    for r in passage:
        assert r.passages[0]["first"] <= 33 and r.passages[0]["end"] >= 87
    assert substring_dedup.repeated_passages(none).collect() == []
    assert {r.doc_id for r in substring_dedup.repeated_passages(clashing).collect()} == own


@pytest.mark.parametrize("small,heads,hot", [(8, 2, 64), (2, 1, 3)])
def test_passages_on_both_sides(monkeypatch, docs, rows, small, heads, hot):
    """Nothing verbatim is missed, nothing is reported that no other text bears out, and classes are what links make them."""
    for name, value in (("SMALL", small), ("HEADS", heads), ("HOT", hot)):
        monkeypatch.setattr(substring_dedup, name, value)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    texts = {i: words(t) for i, t in rows if i is not None and len(words(t)) >= 50 and i != 308}
    grams = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in texts.items()}
    at = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            at[tuple(w[k : k + 50])].add(i)
    verbatim = {(i, j) for ids in at.values() for i in ids for j in ids if i < j}
    assert {i for p in verbatim for i in p} <= set(got) <= set(texts)
    for i, j in verbatim:
        assert got[i].class_id == got[j].class_id
    # the best similarity of any 46 shingles of a passage with any 46 of another document of the class
    index = {g: k for k, g in enumerate(sorted({g for x in grams.values() for g in x}))}
    rng = random.Random(1)
    for i in rng.sample(sorted(got), 20):
        others = [j for j in texts if j != i and j in got and got[j].class_id == got[i].class_id]
        for p in got[i].passages:
            assert 0 <= p["first"] and p["end"] <= len(texts[i]) and p["end"] - p["first"] >= 50
            own = [index[g] for g in grams[i][p["first"] : p["end"] - 4]]
            best = 0.0
            for j in others:
                other = [index[g] for g in grams[j]]
                shared = np.isin(own, other)
                # a passage of similarity 0.75 shares 86 % of its shingles; half is borne out by any part of it
                best = max(best, max(shared[k : k + 46].mean() for k in range(max(1, len(own) - 45))))
            assert best >= 0.8, (i, p, best)
    least = {}
    for i, r in got.items():
        least[r.class_id] = min(i, least.get(r.class_id, i))
    assert all(k == v for k, v in least.items())


def test_no_passage_of_a_quoted_text_is_lost(spark):
    """Many documents that quote one text at places a few words apart, and near copies with one edit each: groups far over SMALL."""
    rng = random.Random(12)
    table = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    source = sentence(rng, 700).split()
    quotes = [(k, f"{sentence(rng, 25)} {' '.join(source[3 * k : 3 * k + 60])} {sentence(rng, 25)}") for k in range(200)]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(table(quotes)).collect()}
    assert len(got) == 200 and {r.class_id for r in got.values()} == {0}
    # each quoted word that another document quotes too, in a stretch of 50 words or more
    assert all(any(p["first"] <= 25 and p["end"] >= 85 for p in got[k].passages) for k in range(4, 196))
    text = sentence(rng, 60)
    near = [(k, f"{sentence(rng, 25)} {edited(rng, text, 'change')} {sentence(rng, 25)}") for k in range(150)]
    got = {r.doc_id for r in substring_dedup.repeated_passages(table(near)).collect()}
    assert len(got) >= 147


def shingled(text):
    w = words(text)
    return np.array([int.from_bytes(hashlib.blake2b(" ".join(w[k : k + 5]).encode(), digest_size=8).digest(), "little") for k in range(len(w) - 4)], np.uint64)


def edited(rng, text, edit):
    w = text.split()
    at = len(w) // 2 if edit == "middle" else rng.randrange(len(w))
    w[at : at + (edit != "insert")] = [] if edit == "delete" else [sentence(rng, 1) + "x"]
    return " ".join(w)


@pytest.mark.parametrize("edit", ["middle", "change", "insert", "delete"])
def test_near_passages_with_one_edit(edit):
    rng = random.Random(5)
    for n in range(51, 71):
        text = sentence(rng, n)
        x, y = (shingled(f"{sentence(rng, 20)} {t} {sentence(rng, 20)}") for t in (text, edited(rng, text, edit)))
        found = substring_dedup.shared_runs(x, y, 46, 75)
        assert len(found) == 1
        for f, g, p, q in found:
            a, b = set(x[f:g].tolist()), set(y[p:q].tolist())
            assert g - f >= 46 and q - p >= 46 and 100 * len(a & b) >= 75 * len(a | b)
    assert substring_dedup.shared_runs(shingled(sentence(rng, 90)), shingled(sentence(rng, 90)), 46, 75) == []
    # two halves that changed places: two diagonals far apart, no passage
    halves = sentence(rng, 44), sentence(rng, 44)
    assert substring_dedup.shared_runs(shingled(f"{halves[0]} {sentence(rng, 60)} {halves[1]}"), shingled(f"{halves[1]} {sentence(rng, 60)} {halves[0]}"), 47, 90) == []


def linked(n, pairs):
    """The smallest row that pairs lead to, of each row."""
    least = list(range(n))
    while True:
        before = list(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return least


@pytest.mark.parametrize("edits,heads", [(0, 2), (1, 2), (2, 2), (2, 64)])
def test_group_pairs_lose_nothing(edits, heads):
    """Pairs of a large group that are left out add no document, no class and no shingle that both sides of a passage have."""
    rng = np.random.default_rng(7 + edits)
    source, n, t = rng.integers(1 << 20, 1 << 32, 130), 60, 46
    rows = []
    for k in range(n):
        x = source[(k % 5) * 8 : (k % 5) * 8 + 80].copy()
        for at in rng.integers(0, 76, edits):
            x[at : at + 5] = rng.integers(1 << 20, 1 << 32, 5)
        rows.append(np.concatenate([rng.integers(1 << 20, 1 << 32, 20), x, rng.integers(1 << 20, 1 << 32, 20)]))
    pivot = np.array([20 + 60 - (k % 5) * 8 for k in range(n)])
    for x, p in zip(rows, pivot, strict=True):
        x[p] = source[60]
    found = {}
    for i in range(n):
        for j in range(i + 1, n):
            if runs := substring_dedup.shared_runs(rows[i].astype(np.uint64), rows[j].astype(np.uint64), t, 75):
                found[i, j] = runs

    def result(pairs):
        held = [set() for _ in range(n)]
        for i, j in pairs:
            for f, g, p, q in found[i, j]:
                held[i] |= {f + x for x in np.flatnonzero(np.isin(rows[i][f:g], rows[j][p:q])).tolist()}
                held[j] |= {p + x for x in np.flatnonzero(np.isin(rows[j][p:q], rows[i][f:g])).tolist()}
        return linked(n, pairs), held

    bound = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    made = substring_dedup.group_pairs(np.concatenate(rows), bound, pivot, np.arange(n) * 3, t, 75, (16, heads, 7))
    asked = {(min(p), max(p)) for h, k in made for p in zip(h.tolist(), k.tolist(), strict=True)}
    assert len(asked) < n * (n - 1) // 2
    assert found and result(asked & set(found)) == result(set(found))


def test_group_pairs_come_once():
    """Rows that share shingles, repeated ones too: no pair is given twice."""
    rng = np.random.default_rng(3)
    source, rows = rng.integers(1 << 20, 1 << 32, 100), []
    for k in range(40):
        x = source.copy()
        x[5 + 2 * k : 10 + 2 * k] = x[:5] if k % 4 == 0 else rng.integers(1 << 20, 1 << 32, 5)
        rows.append(x)
    bound = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    made = substring_dedup.group_pairs(np.concatenate(rows), bound, np.full(40, 99), np.arange(40), 46, 75, (16, 8, 7))
    asked = [(min(p), max(p)) for h, k in made for p in zip(h.tolist(), k.tolist(), strict=True)]
    plain = [p for p in asked if p[0] % 4 or p[1] % 4]
    assert len(plain) == len(set(plain)) and len(set(asked)) == 40 * 39 // 2


def test_near_copies_of_two_edits(spark):
    """150 near copies, of which many are near few others only: those that a comparison of all pairs finds are found and of its classes."""
    rng = random.Random(1)
    text, texts = sentence(rng, 60), []
    for _ in range(150):
        texts.append(f"{sentence(rng, 25)} {edited(rng, edited(rng, text, 'change'), 'change')} {sentence(rng, 25)}")
    grams = [shingled(x) for x in texts]
    pairs = [(i, j) for i in range(150) for j in range(i + 1, 150) if substring_dedup.shared_runs(grams[i], grams[j], 46, 75)]
    want = {i for p in pairs for i in p}
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want)


def test_recall_of_near_passages(spark):
    rng = random.Random(6)
    texts = []
    for k in range(60):
        text = sentence(rng, 50 + k % 21)
        texts += [(2 * k, f"{sentence(rng, 30)} {text} {sentence(rng, 30)}"), (2 * k + 1, f"{sentence(rng, 30)} {edited(rng, text, 'middle')} {sentence(rng, 30)}")]
    texts += [(1000 + k, sentence(rng, 120)) for k in range(40)]
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    # pairs of Jaccard similarity 0.80 to 0.86, of which 4 of 8 min-hashes must agree
    assert sum(got.get(2 * k) == got.get(2 * k + 1) == 2 * k for k in range(60)) >= 56
    assert max(got) < 1000


# ---------------------------------------------------------------- 2: line dedup

LINES = [
    (1, "a line that repeats\nonly here one\n\nshort"), (2, "  A LINE that repeats \nshort\nsecond only here"), (3, "a line that repeats\na line that repeats"),
    (4, None), (5, ""), (6, "twice in one\ntwice in one"), (7, "É line with an accent\nx"), (8, "é line with an accent\nx"), (9, "É line with an accent"), (None, "a line that repeats"), (3, "a line that repeats\na line that repeats"), (10, "x\n" * 3000 + "a line that repeats"),
]


def deduped(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(spark, batches):
    df = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("pos", __import__("pyspark").sql.functions.lit(1))
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, batches).collect())
    assert got == deduped(LINES)


def test_line_dedup_of_nothing(none):
    assert line_dedup.dedup_lines(none).collect() == []


# ---------------------------------------------------------------- 3: licences


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][2].replace("hereby ", "").replace("deal in", "trade in")
    texts = [(1, f"x\n{mit}\nmore"), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 3.0."), (4, None), (5, ""), (6, "a licensed driver"), (7, "y " * 5000 + "Licensed under the Apache License, Version 2.0. " + "z " * 5000), (2, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")]
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {(1, "MIT"): 1, (2, "MIT"): 2, (7, "Apache-2.0"): 1, (None, "CC-BY-4.0"): 1}
    first = next(r for r in got if r.doc_id == 1)
    assert (first.differences, first.wording) == (2, "-hereby deal>trade")
    r = next(r for r in got if r.doc_id == 7)
    assert texts[6][1][r.first_char : r.end_char] == "Licensed under the Apache License, Version 2.0"


@pytest.mark.parametrize("width", [200, 100, 80, 60, 50, 40, 30])
@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_wrapped_notices(width, prefix):
    """Every template, wrapped at any width behind a comment sign, is found whole and as itself: of all templates none fits better."""
    import textwrap

    for name, texts in license_scan.TEMPLATES.items():
        for text in texts:
            notice = "\n".join(prefix + line for line in textwrap.wrap(text, width))
            source = f"def f():\n    pass\n\n{notice}\n\nx = 1\ny = 2\n"
            ((found, _, _, a, b, differences, _),) = license_scan.scan(source)
            plain = [w for w, _, _ in license_scan.words(source)]
            assert (found, differences) == (name, 0), (name, width, prefix)
            assert [w for w, _, _ in license_scan.words(source[a:b])] == [w for w, _, _ in license_scan.words(text)]
            best = min((license_scan.align(t[2], plain)[0], -len(t[2])) for t in license_scan._templates())
            assert best == (0, -len(license_scan.words(text)))


def test_license_odd_tables(spark, none, clashing, docs):
    assert license_scan.scan_licenses(none).collect() == []
    assert license_scan.scan_licenses(clashing).collect() == license_scan.scan_licenses(docs).collect() == []
    long = ("word " * 50 + "\n") * 4000 + "Released under the MIT License.\n" + "more " * 20_000
    got = license_scan.scan_licenses(spark.createDataFrame([(1, long), (1, long), (None, "Released under the MIT License.")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "MIT"), ("1", "MIT"), ("None", "MIT")]


def test_license_behind_many_alike():
    for kind in ("General", "Lesser General", "Affero General"):
        text = f"This work is licensed under the GNU {kind} Public License, version 1.\nReleased under the MIT License."
        assert [(x[0], text[x[3] : x[4]]) for x in license_scan.scan(text)] == [("MIT", "Released under the MIT License")]


# ---------------------------------------------------------------- 4: BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, tokenizer, docs, rows):
    source = bpe.read_file()
    odd = ["it's <|endoftext|>Don't", "ΣΊΣΥΦΟΣ Σ", "é É 12٣ a b", "<|startoftext|", "é" * 9000, "x" * 20_000, "", None, "　 ", "🙂🙂 ok!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(1000 + k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in bpe.digests(df, source).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, source), source, mode="text").collect()
    assert next(r.text for r in back if r.doc_id == 0).startswith("it 's <|endoftext|>don 't")


def test_bpe_windows_do_not_change_tokens(tokenizer):
    merges, _ = bpe.coder(bpe.read_file())
    small = bpe.Encoder(merges, window=1, block=64)
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice("abcdeéthn") if rng.random() < 0.95 else rng.choice(" 's") for _ in range(rng.randint(0, 6000)))
        small.memo.clear()
        assert [i for b in small.encode(text) for i in b] == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_knows_the_library_tables(tokenizer):
    merges, _ = bpe.coder(bpe.read_file())
    encoder = bpe.Encoder(merges)
    edges = {c for r in (*bpe.NO_LETTERS, *bpe.NO_MARKS, *((a, b) for a, b, _ in bpe.CAPITALS)) for x in r for c in (x - 1, x, x + 1)}
    for c in sorted(edges | set(range(0x3000)) | set(range(0x3000, 0x110000, 61))):
        if not 0xD800 <= c <= 0xDFFF:
            for text in (f"a{chr(c)}b", f"e{chr(c)}\u0323\u0301 #{chr(c)}# {chr(c)}"):
                assert [i for b in encoder.encode(text) for i in b] == tokenizer.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_reads_runs_in_blocks(tokenizer):
    merges, _ = bpe.coder(bpe.read_file())
    small = bpe.Encoder(merges, window=600, block=300)
    rng = random.Random(2)
    pool = ["a", "b", "Z", "don't", "'", "'s", "1", "22", " ", "\n", "-", "=", "é", "\u0301", "ß", "Σ", "漢", "字", "İ", "<|endoftext|>", "\u088f", "\u0898", "..", "'re", "!", "_"]
    texts = ["".join(rng.choice(pool) * rng.choice([1, 1, 2, 5, 400 if rng.random() < 0.05 else 3]) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    texts += ["x" * 50_000, "-" * 50_000, "1" * 20_000, "漢字" * 20_000, "don't" * 9000, "abc1" * 9000, "!'s" * 9000, "é" * 30_000]
    for text in texts:
        assert [i for b in small.encode(text) for i in b] == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]
    # a long run comes in blocks, so what is held at once does not grow with it
    assert max(len(b) for b in small._pieces("x" * 600)) <= 600
    assert max(len(b) for b, _ in small._blocks("x" * 50_000)) <= 700 and max(len(b) for b, _ in small._blocks("-" * 50_000)) <= 700


def test_bpe_decodes_split_characters():
    merges, encoder = bpe.coder(bpe.read_file())
    decoder = bpe.Decoder(merges, "text")
    ids = [i for b in encoder.encode("🙂 né") for i in b]
    assert "".join(decoder.push([i]) for i in ids) + decoder.finish() == "🙂 né "


# ---------------------------------------------------------------- 5: sharding


@pytest.mark.parametrize("limit, depth", [(4000, 24), (4000, 1), (1500, 2)])
def test_shards_fit(docs, rows, limit, depth):
    got = sharding.shards(docs, limit, depth).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t in rows)
    shard = defaultdict(list)
    for r in got:
        shard[r.shard_bits, r.shard_prefix, r.piece].append(r.n_bytes)
    assert all(sum(x) <= limit or len(x) == 1 for x in shard.values())
    if depth == 24:
        for bits, prefix, _ in shard:
            assert bits == 0 or not any(b < bits and prefix >> (bits - b) == p for b, p, _ in shard)


def test_shards_of_nothing(none):
    assert sharding.shards(none).collect() == []


# ---------------------------------------------------------------- 6: quality rules


def test_quality_counts(docs, rows):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        r = got[i, len(w)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_repeated_windows(spark):
    df = spark.createDataFrame([(1, "a b c d a b c x b c d"), (2, "z z z z z"), (3, "a b")], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.judge(df).collect()} == {1: 10, 2: 5, 3: 0}


def test_quality_rules_reject_divergent_text(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "and", "to", "in", "is", sentence(rng, 1), sentence(rng, 1)]) for _ in range(200)) for _ in range(60)]
    bad = [" ".join(f"{sentence(rng, 1)}***" for _ in range(200)) for _ in range(4)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(60))


# ---------------------------------------------------------------- 8: quality classifier


def test_classifier_generalises(spark, none):
    rng = random.Random(5)
    data = [(i, (sentence(rng, 60) if i % 4 else " ".join(x.upper() + "!!" for x in sentence(rng, 60).split())), int(i % 4 > 0), 0) for i in range(400)] + [(1000, None, 1, 0), (1001, "", None, 0), (None, "x", 1, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")
    weights = quality_model.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    scores = {r.doc_id: r.score for r in quality_model.score(df, weights).collect()}
    held = [(s, i % 4 > 0) for i, s in scores.items() if i is not None and i < 400 and __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((s >= 0.3) == y for s, y in held)
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1000] == scores[1001]
    kept = quality_model.keep_quality(df, weights)
    assert kept.columns == df.columns and kept.where("doc_id < 400 AND doc_id % 4 = 0").count() == 0
    assert not quality_model.train(none, none.selectExpr("doc_id", "1 AS quality")).any()


def test_training_takes_one_row_a_document(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 40) if i % 2 else sentence(rng, 40).upper()) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    table = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    one = quality_model.train(table(rows), labels)
    many = quality_model.train(table(rows).union(table(rows[7:8]).crossJoin(spark.range(20_000)).select("doc_id", "text")), labels)
    assert one.any() and (one == many).all()
    # long texts do not use up the rows
    size = max(len(t) for _, t in rows)
    assert (quality_model.train(table([*rows, *((i, sentence(rng, 400)) for i in range(40, 80))]), labels.union(spark.range(40, 80).selectExpr("id", "1")), 40, size) == one).all()


# ---------------------------------------------------------------- 9: decontamination


def edit(item, region):
    prev = [0] * (len(region) + 1)
    for i, c in enumerate(item):
        cur = [i + 1]
        for j, x in enumerate(region):
            cur.append(min(prev[j] + (c != x), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_alignment_is_the_edit_distance():
    rng = random.Random(3)
    pick = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    for _ in range(200):
        item, k = pick(rng.randint(12, 60)), rng.randint(0, 6)
        x = bytearray(item)
        for _ in range(rng.randint(0, 7)):
            p = rng.randrange(len(x))
            x[p : p + rng.randint(0, 1)] = pick(rng.randint(0, 1))
        region = pick(rng.randint(0, 5)) + bytes(x) + pick(rng.randint(0, 5))
        want, got = edit(item, region), decontaminate.best_alignment(item, region, k)
        assert (got is None) == (want > k) and (got is None or got[0] == want == edit(item, region[got[1] : got[2]]))


def test_decontamination(spark, none, monkeypatch):
    rng = random.Random(6)
    items = [(k, sentence(rng, 40)) for k in range(8)] + [(90, None), (91, ""), (92, "tiny one"), (None, sentence(rng, 30))]
    data, want = [], set()
    for i in range(60):
        text = sentence(rng, 50)
        if i % 3 == 0:
            k, leak = items[i % 8]
            leak = list(leak.title() if i % 2 else leak)
            for _ in range(i % 4):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            text = f"{text}, {''.join(leak)}. {sentence(rng, 20)}"
            want.add((i, k))
        data.append((i, text))
    data += [(100, None), (101, ""), (102, "Tiny, ONE!"), (103, "a tiny one too"), (104, sentence(rng, 3) + " " + items[1][1]), (104, sentence(rng, 3) + " " + items[1][1])]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(102, 92), (104, 1)}
    assert sum(r.doc_id == 104 for r in got) == 2
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert decontaminate.drop_contaminated(docs, bench).count() == len(data) - len({i for i, _ in want}) - 3
    assert decontaminate.matches(none, bench).collect() == [] and decontaminate.matches(docs, bench.limit(0)).collect() == []


def test_long_texts_are_searched_in_parts():
    rng = random.Random(8)
    item = sentence(rng, 40)
    text = sentence(rng, 300_000)
    cut = 1_048_570
    text = f"{text[:cut]} {item} {text[cut:]}"
    _, _, data, offs = next(T.slices(pa.array([text])))
    ((row, k, a, b, distance),) = decontaminate.find(decontaminate.Items([(5, item)]), data, offs)
    assert (row, k, distance, text.encode()[a:b].decode()) == (0, 0, 0, item)


def test_items_across_the_parts_of_a_long_text(monkeypatch):
    """Words of an item far apart in the raw text, wherever the cuts fall."""
    monkeypatch.setattr(decontaminate, "_SEGMENT", 512)
    rng = random.Random(8)
    item = sentence(rng, 12)
    index = decontaminate.Items([(5, item)])
    for gap in (1, 50, 200):
        for lead in range(0, 400, 37):
            text = "é " * lead + sentence(rng, 150) + "\n" + (" " * gap).join(item.split()) + " " + sentence(rng, 300)
            raw = np.frombuffer(text.encode(), np.uint8)
            ((row, k, a, b, distance),) = decontaminate.find(index, raw, np.array([0, len(raw)]))
            assert (row, k, distance) == (0, 0, 0) and raw[a:b].tobytes().decode().split() == item.split()


@pytest.mark.parametrize("lead", [0, 3, 700])
def test_every_cut_equals_the_uncut_search(monkeypatch, lead):
    """Edited and short items, and items that only begin or end a longer word, with the parts of a long text cut at every place."""
    rng = random.Random(10)
    long = sentence(rng, 14)
    items = decontaminate.Items([(1, "the red fox ran"), (2, long), (3, sentence(rng, 9))])
    edited_ = long[:20] + "x" + long[21:]
    text = " " * lead + f"{sentence(rng, 6)} the red foxy qthe red fox rang {edited_} {sentence(rng, 4)} the red fox rang {sentence(rng, 90)} the red fox ran"
    if lead == 3:
        text = text[: text.rindex(" the")]
    raw = np.frombuffer(text.encode(), np.uint8)
    offs = np.array([0, len(raw)])
    want = decontaminate.find(items, raw, offs)
    assert [x[1] for x in want] == ([1] if lead == 3 else [0, 1])
    for cut in range(40, len(raw) // 2 + 1):
        monkeypatch.setattr(decontaminate, "_SEGMENT", cut)
        assert decontaminate.find(items, raw, offs) == want, cut


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "tiny one"), (3, "so it is")], "item_id long, text string")
    texts = {1: "Tell me: who wrote\nHAMLET, and when?", 2: "who wrote hamletian plays", 3: "tiny one", 4: "a tiny one here", 5: "and so it is, then", 6: "also it is", 7: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_every_leak_by_edit_distance(spark):
    """All items against all texts by the whole table of edit distances to any part of the text."""
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(6, 20))) for k in range(6)]
    data = []
    for i in range(60):
        words_ = sentence(rng, 30).split()
        if i % 3:
            own = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(own) // 8)):
                at, kind = rng.randrange(len(own)), rng.random()
                own[at : at + (kind < 0.7)] = [rng.choice("xyz")] if kind < 0.4 or kind >= 0.7 else []
            words_[10:10] = ["".join(own)]
        data.append((i, " ".join(words_)))
    index = decontaminate.Items(items)
    want = set()
    for i, text in data:
        reduced = " ".join(text.split())
        for k, (item_id, _) in enumerate(items):
            x = index.bytes[k].decode()
            row = [0] * (len(reduced) + 1)
            for p in range(1, len(x) + 1):
                new = [p]
                for q in range(1, len(reduced) + 1):
                    new.append(min(row[q - 1] + (x[p - 1] != reduced[q - 1]), row[q] + 1, new[-1] + 1))
                row = new
            if min(row) <= index.edits[k]:
                want.add((i, item_id, min(row)))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 20



# ---------------------------------------------------------------- 10: chats


def test_escapes_are_reversible():
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "\n", "x", "n"]) for _ in range(rng.randint(0, 12)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


def test_chats(spark):
    events = [
        (1, 0, 0, "message", "user", "hi <|im_end|>"), (1, 1, 0, "delta", "assistant", "Hel"), (1, 1, 1, "delta", "assistant", "lo"), (1, 1, 2, "edit", "assistant", "Hello"),
        (1, 1, 3, "regenerate", "assistant", None), (1, 1, 4, "delta", "assistant", "Good"), (1, 1, 5, "delta", "assistant", " day"), (2, 0, 0, "message", None, None), (2, 0, 0, "message", None, None), (None, 3, 0, "message", "assistant", "x"),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi <|im_end|>\nassistant\nGood day\n") and got[1].loss_sha256 == sha("Good day") and got[1].loss_chars == 8
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[None].loss_sha256 == sha("x")
    text = "".join(r.formatted for r in chat_format.format_chats(df).where("conv_id = 1").orderBy("turn").collect())
    assert got[1].formatted_chars == len(text) and text.endswith("<|im_start|>assistant\nGood day<|im_end|>\n")
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).collect() == []


# ---------------------------------------------------------------- odd tables


def test_chats_read_back_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    events = [(c, t, 0, "message", rng.choice(["user", "assistant"]), rng.choice(["same", "same", "<|im_end|>", "x" * 50_000])) for c in range(12) for t in rng.choices(range(4), k=9)] + [(None, None, None, "message", None, None)]
    log = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string").withColumns({"place": F.lit("x"), "formatted": F.lit("x"), "loss_from": F.lit("x")})
    out = chat_format.format_chats(log)
    want = sorted(map(tuple, chat_format.digests(out, ordered=True).collect()), key=str)
    out.repartition(7, "formatted").write.parquet(str(tmp_path / "chats"))
    assert sorted(map(tuple, chat_format.digests(spark.read.parquet(str(tmp_path / "chats"))).collect()), key=str) == want and len(want) == 13
    assert chat_format.digests(chat_format.format_chats(log.limit(0))).collect() == []


def test_bpe_and_model_on_odd_tables(spark, none, clashing, docs):
    source = bpe.read_file()
    assert bpe.digests(none, source).collect() == [] and bpe.coded(none, source).collect() == []
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(bpe.digests(clashing, source), bpe.digests(docs, source))
    weights = np.zeros(quality_model.DIMENSIONS, np.float32)
    weights[::3] = 0.5
    assert quality_model.score(none, weights).collect() == []
    assert same(quality_model.score(clashing, weights), quality_model.score(docs, weights))
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert same(decontaminate.matches(clashing, items), decontaminate.matches(docs, items))
    assert same(sharding.shards(clashing, 1000, 6), sharding.shards(docs, 1000, 6))
    assert quality_rules.judge(none).collect() == []
    assert same(quality_rules.judge(clashing), quality_rules.judge(docs))
    long = spark.createDataFrame([(1, "word " * 200_000), (1, "word " * 200_000)], "doc_id long, text string")
    assert len({r.score for r in quality_model.score(long, weights).collect()}) == 1


def test_updates_by_the_book(spark):
    """The trained weights are those of a plain loop over follow-the-regularised-leader updates, in order of the documents' hashes."""
    rng = random.Random(12)
    texts = [(i, sentence(rng, rng.randint(3, 40))) for i in range(60)]
    labels = [(i, i % 2) for i in range(60)] + [(1, 0), (3, None), (None, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_model.train(docs, marked)
    assert (got == quality_model.train(docs.repartition(5), marked.orderBy(F.rand(1)))).all()
    order = [r.doc_id for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    vectors = {}
    for i, t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        _, index, value = quality_model.features(data, np.array([0, len(data)]))
        vectors[i] = list(zip(index.tolist(), value.astype(np.float32).astype(float).tolist()))
    z, n, w = defaultdict(float), defaultdict(float), defaultdict(float)
    q = quality_model
    for _ in range(q.MOST_EPOCHS):
        for i in order:
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in vectors[i])))
            for k, v in vectors[i]:
                g = (p - i % 2) * v
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / q.ALPHA * w[k]
                n[k] += g * g
                w[k] = 0.0 if abs(z[k]) <= q.L1 else -(z[k] - np.sign(z[k]) * q.L1) / ((q.BETA + np.sqrt(n[k])) / q.ALPHA + q.L2)
    for k in w:
        assert abs(got[k] - w[k]) < 1e-4
    assert np.count_nonzero(got) <= len(w)


def steps(run):
    """Calls of Python and C functions while ``run`` is at work: what pairs cost beyond the length of their arrays."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


@pytest.mark.parametrize("repeats", [False, True])
def test_pairs_take_few_steps_for_each_gap(repeats):
    """The stretches from each run to each later one are tried together, whether shingles are repeated or not."""
    rng = np.random.default_rng(4)
    made = []
    for n in (400, 1600):
        x = rng.integers(1 << 20, 1 << 60, n).astype(np.uint64)
        y = x.copy()
        if repeats:
            x[200:205] = y[200:205] = x[:5]
        for at in range(10, n - 5, 20):  # runs of 15 and gaps of 5: a passage would need six of seven
            y[at : at + 5] = rng.integers(1 << 20, 1 << 60, 5)
        assert substring_dedup.shared_runs(x, y, 46, 75) == []
        made.append(steps(lambda x=x, y=y: substring_dedup.shared_runs(x, y, 46, 75)))
    assert made[0] <= 1000 and made[1] - made[0] <= 30 * 60


def test_windows_of_a_group_are_compared_together():
    """Four times the windows of a group don't take four times the steps."""
    rng = np.random.default_rng(8)
    source = rng.integers(1 << 20, 1 << 32, 80)
    made = []
    for n in (20, 80):
        rows = [source.copy() for _ in range(n)]
        for x in rows:
            at = int(rng.integers(0, 70))
            x[at : at + 5] = rng.integers(1 << 20, 1 << 32, 5)
        bound = np.arange(n + 1) * 80
        args = np.concatenate(rows), bound, np.full(n, 79), np.arange(n), 46, 75, (16, 8, 64)
        made.append(steps(lambda args=args: list(substring_dedup.group_pairs(*args))))
    assert made[1] <= 2 * made[0]


def test_shingles_are_cut_for_many_documents_at_once():
    """Windows' and spans' shingles are those of their own text, as far as it goes, with few batches for many documents."""
    rng = random.Random(9)
    texts = [sentence(rng, n) for n in (80, 6, 3, 120)] * 20
    grams = []
    for text in texts:
        _, _, data, offs = next(T.slices(pa.array([text])))
        found = T.Words(data, offs)
        grams.append(T.shingle_hashes(found.hashes(), found.row, 5, short=False)[0])
    spans = [[{"start": s, "end": s + 50} for s in range(0, len(g), 16)] for g in grams]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), pa.array(texts)], ["sig", "spans", "text"])
    made = list(substring_dedup._span_tokens(5)(iter([batch])))
    assert len(made) == 1
    got = {(r["sig"], r["start"], r["end"]): r["tokens"] for b in made for r in b.to_pylist()}
    assert got == {(k, s["start"], s["end"]): g[s["start"] : s["end"]].tobytes() for k, (g, own) in enumerate(zip(grams, spans, strict=True)) for s in own}
    fields = {"key": pa.int64(), "c": pa.int32(), "left": pa.int32(), "right": pa.int32(), "f": pa.int32()}
    windows = [[{"key": 7, "c": c, "left": min(c, 30), "right": min(len(g) - 1 - c, 20), "f": 1} for c in range(0, len(g), 9)] for g in grams]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(windows, pa.list_(pa.struct(fields))), pa.array(texts)], ["sig", "windows", "text"])
    made = list(substring_dedup._contents(5, 11)(iter([batch])))
    assert len(made) == 1
    for r in (r for b in made for r in b.to_pylist()):
        lo, g = r["c"] - r["pivot"], grams[r["sig"]]
        assert lo == max(0, r["c"] - r["left"] - 11) and r["tokens"] == g[lo : r["c"] + r["right"] + 12].astype(np.uint32).tobytes()


def test_passages_of_a_part_come_joined():
    """Of 30 copies compared in one part each comes once, with one root, not once a pair; spans that only meet are joined, others not."""
    text = np.random.default_rng(2).integers(1 << 20, 1 << 60, 80).astype(np.uint64)
    both = [(a, b) for a in range(30) for b in range(a + 1, 30)]
    a, b = (pa.array(x, pa.int64()) for x in zip(*both, strict=True))
    whole = {c: pa.array([n] * len(both), pa.int64()) for c, n in (("sa", 0), ("ea", 80), ("sb", 0), ("eb", 80))}
    pairs = pa.table({"a": a, "b": b, **whole, "rep_a": a, "rep_b": b})
    tokens = pa.table({"sig": pa.array(range(30), pa.int64()), "start": pa.array([0] * 30, pa.int64()), "tokens": pa.array([text.tobytes()] * 30, pa.binary())})
    rows = substring_dedup._verify(46, 75)((), pairs, tokens).to_pylist()
    assert len(rows) == 30 and {(r["first"], r["end"]) for r in rows} == {(0, 84)} and len({r["root"] for r in rows}) == 1
    spans = np.array([(2, 5, 9), (1, 0, 4), (1, 9, 12), (1, 2, 9), (2, 0, 4)]).T
    assert [x.tolist() for x in substring_dedup._united(*spans)] == [[1, 2, 2], [0, 0, 5], [12, 4, 9]]
    assert [x.tolist() for x in substring_dedup._united(*np.zeros((3, 0), np.int64))] == [[], [], []]


def near_copies_of_one_pivot(n, seed=3):
    """Windows (shingles, pivot's place) of near copies with none to two edits each, and of runs of one shingle of several lengths, that share a pivot."""
    rng = np.random.default_rng(seed)
    source = rng.integers(1 << 20, 1 << 32, 113)
    rows = []
    for k in range(n):
        x = source.copy()
        for at in rng.integers(0, 108, k % 3):
            if not at <= 56 < at + 5:
                x[at : at + 5] = rng.integers(1 << 20, 1 << 32, 5)
        rows.append((x, 56))
    for k in range(n // 4):
        junk = rng.integers(1 << 20, 1 << 32, 22)
        rows.append((np.concatenate([junk[:11], np.full(50 + k % 30, source[56]), junk[11:]]), 11 + k % 7))
    return rows


def test_links_of_a_group_grow_with_its_windows():
    """Links of a large group of near copies are a few a window, not all pairs, and lead to all that all pairs lead to."""
    made = []
    for n in (64, 256):
        rows = near_copies_of_one_pivot(n)
        size = [len(x) for x, _ in rows]
        cols = {"key": [7] * len(rows), "sig": range(len(rows)), "c": [100] * len(rows), "left": [p for _, p in rows], "right": [len(x) - 1 - p for x, p in rows], "f": [0] * len(rows), "pivot": [p for _, p in rows]}
        table = pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()} | {"tokens": pa.array([x.astype(np.uint32).tobytes() for x, _ in rows], pa.binary())})
        links = substring_dedup._content_links(46, 75, 24, (16, 8, 64))((), table)
        a, b = (x.tolist() for x in substring_dedup._unpacked(1, links)[:2])
        made.append(len(set(zip(a, b))))
        assert made[-1] <= 5 * len(rows) and len(size) == len(rows)
        if n == 64:
            grams = [x.astype(np.uint64) for x, _ in rows]
            found = {(i, j): runs for i in range(len(rows)) for j in range(i + 1, len(rows)) if (runs := substring_dedup.shared_runs(grams[i], grams[j], 46, 75))}

            def held(pairs):
                out = [set() for _ in rows]
                for i, j in pairs:
                    for f, g, p, q in found[i, j]:
                        out[i] |= {f + x for x in np.flatnonzero(np.isin(grams[i][f:g], grams[j][p:q])).tolist()}
                        out[j] |= {p + x for x in np.flatnonzero(np.isin(grams[j][p:q], grams[i][f:g])).tolist()}
                return out, linked(len(rows), pairs)

            assert held(set(zip(a, b)) & set(found)) == held(set(found))
    assert made[1] <= 5 * made[0]


def test_words_near_the_end_of_a_passage_belong_to_it():
    """A stretch with similarity 0.75 is found to its last shared shingle, and by many pairs at a time as by each alone."""
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(12):
        x = rng.integers(1 << 20, 1 << 60, 120)
        y = x.copy()
        y[95:100] = rng.integers(1 << 20, 1 << 60, 5)
        y[:k] = rng.integers(1 << 20, 1 << 60, k)
        assert substring_dedup.shared_runs(x.astype(np.uint64), y.astype(np.uint64), 46, 75) == [(k, 120, k, 120)]
        code = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        x, y = code[:120], code[120:]
        pairs.append((k, substring_dedup._Pair(x, y, substring_dedup._previous(x), substring_dedup._previous(y), np.zeros(240, np.int64))))
    assert dict(substring_dedup._runs_of_pairs(iter(pairs), 46, 75)) == {k: [(k, 120, k, 120)] for k in range(12)}
