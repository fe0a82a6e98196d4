"""Operators 4, 6, 7 and 8: decontamination, near duplicates, fingerprints, line dedup."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from ratewise.llm import components, decontam, line_dedup, minhash, queries, winnowing, words
from tests.llm.conftest import LONG, ODD


def ascii_lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def test_word_hashes_tell_words_apart(texts):
    known = {}
    for text in [*texts.values(), LONG * 2, "A\x0bB\x0cC\x85D E  ", "Äa äa"]:
        found = words.word_hashes(words.lowered(text)).tolist()
        split = ascii_lower(text).split()
        assert len(found) == len(split)
        for w, h in zip(split, found):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def shingle_set(text, k):
    w = ascii_lower(text).split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    """(number of shingles, component) of each row of (doc_id, text)."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            inverted[x].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter((doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows))


def found_components(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_near_duplicate_query(spark, sf_dir, texts):
    assert found_components(queries.op6_minhash_near_dedup(spark, sf_dir)) \
        == brute_components(list(texts.items()), 3, 85)


def test_near_duplicates_of_a_large_varied_group(spark):
    """Variants of one text whose links don't all pass its first member, over several blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(3 * minhash.BLOCK):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(10_000 + i, " ".join(base[:40] + [f"u{i}x{j}" for j in range(60)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found_components(minhash.near_duplicates(df, minhash.Similarity(words=3, percent=85)))
    assert got == brute_components(rows, 3, 85)
    assert 1 < len({c for _, _, c in got}) < len(rows)


def test_long_lists_are_split(documents, texts, monkeypatch):
    want = brute_components(list(texts.items()), 3, 85)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SHARE", 2)
    monkeypatch.setattr(minhash, "SAMPLE", 3)
    assert found_components(minhash.near_duplicates(documents, minhash.Similarity(words=3, percent=85))) == want


def test_lists_of_common_passages_are_split(spark, monkeypatch):
    """Texts of three passages each, which many others have too, and a few near copies."""
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(300)]
    rows = []
    for i in range(3000):
        text = " ".join(passages[k] for k in rng.sample(range(300), 3))
        rows.append((2 * i, text))
        if i % 50 == 0:
            rows.append((2 * i + 1, text.replace(f"w{i % 30}", "x", 1)))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    s = minhash.Similarity(words=5, percent=80)
    seen = []
    real, open_ = minhash._block_links, minhash._open
    longest = lambda lists: lists.agg(F.max("n")).first()[0] or 0
    monkeypatch.setattr(minhash, "_block_links", lambda lists, *rest: seen.append(longest(lists)) or real(lists, *rest))
    before = []

    def opened(*given):
        out = open_(*given)
        before.append(longest(out))
        return out

    monkeypatch.setattr(minhash, "_open", opened)
    found = found_components(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), s))
    assert found == brute_components(rows, 5, 80)
    # long lists were there, some were split, and their parts are short
    assert max(before) > 2 * 8 and len(seen) > 1 and max(seen[1:]) <= 8


def test_near_duplicates_odd_rows(odd, none):
    s = minhash.Similarity(words=5, percent=80)
    assert found_components(minhash.near_duplicates(odd, s)) == brute_components(ODD, 5, 80)
    assert minhash.near_duplicates(none, s).collect() == []


def test_least_matches_misses_almost_nothing():
    from math import comb
    for words_, percent in ((3, 85), (5, 80)):
        s = minhash.Similarity(words_, percent)
        t = percent / 100
        missed = sum(comb(s.coordinates, k) * t ** k * (1 - t) ** (s.coordinates - k) for k in range(s.least_matches))
        assert missed < 1e-4


def test_least_matches_keeps_the_exact_tail_at_what_is_stated():
    from fractions import Fraction
    from math import comb
    for percent in (50, 80, 85, 95, 100):
        s, t = minhash.Similarity(3, percent), Fraction(percent, 100)
        tail = lambda m: sum(comb(40, k) * t ** k * (1 - t) ** (40 - k) for k in range(m))
        assert tail(s.least_matches) <= 1e-6 or s.least_matches == 1
        assert s.least_matches == 40 or tail(s.least_matches + 1) > 1e-6


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for u, v in links if u != v for x in (u, v)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_winnow(hashes, window):
    if not hashes:
        return []
    out, width = set(), min(window, len(hashes))
    for i in range(len(hashes) - width + 1):
        least = min(hashes[i:i + width])
        out.add(max(j for j in range(i, i + width) if hashes[j] == least))
    return sorted(out)


def test_winnow_takes_the_rightmost_minimum():
    rng = random.Random(6)
    for _ in range(200):
        n, top = rng.choice([0, 1, 2, 5, 24, 25, 60, 200]), rng.choice([3, 2 ** 32 - 1])
        h = [rng.randint(0, top) for _ in range(n)]
        assert winnowing.winnow(np.array(h, np.uint64), 24).tolist() == brute_winnow(h, 24)


def test_grams_roll():
    points = winnowing.code_points("abcabcabdefgabcabcabdeéf漢gab" * 3)
    for k in (1, 2, 3, 5, 7, 8, 16, 20, 31):
        got = winnowing.gram_hashes(points, k)
        by = defaultdict(set)
        for i, h in enumerate(got.tolist()):
            by[points[i:i + k].tobytes()].add(h)
        assert len(got) == len(points) - k + 1 and len(by) == len(set().union(*by.values()))


def test_shared_runs_leave_common_fingerprints(texts):
    some = list(texts.values())
    n = winnowing.WINDOW + winnowing.K - 1
    for a, b in zip(some[:50], some[50:100]):
        a, b = winnowing.Fingerprint(winnowing.code_points(a + "#" * 7 + LONG[:n])), \
            winnowing.Fingerprint(winnowing.code_points(LONG[:n] + b))
        assert np.intersect1d(a.distinct, b.distinct).size


def check_fingerprints(rows, given):
    order = sorted(given, key=lambda r: -r[0])
    prints = lambda t: winnowing.Fingerprint(winnowing.code_points(t))
    wanted = {}
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 2
        new = text[:len(text) - cut] + after[:cut]
        wanted[doc_id] = (len(text), hashlib.sha256(new.encode()).hexdigest(), str(prints(text)), str(prints(new)),
                          prints(text).likeness(prints(new)), prints(text).likeness(prints(after)))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
           for r in rows}
    assert len(rows) == len(given) and got == wanted


def test_fingerprint_query(spark, sf_dir, texts):
    check_fingerprints(queries.op7_winnowing_fingerprints(spark, sf_dir).collect(), list(texts.items()))


def test_fingerprints_odd_rows(spark, odd, none):
    plain = [r for i, r in enumerate(ODD) if r[0] is not None and i != 6]
    rows = spark.createDataFrame(plain, "doc_id long, text string")
    check_fingerprints(winnowing.edited_fingerprints(rows).collect(), plain)
    one = spark.createDataFrame([(9, "alone in the table with a text")], "doc_id long, text string")
    check_fingerprints(winnowing.edited_fingerprints(one).collect(), [(9, "alone in the table with a text")])
    assert len(winnowing.edited_fingerprints(odd).collect()) == len(ODD)
    assert winnowing.edited_fingerprints(none).collect() == []
    prints = Counter((r.doc_id, r.n_chars) for r in winnowing.fingerprints(odd).collect())
    assert prints == Counter((i, len(t or "")) for i, t in ODD)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, max_edits, min_chars):
    """Kept lines of each row of (doc_id, text); ids distinct or rows equal."""
    first = {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (doc_id is None, doc_id or 0, pos))
    names = sorted((x for x in first if len(x) >= min_chars), key=first.get)
    late = {b for i, b in enumerate(names) for a in names[:i]
            if abs(len(a) - len(b)) <= max_edits and distance(a, b) <= max_edits}
    out = Counter()
    for doc_id, text in rows:
        if text is None:
            out[doc_id, None, 0, 0, None] += 1
            continue
        lines = text.split("\n")
        new = [x not in late and first.get(x) == (doc_id is None, doc_id or 0, pos) for pos, x in enumerate(lines)]
        kept = [x for x, n in zip(lines, new) if n or not x.strip(" ")]
        out[doc_id, "\n".join(kept), len(lines), len(kept), sum(new) if text.replace("\n", "").strip(" ") else None] += 1
    return out


def found_lines(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", *df.columns[-3:]).collect())


def test_probes_reach_every_match():
    """Any line within the edits of another holds a segment of it at a probed place."""
    rng = random.Random(7)
    for edits in (0, 1, 2, 3):
        combos = line_dedup.probes(edits)
        for _ in range(400):
            a = "".join(rng.choices("ab", k=rng.randint(8, 16)))
            b = a
            for _ in range(edits):
                p = rng.randrange(len(b))
                b = rng.choice([b[:p] + rng.choice("ab") + b[p + 1:], b[:p] + b[p + 1:], b[:p] + rng.choice("ab") + b[p:]])
            a, b = sorted((a, b), key=len)
            parts = edits + 1
            assert any(0 <= (s := len(a) * i // parts + shift) and
                       b[s:s + len(a) * (i + 1) // parts - len(a) * i // parts] == a[len(a) * i // parts:len(a) * (i + 1) // parts]
                       for less, i, shift in combos if less == len(b) - len(a))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcde ", k=rng.randint(10, 24))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                p = rng.randrange(len(x))
                x = rng.choice([x[:p] + rng.choice("abcdeé") + x[p + 1:], x[:p] + x[p + 1:], x[:p] + "z" + x[p:]])
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for edits in (0, 1, 2):
        assert found_lines(line_dedup.dedup_lines(df, edits, 10)) == brute_lines(rows, edits, 10)


def test_banded_distance(spark):
    """The bit-parallel distance against the plain table, for bands of one, two and three edits."""
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = b = "".join(rng.choices("abé漢\U0001f600", k=rng.randint(4, 40)))
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(b))
            b = rng.choice([b[:p] + rng.choice("abx") + b[p + 1:], b[:p] + b[p + 1:] if len(b) > 4 else b, b[:p] + "z" + b[p:]])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        rows = df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), most).alias("n")).collect()
        for r in rows:
            if abs(len(r.a) - len(r.b)) <= most:
                want = distance(r.a, r.b)
                assert (r.n == want) if want <= most else (r.n > most), (r, want)


def test_line_index_code_is_compiled(spark, tmp_path, capsys):
    """No generated method of the segment index is over the 8,000 bytes beyond which the JVM interprets it."""
    spark.range(8).select(F.col("id").alias("h1"), F.repeat(F.lit("ab"), 20).alias("line")).write.parquet(str(tmp_path / "lines"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup._near(spark.read.parquet(str(tmp_path / "lines")), line_dedup.MAX_EDITS).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_line_dedup_query(spark, sf_dir, texts):
    got = {r.doc_id: r.text for r in queries.op8_line_dedup(spark, sf_dir).collect()}
    lines = Counter(x for t in got.values() for x in t.split("\n") if x.strip(" "))
    assert set(got) == set(texts) and max(lines.values()) == 1
    before = {x for t in texts.values() for x in t.split("\n") if x.strip(" ")}
    assert all(len(x) >= line_dedup.MIN_CHARS for x in before - set(lines))
    for gone in before - set(lines):
        assert any(distance(gone, x) <= line_dedup.MAX_EDITS for x in before
                   if x != gone and abs(len(x) - len(gone)) <= line_dedup.MAX_EDITS)


def test_line_dedup_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert set(odd.columns) < set(out.columns)
    assert found_lines(out) == brute_lines(ODD, line_dedup.MAX_EDITS, line_dedup.MIN_CHARS)
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_is_native(documents):
    plan = line_dedup.dedup_lines(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def best_substring(pattern, text):
    row, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        last, row[0] = 0, 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        if row[-1] < best[0]:
            best = row[-1], j
    return best


def test_myers_distance():
    rng = random.Random(9)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab c", k=n)) for n in (rng.randint(1, 80), rng.randint(0, 90)))
        most = rng.randint(0, len(p) - 1)
        want = best_substring(p, t)
        assert decontam.Pattern(p).best_end(t, most) == (want if want[0] <= most else None)


def test_decontamination_finds_all_edits_within_budget(spark):
    rng = random.Random(10)
    letters = "abcdefghij klmno"
    items = [(i, "".join(rng.choices(letters, k=rng.choice([5, 20, 60, 200])))) for i in range(12)]
    docs = []
    for i in range(150):
        text = "".join(rng.choices(letters, k=300))
        if i % 3:
            x = decontam.normal(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(x) // decontam.PER_EDIT + 2)):
                p = rng.randrange(len(x))
                x = rng.choice([x[:p] + "z" + x[p + 1:], x[:p] + x[p + 1:], x[:p] + "é" + x[p:]])
            text = text[:150] + "  " + x.upper() + "\n" + text[150:]
        docs.append((i, text))
    want = set()
    for i, text in docs:
        for k, item in items:
            item, found = decontam.normal(item), best_substring(decontam.normal(item), decontam.normal(text))[0]
            if item and found <= len(item) // decontam.PER_EDIT:
                want.add((i, k, found))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x")], "item_id long, text string")
    rows = decontam.find_items(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == want and len(rows) == len(want)
    held = {i for i, _, _ in want}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {i for i, _ in docs} - held
    for r in rows:
        part = decontam.normal(dict(docs)[r.doc_id])[r.start:r.end]
        assert distance(part, decontam.normal(dict(items)[r.item_id])) == r.distance
    # several blocks of items give the same
    small = [b for b, _ in decontam.item_blocks(bench, block_chars=400)]
    assert len(small) > 1 and sorted(x for b in small for x in b) == sorted((i, decontam.normal(t)) for i, t in items)
    again = decontam.find_items(df, bench, block_chars=400).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in again} == want and len(again) == len(want)
    assert {r.doc_id for r in decontam.clean(df, bench, block_chars=400).collect()} == {i for i, _ in docs} - held


def test_decontamination_query(spark, sf_dir, texts):
    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.op4_benchmark_decontamination(spark, sf_dir).collect()}
    exact = {(i, k) for i, t in texts.items() for k, x in items.items() if x in decontam.normal(t)}
    assert exact <= set(got)
    for (i, k), r in got.items():
        assert distance(decontam.normal(texts[i])[r.start:r.end], items[k]) == r.distance <= decontam.budget(items[k])


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "lazy dog and runs"), (1, "lazy dog and runs"), (2, "")], "item_id long, text string")
    rows = decontam.find_items(odd, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == Counter({(1, 1): 2, (6, 1): 2})
    assert decontam.find_items(none, bench).collect() == []
    assert decontam.find_items(odd, bench.limit(0)).collect() == []
    assert decontam.clean(odd, bench.limit(0)).columns == odd.columns


@pytest.mark.parametrize("text", ["", None, "one", "one two", LONG])
def test_signatures_agree_with_their_sets(text):
    a = minhash.shingles(text, 3)
    assert len(a) == len(shingle_set(text, 3))
    assert (minhash.signature(a, 40) == minhash.signature(a[::-1], 40)).all()
