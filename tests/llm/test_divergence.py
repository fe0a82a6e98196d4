"""Operator 13: run-length columns against a plain sum over the vocabulary."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from ratewise.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    """All terms of all pairs, in Python integers."""
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        sources = [s for name, s in counts if name == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + (10 ** 9 * (count[t] + 5)) // (total + 5 * len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def result(df, **given):
    out = dv.divergence(df, **given)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in out.collect())


def test_divergence_equals_plain_sums(spark, documents):
    rows = [(r.lang, r.source, r.text) for r in documents.collect()]
    assert result(documents, min_docs=3, top=5) == brute(rows, 3, 5)


def test_divergence_odd_rows(spark, odd, none):
    given = [("xx", None, None), (None, "b", "Ab aB É É-é"), (None, "a", "ab É ab"), ("", "c", ""), ("one", "x", "lone ab"),
             (None, "b", "zz ÉÉ " * 5000), (None, "b", "Ab aB É É-é"), ("no", "p", "1 2 3"), ("no", "q", None)]
    df = spark.createDataFrame(given, "lang string, source string, text string").selectExpr(
        "*", "1 as n", "2 as place", "3 as term", "4 as block", "5 as total")
    assert result(df, min_docs=2, top=3) == brute(given, 2, 3)
    assert {r[:3] for r in result(df, min_docs=2)} >= {("no", "p", "pair"), ("no", "q", "pair")}
    assert result(df.limit(0)) == []


def test_many_sources_use_several_blocks_and_slices(spark, monkeypatch):
    """More sources than a block and more terms than a slice, one hot source."""
    monkeypatch.setattr(dv, "SLICE", 8)
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [("l", f"s{0 if k % 3 else k % 80}", " ".join(rng.choice(words, 12))) for k in range(400)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert len({r[1] for r in rows}) > dv.BLOCK
    assert result(df, min_docs=2, top=4) == brute(rows, 2, 4)


def test_runs_are_shorter_than_the_vocabulary():
    rng = np.random.default_rng(1)
    table = rng.poisson(0.4, (5000, 3))
    ordered = dv.clustered(table)
    runs = [dv.Runs(ordered[:, k], 6000, int(table[:, k].sum()), 6000) for k in range(3)]
    assert all(len(r.starts) < 600 for r in runs)
    whole = [dv.shares(np.append(table[:, k], np.zeros(1000, int)), int(table[:, k].sum()), 6000) for k in range(3)]
    assert runs[0].distance(runs[2]) == runs[2].distance(runs[0]) == int(np.abs(whole[0] - whole[2]).sum())


def test_shares_are_exact_for_large_counts():
    count = np.array([0, 7, 10 ** 12, 10 ** 15])
    total, size = 3 * 10 ** 15 + 7, 10 ** 9
    assert dv.shares(count, total, size).tolist() == [1 + (10 ** 9 * (int(c) + 5)) // (total + 5 * size) for c in count]
