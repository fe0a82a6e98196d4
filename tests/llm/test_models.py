"""Operators 1, 2 and 3: quality ranking, language model, preference formatting."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.llm import maxent_lm, preference, quality, queries
from ratewise.llm.common import remainder
from tests.llm.conftest import LONG, ODD

MEDIUM = "/root/testdata/sf0.01"


def held(doc_id, divisor, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == rest


def test_quality_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.op1_quality_ranking(spark, MEDIUM).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    for part in (True, False):
        own = [(rows[i], q) for i, q in labels.items() if rows[i].held_out == part]
        assert sum(r.predicted == q for r, q in own) / len(own) >= 0.95
        wins = [a.score > b.score for a, p in own for b, q in own if p == 1 and q == 0]
        assert sum(wins) / len(wins) >= 0.98


def test_quality_ignores_ids_and_other_columns(spark, documents):
    labels = quality.training_labels(spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    model = quality.fit(quality.feature_table(spark.read.parquet(f"{MEDIUM}/documents.parquet")), labels)
    x = np.array([quality.features(t) for t in ("", "words in a line.", "WORDS!! IN!! CAPS!!")])
    assert (model.score(x) == model.score(x)).all() and model.score(x)[2] < quality.DECISION
    assert quality.features("abc abc").shape == (quality.FEATURES,)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 0), (6, 1), (3, 0), (None, 1), (5, None), (99, 1)],
                                   "doc_id long, label int")
    rows = quality.score_documents(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.score, r.predicted))
    assert by[1] == by[6] and len(by[5]) == 1 and by[2] == by[3]
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.predicted)
    assert quality.score_documents(none, labels).collect() == []
    same = quality.score_documents(odd, labels.where("label = 1")).collect()
    assert {r.score for r in same} == {quality.NEUTRAL} and {r.predicted for r in same} == {1}


def test_block_pairs_meet_every_row():
    rng = np.random.default_rng(0)
    for share in (0.02, 0.3, 0.9):
        label = (rng.random(300) < share).astype(int)
        a, b = quality.block_pairs(label)
        assert set(a) | set(b) == set(range(300)) and (label[a] == 1).all() and (label[b] == 0).all()
    assert len(quality.block_pairs(np.ones(5))[0]) == 0


@pytest.fixture(scope="module")
def rare_bad(spark):
    """Features and labels of sf0.01 documents of which 2 in 1,000 are bad."""
    table = quality.feature_table(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    marked = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    bad = sorted(r.doc_id for r in marked.where("label = 0").collect())[:2]
    return table, marked.where((F.col("label") == 1) | F.col("doc_id").isin(bad))


def test_every_labelled_row_is_compared(spark, rare_bad, monkeypatch):
    """Several blocks, hardly any bad rows: each block holds both kinds, and few rows are added."""
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "SPREAD", 8)
    table, labels = rare_bad
    rows = table.join(labels, "doc_id").select("doc_id", "row_id", "label", "x")
    n, bad = rows.count(), rows.where("label = 0").count()
    blocks = -(-n // quality.BLOCK)
    assert bad == 2 and blocks > 10
    got = quality.deal(rows, blocks, bad, n - bad).collect()
    assert {(r.doc_id, r.label) for r in got} == {(r.doc_id, r.label) for r in rows.collect()}
    assert len(got) <= n + 8 * blocks + bad
    for block in range(blocks):
        own = [r for r in got if r.block == block]
        assert {r.label for r in own} == {0, 1}
        a, b = quality.block_pairs(np.array([r.label for r in own]))
        assert set(a) | set(b) == set(range(len(own)))


def test_ranking_equals_brute_force(spark, rare_bad, monkeypatch):
    """Loss, gradient, Newton steps and threshold in plain numpy, pair by pair."""
    monkeypatch.setattr(quality, "BLOCK", 64)
    table, labels = rare_bad
    model = quality.fit(table, labels)
    rows = table.join(labels, "doc_id").select("doc_id", "row_id", "label", "x")
    n = rows.count()
    one = {r.doc_id: (np.frombuffer(r.x, np.float32).astype(float), r.label) for r in rows.collect()}
    x = np.array([v for v, _ in one.values()])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    pairs = []
    dealt = quality.deal(rows, -(-n // quality.BLOCK), 2, n - 2).select("block", "row_id", "doc_id", "label").collect()
    for block in sorted({r.block for r in dealt}):
        own = sorted((r.row_id, r.label, r.doc_id) for r in dealt if r.block == block)
        for a, b in zip(*quality.block_pairs(np.array([label for _, label, _ in own]))):
            pairs.append((one[own[a][2]][0] - one[own[b][2]][0]) / scale)
    weights = np.zeros(x.shape[1])
    for _ in range(quality.STEPS):
        gradient, curve = -quality.RIDGE * weights, quality.RIDGE * np.eye(len(weights))
        for d in pairs:
            lost = 1 / (1 + math.exp(min(500, d @ weights)))
            gradient = gradient + d * lost / len(pairs)
            curve += np.outer(d, d) * (lost * (1 - lost) / len(pairs))
        step = np.linalg.solve(curve, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    assert model.weights == pytest.approx(weights, abs=1e-4)
    raw = sorted(((x - mean) / scale) @ weights)
    assert raw[1] - 1e-3 <= model.threshold <= raw[2] + 1e-3  # two bad ones: between the second and the third


def tokens(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split() + [None]


def check_counts(rows, given):
    count = Counter(w for i, t in given if not held(i, 7, 2) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    want, got = defaultdict(list), defaultdict(list)
    for i, t in given:
        own = tokens(t)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        want[i].append((held(i, 7, 2), len(own), sum(count[w] > 0 for w in own), total, base))
    for r in rows:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert math.isfinite(r.score) and r.score <= 0
    assert set(got) == set(want)
    for k in want:
        assert [x for r in sorted(got[k]) for x in r] == pytest.approx([x for r in sorted(want[k]) for x in r], rel=1e-9)


def test_language_model(spark):
    rows = queries.op2_maxent_language_model(spark, MEDIUM).collect()
    check_counts(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()])
    for part in (True, False):
        own = [r for r in rows if r.held_out == part]
        assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.05 * sum(r.n_tokens for r in own)


def test_language_model_odd_rows(odd, none, monkeypatch):
    condition = remainder(F.col("doc_id"), 7) == 2
    check_counts(maxent_lm.score_corpus(odd, condition).collect(), ODD)
    assert maxent_lm.score_corpus(none, condition).collect() == []
    untrained = maxent_lm.score_corpus(odd, F.lit(True)).collect()
    assert len(untrained) == len(ODD) and {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}


def test_rare_words_come_from_the_join(odd, monkeypatch):
    """With a tiny head nearly all counts come from the count table."""
    monkeypatch.setattr(maxent_lm, "HEAD", 5)
    monkeypatch.setattr(maxent_lm, "WORDS", 3)
    check_counts(maxent_lm.score_corpus(odd, remainder(F.col("doc_id"), 7) == 2).collect(), ODD)


def test_probabilities_of_all_words_sum_to_one(spark, documents):
    """Over the classes, over each class's nodes, and over all known words and one unknown of each tail child."""
    rows = documents.select("text")
    counts = maxent_lm.count_tokens(rows)
    model = maxent_lm.train(rows, maxent_lm.initial_model(counts))
    assert model.by_class.any() and model.by_node.any()
    known = np.array([r.token for r in counts.select("token").collect()], np.int64).view(np.uint64)
    number = {np.uint64(r.token & 0xFFFFFFFFFFFFFFFF).item(): r.n for r in counts.collect()}
    reader = maxent_lm.Reader(model)
    context = maxent_lm.token_ids("the and attion to")[:-1]
    unknown = np.arange(len(model.tail_log10), dtype=np.uint64) + np.uint64(1 << 40)
    total = 0.0
    last = np.concatenate([known, unknown])
    for lo in range(0, len(last), 20_000):
        part = last[lo:lo + 20_000]
        b = reader.read([np.append(context, w) for w in part])
        log = maxent_lm.log_probabilities(model, b)[len(context)::len(context) + 1]
        child = b.child[len(context)::len(context) + 1]
        own = np.array([number.get(w.item(), 0) for w in part])
        tail = child >= 0
        log[tail] += np.log10(own[tail] + 1) - model.tail_log10[child[tail]]
        total += (10 ** log).sum()
    assert total == pytest.approx(1, abs=1e-4)


def softmax(logits):
    odds = [math.exp(x) for x in logits]
    return [x / sum(odds) for x in odds]


def brute_log10(model, ids, words):
    """log10 P of a text's tokens, one by one, from the tables of the trained model."""
    size, top = model.sizes, {w: k for k, w in enumerate(model.head.tolist())}
    mixed = lambda x: int(maxent_lm.mix(np.array([x % 2 ** 64], np.uint64))[0])
    total, before = 0.0, [maxent_lm.START] * 3
    for w in ids.tolist():
        one, two, three = before
        hashed = [mixed(one + 0x51), mixed(mixed(one) + two + 0x52), mixed(two + 0x5300), mixed(three + 0x540000)]
        logits = [sum(float(model.by_class[h % size.rows, k]) for h in hashed) + float(model.class_log[k])
                  for k in range(size.classes)]
        child = None
        if top.get(w, size.words) < len(model.member_class):
            klass, column = int(model.member_class[top[w]]), int(model.member_place[top[w]])
        else:
            child = w % 16 * size.children + w // 16 % size.children
            klass, column = size.head_classes + w % 16, len(model.member_class) + child
        total += math.log10(softmax(logits)[klass])
        nodes = range(model.lows[klass], model.highs[klass])
        rows = [hashed[k] >> 40 & size.word_rows - 1 for k in (0, 2)]
        logits = [sum(float(model.by_node[r, c]) for r in rows) + float(model.node_log[c]) for c in nodes]
        total += math.log10(softmax(logits)[column - nodes[0]])
        if child is not None:
            total += math.log10(words[w] + 1) - float(model.tail_log10[child])
        seen = w if top.get(w, size.context) < size.context else 2 + w % 16
        before = [seen, one, two]
    return total


def test_scores_equal_brute_force_of_the_model(spark, monkeypatch):
    """Token by token over all classes and nodes; with a tiny head nearly all counts come from the join."""
    given = [(i, t) for i, t in ODD if t is None or len(t) < 1000] + [(10 + i, "the fox and the dog ran") for i in range(5)]
    rows = maxent_lm.identified(spark.createDataFrame(given, "doc_id long, text string")) \
        .withColumn("held_out", F.lit(False))
    ids = [maxent_lm.token_ids(t) for _, t in given]
    words = Counter(w for t in ids for w in t.tolist())
    for head, own in ((5, 3), (1 << 16, 3), (1 << 16, 1024)):
        monkeypatch.setattr(maxent_lm, "HEAD", head)
        monkeypatch.setattr(maxent_lm, "WORDS", own)
        counts = maxent_lm.count_tokens(rows)
        model = maxent_lm.train(rows, maxent_lm.initial_model(counts))
        assert model.by_class.any()
        want = sorted((-1 if i is None else i, brute_log10(model, t, words)) for (i, _), t in zip(given, ids))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in maxent_lm.score(rows, model, counts).collect())
        assert [x for r in got for x in r] == pytest.approx([x for r in want for x in r], rel=1e-4)


def test_model_grows_with_the_vocabulary():
    small, large, huge = (maxent_lm.sizes(n) for n in (0, 1 << 23, 10 ** 10))
    assert small == maxent_lm.sizes(maxent_lm.VOCABULARY)
    for a, b in ((small, large), (large, huge)):
        assert b.context >= a.context and b.words > a.words and b.rows > a.rows and b.children > a.children
        assert b.classes > a.classes and b.word_rows >= a.word_rows
    weights = huge.rows * huge.classes + huge.word_rows * (huge.words + 16 * huge.children)
    assert weights * 4 < 2 ** 30


def test_gain_comes_from_the_trained_weights(spark):
    """With zero weights the model is a unigram model; the weights tell texts of equal words apart by their order."""
    rows = [(i, "zorkab blipab quuxab flamab") for i in range(40)] + [(100, "zorkab blipab quuxab flamab"),
                                                                      (101, "blipab zorkab flamab quuxab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in maxent_lm.score_corpus(df, F.col("doc_id") >= 100).collect()}
    assert by[100].base_score == pytest.approx(by[101].base_score)
    assert by[100].score > by[101].score + 0.5


def test_language_model_ignores_extra_columns(spark, documents):
    condition = remainder(F.col("doc_id"), 7) == 2
    clash = documents.select("doc_id", "text", F.lit("x").alias("rare"), F.lit(1).alias("row_id"),
                             F.lit("y").alias("token"), F.lit(2).alias("n"), F.lit(None).alias("no_id"))
    got, want = (sorted(tuple(r)[:6] for r in maxent_lm.score_corpus(d, condition).collect())
                 for d in (clash, documents.select("doc_id", "text")))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def test_lookup():
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(32, 2 ** 63, 5000, dtype=np.uint64))
    rng.shuffle(ids)
    find = maxent_lm.Lookup(ids)
    assert (find(ids) == np.arange(len(ids))).all()
    assert (find(ids + np.uint64(1))[~np.isin(ids + np.uint64(1), ids)] == -1).all()
    assert maxent_lm.Lookup(ids[:0])(ids).max() == -1


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def mask(turns):
    out = []
    for r, t in turns:
        out += [(len(f"<|{r or ''}|>\n"), False), (len(t or "") + 8, r == "assistant")]
    return out


def test_preference_pairs(spark):
    rng = random.Random(11)
    say = lambda: rng.choice(["hi", "", None, "çé 漢", "a\nb"])
    sides = {}
    for p in range(60):
        common = [(rng.choice(["user", "assistant", "system", None]), say()) for _ in range(rng.randint(0, 4))]
        sides[p] = [common + [(rng.choice(["user", "assistant"]), say()) for _ in range(rng.randint(0, 3))] for _ in "ab"]
    frames = [spark.createDataFrame([(p, k, r, t, "x") for p, s in sides.items() for k, (r, t) in enumerate(s[side])],
                                    "pair_id long, turn long, role string, text string, prompt string").repartition(3)
              for side in (0, 1)]
    got = {r.pair_id: r for r in preference.format_pairs(*frames).collect()}
    assert set(got) == {p for p, s in sides.items() if s[0] and s[1]}
    for p, r in got.items():
        c, j = ([(x or "", t or "") for x, t in side] for side in sides[p])
        n = 0
        while n < min(len(c), len(j)) and c[n] == j[n]:
            n += 1
        assert (r.prompt_turns, r.chosen_turns, r.rejected_turns) == (n, len(c) - n, len(j) - n)
        assert (r.prompt, r.chosen, r.rejected) == (render(c[:n]), render(c[n:]), render(j[n:]))
        assert [tuple(x) for x in r.chosen_mask] == mask(c[n:]) and [tuple(x) for x in r.rejected_mask] == mask(j[n:])
        assert sum(x.characters for x in r.chosen_mask) == len(r.chosen)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", MEDIUM])
def test_preference_query_equals_sql(spark, folder):
    got = sorted(tuple(r) for r in queries.op3_preference_formatting(spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    assert got == sorted(tuple(r) for r in con.execute(preference.ORACLE).fetchall()) and got


def brute_swaps(rows):
    """conv_id -> (chosen turns, rejected turns) of rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {k: [t[2:] for t in sorted(v)] for k, v in sorted(convs.items())}
    last = {k: max(i for i, t in enumerate(v) if t[0] == "assistant") for k, v in convs.items() if any(t[0] == "assistant" for t in v)}
    order = list(last)
    out = {}
    for k, v in convs.items():
        if k not in last:
            out[k] = v, v
            continue
        after = order[(order.index(k) + 1) % len(order)]
        out[k] = v, [*v[:last[k]], ("assistant", convs[after][last[after]][1])]
    return out


def check_swaps(df, rows):
    got = {r.pair_id: r for r in preference.format_sides(preference.swapped_replies(df)).collect()}
    want = brute_swaps(rows)
    assert set(got) == set(want)
    for k, (c, j) in want.items():
        n = 0
        while n < min(len(c), len(j)) and c[n] == j[n]:
            n += 1
        r = got[k]
        assert (r.prompt_turns, r.chosen_turns, r.rejected_turns) == (n, len(c) - n, len(j) - n)
        assert (r.prompt, r.chosen, r.rejected) == (render(c[:n]), render(c[n:]), render(j[n:]))
        assert [tuple(x) for x in r.chosen_mask] == mask(c[n:]) and [tuple(x) for x in r.rejected_mask] == mask(j[n:])
    return got


def test_preference_odd_rows(spark):
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", None, None), (1, 2, "user", "more", None),
            (2, 0, "user", LONG, None), (2, 0, "user", LONG, None), (2, 1, "assistant", "b", None),
            (2, 1, "assistant", "a", None), (3, 0, "assistant", "b", None), (4, None, "assistant", "b", None),
            (5, 0, None, None, None), (None, 0, "assistant", "x", None), (6, 0, "assistant", "", None), (6, 0, "user", "z", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last string")
    got = check_swaps(df, [r[:4] for r in rows])
    # trailing turns stay on the chosen side; equal replies are prompt; no reply: all prompt
    assert got[1].prompt == render([("user", "q")]) and got[1].chosen == render([("assistant", ""), ("user", "more")])
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt_turns == 4
    assert got[5].prompt_turns == 1 and got[5].chosen == got[5].rejected == ""
    assert preference.format_sides(preference.swapped_replies(df.limit(0))).collect() == []


def test_preference_gives_every_conversation_a_row(spark):
    """Sparse ids over several ranges, conversations without a reply between them, the last followed by the first."""
    rng = random.Random(3)
    rows = [(conv * 10 ** 6 + 7, turn, rng.choice(["user", "assistant", "assistant", "system"]), f"{conv}.{turn}")
            for conv in range(400) for turn in range(rng.randint(1, 4))]
    rows += [(10 ** 17, 0, "user", "no reply"), (10 ** 17 + 5, 0, "assistant", "the last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    check_swaps(df, rows)
    one = [(10, 0, "user", "a"), (10, 1, "assistant", "b")]
    check_swaps(spark.createDataFrame(one, df.schema), one)


def test_preference_is_native(spark):
    plan = queries.op3_preference_formatting(spark, MEDIUM)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
