"""Operator 12: pointer jumping against the common ends of the tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ratewise.llm import alignment, bpe
from ratewise.llm.common import materialise
from tests.llm.conftest import ODD


def library():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_groups(text, a, b):
    """Groups of (A ids, B ids) from the sets of ends, by walking both sides."""
    if not text:
        return []
    whole = (" " + text).encode()
    byte_of = bpe._byte_of_char()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    out, group, i, j, at, bt = [], ([], []), 0, 0, 0, 0
    while i < len(a_ids) or j < len(b_ids):
        if at <= bt and i < len(a_ids) and not (at == bt and group[0]):
            at += len(a_bytes[i])
            group[0].append(a_ids[i])
            i += 1
        else:
            bt += len(b_bytes[j])
            group[1].append(b_ids[j])
            j += 1
        if at == bt and group[1]:
            out.append(group)
            group = ([], [])
    return out


def brute(rows):
    """The contract's rows by counting everything in one place."""
    a, b = library()
    groups = [brute_groups(t, a, b) for _, t in rows]
    count = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    highest = defaultdict(int)
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    out = []
    for (doc_id, _), g in zip(rows, groups):
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(count[k] == highest[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    out = alignment.align(df)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_alignment_of_all_documents(documents, texts, monkeypatch):
    assert result(documents) == brute([(k, t) for k, t in texts.items()])


def test_alignment_odd_rows(spark, odd, none, monkeypatch):
    assert result(odd) == brute([(k, t) for k, t in ODD])
    assert result(none) == []
    more = [(1, "▁ is a block"), (2, "<0x41> <s> <unk> <|endoftext|>"), (3, "\x00\x01 \r\n\t"), (None, "éﬁ \U0001f469‍\U0001f4bb"),
            (4, "  leading"), (5, "�﻿"), (6, "a" * 4000), (2, "same <s>"), (2, "same <s>"), (7, " 　 x")]
    assert result(spark.createDataFrame(more, "doc_id long, text string")) == brute(more)


def test_counts_are_corpus_wide_over_blocks(documents, texts, monkeypatch):
    """Blocks of a few documents give the same counts."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    blocks = alignment.aligned_blocks(documents, bpe.default_path(), alignment.default_pieces())
    from pyspark.sql import functions as F
    assert blocks.count() > 20
    assert blocks.agg(F.sum(F.size("doc_ids"))).first()[0] == len(texts)


def test_blocks_are_bounded(spark, documents, texts):
    """No row of a block is longer than the limit and its last document; rows without text fill blocks too."""
    paths = bpe.default_path(), alignment.default_pieces()
    b = library()[1]
    most = max(len(b.encode(t)) for t in texts.values() if t) * 4
    rows = alignment.aligned_blocks(documents, *paths).toPandas()
    held = [sum(len(r[c] or b"") for c in ("links", "pairs", "times")) + alignment._DOC_BYTES * len(r.doc_ids)
            for _, r in rows.iterrows()]
    assert max(held) <= alignment.ROW_BYTES + alignment._DOC_BYTES + most and max(held) >= alignment.ROW_BYTES // 2
    blank = spark.createDataFrame([(i, None) for i in range(20_000)], "doc_id long, text string").coalesce(1)
    found = alignment.aligned_blocks(blank, *paths).groupBy("block").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(found) > 1 and sum(r.n for r in found) == 20_000
    assert {tuple(r)[1:] for r in alignment.align(blank).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_blocks_are_written_in_short_row_groups(spark):
    """The writer and the reader of blocks hold a few MB of long rows at once."""
    import pyarrow.dataset as ds
    long = spark.range(0, 48, 1, 1).select("id", F.expr("unhex(repeat(sha2(CAST(id AS string), 256), 1 << 15))").alias("links"))
    written = materialise(long.withColumn("links", F.expr("aes_encrypt(links, '0123456789abcdef')")), "test-rows", **alignment._FILES)
    sizes = [g.total_byte_size for f in written.inputFiles() for d in ds.dataset(f.removeprefix("file://")).get_fragments()
             for g in d.row_groups]
    assert written.count() == 48 and max(sizes) < 16 << 20


def test_wide_places(spark, documents, texts, monkeypatch):
    """Blocks whose lists of pairs are longer than two bytes can count; rows of one document each."""
    monkeypatch.setattr(alignment, "_places", lambda n_pairs: "<u4")
    monkeypatch.setattr(alignment, "ROW_BYTES", 64)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 5000)
    some = documents.limit(40)
    assert result(some) == brute([(r.doc_id, r.text) for r in some.collect()])


def test_terminals_on_random_splits():
    """Doubling reaches the last token of each component; a long chain without a common end too."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 400):
        for _ in range(20):
            cuts = [np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for p in rng.random(2)]
            a_last, b_last = alignment.terminals(*cuts)
            common = np.intersect1d(*cuts)
            for ends, last in zip(cuts, (a_last, b_last)):
                assert (cuts[1][last] == common[np.searchsorted(common, ends, "left")]).all()
    n = 1 << 16
    odd_even = alignment.terminals(np.append(np.arange(1, n, 2), n), np.append(np.arange(2, n, 2), n))
    assert (odd_even[0] == odd_even[1][-1]).all() and (odd_even[1] == odd_even[1][-1]).all()


def test_groups_of_a_text():
    groups = alignment.group_texts("unbelievable tokenization")
    assert b"".join(t for a, _ in groups for t in a) == b" unbelievable tokenization"
    assert all(b"".join(a) == b"".join(b) for a, b in groups) and len(groups) >= 2
