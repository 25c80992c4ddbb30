"""Small tests of the operators against brute force, and of their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


EDGE = [None, "", "   \n", "a", "a b c", "a b c", "word " * 3000, "Ünïcödé \U0001F600 日本 text\x0bend"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def test_base_score_and_better_model(spark):
    from quorum.llm import ngrams
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        docs(spark, EDGE).select(F.col("doc_id") + 10000, "text"))
    got = {r.doc_id: r for r in ngrams.scores(table).collect()}
    rows = table.collect()
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(words(r.text) + ["</s> "])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ts = words(r.text) + ["</s> "]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert g.base_score == pytest.approx(
            sum(math.log10((counts[t] + .5) / (n + .5 * (v + 1))) for t in ts), abs=1e-6)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_scores_are_of_the_whole_corpus(spark, monkeypatch):
    """Equal to brute force, up to the codes' rounding, whatever the shards and heads."""
    from quorum.llm import ngrams
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        docs(spark, EDGE).select(F.col("doc_id") + 10000, "text"))
    c1, c2, c3 = (collections.Counter() for _ in range(3))
    texts = {r.doc_id: ["<s> "] * 2 + words(r.text) + ["</s> "] for r in table.collect()}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c1.update(t[2:])
            c2.update(zip(t[1:], t[2:]))
            c3.update(zip(t, t[1:], t[2:]))
    cv, cuv, nv, nuv = (collections.Counter() for _ in range(4))
    for (v, _), c in c2.items():
        cv[v] += c
        nv[v] += 1
    for (u, v, _), c in c3.items():
        cuv[u, v] += c
        nuv[u, v] += 1
    d2, d3 = (ngrams.discount(*(sum(x == k for x in c.values()) for k in (1, 2))) for c in (c2, c3))
    norm = sum(c1.values()) + .5 * (len(c1) + 1)

    def p(u, v, w):
        out = (c1[w] + .5) / norm
        if cv[v]:
            out = max(c2[v, w] - d2, 0) / cv[v] + d2 * nv[v] / cv[v] * out
        if cuv[u, v]:
            out = max(c3[u, v, w] - d3, 0) / cuv[u, v] + d3 * nuv[u, v] / cuv[u, v] * out
        return math.log10(out)
    want = {i: sum(p(*x) for x in zip(t, t[1:], t[2:])) for i, t in texts.items()}
    for shards, heads in ((3, 1 << 18), (60, 1 << 18), (60, 64)):
        monkeypatch.setattr(ngrams, "HEADS", heads)
        got = {r.doc_id: r.score for r in ngrams.scores(table, min_shards=shards).collect()}
        assert set(got) == set(want)
        off = [abs(got[i] - x) / len(texts[i]) for i, x in want.items()]
        assert np.median(off) < 0.002 and max(off) < 0.1, (shards, heads)
        assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.002)


def test_first_tokens_are_spread_and_events_move_once(spark):
    """Of many short texts no shard holds all first tokens, and the events' exchange is reused."""
    import pyarrow as pa
    from pyspark import TaskContext
    from quorum.llm import ngrams
    heads = np.array([ngrams.END, 77], dtype=np.uint64)
    uni = ngrams.Unigrams(6000, 4000, heads, np.array([2000, 300]), 96)
    rng = random.Random(1)
    texts = [f"w{rng.random()} x{rng.random()}" for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([False] * 2000), pa.array(texts)],
                                       names=["id", "held", "t"])

    class Shared:
        value = uni
    TaskContext._taskContext, before = type("C", (), {"partitionId": lambda self: 0})(), TaskContext._taskContext
    try:
        got = pa.Table.from_batches(ngrams._events(Shared)([batch])).to_pylist()
    finally:
        TaskContext._taskContext = before
    firsts, events = [], 0
    for r in got:
        if r["shard"] >= 0:
            (v, u, w, tag), _ = ngrams._unpacked([r["data"]], uni)
            firsts.append(int((v == ngrams.START).sum()))
            events += len(w)
            assert (u[v == ngrams.START] == 0).all() and not (tag % 2).any()
    assert (sum(firsts), events) == (2000, 6000) and max(firsts) < 2000 / uni.pieces_of_start * 4
    df = ngrams.scores(docs(spark, texts[:50]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_elias_fano_round_trip():
    from quorum.llm.eliasfano import EliasFano
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1 << 60), (1000, 50), (150_000, 1 << 40)):
        x = np.sort(rng.integers(0, top, size=n, dtype=np.uint64))
        e = EliasFano.encode(x)
        assert (e.values() == x).all()
        if n:
            keys = np.unique(np.concatenate((x[::7], x[::5] + np.uint64(1))))
            at = e.find(keys)
            assert ((at >= 0) == np.isin(keys, x)).all() and (x[at[at >= 0]] == keys[at >= 0]).all()


def test_simhash_components(spark):
    from quorum.llm import simhash
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        docs(spark, EDGE).select(F.col("doc_id") + 10000, "text"))
    got = simhash.report(table).collect()
    fps = np.array([int(r.fingerprint, 16) for r in got], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = [r.doc_id for r in got]
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(got))]
        if new == label:
            break
        label = new
    assert [r.component_id for r in got] == label


def test_covering_finds_every_close_pair(spark):
    from quorum.llm import simhash
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in links:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3
        parent[find(r.a)] = find(r.b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                assert find(a) == find(b)


def test_chat_round_trip(spark):
    from quorum.llm import chat
    rows = spark.createDataFrame([
        (1, 0, "user", "[INST] <s>"), (1, 1, "assistant", "</s>\\<\\/s>[\\\\INST]"), (2, 0, None, None),
        (2, 1, "tool", "[/TEXT][ROLE]x"), (2, 1, "tool", "[/TEXT][ROLE]x"), (None, None, "assistant", "z" * 5000),
    ], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.report(chat.with_probe(spark, rows)).collect()}
    assert set(got) == {1, 2, None, -1} and got[1].valid and not got[2].valid
    assert got[2].n_turns == 3 and got[1].loss_chars == len("</s>\\<\\/s>[\\\\INST]")
    text = "user\n[INST] <s>\nassistant\n</s>\\<\\/s>[\\\\INST]\n"
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert chat.report(rows.limit(0)).count() == 0


def test_substrings_find_a_shifted_passage(spark):
    from quorum.llm import substrings
    rng = random.Random(5)
    w = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(k))
    passage = w(60)
    texts = [w(80) + " " + passage, w(33) + " " + passage + " " + w(20), w(200), *EDGE]
    table = docs(spark, texts)
    got = substrings.report(table).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(1, 0)}
    cut = {r.doc_id: r.text for r in substrings.without_passages(table).collect()}
    assert cut[0] == texts[0] and len(cut[1]) < len(texts[1]) - 200 and cut[2] == texts[2]
    assert substrings.report(table.limit(0)).count() == 0


def test_chunks_of_several_documents_are_no_passage(spark):
    from quorum.llm import substrings
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    whole = " ".join(word() for _ in range(60))
    raw = np.frombuffer(whole.encode(), dtype=np.uint8)
    ends = substrings.boundaries(raw, np.array([0, len(raw)]))
    # each chunk of ``whole`` is in a document of its own, with what decides its ends
    parts = [whole[max(0, a - 30):b + 4] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()) if b - a < 60]
    assert all(len(x.split(" ")) < 20 for x in parts)
    passage = " ".join(word() for _ in range(60))
    middle = " ".join(passage.split(" ")[15:45])
    n = len(parts)
    texts = [*parts, whole, f"{word()} {middle} {word()}", f"{word()} {passage}",
             " ".join([word(), passage, *(word() for _ in range(9))])]
    table = docs(spark, texts)
    got = substrings.report(table).collect()
    assert {r.doc_id for r in got} == {n + 2, n + 3}
    raw = [(t or "").encode() for t in texts]
    for r in got:
        piece = raw[r.doc_id][r.begin:r.end]
        assert r.n_words >= 20 and piece in raw[r.first_doc_id]
    cut = {r.doc_id: r.text for r in substrings.without_passages(table).collect()}
    assert [cut[i] for i in range(n + 2)] == texts[:n + 2] and len(cut[n + 3]) < len(texts[n + 3]) - 200


def test_wrapped_licences(spark):
    from quorum.llm import licenses
    mit = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy and sell copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
    bsd2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer."""
    bsd3 = bsd2 + """
3. Neither the name of the Example Institute nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission."""
    apache = """# Licensed under the Apache License, Version 2.0 (the
# "License"); you may not use this file except in compliance
# with the License. You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
    short = "// This software is released under the\n// MIT License.\nint x;"
    texts = [mit, bsd2, bsd3, apache, gpl, gpl.replace("GNU General", "GNU Lesser General"), short,
             "Released under the MIT\nLicense of another kind"]
    got = [r.licences for r in licenses.report(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-or-later",
                   "LGPL-3.0-or-later", "MIT", ""]


def test_licences(spark):
    from quorum.llm import licenses
    got = licenses.report(docs(spark, ["Released under the MIT License.\nx", "released under the MIT license!",
                                       "All rights reserved", *EDGE])).collect()
    assert [r.licences for r in got][:3] == ["MIT", "MIT", "LicenseRef-all-rights-reserved"]
    assert all(not r.licences for r in got[3:])


def test_quality_base_counts(spark):
    from quorum.llm import quality
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").union(
        docs(spark, EDGE).select(F.col("doc_id") + 10000, "text", "source"))
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in quality.report(table).collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        c = collections.Counter(windows)
        hit = {k for i, x in enumerate(windows) if c[x] > 1 for k in (i, i + 1, i + 2)}
        ls = [x for x in (texts[r.doc_id] or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id] or "")),
            len(ls) - len(set(ls)), len(hit))
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws))


def test_frequent_line_goes_and_copies_stay(spark):
    from quorum.llm import quality, templates
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
    copied = "\n".join(line() for _ in range(4))
    texts = [f"{line()}\n{line()}\nread more on our site\n{line()}" for _ in range(30)] + [copied] * 20
    for out in (quality.clean(docs(spark, texts)), templates.drop_lines(docs(spark, texts))):
        got = [r.text for r in out.orderBy("doc_id").collect()]
        assert got[:30] == [t.replace("\nread more on our site", "") for t in texts[:30]]
        assert got[30:] == texts[30:]


def test_template_goes_however_large_the_input(spark):
    from quorum.llm import templates
    held = spark.range(12).selectExpr("id", "concat('a', uuid(), '\\nread more on our site\\nb', uuid()) as text")
    others = spark.range(12, 15000).selectExpr("id", "uuid() as text")
    out = templates.drop_lines(held.union(others))
    assert out.where("text like '%read more%'").count() == 0 and out.count() == 15000


def test_row_numbers_repeat_however_files_are_split(spark, tmp_path):
    from quorum.llm.common import numbered
    path = str(tmp_path / "rows")
    # files of different sizes are read in another order once each is a partition of its own
    for n in (10, 3000, 200):
        spark.range(n).selectExpr("id", "uuid() as text").coalesce(1).write.mode("append").parquet(path)
    plain = spark.read.parquet(path).where("id >= 0")
    rows = numbered(plain, "row")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    seen = []
    try:
        for limit in ("128m", "2k"):
            spark.conf.set(key, limit)
            seen.append({(r.id, r.text): r.row for r in rows.select("*").collect()})
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 3210
    # a join makes several rows of one: these are written
    twice = numbered(plain.join(spark.range(2).withColumnRenamed("id", "k")), "row")
    assert twice.select("row").distinct().count() == twice.count() == 6420
    assert "monotonically" not in twice._jdf.queryExecution().toString()


def test_bpe_matches_library(spark):
    import base64

    import tiktoken
    from quorum.llm import bpe
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = docs(spark, EDGE + ["aaaa" * 100, "'s don't 123\n\n  x"])
    out = bpe.encode(table, path, public_tokenizers.PATTERN)
    for r in out.collect():
        assert list(r.ids) == lib.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
    back = bpe.decode(out.drop("text"), path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {
        r.doc_id: r.text or "" for r in table.collect()}


def test_utf8_stream():
    from quorum.llm.bpe import Utf8Stream
    raw = bytes(random.Random(2).choices(range(256), k=4000)) + "é日\U0001F600".encode()
    s = Utf8Stream()
    assert "".join(s.feed(raw[i:i + 5]) for i in range(0, len(raw), 5)) + s.finish() == raw.decode(
        "utf-8", "replace")


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_decontaminate(spark, block):
    from quorum.llm import decontaminate as D
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven"),
                                   (12, "Short, item"), (3, None), (4, "")], "item_id long, text string")
    texts = ["x ONE two; three four five six seven eight nine ten eleven y " + "w " * 30, "a short item b c d e",
             "one two three four five six seven eight nine", *EDGE]
    table = docs(spark, texts)
    got = D.digest(D.report(table, items)).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items) for r in got][:3] == [(11, 1), (2, 1), (0, 0)]
    assert not any(r.contaminated for r in got[2:])
    clean = {r.doc_id: r.text for r in D.decontaminate(table, items, block_bytes=block).collect()}
    assert clean[0] == "x  y " + "w " * 30 and clean[1] == "a  b c d e" and clean[2] == texts[2]


def test_main_text(spark):
    from quorum.llm import sitetree
    html = ("<html><header>h</header><nav><a>n</a></nav><article><h1>T &amp; t</h1><p>a <b>b</b>c<p>d<br>e"
            "<aside>s</aside><div class='comments'>c</div><script>if(a<b)</script></article><footer>f</footer>")
    pages = spark.createDataFrame([(1, "http://a.b/c", html), (2, None, None), (3, "x", "")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.report(pages).collect()}
    assert got == {1: "T & t a bc d e", 2: "", 3: ""}


def block_texts(rng, n_lines, n_docs=40):
    """Documents that share a header, a menu and a footer of ``n_lines`` lines each,
    one group of near copies, one of exact copies, and texts of their own."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    line = lambda n: " ".join(word() for _ in range(n))
    head, menu, foot = ([line(5) for _ in range(n_lines)] for _ in range(3))
    pages = [head + [line(60) for _ in range(3)] + menu + [line(60) for _ in range(3)] + foot
             for _ in range(n_docs)]
    story = [line(12) for _ in range(30)]
    near = []
    for i in range(20):
        near.append(list(story))
        near[i][i] = line(12)
    return pages, head + menu + foot, near + [story] * 20, [[line(60) for _ in range(4)] for _ in range(40)]


@pytest.mark.parametrize("n_lines", [1, 2, 3, 5])
def test_blocks_of_lines_go_and_copies_stay(spark, n_lines):
    from quorum.llm import quality, templates
    pages, shared, copies, others = block_texts(random.Random(n_lines), n_lines)
    texts = ["\n".join(x) for x in (*pages, *copies, *others)]
    want = {i: "\n".join(x for x in t.split("\n") if x not in shared) for i, t in enumerate(texts)}
    table = docs(spark, texts)
    assert {r.doc_id: r.text for r in quality.clean(table).collect()} == want
    assert {r.doc_id: r.text for r in templates.drop_lines(table).collect()} == want


def test_windows_of_long_texts_are_compared_whole(spark):
    """More than 2**20 words: the places take 21 bits, the hashes are still compared whole."""
    from quorum.llm import quality
    n = (1 << 20) + 50
    text = " ".join(f"w{i}" for i in range(n)) + " w7 w8 w9 x w1 w2"
    r = quality.with_base(docs(spark, [text, "a b c a b c"])).select(
        "doc_id", "n_words", "n_repeat_words").orderBy("doc_id").collect()
    assert [tuple(x) for x in r] == [(0, n + 6, 6), (1, 6, 6)]


def brute_hits(texts, items, n=10):
    """(words hit, ids of the items found) of each text."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k:k + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = word(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("piece,block", [(1 << 14, 1 << 25), (3, 4000)])
def test_decontaminate_equals_brute_force(spark, monkeypatch, piece, block):
    """Long items in pieces, shared and repeated items, blocks of a few pieces each."""
    from quorum.llm import decontaminate as D
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(40)]
    w = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, long = w(25), w(60)
    items = [("a", " ".join(passage)), ("b", " ".join(w(5) + passage)), ("b", " ".join(w(5) + passage)),
             ("c", " ".join(long)), ("d", "w1 w2"), ("e", "w3"), ("f", None), ("", "W7, w8; W9!"),
             *((f"copy{i}", " ".join(passage)) for i in range(20))]
    texts = [*(" ".join(w(rng.randint(0, 90)) + rng.choice([passage, long, []]) + w(9)) for _ in range(30)), *EDGE]
    monkeypatch.setattr(D, "PIECE", piece)
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D.window_sets, "__defaults__", (10, block))
    monkeypatch.setattr(D.mark_hits, "__defaults__", (10, "text", block))
    got = D.report(docs(spark, texts), spark.createDataFrame(items, "item_id string, text string"))
    want = brute_hits(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got.collect()} == dict(enumerate(want))


def test_windows_that_share_a_hash(monkeypatch):
    from quorum.llm import decontaminate as D
    few = D.window_hashes
    monkeypatch.setattr(D, "window_hashes", lambda *a: few(*a) & np.uint64(3))
    rng = random.Random(12)
    words_ = lambda k: " ".join(rng.choice("abcdefg") for _ in range(k))
    items = [(f"i{k}", words_(rng.randint(1, 30))) for k in range(60)]
    texts = [words_(40) for _ in range(20)]
    built = D.WindowSet([(i, t.encode()) for i, t in items], 4)
    import pyarrow as pa
    got = []
    for low, s, e, h in D.documents_words(pa.array(texts)):
        at, found = built.scan(low, s, e, h)
        got.append((len(h), len(at), found))
    assert got == brute_hits(texts, items, 4)


def test_decontaminate_empty_tables(spark):
    from quorum.llm import decontaminate as D
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    table = docs(spark, ["one two", "x"])
    assert [r.contaminated for r in D.report(table, items.limit(0)).collect()] == [False, False]
    assert D.report(table.limit(0), items).count() == 0 and D.decontaminate(table, items.limit(0)).count() == 2


def brute_rules(ids, rules):
    """Licences of a sequence, rule by rule, each sentence used once."""
    ids, found = list(ids), []
    for name, seq in sorted(rules, key=lambda r: len(r[1]) == 1):
        seq, at = [p for p in seq if p != "..."], 0
        while True:
            places = []
            for p in seq:
                while at < len(ids) and ids[at] != p:
                    at += 1
                if at == len(ids):
                    break
                places.append(at)
                at += 1
            if len(places) < len(seq):
                break
            for k in places:
                ids[k] = None
            found.append(name)
    found = list(dict.fromkeys(found))
    return [x for x in found if x != "LicenseRef-all-rights-reserved"] if len(found) > 1 else found


def test_rules_use_their_own_sentences_only(spark):
    from quorum.llm import licenses as L
    rng = random.Random(13)
    names = sorted({p for _, seq in L.RULES if len(seq) > 1 for p in seq if p != "..."}) + ["lic-mit", "all-rights"]
    rows = [["bsd-redistribution", "lic-mit", "bsd-source", "bsd-binary"], ["all-rights"], [],
            ["all-rights", "bsd-redistribution", "bsd-source", "bsd-binary"]]
    rows += [[rng.choice(names) for _ in range(rng.randint(0, 25))] for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, ids array<string>").select(
        "i", L.match_rules(F.col("ids")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [brute_rules(x, [*L.RULES[:-1], *L.notices()[1], L.RULES[-1]]) for x in rows]
    assert set(got[0].x) == {"BSD-2-Clause", "MIT"} and got[3].x == ["BSD-2-Clause"]


def test_notices_tags_and_titles(spark):
    from quorum.llm import licenses
    cases = {
        "This file is licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "The code in this folder is released under the BSD 3-Clause License.\nx": "BSD-3-Clause",
        "# SPDX-License-Identifier: MIT\nimport os": "MIT",
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */": "Apache-2.0,MIT",
        "// SPDX-License-Identifier: GPL-2.0+\n": "GPL-2.0-or-later",
        "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only",
        "                Apache License\n          Version 2.0, January 2004\n  http://www.apache.org/licenses/": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright": "GPL-3.0",
        "Copyright 2020 X. All rights reserved.\nDistributed under the MIT License.": "MIT",
        "Copyright 2020 X. All rights reserved.": "LicenseRef-all-rights-reserved",
        "He said that MIT OR Apache-2.0 AND more": "",
        "Distributed under the MIT License of old times": "",
        "SPDX-License-Identifier: Nothing-1.0": "",
    }
    table = docs(spark, list(cases)).withColumn("licences", F.lit(1)).withColumn("Sentence_Ids", F.lit(2))
    got = licenses.recognise(table).orderBy("doc_id").collect()
    assert [",".join(sorted(r["_licences"])) for r in got] == list(cases.values())
    assert all((r["licences"], r["Sentence_Ids"]) == (1, 2) for r in got)
    assert licenses.report(table.limit(0)).count() == 0


def test_pairs_are_told_apart_as_by_merging(tmp_path):
    """``stays_apart`` takes tokens apart again; it says what merging their bytes says."""
    import base64
    from quorum.llm.bpe import Merges
    words = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaa", b"aaaa", b"ca", b"abca", b"cab", b"xyz"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    m = Merges(str(path))
    of = [ord(c) for c in "abcxyz"] + list(range(256, len(words)))
    for a in of:
        for b in of:
            left, right = words[a], words[b]
            assert m.stays_apart(a, b) == (m.merge(left + right) == [left, right]), (left, right)
