"""Hard negatives, URL filter and importance resampling against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    """The contract, pair by pair."""
    good = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        one = (lab, [math.floor(256 * float(x)) for x in v])
        good[i] = min(good[i], one) if i in good else one
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in (i for i in good if i % 100 == 0):
        lab, v = good[a]
        ranked = sorted(((-dot(v, w), j, other) for j, (other, w) in good.items() if j != a))
        for ps, p in [(-s, j) for s, j, other in ranked if other == lab][:5]:
            band = [(-s, j) for s, j, other in ranked if other != lab and 30 * ps <= -100 * s <= 90 * ps]
            out |= {(a, p, k, j, ps, s) for k, (s, j) in enumerate(band[:10], 1)}
    return out


def mined(df, **kw):
    from quorum.llm import negatives
    rows = negatives.mine(df, **kw).collect()
    got = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture()
def small_blocks(monkeypatch):
    """Several rounds, packs and clusters, one of them split, on a few hundred rows."""
    from quorum.llm import negatives
    for name, value in (("BLOCK_ROWS", 60), ("PACK_ROWS", 4), ("CLUSTER_ROWS", 3), ("GROWTH", 3), ("CHUNK", 16)):
        monkeypatch.setattr(negatives, name, value)


def test_negatives_equal_brute_force(spark, small_blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(0, 1200, 3):
        v = centres[i % 6] * .2 + rng.normal(size=8) * .1
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    same = [0.25, 0.5, 0., 0., 0., 0., 0., 0.]          # a vector that a third of the rows share
    rows += [(i, same, i % 3) for i in range(1, 600, 3)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute_negatives(rows)
    assert len(want) > 100 and mined(df) == want


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1., 0.], 1), (0, [1., 0.], 1), (0, [9., 9.], 2),       # repeated rows and a repeated id
            (100, [0., 0.], 1), (200, [], 1), (300, [.5], 1),            # zero, empty and shorter vectors
            (400, None, 1), (500, [1., None], 1), (600, [nan, 1.], 1), (700, [inf, 1.], 1), (800, [1., 1.], None), (None, [1., 1.], 1),
            (3, [1., 0.], 1), (4, [1., 0.], 1), (5, [.5, 0.], 2), (6, [.5, 0.], 2), (8, [.5, 0.], 3), (9, [-1., 0.], 1)]
    rows += [(i, [.5, .1], 5) for i in range(1000, 1040)]                # more ties than are asked for
    got = mined(spark.createDataFrame(rows, VECTORS).withColumns({"block": F.lit(1), "score": F.lit("x"), "VEC": F.lit(0)}))
    assert got == brute_negatives(rows) and got
    empty = spark.createDataFrame([], VECTORS)
    assert mined(empty) == set() and mined(spark.createDataFrame([(7, [1.], 1)], VECTORS)) == set()


def test_walk_is_exact_for_large_components(small_blocks):
    from quorum.llm import negatives
    rng = np.random.default_rng(3)
    for most in (200, 1 << 20, 1 << 28):                                 # each kind of number
        x = rng.integers(-most, most, size=(80, 5))
        ids, labels = rng.permutation(80), rng.integers(0, 2, 80)
        low, high = np.full((10, 1), negatives._NONE + 1), np.full((10, 1), negatives._MOST)
        (i, _, score, other), = negatives.walk(ids, labels, x, ids[:10], labels[:10], x[:10], low, high, 4, True)
        for m in range(10):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(x[m], x[j])), int(ids[j])) for j in range(80)
                          if labels[j] == labels[m] and j != m)[:4]
            assert sorted((-int(s), int(o)) for k, s, o in zip(i, score, other) if k == m) == want


# -- URL filter ---------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def split_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", url or "")
    if not m:
        return "", "", ""
    host = re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1))
    return host, m.group(2), host + m.group(2) + m.group(3)


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path)) if fit else None


def brute_urls(urls, rules, order=5):
    """Counts, probabilities, threshold and verdicts in plain Python."""
    parsed = [split_url(u) for u in urls]
    fits = [rule_of(h, p, rules) for h, p, _ in parsed]
    held = [int(hashlib.sha256(t.encode()).hexdigest()[:7], 16) % 5 == 0 for _, _, t in parsed]
    grams = lambda t: [("\x02" * order + t + "\x03")[i:i + order + 1] for i in range(len(t) + 1)]
    seen = {v: collections.Counter() for v in ("allow", "block")}
    for (_, _, t), r, h in zip(parsed, fits, held):
        if r and not h:
            seen[r.verdict].update(grams(t))
    letters = {g[-1] for c in seen.values() for g in c}
    level = {v: [collections.Counter() for _ in range(order + 1)] for v in seen}
    after = {v: [collections.defaultdict(lambda: [0, 0]) for _ in range(order + 1)] for v in seen}
    for v, c in seen.items():
        for n in range(order + 1):
            for g, k in c.items():
                level[v][n][g[order - n:]] += k
            for g, k in level[v][n].items():
                after[v][n][g[:-1]][0] += k
                after[v][n][g[:-1]][1] += 1

    def p(v, g):
        out = 1 / (len(letters) + 1)
        for n in range(order + 1):
            total, kinds = after[v][n].get(g[order - n:-1], (0, 0))
            if total:
                out = (level[v][n][g[order - n:]] + kinds * out) / (total + kinds)
        return out

    diff = [sum(round((math.log(p("allow", g)) - math.log(p("block", g))) * 1e6) for g in grams(t)) for _, _, t in parsed]
    size = [len(t) + 1 for _, _, t in parsed]
    steps = [(math.floor(d / n / 1000), r.verdict) for d, n, r, h in zip(diff, size, fits, held) if r and h]
    a, b = (sum(v == w for _, v in steps) for w in ("allow", "block"))
    limit = 0
    if a and b:
        share = {s: b * sum(v == "allow" and x >= s for x, v in steps) + a * sum(v == "block" and x < s for x, v in steps)
                 for s in {0, *(x for x, _ in steps)}}
        limit = 1000 * min(share, key=lambda s: (-share[s], abs(s), s))
    return [(h, q, r.host + r.path if r else None, r.verdict if r else "allow" if d >= limit * n else "block")
            for (h, q, _), r, d, n in zip(parsed, fits, diff, size)]


EDGE_URLS = [None, "", "no scheme", "http://", "HTTP://UP.Example.NET/EN/x", "http://www.example.net/en/1", "http://example.net",
             "http://net/", "http://example.net?x=/en/", "a://b://c.org/fr/", "http://example.com/de/#x", "http://badexample.com/de/y",
             "http://x.org/fr/a\nb", "http://ünï.example.org/日本", "http://long.example.org/" + "ab/" * 4000]


def test_urls_equal_brute_force(spark):
    from quorum.llm import urlfilter
    rng = random.Random(8)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'bet', 'news'])}.example.{rng.choice(['net', 'com', 'org'])}"
            f"/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(500)}" for _ in range(300)]
    urls = urls + [urls[0]] * 150 + EDGE_URLS                            # one URL is a third of the rows
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES).repartition(4)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.report(df).collect()}
    want = brute_urls(urls, urlfilter.RULES)
    assert [got[i] for i in range(len(urls))] == want
    assert {v for *_, r, v in want if r is None} == {"allow", "block"}


def test_urls_without_a_broadcast(spark):
    from quorum.llm import urlfilter
    df = spark.createDataFrame([(i, f"http://h{i % 9}.example.{t}/{p}/{i}", "") for i in range(60) for t, p in
                                (("net", "en"), ("net", "de"), ("org", "es"))], PAGES)
    urls = df.select(urlfilter.url_text(F.col("url")).alias("text"), F.lit("allow").alias("label"), F.lit(1).cast("long").alias("n")).distinct()
    small, large = (sorted(tuple(r) for r in urlfilter.scores(urls, max_broadcast_rows=n).collect()) for n in (10 ** 6, 1))
    assert small == large and len(small) == 180


def test_urls_edges(spark):
    from quorum.llm import urlfilter
    empty = spark.createDataFrame([], PAGES)
    assert urlfilter.report(empty).collect() == []
    one = spark.createDataFrame([(None, "http://a.org/x", None)] * 2, PAGES).withColumns(
        {c: F.lit(c) for c in ("host", "text_", "label_", "host_", "url_", "accepted_", "n")})
    got = urlfilter.judge(one).collect()
    assert [(r.page_id, r.host, r.path, r.verdict, r.text_, r.n, r.score) for r in got] == [(None, "a.org", "/x", "allow", "text_", "n", 0.)] * 2
    kept = urlfilter.filtered(one)
    assert kept.columns == one.columns and kept.count() == 2 and kept.first().host == "host"


# -- importance resampling ----------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n-- ", "One", "a b " * 12, "a b " * 12, "Ünï 日本 9z " * 9, "x" * 200_000 + " y" * 30, "w " * 60_000]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))


def brute_draw(docs, target, max_run=1):
    def features(text):
        w = tokens(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]
    s, t = (collections.Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in docs], target))
    big = (sum(s.values()) + 10000, sum(t.values()) + 10000)
    rows = []
    for place, (i, text) in enumerate(docs):
        f = features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * big[0] / ((s[b] + 1) * big[1]))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, place, len(tokens(text))])
    fit = sorted((r for r in rows if r[6] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[5]))
    for k, r in enumerate(fit[:10 * len(fit) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def drawn_docs(n=700):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(150)]
    return [(7 * i - 900, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(n)] + [
        (100_000 + i, t) for i, t in enumerate(EDGE)] + [(100_000_000_000, "same words " * 15)] * 150


@pytest.mark.parametrize("digit_bits,block_rows", [(4, 64), (12, 1 << 15)])
def test_draw_equals_brute_force(spark, monkeypatch, digit_bits, block_rows):
    from quorum.llm import resample
    monkeypatch.setattr(resample, "DIGIT_BITS", digit_bits)
    monkeypatch.setattr(resample.radix_places, "__defaults__", (block_rows,))
    docs, target = drawn_docs(), ["abc a d", None, "b é é cab"]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    goal = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    got = [tuple(r) for r in resample.report(table, goal).collect()]
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] or 0)
    assert sorted(got, key=key) == sorted(brute_draw(docs, target), key=key)


def test_longer_runs_and_crc():
    from quorum.llm import resample
    from quorum.llm.text import LOWER, WORD_CHARS, utf8, word_spans
    import pyarrow as pa
    texts = ["One two three", "", "four", "five " + "s" * 300 + " seven", "日本 x"]
    buf, offsets = utf8(pa.array(texts))
    buf = LOWER[buf]
    starts, ends, per_row = word_spans(buf, offsets, WORD_CHARS)
    got = collections.Counter()
    for rows, buckets in resample.run_buckets(buf, starts, ends, per_row, 10000, 3):
        got.update(zip(rows.tolist(), buckets.tolist()))
    want = collections.Counter((i, zlib.crc32(" ".join(w[j:j + n]).encode()) % 10000) for i, w in enumerate(map(tokens, texts))
                               for n in (1, 2, 3) for j in range(len(w) - n + 1))
    assert got == want


def test_radix_places_are_stable(spark):
    from quorum.llm import resample
    rng = random.Random(1)
    rows = [(rng.choice([5, 1 << 40, 7]), rng.randrange(3), i * 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, place long").repartition(6)
    got = resample.radix_places(df, ["a", "b"], "place", 32).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500))
    assert [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _ in rows)
    same = resample.radix_places(df.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}), ["a", "b"], "place", 32)
    assert sorted(r.place for r in same.collect()) == list(range(500))


def test_draw_edges(spark):
    from quorum.llm import resample
    empty = spark.createDataFrame([], DOCS)
    goal = spark.createDataFrame([], "item_id string, text string")
    assert resample.report(empty, goal).collect() == []
    docs = [(None, "w " * 30)] * 20 + [(1, "w " * 30)] + [(2, None)]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    key = lambda r: (r[0] or 0, r[4] or 0)
    got = [tuple(r) for r in resample.report(table, goal).collect()]
    assert sorted(got, key=key) == sorted(brute_draw(docs, []), key=key)
    clash = table.withColumns({c: F.lit(c) for c in ("row", "row_", "drawn_", "rank", "score", "weight", "__place")})
    kept = resample.draw(clash, goal)
    assert kept.columns == clash.columns and kept.count() == 2 and kept.first()["row_"] == "row_"


# -- HTML extraction: what main elements and foreign elements take with them --------

def extracted(spark, *pages, **kw):
    from quorum.llm import sitetree
    df = spark.createDataFrame([(i, "http://h.example.org/a", p) for i, p in enumerate(pages)], PAGES)
    return [r.text for r in sitetree.extract(df, **kw).orderBy("page_id").collect()]


def test_main_elements_are_evidence_and_foreign_elements_end(spark):
    story = "a long story about many things " * 5
    assert extracted(
        spark, f"<div><p>{story}</p></div><article><p>teaser card</p></article>",
        f"<article><p>{story}</p></article><div>more to read</div>",
        "<p>before</p><svg viewBox='0 0 1 1'/><p>after one</p><object data='x' /><p>after two</p>",
        "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><svg><text>drawn</text></svg><p>end</p>") == [
        story.strip() + " teaser card", story.strip(), "before after one after two", "so x=1 holds end"]


def test_low_keys_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    from quorum.llm import sitetree
    pages = [f"<div><p>the same line on every page</p><p>text of page {i} {'x' * i}</p></div>" for i in range(12)]
    want = [f"text of page {i} {'x' * i}".strip() for i in range(12)]
    assert extracted(spark, *pages) == want
    monkeypatch.setattr(sitetree, "MAX_HOST_KEYS", 0)
    assert extracted(spark, *pages) == want


# -- columns of the documents that bear the names of helpers -----------------------

HELPERS = ["r_", "k_", "gone_", "keep_", "spans_", "span_id_", "row_", "row_number_", "rid", "h", "host", "n_words", "fp", "component", "id"]


def _stages():
    from quorum.llm import quality, simhash, substrings, templates
    return {"clean": quality.clean, "drop_lines": templates.drop_lines, "keep_one": simhash.keep_one,
            "without_passages": substrings.without_passages}


@pytest.mark.parametrize("name", ["clean", "drop_lines", "keep_one", "without_passages"])
def test_helper_names_do_not_clash(spark, name):
    stage = _stages()[name]
    rng = random.Random(6)
    texts = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=80)) + f"\nshared line\n{i}" for i in range(14)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts + [None, "", texts[0]])]
    plain = spark.createDataFrame(rows, DOCS)
    clash = plain.withColumns({c: F.lit(f"own {c}") for c in HELPERS})
    got, want = stage(clash), stage(plain)
    assert got.columns == clash.columns
    key = lambda r: (r.doc_id, r.text or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert all(r[c] == f"own {c}" for r in got.collect() for c in HELPERS)
    empty = stage(clash.limit(0))
    assert empty.columns == clash.columns and empty.count() == 0
