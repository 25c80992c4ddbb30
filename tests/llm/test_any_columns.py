"""Every operator on documents and the pipeline: columns of any name, nulls, empty
and long texts, repeated rows, empty tables."""

import ast
import pathlib
import re
import sys

import pytest
from pyspark.sql import functions as F

ROOT = pathlib.Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = ("doc_id", "text", "lang", "source", "n_chars")
SENTENCE = "the quick brown fox jumps over a lazy dog near one old river bank today"


def names_in(*modules):
    """Every string of a module's code that may be a column's name, in one letter case."""
    found = {}
    for m in ("common", *modules):
        for node in ast.walk(ast.parse((ROOT / "quorum" / "llm" / f"{m}.py").read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                if re.fullmatch(r"[A-Za-z_]\w{0,30}", node.value) and node.value.lower() not in BASE:
                    found.setdefault(node.value.lower(), node.value)
    return sorted(found.values())


def table(spark, extra):
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, SENTENCE), (3, SENTENCE), (4, f"{SENTENCE} {SENTENCE} x"),
            (None, SENTENCE), (5, "\n".join(f"line {i} of {i * i} words {i % 7}" for i in range(4000))),
            (6, "Ünïcödé \U0001F600 日本")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "s", None if t is None else len(t))
                                  for i, t in rows], SCHEMA)
    return docs.select("*", *[F.lit(f"value of {c}").alias(c) for c in extra])


def operators():
    from quorum.llm import decontaminate, licenses, quality, simhash, substrings, templates
    items = "select 'b' as item_id, 'the quick brown fox jumps over a lazy dog near one' as text"
    return {
        "clean": (quality.clean, ("quality", "text")),
        "drop_lines": (templates.drop_lines, ("templates",)),
        "keep_one": (simhash.keep_one, ("simhash", "components")),
        "without_passages": (substrings.without_passages, ("substrings", "text")),
        "decontaminate": (lambda d: decontaminate.decontaminate(d, d.sparkSession.sql(items)),
                          ("decontaminate", "text")),
        "recognise": (licenses.recognise, ()),
        "with_fingerprints": (simhash.with_fingerprints, ()),
        "with_base": (quality.with_base, ()),
    }


@pytest.mark.parametrize("name", ["clean", "drop_lines", "keep_one", "without_passages", "decontaminate"])
def test_extra_columns_change_nothing(spark, name):
    op, modules = operators()[name]
    extra = names_in(*modules)
    plain = op(table(spark, [])).collect()
    got = op(table(spark, extra))
    assert got.columns == [*BASE, *extra]
    rows = got.collect()
    key = lambda r: repr([r[c] for c in BASE])
    assert sorted(map(key, rows)) == sorted(map(key, plain))
    assert all(r[c] == f"value of {c}" for r in rows for c in extra)
    assert {r.doc_id for r in rows} <= {None, *range(7)}


@pytest.mark.parametrize("name", ["clean", "drop_lines", "keep_one", "without_passages", "decontaminate",
                                  "recognise", "with_fingerprints", "with_base"])
def test_empty_tables(spark, name):
    op, _ = operators()[name]
    assert op(table(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["bpe", "ngrams", "substrings", "licenses", "quality", "simhash", "templates",
                                  "decontaminate"])
def test_reports_ignore_extra_columns(spark, name):
    """The queries' reports: same rows whatever stands beside the columns they read."""
    import importlib

    import public_tokenizers
    m = importlib.import_module(f"quorum.llm.{name}")
    if name == "bpe":
        run = lambda d: m.report(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                 public_tokenizers.PATTERN)
    elif name == "decontaminate":
        run = lambda d: m.report(d, d.sparkSession.sql("select 'b' as item_id, 'a lazy dog' as text"))
    else:
        run = m.report
    own = {c.lower() for c in run(table(spark, [])).columns}
    extra = [c for c in names_in(name) if c.lower() in own or len(c) < 3 or c.endswith("_")]
    want = sorted(map(repr, run(table(spark, [])).collect()))
    assert sorted(map(repr, run(table(spark, extra)).collect())) == want
    assert run(table(spark, extra).limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """The whole pipeline on a small table with columns of helpers' names: stages return the
    documents' columns, copies, passages and rejected documents go, clean ones stay whole."""
    sys.path.insert(0, str(ROOT))
    import random

    import corpus_pipeline
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))
    footer = "subscribe to our letter now"
    own = ["\n".join(line(40) for _ in range(3)) for _ in range(30)]
    passage = line(14)
    texts = [*(f"{t}\n{footer}" for t in own), own[0] + "\n" + footer, f"{own[1]} ", line(20), None, "",
             f"{line(60)}\n{line(30)} {passage} {line(30)}"]
    extra = [c for c in names_in("quality", "templates", "simhash", "components", "decontaminate", "bpe")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)],
                                 SCHEMA).select("*", *[F.lit(1).alias(c) for c in extra])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    stage_docs = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, str(tmp_path))
        assert stage_docs.columns == docs.columns
    kept = {r.doc_id: r.text for r in stage_docs.collect()}
    last = len(texts) - 1
    assert set(kept) == {*range(30), last}, "copies 30 and 31, the short, null and empty ones go"
    assert all(kept[i].strip() == own[i] for i in range(30))
    assert passage not in kept[last] and len(kept[last]) > len(texts[last]) - len(passage) - 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept) and all(r.n_tokens == len(r.ids) > 0 for r in out)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []


def test_lines_are_normal_whichever_way(spark):
    """The whole text at once gives the lines that each line by itself gives, and their paths."""
    from pyspark.sql import functions as F
    from quorum.llm import templates
    texts = [" a\tb  c 12 3x \r\n\x0b\x0c q\x0b \n\n  \n z 7#y8 9", "", None, "\r\r a \t\t b\r", "x1 2y z3 w\n#", "1\n 2"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(
        F.btrim(F.regexp_replace(x, "[ \\t-\\r]+", " ")), "[0-9]+", "#"))
    rows = df.select(templates._normal_lines(F.col("text")).alias("new"), old.alias("old"))
    assert rows.where("new <> old").count() == 0
    masked = F.array_join(F.transform(F.split(F.substring_index("l", " ", 3), " "), lambda t: F.when(
        F.contains(t, F.lit("#")), F.lit("<*>")).otherwise(t)), " ")
    lines = rows.select(F.explode("new").alias("l"))
    assert lines.where(templates.leaf(F.col("l")) != F.xxhash64(templates.n_tokens(F.col("l")), masked)).count() == 0
