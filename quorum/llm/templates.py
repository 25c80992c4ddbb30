"""Line dedup by a log-template tree.

Every line is parsed into a tree of fixed depth: its number of tokens, then
its ``LEAD`` leading tokens (digits masked).  The path is the leaf.  Within a
leaf, a token is a constant of its place if lines of enough documents have
it there, otherwise the place is a variable field ``<*>``; a line's template
is what remains, if at least ``SIMILARITY`` of it is constant.  Lines whose
template recurs across ``MIN_DOCS`` documents, however many there are in all,
are dropped.

Only leaves that enough documents reach can hold a recurring template, so
the tokens of all other lines are never spread out: a first pass counts
documents by leaf (hashes only), a bitmap of fixed size with the reached
leaves thins the second pass, an exact join does the rest, and equal lines
are merged before their tokens are.  Counts are combined before each shuffle.

Copies of a document are not templates: a text counts once, and a template
must stand among different neighbouring lines (``MIN_CONTEXTS``), or in blocks
of recurring lines that do and that are the lesser part of their documents.

Defined results: null and empty texts have no lines and stay; lines of fewer
than ``MIN_TOKENS`` tokens are kept; repeated rows and repeated lines are
treated alike; an empty table gives an empty one; very long texts and lines
are read whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import block_keys, fresh_name, numbered, saved

LEAD = 3
MIN_TOKENS = 3
MIN_DOCS = 10
SIMILARITY = 0.5
MIN_CONTEXTS = 0.5
BITMAP_BYTES = 1 << 16
SALTS = 16
_FIELD = "<*>"


def _one_space(text: Column, white: str) -> Column:
    """``text`` with one space for each run of ``white``; single spaces, as most are, match nothing."""
    return F.regexp_replace(text, f"[ {white}]{{2,}}|[{white}]", " ")


def normal(line: Column) -> Column:
    """A line with one space between tokens and runs of digits as ``#``."""
    return F.regexp_replace(F.btrim(_one_space(line, "\\t-\\r")), "[0-9]+", "#")


def n_tokens(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(
        F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def leaf(norm: Column) -> Column:
    """The path of a normal line: token count and leading tokens, fields masked."""
    lead = F.substring_index(norm, " ", LEAD)
    masked = F.when(F.contains(lead, F.lit("#")), F.regexp_replace(lead, "[^ ]*#[^ ]*", _FIELD)).otherwise(lead)
    return F.xxhash64(n_tokens(norm), masked)


def _normal_lines(text: Column) -> Column:
    """:func:`normal` of each line, with one pass over the text for each pattern and none for each line."""
    whole = F.regexp_replace(_one_space(F.coalesce(text, F.lit("")), "\\t\\x0B-\\r"), "[0-9]+", "#")
    return F.transform(F.split(whole, "\n"), lambda x: F.btrim(x))


def parsed(rows: DataFrame, rid: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per document without its text: ``rid``, the columns ``keep``,
    the text's hash and its lines of MIN_TOKENS or more (at, leaf, h, around)."""
    d = rows.select(F.col(rid).alias("rid"), *[F.col(f"`{c}`") for c in keep or []],
                    F.xxhash64(text_col).alias("text_"), _normal_lines(F.col(text_col)).alias("norm_"))
    d = d.withColumn("hash_", F.transform("norm_", lambda x: F.xxhash64(x)))
    each = F.transform("norm_", lambda x, i: F.struct(
        i.alias("at"), n_tokens(x).alias("n"), leaf(x).alias("leaf"), F.get("hash_", i).alias("h"),
        F.xxhash64(F.get("hash_", i - 1), F.get("hash_", i + 1)).alias("around")))
    return d.withColumn("lines_", F.filter(each, lambda s: s["n"] >= MIN_TOKENS)).drop("norm_", "hash_")


def _bitmap(leaves: DataFrame) -> bytes:
    """A bitmap of BITMAP_BYTES with the bit of each leaf set."""
    bit = F.pmod("leaf", F.lit(BITMAP_BYTES * 8))
    parts = leaves.groupBy((bit / (4096 * 8)).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.pmod(bit, F.lit(4096 * 8))).alias("m"))
    out = bytearray(BITMAP_BYTES)
    for r in parts.collect():                       # at most BITMAP_BYTES / 4096 rows
        out[r.part * 4096:(r.part + 1) * 4096] = r.m
    return bytes(out)


def _in_bitmap(leaf_col: Column, bits: bytes) -> Column:
    bit = F.pmod(leaf_col, F.lit(BITMAP_BYTES * 8))
    byte = F.conv(F.hex(F.substring(F.lit(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1


def recurring(rows: DataFrame, rid: str, text_col: str = "text", min_docs: int = MIN_DOCS,
              similarity: float = SIMILARITY, min_contexts: float = MIN_CONTEXTS,
              keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, lines, templates): table as in :func:`parsed`, lines its lines
    as rows; templates has (h, template) of the lines that a recurring
    template generalises."""
    table = saved(parsed(rows, rid, text_col, keep), "parsed")
    lines = table.select("rid", "text_", F.explode("lines_").alias("l")).select(
        "rid", "text_", "l.at", "l.leaf", "l.h", "l.around")
    docs = lines.groupBy("text_").agg(F.min("rid").alias("rid")).select("rid")
    once = saved(lines.join(docs, "rid", "left_semi").groupBy("rid", "leaf", "h", "around").agg(
        F.lit(1).alias("one")).drop("one"), "lines")
    per_leaf = once.groupBy("rid", "leaf").agg(F.lit(1).alias("one")).groupBy("leaf").agg(
        F.count("*").alias("docs"))
    leaves = saved(per_leaf.where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    bits = _bitmap(leaves)
    norm = rows.select(F.explode(_normal_lines(F.col(text_col))).alias("line"))
    # distinct lines of the reached leaves, with the number of documents that hold each
    texts = norm.where((n_tokens(F.col("line")) >= MIN_TOKENS) & _in_bitmap(leaf(F.col("line")), bits)) \
        .groupBy("line").agg(F.lit(1).alias("one")).select(
            "line", leaf(F.col("line")).alias("leaf"), F.xxhash64("line").alias("h"))
    held = once.select("rid", "h").distinct().groupBy("h").agg(F.count("*").alias("docs"))
    distinct = saved(texts.join(leaves, "leaf", "left_semi").join(held, "h"), "lines")
    # the leading tokens of a reached leaf are constant by its path (unless masked); the others are
    # counted by place, and met again by (leaf, place, token) in SALTS parts, so that a token of all
    # lines of a leaf is in no one task
    tokens = F.transform(F.split("line", " "), lambda t, i: F.struct(i.alias("place"), t.alias("token")))
    plain = F.filter(tokens, lambda x: ~F.contains(x["token"], F.lit("#")))
    shapes = distinct.select("leaf", "h", n_tokens(F.col("line")).alias("n"),
                             F.size(F.filter(plain, lambda x: x["place"] < LEAD)).alias("lead"))
    places = distinct.select("leaf", "h", "docs", F.explode(F.filter(plain, lambda x: x["place"] >= LEAD)).alias("p")) \
        .select("leaf", "h", "docs", "p.place", "p.token")
    constant = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(
        F.col("n") >= min_docs).select("leaf", "place", "token")
    fixed = places.drop("docs").withColumn("salt", F.pmod("h", F.lit(SALTS))).join(
        constant.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))),
        ["leaf", "place", "token", "salt"]).groupBy("leaf", "h").agg(
            F.array_sort(F.collect_list(F.struct("place", "token"))).alias("fixed"))     # of one line
    templates = shapes.join(fixed, ["leaf", "h"], "left").where(
        F.col("lead") + F.coalesce(F.size("fixed"), F.lit(0)) >= F.lit(similarity) * F.col("n")).select(
        "h", F.xxhash64("leaf", F.coalesce("fixed", F.array().cast("array<struct<place:int,token:string>>"))).alias("template"))
    seen = once.join(templates, "h").select("rid", "around", "template")
    n_docs = seen.select("rid", "template").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    n_around = seen.select("around", "template").distinct().groupBy("template").agg(
        F.count("*").alias("contexts"))
    often = n_docs.where(F.col("docs") >= min_docs)
    alone = often.join(n_around, "template").where(
        F.col("contexts") >= F.col("docs") * min_contexts).select("template")
    each = F.transform("lines_", lambda x, i: F.struct(
        i.alias("at"), x["h"].alias("h"), x["n"].alias("words"),
        F.get("lines_", i - 1)["h"].alias("before"), F.get("lines_", i + 1)["h"].alias("after")))
    total = F.aggregate("lines_", F.lit(0), lambda s, x: s + x["n"])
    known = saved(templates.join(often, "template", "left_semi"), "candidates")
    hits = table.join(docs, "rid", "left_semi").select("rid", total.alias("total"), F.explode(each).alias("l")).select(
        "rid", "total", "l.*").join(known, "h")
    good = alone.union(block_keys(hits, ["template"], min_docs, min_contexts)).distinct()
    return table, lines, saved(known.join(good, "template", "left_semi"), "templates")


def drop_lines(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without the lines of recurring templates."""
    rid = fresh_name(docs, "row_")
    rows = numbered(docs, rid)
    _, lines, templates = recurring(rows, rid, text_col, **limits)
    r, hit = (fresh_name(rows, c) for c in ("r_", "gone_"))
    gone = (lines.select("rid", "h").join(templates.select("h"), "h", "left_semi")
            .groupBy("rid").agg(F.collect_set("h").alias(hit)).withColumnRenamed("rid", r))
    joined = rows.join(gone, F.col(rid) == F.col(r), "left")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(
        F.col(hit), F.xxhash64(normal(x)))), "\n")
    return joined.withColumn(text_col, F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(
        left)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, n_dropped (lines), n_templates and the
    dropped lines' numbers (from 0, in order)."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    table, lines, templates = recurring(rows, "rid", "text", keep=["doc_id"], **limits)
    found = lines.join(templates, "h").groupBy("rid").agg(
        F.count("*").alias("n_dropped"), F.count_distinct("template").alias("n_templates"),
        F.array_join(F.array_sort(F.collect_list("at")), ",").alias("dropped"))
    return table.select("doc_id", "rid").join(found, "rid", "left").select(
        "doc_id", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce("n_templates", F.lit(0)).alias("n_templates"),
        F.coalesce("dropped", F.lit("")).alias("dropped"))
