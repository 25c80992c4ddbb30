"""Document quality rules, and cross-document line frequency by host.

Base rules count words, symbols, duplicate lines and repeated 3-word windows
of each whole text with array functions on the row (no shuffle).  The line
rule then looks across documents: the distinct normalised lines of each
document are hashed, documents are counted by (host, line) with a partial
count before the shuffle, lines above the limits are removed, and documents
that lose too many of their words are rejected.  Copies of a document are not
boilerplate: a text counts once per host, and a frequent line must also stand
among different neighbours (the lines of near copies keep theirs), or belong
to a block of frequent lines that is the lesser part of its documents and
stands among different neighbours (headers, menus and footers of several lines).

All of it is DataFrame functions; hot hosts are spread by the line's hash.

Defined results: a null or empty text has no words and fails the base rules;
a null host is a host of its own; repeated rows count alike; other columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import SPACE_PATTERN, WHITE, block_keys, fresh_name, numbered, saved

MIN_WORDS = 50
WINDOW = 3
MAX_REPEAT = 0.5
SYMBOLS = "#*$%&|<>"
MIN_LINE_DOCS = 8          # a line is frequent if at least so many documents of its host hold it,
MAX_LINE_SHARE = 0.02      # at least this share of them,
MIN_CONTEXTS = 0.5         # and if it, or its block, stands among different lines in this share of those
MIN_LEFT = 0.3             # share of its words that a document must keep


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    plain = F.coalesce(text, F.lit(""))
    for c in WHITE[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def lines(text: Column) -> Column:
    """Lines (split at \\n) of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                    lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)


def n_symbols(text: Column) -> Column:
    """Characters of ``SYMBOLS`` in a text."""
    text = F.coalesce(text, F.lit(""))
    left = text
    for c in SYMBOLS:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def with_base(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed (names prefixed by ``prefix``)."""
    text = F.col(text_col)
    w, k, b, e = (fresh_name(docs, c) for c in ("words_", "windows_", "bits_", "equal_"))
    d = docs.withColumn(w, words(text))
    n = F.size(w)
    # repeated windows: each window is one long, its hash in the high bits and its place in
    # the low ones (as many as the text needs); sorted, equal windows are neighbours
    hashed = ", ".join(f"get({w}, i + {j})" for j in range(WINDOW))
    d = d.withColumn(b, F.expr(f"cast(length(bin(size({w}))) as int)"))
    d = d.withColumn(k, F.when(n >= WINDOW, F.expr(
        f"sort_array(transform(sequence(0, size({w}) - {WINDOW}), "
        f"i -> shiftleft(xxhash64({hashed}), {b}) + i))")).otherwise(F.array().cast("array<bigint>")))
    # those whose kept bits are equal are compared again by their whole hashes
    whole = ", ".join(f"get({w}, cast(x & (shiftleft(1L, {b}) - 1) as int) + {j})" for j in range(WINDOW))
    d = d.withColumn(e, F.expr(
        f"sort_array(transform(filter({k}, (x, i) -> "
        f"shiftright(x ^ get({k}, i - 1), {b}) <=> 0L or shiftright(x ^ get({k}, i + 1), {b}) <=> 0L), "
        f"x -> struct(xxhash64({whole}) as h, x & (shiftleft(1L, {b}) - 1) as at)))"))
    dup_places = F.expr(
        f"sort_array(transform(filter({e}, (x, i) -> "
        f"x.h <=> get({e}, i - 1).h or x.h <=> get({e}, i + 1).h), x -> x.at))")
    covered = F.aggregate(
        dup_places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"),
                              p.alias("last")), lambda s: s["n"])
    ls = lines(text)
    plain = F.coalesce(text, F.lit(""))
    for c in WHITE:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    d = d.withColumns({
        prefix + "n_words": n.cast("long"),
        prefix + "word_chars": F.length(plain).cast("long"),
        prefix + "n_symbols": n_symbols(text),
        prefix + "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        prefix + "n_repeat_words": covered,
    }).drop(w, k, b, e)
    nw, nr = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return d.withColumn(prefix + "base_failed",
                        (nw < MIN_WORDS) | (nr > F.lit(MAX_REPEAT) * nw))


def with_lines(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with the text replaced by ``text_``, its hash, and ``lines_``:
    of each line its hash, the hash of its neighbours and its words.
    Normalised: lower case, white space runs are one space, trimmed."""
    norm = F.transform(lines(F.col(text_col)), lambda x: F.btrim(
        F.regexp_replace(F.lower(x), SPACE_PATTERN, " ")))
    d = rows.withColumn("norm_", norm)
    d = d.withColumns({"text_": F.xxhash64(text_col),
                       "hash_": F.transform("norm_", lambda x: F.xxhash64(x))})
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return d.withColumn("lines_", F.transform("hash_", lambda h, i: F.struct(
        h.alias("h"), F.xxhash64(F.get("hash_", i - 1), F.get("hash_", i + 1)).alias("around"),
        (spaces(F.get("norm_", i)) + 1).alias("words")))).drop("norm_", "hash_", text_col)


def frequent_lines(table: DataFrame, min_docs: int = MIN_LINE_DOCS,
                   max_share: float = MAX_LINE_SHARE,
                   min_contexts: float = MIN_CONTEXTS) -> DataFrame:
    """(host, h) of the lines above the limits."""
    texts = table.groupBy("host", "text_").agg(F.min("rid").alias("rid")).select("rid")
    once = table.join(texts, "rid", "left_semi").select("rid", "host", "n_words", "lines_")
    per_host = once.groupBy("host").agg(F.count("*").alias("host_docs"))
    rows = once.select("host", F.explode(F.array_distinct(F.transform(
        "lines_", lambda x: F.struct(x["h"], x["around"])))).alias("l")).select("host", "l.*")
    docs_of = once.select("host", F.explode(F.array_distinct(F.transform(
        "lines_", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_docs)
    often = saved(docs_of.join(per_host, docs_of.host.eqNullSafe(per_host.host)).where(
        F.col("n") >= F.col("host_docs") * max_share).select(docs_of.host, "h", "n"), "often")
    is_often = (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_"))
    names = often.select(F.col("host").alias("host_"), F.col("h").alias("h_"))
    contexts = rows.join(names, is_often, "left_semi").distinct().groupBy("host", "h").agg(
        F.count("*").alias("contexts"))
    alone = often.join(contexts.withColumnsRenamed({"host": "host_", "h": "h_"}), is_often).where(
        F.col("contexts") >= F.col("n") * min_contexts).select("host", "h")
    each = F.transform("lines_", lambda x, i: F.struct(
        i.alias("at"), x["h"].alias("h"), x["words"].alias("words"),
        F.get("lines_", i - 1)["h"].alias("before"), F.get("lines_", i + 1)["h"].alias("after")))
    hits = once.select("rid", "host", F.col("n_words").alias("total"), F.explode(each).alias("l")).select(
        "rid", "host", "total", "l.*").join(names, is_often, "left_semi")
    return alone.union(block_keys(hits, ["host", "h"], min_docs, min_contexts)).distinct()


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source",
          keep: list[str] | None = None, min_docs: int = MIN_LINE_DOCS,
          max_share: float = MAX_LINE_SHARE, min_contexts: float = MIN_CONTEXTS,
          min_left: float = MIN_LEFT) -> tuple[DataFrame, DataFrame]:
    """(verdicts, frequent): verdicts has one row per row of ``docs``: the
    columns ``keep`` and those of :func:`with_base`, ``rid`` (a row number),
    ``host``, ``lines_``, ``removed_words`` and ``kept``."""
    keep = keep or []
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("t_"),
                       F.col(host_col).alias("host"), F.monotonically_increasing_id().alias("rid"))
    # one pass over the texts, written: base counts and line hashes
    table = saved(with_lines(with_base(rows, "t_"), "t_"), "quality")
    frequent = saved(frequent_lines(table, min_docs, max_share, min_contexts), "frequent")
    removed = (table.select("rid", "host", F.explode("lines_").alias("l"))
               .select("rid", "host", F.col("l.h").alias("h"), F.col("l.words").alias("w"))
               .join(frequent.withColumnsRenamed({"host": "host_", "h": "h_"}),
                     (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_")))
               .groupBy("rid").agg(F.sum("w").alias("removed_words")))
    verdicts = table.join(removed, "rid", "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn(
        "kept", ~F.col("base_failed")
        & (F.col("n_words") - F.col("removed_words") >= F.lit(min_left) * F.col("n_words")))
    return verdicts, frequent


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words and kept."""
    verdicts, _ = judge(docs, keep=["doc_id"])
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "base_failed", "removed_words", "kept")


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` without its rejected rows and without frequent lines; texts
    that hold no frequent line stay as they are."""
    rid = fresh_name(docs, "row_")
    rows = numbered(docs, rid)
    verdicts, frequent = judge(rows, text_col, host_col, keep=[rid], **limits)
    r, k, gone = (fresh_name(rows, c) for c in ("r_", "k_", "gone_"))
    hit = (verdicts.where("kept and removed_words > 0")
           .select(F.col(rid).alias(r), "host", F.explode("lines_.h").alias("h"))
           .join(frequent.withColumnsRenamed({"host": "host_", "h": "h_"}),
                 (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_")))
           .groupBy(r).agg(F.collect_set("h").alias(gone)))
    kept = verdicts.where("kept").select(F.col(rid).alias(k))
    joined = rows.join(kept, F.col(rid) == F.col(k), "left_semi").join(
        hit, F.col(rid) == F.col(r), "left")
    left = F.concat_ws("\n", F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(
        F.col(gone), F.xxhash64(F.btrim(F.regexp_replace(F.lower(x), SPACE_PATTERN, " "))))))
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
