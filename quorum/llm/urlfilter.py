"""URL filter: rules of hosts and paths, then a ratio of two character language models.

A URL is read as a host and a path.  The longest rule that fits decides; the
others are judged by two smoothed variable-order Markov models over characters,
one of accepted and one of rejected URLs (by default those that the rules
allow and block).  The probability of a character interpolates all context
lengths from ``ORDER`` down to none (Witten-Bell: an unseen context hands on
to the shorter one whole, a context with many continuations hands on more).
A URL's score is the log-likelihood difference per character, the end of the
text included; the threshold is calibrated on a fold of the labelled URLs that
the models do not see (the best balanced accuracy, nearest to zero of equals).

All of it is DataFrame work: characters with their contexts are counted once,
at the full order, and shorter contexts are summed from those counts.  Every
distinct character-in-context of all URLs gets its log difference, in millionths
and whole, so that sums do not depend on their order; it meets the URLs by a
broadcast when it is proven small, else by a shuffled join whose frequent
entries adaptive execution splits.

Defined results: a null URL or one without ``://`` has an empty host and path
and is judged as an empty text; without labelled URLs of both kinds the
difference is 0 and the verdict ``allow``; an empty table gives an empty table;
repeated rows and equal ids are rows of their own; long URLs are read whole;
other columns come back as they are, and new columns take the place of
columns of their names in :func:`judge`.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import fresh_name, lower_ascii, saved

Rule = namedtuple("Rule", "verdict host path")

#: the rules of the registered query
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

ORDER = 5
FOLDS = 5
#: scores are sums of millionths
UNIT = 1_000_000
#: a threshold is a multiple of this many millionths a character, at most LIMIT of them from zero
STEP = 1_000
LIMIT = 20_000
START, END = "\x02", "\x03"
MAX_BROADCAST_ROWS = 400_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_text(url: Column) -> Column:
    """What the models read: host and rest of the URL, without the scheme; empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    return F.concat(host_of(url), rest)


def _grams(text: Column, order: int) -> Column:
    """Each character of a text, and its end, with the ``order`` characters before it: strings of order + 1."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """(gram, acc, rej): occurrences in accepted and rejected texts."""
    return (texts.select(F.explode(_grams(F.col("text"), order)).alias("gram"), "label", "n")
            .groupBy("gram").agg(_of("allow").alias("acc"), _of("block").alias("rej")))


def _of(verdict: str) -> Column:
    """How many rows have this label."""
    return F.sum(F.when(F.col("label") == verdict, F.col("n")).otherwise(0))


def _context_counts(counts: DataFrame, order: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Counts of grams whose context has ``length`` characters, and of those contexts (n: all, t: distinct)."""
    gram = F.substr("gram", F.lit(order - length + 1), F.lit(length + 1))
    grams = counts.groupBy(gram.alias("g")).agg(F.sum("acc").alias("ca"), F.sum("rej").alias("cr"))
    contexts = grams.groupBy(F.substr("g", F.lit(1), F.lit(length)).alias("h")).agg(
        F.sum("ca").alias("na"), F.count_if(F.col("ca") > 0).alias("ta"),
        F.sum("cr").alias("nr"), F.count_if(F.col("cr") > 0).alias("tr"))
    return grams, contexts


def differences(grams: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, diff): log P(accepted) - log P(rejected) of each gram's last character, in millionths."""
    # one share is left for a character that no model knows
    size = F.broadcast(counts.agg(F.count_distinct(F.right("gram", F.lit(1))).alias("letters")))
    d = grams.crossJoin(size).withColumns({k: F.lit(1.0) / (F.col("letters") + 1) for k in ("pa", "pr")})
    for length in range(order + 1):
        seen, contexts = _context_counts(counts, order, length)
        d = (d.withColumns({"g": F.substr("gram", F.lit(order - length + 1), F.lit(length + 1)),
                            "h": F.substr("gram", F.lit(order - length + 1), F.lit(length))})
             .join(contexts, "h", "left").join(seen, "g", "left").drop("g", "h"))
        for p, c, n, t in (("pa", "ca", "na", "ta"), ("pr", "cr", "nr", "tr")):
            d = d.withColumn(p, F.when(F.col(n) > 0, (F.coalesce(F.col(c), F.lit(0)) + F.col(t) * F.col(p))
                                       / (F.col(n) + F.col(t))).otherwise(F.col(p)))
        d = d.select("gram", "letters", "pa", "pr")
    return d.select("gram", F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("diff"))


def held_out(text: Column) -> Column:
    """Whether a URL is kept for the threshold: all copies of one fall on the same side."""
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(7)), 16, 10).cast("long") % FOLDS == 0


def scores(urls: DataFrame, order: int = ORDER, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``urls`` (text, label, n: distinct texts) with ``diff``, the summed log difference under the models of the
    labelled texts that are not held out."""
    train = urls.where(F.col("label").isNotNull() & ~held_out(F.col("text")))
    counts = saved(_counts(train, order), "url-counts")
    spread = urls.select("text", "label", "n", F.explode(_grams(F.col("text"), order)).alias("gram"))
    table = saved(differences(spread.select("gram").distinct(), counts, order), "url-grams")
    # a gram has a fixed length, so that rows bound the bytes as well
    small = table.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    return (spread.join(F.broadcast(table) if small else table.hint("merge"), "gram")
            .groupBy("text", "label", "n").agg(F.sum("diff").alias("diff")))


def _letters() -> Column:
    """Characters of a text, its end counted."""
    return F.length("text") + 1


def threshold(urls: DataFrame) -> int:
    """The difference per character, in millionths, from which on a URL is accepted.

    ``urls``: labelled (text, label, n, diff).  Scores fall on at most 2 * LIMIT + 1 steps: as many rows as one task orders."""
    step = F.floor(F.col("diff") / _letters() / STEP)
    by = urls.groupBy(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), step)).cast("long").alias("step")).agg(
        _of("allow").alias("a"), _of("block").alias("r"))
    by = by.union(urls.sparkSession.sql("SELECT 0L, 0L, 0L")).groupBy("step").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    up = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    down = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = by.select("step", F.sum("a").over(up).alias("kept"), F.coalesce(F.sum("r").over(down), F.lit(0)).alias("cut"),
                  F.sum("a").over(every).alias("accepted"), F.sum("r").over(every).alias("rejected"))
    # the two shares over one denominator: whole numbers, so that equal ones tie
    share = (F.col("kept").cast("decimal(18,0)") * F.col("rejected").cast("decimal(18,0)")
             + F.col("cut").cast("decimal(18,0)") * F.col("accepted").cast("decimal(18,0)"))
    best = d.where("accepted > 0 AND rejected > 0").orderBy(share.desc(), F.abs("step"), "step").first()
    return int(best.step) * STEP if best else 0


def judge(pages: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the difference per character)."""
    new = ("host", "path", "rule", "verdict", "score")
    u = F.col(f"`{url}`")
    rule, verdict = matching_rule(host_of(u), path_of(u), rules)
    # every helper under names that no column of the pages has
    made = dict(zip(("text", "label", *new), (fresh_name(pages, c + "_") for c in ("text", "label", *new))))
    rows = pages.withColumns({made["host"]: host_of(u), made["path"]: path_of(u), made["rule"]: rule,
                              made["label"]: verdict, made["text"]: url_text(u)})
    urls = saved(rows.groupBy(F.col(made["text"]).alias("text"), F.col(made["label"]).alias("label"))
                 .agg(F.count("*").alias("n")), "urls")
    got = saved(scores(urls, order), "url-scores")
    limit = threshold(got.where(F.col("label").isNotNull() & held_out(F.col("text"))))
    by_model = F.when(F.col("diff") >= F.lit(limit).cast("long") * _letters(), "allow").otherwise("block")
    key, accepted, score = (fresh_name(rows, c) for c in ("url_", "accepted_", "per_letter_"))
    models = got.select(F.col("text").alias(key), by_model.alias(accepted),
                        (F.col("diff") / _letters() / UNIT).alias(score))
    # new columns take the place of columns of their names
    kept = [c for c in pages.columns if c.lower() not in new]
    return rows.join(models, rows[made["text"]] == models[key]).select(
        *[F.col(f"`{c}`") for c in kept], F.col(made["host"]).alias("host"), F.col(made["path"]).alias("path"),
        F.col(made["rule"]).alias("rule"), F.coalesce(made["label"], accepted).alias("verdict"),
        F.col(score).alias("score"))


def filtered(pages: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """The allowed rows of ``pages``, with their own columns."""
    names = [fresh_name(pages, f"c{i}_") for i in range(len(pages.columns))]
    got = judge(pages.toDF(*names), names[pages.columns.index(url)], rules, order)
    return got.where("verdict = 'allow'").select(*names).toDF(*pages.columns)


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
