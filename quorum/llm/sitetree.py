"""Main text of HTML pages by site style trees.

Each page is parsed into a tree; the trees of one host are merged: an element
is known by its path of tags and classes, its presentation by the tags of its
children, its content by its blocks of text.  Over the pages of a host, the
importance of a content is ``1 - ln(pages that have it) / ln(pages)`` - 0 if
every page shows it, 1 if one does - and the importance of a presentation is
the entropy of its variants.  A branch's importance is that of its contents,
and for branches outside a page's main element also that of its
presentation.  Branches below ``MIN_IMPORTANCE`` are removed from every page;
elements that are by name menus, footers, notices, adverts, forms, scripts,
comments and the like have no importance on any site.

The merge counts (host, path, content) with a partial count per task, so a
host with a third of all pages is spread by its contents; nothing
is collected by host.

Defined results: a null or empty page has empty text; pages without a known
host are a host of their own; unclosed and stray tags are tolerated; a host
of fewer than ``MIN_PAGES`` pages is judged by names alone; repeated rows are
pages of their own.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import map_batches, saved

MIN_IMPORTANCE = 0.1
MIN_PAGES = 10
#: low keys that are broadcast by host: in all, and of one host (a content's key is low only when nearly
#: all pages of its host have it, so a host has about as many as a page has blocks)
MAX_BROADCAST_KEYS = 500_000
MAX_HOST_KEYS = 2_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "object"}
#: elements that may close themselves (``<svg/>``)
FOREIGN = {"svg", "object"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
          "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup",
          "munder", "mover", "munderover", "mstyle", "mpadded", "semantics"}
NOISE_TAGS = {"head", "nav", "footer", "aside", "menu", "form", "button", "select", "dialog", "input",
              *RAW}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "dialog",
               "alert", "menubar", "toolbar"}
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsbygoogle|banners?|promos?|promotions?|sponsor(?:s|ed)?"
    r"|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|comments?|disqus|respond|replies"
    r"|sidebars?|menus?|nav(?:bar|igation)?|breadcrumbs?|share|sharing|social|related|recommended"
    r"|newsletters?|subscribe|subscription|signup|login|footers?|toolbar|pagination|pager|widgets?"
    r"|masthead|topbar|header|site-header|page-header|skip|hidden|sr-only)(?:$|[\s_-])", re.I)
#: elements of which a new one ends an open one
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
                    re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag, path, noise, main):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


def parse(page: str):
    """(blocks, styles): blocks are (path, inside main, text) of text that is
    no noise by name; styles are (path, tags of the children) of the block
    elements outside noise."""
    blocks, styles, parts = [], [], []
    root = Element("", "", False, False)
    stack = [root]

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
        parts.clear()
        if text and not stack[-1].noise:
            block = next(e for e in reversed(stack) if e.tag not in INLINE)
            blocks.append((block.path, stack[-1].main, text))

    def close(upto: int):
        flush()
        for e in reversed(stack[upto:]):
            if not e.noise and e.tag not in INLINE:
                styles.append((e.path, " ".join(e.children)))
        del stack[upto:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not stack[-1].noise:
            parts.append(text)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):                                   # an end tag
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                if tag in INLINE:
                    if not any(e.tag not in INLINE for e in stack[k:]):
                        if stack[k].noise:
                            flush()
                        del stack[k:]
                else:
                    close(k)
            continue
        if tag not in INLINE:
            flush()
        up = stack[-1]
        if tag in VOID:
            up.children.append(tag)
            continue
        for i in range(len(stack) - 1, 0, -1):           # <p> after an open <p>, and the like
            if stack[i].tag in CLOSES.get(tag, ()):
                close(i)
                break
            if stack[i].tag not in INLINE and tag != "tr":
                break
        up = stack[-1]
        attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m.group(3))}
        names = " ".join(attrs.get(k, "") for k in ("class", "id"))
        top = tag in ("html", "body", "article", "main")
        noise = up.noise or tag in NOISE_TAGS or (not top and (
            attrs.get("role", "").lower() in NOISE_ROLES or bool(names and NOISE_NAMES.search(names))
            or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or "display:none" in attrs.get("style", "").replace(" ", "")
            or tag == "header" and not up.main))
        if noise and not up.noise:
            flush()
        main = up.main or tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        up.children.append(tag)
        if tag in FOREIGN and m.group(3).rstrip().endswith("/"):
            continue                                     # self-closed: nothing inside
        if tag in RAW:                                   # no markup inside: skip to its end
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if m.group(3).rstrip().endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            continue
        label = f"{tag}.{names}" if names.strip() else tag
        stack.append(Element(tag, f"{up.path}/{label}" if tag not in INLINE else up.path, noise, main))
    close(1)
    flush()
    return blocks, styles


_PARSED = ("row_ long, page_id long, url string, host string, "
           "blocks array<struct<path:string,text:string>>, styles array<struct<path:string,style:string>>")


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page: its candidate blocks in page order and its styles.  Main
    elements are evidence: where they hold at least half of a page's candidate text, its
    blocks are theirs (and it has no styles to compare); where they hold less - a teaser
    beside a story - all blocks stay candidates."""
    rows = pages.select(F.monotonically_increasing_id().alias("row_"), "page_id", "url",
                        F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
                        "html")

    def run(batches):
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
        style = pa.list_(pa.struct([("path", pa.string()), ("style", pa.string())]))
        for batch in batches:
            blocks, styles = [], []
            for value in batch.column(4):
                found, shapes = parse(value.as_py() or "")
                inside = [b for b in found if b[1]]
                if 2 * sum(len(t) for _, _, t in inside) < sum(len(t) for _, _, t in found):
                    inside = []
                blocks.append([{"path": p, "text": t} for p, _, t in inside or found])
                styles.append([] if inside else [{"path": p, "style": s} for p, s in shapes])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(blocks, kind), pa.array(styles, style)],
                names=["row_", "page_id", "url", "host", "blocks", "styles"])

    return map_batches(rows, run, _PARSED)


def unimportant(pages: DataFrame, min_pages: int = MIN_PAGES,
                min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, key) of the contents and branches of low importance; ``pages``
    as :func:`parsed` gives them.  A content's key is the hash of its path
    and text, a branch's key that of its path."""
    per_host = pages.groupBy("host").agg(F.count("*").alias("pages")).where(
        F.col("pages") >= min_pages).withColumnRenamed("host", "host_")
    content = (pages.select("host", F.explode(F.array_distinct(F.transform(
        "blocks", lambda b: F.xxhash64(b["path"], b["text"])))).alias("key"))
        .groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1"))
    low = content.join(per_host, F.col("host").eqNullSafe(F.col("host_"))).where(
        1 - F.log("n") / F.log("pages") < min_importance).select("host", "key")
    # presentation: entropy of the variants of a branch, over the pages that have it
    variants = (pages.select("host", F.explode(F.array_distinct("styles")).alias("s"))
                .groupBy("host", F.col("s.path").alias("path"), F.col("s.style").alias("style"))
                .agg(F.count("*").alias("n")))
    shape = variants.groupBy("host", "path").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn")).where(
        F.col("m") >= min_pages).withColumn(
        "presentation", (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m"))
    shown = (pages.where(F.size("styles") > 0).select("host", F.explode("blocks").alias("b"))
             .select("host", F.col("b.path").alias("path"), F.xxhash64("b.text").alias("t"))
             .groupBy("host", "path", "t").agg(F.count("*").alias("n"))
             .groupBy("host", "path").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log("n")).alias("c")))
    varied = shown.withColumn("content", F.when(F.col("k") > 1, (
        F.log("k") - F.col("c") / F.col("k")) / F.log("k")).otherwise(F.lit(1.0)))
    s, v = shape.alias("s"), varied.alias("v")
    branches = s.join(v, F.col("s.host").eqNullSafe(F.col("v.host")) & (F.col("s.path") == F.col("v.path"))).where(
        (F.col("presentation") < min_importance) & (F.col("content") < min_importance)).select(
        "s.host", F.xxhash64("s.path").alias("key"))
    return low.union(branches)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES,
            min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """One row per page: page_id, url, text."""
    table = saved(parsed(pages), "pages")
    low = saved(unimportant(table, min_pages, min_importance), "unimportant").withColumnsRenamed(
        {"host": "host_", "key": "key_"})
    per_host = low.groupBy("host_").agg(F.collect_set("key_").alias("gone_"))
    size = per_host.agg(F.coalesce(F.sum(F.size("gone_")), F.lit(0)), F.coalesce(F.max(F.size("gone_")), F.lit(0))).first()
    if size[0] <= MAX_BROADCAST_KEYS and size[1] <= MAX_HOST_KEYS:
        # the keys go to the pages, whose texts cross no exchange
        joined = table.drop("styles").join(F.broadcast(per_host), F.col("host").eqNullSafe(F.col("host_")), "left")
    else:
        keys = table.select("row_", "host", F.explode(F.array_distinct(F.flatten(F.transform(
            "blocks", lambda b: F.array(F.xxhash64(b["path"], b["text"]), F.xxhash64(b["path"])))))).alias("key"))
        gone = keys.join(low, F.col("host").eqNullSafe(F.col("host_")) & (F.col("key") == F.col("key_"))).groupBy(
            "row_").agg(F.collect_set("key").alias("gone_")).withColumnRenamed("row_", "gone_row_")
        joined = table.drop("styles").join(gone, F.col("row_") == F.col("gone_row_"), "left")
    kept = F.when(F.col("gone_").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~(
        F.array_contains("gone_", F.xxhash64(b["path"], b["text"]))
        | F.array_contains("gone_", F.xxhash64(b["path"])))))
    return joined.select("page_id", "url", F.array_join(F.transform(
        kept, lambda b: b["text"]), " ").alias("text"))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).withColumn(
        "n_chars", F.length("text").cast("long"))
