"""DuckDB statements of the queries that SQL can express."""

from quorum.llm import urlfilter

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

#: windows of the items against all windows of the same lengths in the documents
DECONTAMINATE = f"""WITH
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
           FROM docs JOIN (SELECT DISTINCT n FROM item_windows) ON len(w) >= n),
doc_windows AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM starts),
hits AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.g = i.g),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
              FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""

#: inner products of every anchor with every row
HARD_NEGATIVES = """WITH
rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
         FROM embeddings
         WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                 CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
banded AS (SELECT p.anchor_id, p.positive_id, n.other AS negative_id, p.positive_score, n.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
           FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM banded WHERE rank <= 10"""


def url_models(order: int, folds: int, unit: int, step: int, limit: int, rules) -> str:
    """Rules, counts of characters in context, interpolated probabilities, calibrated threshold."""
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    rest = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1), '')"
    by_length = sorted(rules, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in by_length]
    rule = " ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(fits, by_length))
    label = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, by_length))
    levels, last = "", "d"
    for n in range(order + 1):
        gram, at = f"substr(gram, {order - n + 1}, {n + 1})", f"substr(gram, {order - n + 1}, {n})"
        mix = ", ".join(
            f"CASE WHEN h.n{k} > 0 THEN (CAST(coalesce(s.c{k}, 0) AS DOUBLE) + CAST(h.t{k} AS DOUBLE) * p.p{k}) "
            f"/ CAST(h.n{k} + h.t{k} AS DOUBLE) ELSE p.p{k} END AS p{k}" for k in "ar")
        levels += f""",
s{n} AS (SELECT {gram} AS g, sum(acc) AS ca, sum(rej) AS cr FROM counts GROUP BY 1),
h{n} AS (SELECT substr(g, 1, {n}) AS h, sum(ca) AS na, count(*) FILTER (ca > 0) AS ta, sum(cr) AS nr,
                count(*) FILTER (cr > 0) AS tr FROM s{n} GROUP BY 1),
d{n} AS (SELECT p.gram, {mix}
        FROM {last} p LEFT JOIN h{n} h ON h.h = {at.replace("gram", "p.gram")} LEFT JOIN s{n} s ON s.g = {gram.replace("gram", "p.gram")})"""
        last = f"d{n}"
    return f"""WITH
parsed AS (SELECT page_id, {host} AS host, {path} AS path, {rest} AS rest FROM pages),
ruled AS (SELECT page_id, host, path, host || rest AS text, CASE {rule} END AS rule, CASE {label} END AS label FROM parsed),
urls AS (SELECT text, label, count(*) AS n, length(text) + 1 AS letters,
                CAST('0x' || substr(sha256(text), 1, 7) AS BIGINT) % {folds} = 0 AS held FROM ruled GROUP BY text, label),
spread AS (SELECT text, label, n, held, substr(padded, i, {order + 1}) AS gram
           FROM (SELECT *, repeat(chr(2), {order}) || text || chr(3) AS padded, unnest(range(1, letters + 1)) AS i FROM urls)),
counts AS (SELECT gram, coalesce(sum(n) FILTER (label = 'allow'), 0) AS acc, coalesce(sum(n) FILTER (label = 'block'), 0) AS rej
           FROM spread WHERE label IS NOT NULL AND NOT held GROUP BY gram),
d AS (SELECT gram, pa, pa AS pr FROM (SELECT DISTINCT gram FROM spread),
      (SELECT CAST(1 AS DOUBLE) / (count(DISTINCT right(gram, 1)) + 1) AS pa FROM counts)){levels},
diffs AS (SELECT gram, CAST(round((ln(pa) - ln(pr)) * {unit}) AS BIGINT) AS diff FROM {last}),
sums AS (SELECT u.text, CAST(sum(g.diff) AS BIGINT) AS diff FROM spread u JOIN diffs g ON g.gram = u.gram GROUP BY u.text),
judged AS (SELECT u.*, s.diff FROM urls u JOIN sums s ON s.text = u.text),
steps AS (SELECT step, sum(a) AS a, sum(r) AS r FROM (
            SELECT greatest(-{limit}, least({limit}, CAST(floor(CAST(diff AS DOUBLE) / letters / {step}) AS BIGINT))) AS step,
                   CASE WHEN label = 'allow' THEN n ELSE 0 END AS a, CASE WHEN label = 'block' THEN n ELSE 0 END AS r
            FROM judged WHERE held AND label IS NOT NULL UNION ALL SELECT 0, 0, 0) GROUP BY step),
gains AS (SELECT step, sum(a) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept,
                 coalesce(sum(r) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
                 sum(a) OVER () AS accepted, sum(r) OVER () AS rejected FROM steps),
best AS (SELECT step * {step} AS t FROM gains WHERE accepted > 0 AND rejected > 0
         ORDER BY kept * rejected + cut * accepted DESC, abs(step), step LIMIT 1)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.label, CASE WHEN j.diff >= coalesce((SELECT t FROM best), 0) * j.letters THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r JOIN judged j ON j.text = r.text AND j.label IS NOT DISTINCT FROM r.label"""


#: CRC-32 of every distinct word by its bytes, gains by bucket, the draw by one global order
RESAMPLE = f"""WITH
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
        FROM range(256) r(i)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM docs),
tw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
words AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
buckets AS (SELECT word, xor(list_reduce(range(1, length(hx), 2), lambda c, p:
                     xor(c >> 8, t[xor(c & 255, CAST('0x' || substr(hx, p, 2) AS BIGINT)) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM words, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM tw JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT b.i AS bucket, CAST(floor(1000 * ln(
              CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) AS DOUBLE)
              / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM tw) + 10000) AS DOUBLE))) AS BIGINT) AS gain
          FROM range(10000) b(i) LEFT JOIN s ON s.bucket = b.i LEFT JOIN t ON t.bucket = b.i),
sums AS (SELECT doc_id, sum(gain) AS total FROM dw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features,
                  CASE WHEN len(w) > 0 THEN CAST(floor(CAST(total AS DOUBLE) / len(w)) AS BIGINT) ELSE 0 END AS weight,
                  CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
           FROM docs d LEFT JOIN sums ON sums.doc_id = d.doc_id),
noisy AS (SELECT doc_id, n_features, weight,
                 weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
          FROM noisy WHERE n_features >= 20)
SELECT n.doc_id, n.n_features, n.weight, n.score, CASE WHEN d.rank <= 10 * d.n // 100 THEN d.rank END AS rank
FROM noisy n LEFT JOIN drawn d ON d.doc_id = n.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op9_decontaminate": DECONTAMINATE,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_url_filter": url_models(urlfilter.ORDER, urlfilter.FOLDS, urlfilter.UNIT, urlfilter.STEP, urlfilter.LIMIT, urlfilter.RULES),
    "op13_resample": RESAMPLE,
}
