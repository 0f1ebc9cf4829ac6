"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from lexweave.llm.quality_rules import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CLASS_CHARS, MIN_WORD_WORDS

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH docs AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rk FROM docs GROUP BY source),
caps AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((rk - 1) % 3 + 1 AS INT)] AS weight, source_size * 2.0::DOUBLE AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sizes),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM caps),
fit AS (SELECT arg_min(lvl, cap / weight) AS lvl FROM levels WHERE lvl * weight <= cap),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT lvl FROM fit) * weight), cap) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + least(size, greatest(0, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP3 = """
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS merged,
         length(text) + length(text) - length(translate(text, '~[<', '')) AS escaped,
         length(role) + length(role) - length(translate(role, '~[<', '')) AS escaped_role FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN merged THEN length('[NEXT]') ELSE length('<s>[ROLE][TEXT][END]</s>') + escaped_role END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_COMMON = "CASE lang " + " ".join("WHEN '%s' THEN [%s]" % (k, ", ".join(f"'{w}'" for w in v)) for k, v in COMMON_WORDS.items()) + " END"


def _jensen_shannon(p: str, q: str) -> str:
    def term(x: str, y: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    pairs = f"list_transform(range(1, len({p}) + 1), lambda i: {term(f'{p}[i]', f'{q}[i]')} + {term(f'{q}[i]', f'{p}[i]')})"
    return f"sqrt(greatest(list_sum({pairs}) / 2, 0))"


def _shares(where: str) -> str:
    return f"""SELECT *, list_transform([upper, digit, n_chars - word_chars, point, n_symbols, n_chars - upper - digit - (n_chars - word_chars) - point - n_symbols], lambda x: x / greatest(n_chars, 1)::DOUBLE) AS classes,
       list_transform(list_append(bins, n_words - list_sum(bins)), lambda x: x / greatest(n_words, 1)::DOUBLE) AS commons FROM {where}"""


OP7 = rf"""
WITH base AS (
  SELECT doc_id, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang ELSE '*' END AS lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM base),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(5) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(text) AS n_chars,
         length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS upper,
         length(text) - length(translate(text, '0123456789', '')) AS digit,
         length(text) - length(translate(text, '.,;:!?''"()-', '')) AS point,
         list_transform(w, lambda x: coalesce(list_position({_COMMON}, lower(rtrim(x, '.,'))), 0)) AS hits
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN dups d USING (doc_id)),
binned AS (
  SELECT *, list_transform(range(1, 13), lambda k: len(list_filter(hits, lambda h: h = k))) AS bins,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
pooled AS (
  SELECT lang, {", ".join(f"sum({c}) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_chars", "upper", "digit", "point"))},
         [{", ".join(f"sum(bins[{i}])" for i in range(1, 13))}] AS bins FROM binned WHERE NOT base_failed GROUP BY lang),
reference AS ({_shares("pooled")}),
shares AS ({_shares("binned")}),
judged AS (
  SELECT s.*, {_jensen_shannon("s.classes", "r.classes")} AS class_distance, {_jensen_shannon("s.commons", "r.commons")} AS word_distance
  FROM shares s LEFT JOIN reference r ON s.lang = r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_chars >= {MIN_CLASS_CHARS} AND coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE})
       AND NOT (lang <> '*' AND n_words >= {MIN_WORD_WORDS} AND coalesce(word_distance, 0) > {MAX_WORD_DISTANCE}) AS kept
FROM judged
"""

# Base32 in SQL: eight groups of five bits from each five bytes of the digest, cut from its hex digits.
OP5 = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
      (('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) AS INT) + 1, 1)), '') AS payload_digest FROM hashed)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(min(page_id) OVER (PARTITION BY html), page_id) AS refers_to
FROM coded
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS p, unnest(list_transform(range(0, n - 49), lambda i: substr(h, 2 * i + 1, 100))) AS s FROM d WHERE n >= 50),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT DISTINCT doc_id, p FROM w JOIN f USING (s) WHERE least < doc_id),
starts AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM hits),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM starts),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM grouped GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
parts AS (SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2)::HUGEINT // (total + 2 * v) AS q FROM kept JOIN langs USING (lang)),
named AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (coalesce(t.total, 0) + 2 * l.v) AS p
  FROM named g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT d.lang, d.source, d.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM dense d JOIN q ON q.lang = d.lang AND q.term = d.term WHERE d.n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""

# Classes of equal sets first; links between classes by shared shingles, then reachability by a recursive union.
OP12 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
classes AS (SELECT s, CAST(len(s) AS BIGINT) AS n, min(doc_id) AS node FROM sets GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS g FROM classes WHERE n > 0),
links AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT d.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN d.doc_id ELSE coalesce(l.label, c.node) END AS component_id,
       CASE WHEN c.n = 0 THEN true ELSE d.doc_id = coalesce(l.label, c.node) END AS kept
FROM sets d JOIN classes c ON d.s = c.s LEFT JOIN least l ON l.node = c.node
"""

ORACLES = {"op8_suffix_dedup": OP8, "op5_warc": OP5, "op3_chat_format": OP3, "op7_quality_rules": OP7, "op2_mixing": OP2, "op9_exact_dedup": OP9, "op12_minhash": OP12, "op13_source_divergence": OP13}
