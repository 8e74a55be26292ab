"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

#: Features of one document, without its host.
_QUALITY = r"""
t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
h AS (SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1),
             lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS h FROM w),
u AS (SELECT doc_id, unnest(h) AS g, unnest(range(1, len(h) + 1)) AS p FROM h),
d AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM d WHERE c > 1) GROUP BY doc_id),
f AS (SELECT h.doc_id, source, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM h LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2,
             10 * n_symbols > n_words AS r3, 10 * n_dup_lines > 3 * n_lines AS r4 FROM f),
hosts AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS k FROM (
             SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([r1, r2, r3, r4]) AS failed FROM b WHERE source IS NOT NULL)
          GROUP BY ALL),
prior AS (SELECT rule, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS v FROM hosts GROUP BY rule),
strength AS (SELECT rule, m, CASE WHEN v <= 1e-12 THEN 1000 ELSE least(greatest(m * (1 - m) / v - 1, 2), 1000) END AS s FROM prior),
bad AS (SELECT DISTINCT source FROM hosts JOIN strength USING (rule) WHERE (k + s * m) / (n + s) >= 0.5)
"""

ORACLE_SQL["op7_quality_rules"] = (
    "WITH"
    + _QUALITY
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
       NOT (r1 OR r2) AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.source"""
)

#: Lines that later occurrences of a repeated window of three worded lines cover.
_LINES = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM {docs}),
worded AS (SELECT doc_id, i, x, lead(i) OVER o AS i2, lead(x) OVER o AS x2, lead(i, 2) OVER o AS i3, lead(x, 2) OVER o AS x3
           FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id, i) AS n FROM worded WHERE i3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM ranked WHERE n > 1),
stay AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
gone_by AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
deduped AS (SELECT d.* REPLACE (CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(s.text, '') END AS text),
                   len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed
            FROM {docs} d LEFT JOIN gone_by g USING (doc_id) LEFT JOIN stay s USING (doc_id))
"""

ORACLE_SQL["op3_line_dedup"] = "WITH" + _LINES.format(docs="documents") + "SELECT doc_id, text, n_lines, n_removed FROM deduped"

#: Words and hits of benchmark windows.
_LEAKS = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iv AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
              lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
widths AS (SELECT DISTINCT n FROM iv),
dv AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g,
              unnest(range(1, len(w) - n + 2)) AS p FROM dw, widths WHERE len(w) >= n),
hits AS (SELECT doc_id, p, n, item_id FROM dv JOIN iv USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
"""

ORACLE_SQL["op4_decontamination"] = (
    "WITH"
    + _LEAKS.format(docs="documents")
    + """SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""
)

ORACLE_SQL["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS first FROM d)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
