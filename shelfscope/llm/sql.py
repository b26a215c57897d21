"""SQL that DuckDB runs for the queries it can express, written from what they should return."""

from __future__ import annotations

from shelfscope.llm.quality_rules import CLASSES, COMMON_WORDS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS} AS w FROM documents
), named AS (
    SELECT doc_id, w, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS rep
    FROM w
), bag AS (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c
    FROM named, unnest(range(1, len(w) - 3)) u(i)
    WHERE doc_id = rep AND len(w) >= 5 GROUP BY ALL
), total AS (
    SELECT doc_id, sum(c) AS t FROM bag GROUP BY doc_id
), both_have AS (
    SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o
    FROM bag a JOIN bag b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM both_have JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b
    WHERE CAST(o AS DOUBLE) / CAST(x.t + y.t - o AS DOUBLE) >= 0.8
    UNION SELECT rep, doc_id FROM named WHERE rep <> doc_id
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(id, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT e.b, r.c FROM reach r JOIN edges e ON r.id = e.a
), classes AS (
    SELECT id AS doc_id, min(c) AS class_id FROM reach GROUP BY id
)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size,
       doc_id = class_id AS is_first
FROM classes
"""


def _op2() -> str:
    def matching(c: str) -> str:
        c = c.replace("'", "''")
        return f"length(text) - length(regexp_replace(text, '{c}+', '', 'g'))"

    classes = ", ".join(matching(c) for c in CLASSES)
    words = ", ".join(f"('{k}', {i + 1}, '{w}')" for k, v in COMMON_WORDS.items() for i, w in enumerate(v))
    n = len(CLASSES) + 1
    return f"""
WITH common(lang, pos, word) AS (
    VALUES {words}
), d AS (
    SELECT doc_id, coalesce(text, '') AS text, lang, {WORDS} AS w FROM documents
), grams AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM d, unnest(range(1, len(w) - 6)) u(i) WHERE len(w) >= 8
), twice AS (
    SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), steps AS (
    SELECT doc_id, i - lag(i, 1, i - 8) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM twice
), repeated AS (
    SELECT doc_id, sum(least(8, step)) AS n FROM steps GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^ \\x09-\\x0D]') GROUP BY doc_id
), base AS (
    SELECT doc_id, lang, text, w, len(w) AS n_words,
           length(array_to_string(w, '')) AS word_chars,
           {matching(CLASSES[2])} AS n_symbols,
           coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
           len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
    FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN lines l USING (doc_id)
), counted AS (
    SELECT doc_id, 'class' AS kind, unnest(range(1, {n})) AS pos,
           unnest([{classes}]) AS n, word_chars AS of
    FROM base
    UNION ALL
    SELECT doc_id, 'word', pos, len(list_filter(w, lambda x: x = word)), n_words
    FROM base JOIN common USING (lang)
), histogram AS (
    SELECT doc_id, kind, pos, n FROM counted
    UNION ALL SELECT doc_id, kind, 99, any_value(of) - sum(n) FROM counted GROUP BY ALL
), usual AS (
    SELECT lang, kind, pos, sum(n) AS n FROM histogram JOIN base USING (doc_id)
    WHERE NOT base_failed GROUP BY ALL
), shares AS (
    SELECT doc_id, kind, h.n / sum(h.n) OVER (PARTITION BY doc_id, kind) AS a,
           u.n / sum(u.n) OVER (PARTITION BY doc_id, kind) AS b
    FROM histogram h JOIN base USING (doc_id) JOIN usual u USING (lang, kind, pos)
), terms AS (
    SELECT doc_id, kind, a, b, (a + b) / 2 AS m FROM shares
), apart AS (
    SELECT doc_id, kind, sqrt(greatest(sum(
        (CASE WHEN a > 0 THEN a * log2(a / m) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / m) ELSE 0 END) / 2
    ), 0)) AS js
    FROM terms WHERE a IS NOT NULL AND NOT isnan(a) GROUP BY ALL
), judged AS (
    SELECT base.*, CASE WHEN word_chars >= 100 THEN c.js END AS by_class,
           CASE WHEN n_words >= 60 THEN v.js END AS by_word
    FROM base LEFT JOIN apart c ON c.doc_id = base.doc_id AND c.kind = 'class'
    LEFT JOIN apart v ON v.doc_id = base.doc_id AND v.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(by_class > 0.22 + 2.0 / sqrt(word_chars), false)
       AND NOT coalesce(by_word > 0.2 + 0.7 / sqrt(n_words), false) AS kept,
       round(by_class, 4) AS class_distance, round(by_word, 4) AS word_distance
FROM judged
"""


OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), s AS (
    SELECT payload, max(page_id) AS largest FROM p GROUP BY payload
)
SELECT p.page_id,
       CAST(strlen(p.payload) AS BIGINT) AS payload_bytes,
       b.digest AS payload_digest,
       CASE WHEN p.page_id = s.largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> s.largest THEN s.largest END AS refers_to
FROM p JOIN s USING (payload) JOIN (
    SELECT page_id, string_agg(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(('0b' || substr(bits, 5 * i + 1, 5)) AS INTEGER) + 1, 1), '' ORDER BY i) AS digest
    FROM (SELECT page_id, CAST(unhex(sha1(payload)) AS BLOB)::BIT::VARCHAR AS bits FROM p),
         range(32) r(i)
    GROUP BY page_id
) b USING (page_id)
"""

OP7_SQL = f"""
WITH w AS (
    SELECT doc_id, {WORDS} AS w FROM documents
), blocks AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS b
    FROM w, unnest(range(1, len(w) - 48)) u(i) WHERE len(w) >= 50
), repeated AS (
    SELECT doc_id, i FROM blocks QUALIFY min(doc_id) OVER (PARTITION BY b) < doc_id
), gone AS (
    SELECT DISTINCT doc_id, i + k AS pos FROM repeated, range(50) r(k)
), words AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w
), left_over AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
    FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""

CAPITALS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           {CAPITALS.format("coalesce(text, '')")} AS text
    FROM documents
), t AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), terms AS (
    SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), held AS (
    SELECT lang, source, term, count(*) AS n, any_value(lang_n) AS lang_n
    FROM t JOIN terms USING (lang, term) GROUP BY lang, source, term
), langs AS (
    SELECT lang, count(*) AS v, sum(lang_n) AS total FROM terms GROUP BY lang
), pairs_of AS (
    SELECT DISTINCT lang, source FROM d
), groups AS (
    SELECT lang, source, coalesce(v, 0) + coalesce(sum(n), 0) AS w, coalesce(any_value(total), 0) + coalesce(v, 0) AS lang_w
    FROM pairs_of LEFT JOIN held USING (lang, source) LEFT JOIN langs USING (lang) GROUP BY lang, source, v
), dense AS (
    SELECT lang, source, term, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // w AS p
    FROM groups JOIN terms USING (lang) LEFT JOIN held USING (lang, source, term)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), single AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM (
        SELECT lang, source, term, 1 + 1000000000::HUGEINT * (n + 1) // w AS p,
               1 + 1000000000::HUGEINT * (lang_n + 1) // lang_w AS q
        FROM held JOIN groups USING (lang, source)
    ) WHERE p > q
), everything AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL SELECT lang, source, 'term', item, value FROM single
)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM everything QUALIFY part = 'pair' OR rank <= 200
"""

OP13_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {OP13_TERMS.format(CAPITALS.format("text"))} AS t FROM documents
), stats AS (
    SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0
), items AS (
    SELECT row_number() OVER () AS i, item_id, unnest({OP13_TERMS.format(CAPITALS.format("text"))}) AS term FROM benchmark
), tf AS (
    SELECT r, doc_id, len(t) AS n, term, count(*) AS tf
    FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d)
    WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, stats GROUP BY term, n_docs
), scored AS (
    SELECT i, item_id, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term), stats GROUP BY i, item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank,
       doc_id, score::BIGINT AS score
FROM scored WHERE score > 0 AND doc_id IS NOT NULL QUALIFY rank <= 20
"""

SQL = {
    "op1_near_dedup": OP1_SQL,
    "op2_quality_rules": _op2(),
    "op6_warc": OP6_SQL,
    "op7_substrings": OP7_SQL,
    "op12_divergence": OP12_SQL,
    "op13_ranking": OP13_SQL,
}
