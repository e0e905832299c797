"""SQL for the operators that SQL can express, over the same tables. The other queries are tested
against brute force, the public libraries, or held-out rows."""

FINITE = """embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"""

CLOSURE = """reach(v, c) AS (SELECT id, id FROM nodes UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.c),
    named AS (SELECT v AS id, min(c) AS component FROM reach GROUP BY v),
    linked AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)"""

STATEMENTS = {
    "op2_substrings": r"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
    again AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
    kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS t FROM words k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i GROUP BY k.doc_id),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
    FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN lost l ON l.doc_id = d.doc_id""",
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
    digits AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(h, g * 5 + 1, 5))::BIGINT) AS parts FROM p)
    SELECT page_id, strlen(body) AS payload_bytes,
        array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM digits""",
    "op4_neighbours": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {FINITE}),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op5_jaccard": r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\s]+') AS w FROM documents),
    runs AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
    both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM runs x JOIN runs y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_ JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 10 * m >= 8 * (s.n + t.n - m)),
    nodes AS (SELECT doc_id AS id FROM documents), """ + CLOSURE + """
    SELECT n.id AS doc_id, component AS class_id, coalesce(l.n, 0) AS n_links, n.id = component AS kept
    FROM named n LEFT JOIN linked l ON l.id = n.id""",
    "op8_near_duplicates": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
        WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
    nodes AS (SELECT vec_id AS id FROM embeddings), {CLOSURE}
    SELECT n.id AS vec_id, coalesce(l.n, 0) AS n_links, component AS component_id, n.id = component AS kept
    FROM named n LEFT JOIN linked l ON l.id = n.id""",
    "op13_ranked": r"""WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT r, doc_id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM lowered),
    lens AS (SELECT r, doc_id, len(w) AS n FROM words WHERE len(w) > 0),
    whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lens),
    tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM words) GROUP BY r, term),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, whole GROUP BY term),
    asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id,
        unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY q, item_id, term),
    scored AS (SELECT q, any_value(item_id) AS item_id, r, any_value(l.doc_id) AS doc_id,
        sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lens l USING (r), whole GROUP BY q, r),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op11_prefixes": r"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
    codes AS (SELECT conv_id, list_transform(range(1, strlen(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT) AS c
        FROM (SELECT DISTINCT conv_id FROM turns)),
    convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(c, lambda a, b: list_reduce(range(0, 8),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295), 4294967295) % 4 AS h FROM codes),
    parts AS (SELECT c.conv_id, 0 AS part, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND i <= h
        UNION ALL SELECT c.conv_id, 1, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i > h),
    rebuilt AS (SELECT conv_id, row_number() OVER w AS d, text, md5(string_agg(sha256(role) || sha256(text), '') OVER w) AS p
        FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
    paths AS (SELECT conv_id, d, p, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    linked AS (SELECT *, lag(p) OVER w AS parent, lead(p) OVER w IS NULL AS ending FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
    node AS (SELECT p, any_value(d) AS d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256 FROM linked GROUP BY p),
    kids AS (SELECT parent AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY parent),
    below AS (SELECT a.p, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((q.n_convs - 1) * q.words) AS saved
        FROM node q JOIN paths a ON a.conv_id = q.conv_id AND a.d <= q.d LEFT JOIN kids k ON k.p = q.p GROUP BY a.p)
    SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM node n JOIN below b ON b.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN node up ON up.p = n.parent AND n.d > 0""",
}
