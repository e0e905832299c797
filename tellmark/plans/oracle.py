"""Independent SQL for the queries, for an engine that has the given tables as views.

Each statement is written from the operator's definition, with global windows and plain
grouping where the Spark side avoids them.
"""

from __future__ import annotations

from tellmark import config as cfg

WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


TOKEN = r"[\p{L}\p{N}_]{2,}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WS.replace('[', '[^', 1)}+')"


def decorated(text: str, number: str) -> str:
    return f"""CASE ({number}) % 8
        WHEN 1 THEN '<think>plan' || chr(10) || 'notes</think>' || chr(10) || {text}
        WHEN 2 THEN 'Sure, here are my words: ' || {text}
        WHEN 3 THEN 'Review:' || repeat(chr(10), 4) || '"' || {text} || '"'
        WHEN 4 THEN 'Certainly! - here is the text:' || chr(10) || ' ''' || {text} || '''  '
        WHEN 5 THEN '“' || {text} || ';' || repeat(chr(10), 4) || '–”'
        WHEN 6 THEN {text} || ' 前台的简，非常乐'
        WHEN 7 THEN 'Review — ' || {text} || ' - we’ll see…'
        ELSE {text} END"""


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted('(?i)' + portable(pattern))})"


def portable(pattern: str) -> str:
    """White space, digits and a word's begin spelled out, since engines differ in what they take for them."""
    if pattern.startswith(r"\b"):
        return r"(?:^|[^\p{L}\p{N}_])" + portable(pattern[2:])
    return pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", WS)


def hash_number(h: str, digits: int = 8) -> str:
    return f"('0x' || substr({h}, 1, {digits}))::BIGINT"


def opener(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[^A-Za-z]*([A-Za-z'']+)', 1))"


def move_draw(seed: str, cell: str, rep: str) -> str:
    total = sum(w for _, w in cfg.OPENER_MOVES)
    draw = hash_number(f"md5(concat_ws(':', {seed}, {cell}, {rep}, 'opener'))") + f" * {total}"
    out, upto = "CASE", 0
    for move, weight in cfg.OPENER_MOVES:
        upto += weight
        out += f" WHEN {draw} < {upto * 2**32} THEN {quoted(move)}"
    return out + " END"


def stray(x: str) -> str:
    keep = rf"regexp_matches(c, '^\p{{L}}$') OR contains('{cfg.CJK_PUNCTUATION}', c)"
    found = rf"regexp_extract_all({x}, '[^\x00-\x{{24F}}]')"
    return f"array_to_string(list_sort(list_distinct(list_filter({found}, lambda c: {keep}))), '')"


def cleaned(source: str, name: str, normalize: bool = False) -> str:
    """CTEs that clean column ``text`` of ``source`` step by step; the result is ``name``."""
    reasoning = quoted("(?is)" + portable(cfg.REASONING_PATTERN))
    preamble = quoted(f"(?i)^(?:{portable(cfg.PREAMBLE_PATTERN)})+")
    steps = [
        f"regexp_replace(coalesce(text, ''), {reasoning}, '', 'g')",
        strip("text"),
        f"regexp_replace(text, {preamble}, '')",
        strip("text"),
    ]
    for left, right in (('"', '"'), ("'", "'"), ("“", "”")):
        inner = strip("substr(text, 2, length(text) - 2)")
        steps.append(
            f"CASE WHEN length(text) > 1 AND starts_with(text, {quoted(left)}) "
            f"AND ends_with(text, {quoted(right)}) THEN {inner} ELSE text END"
        )
    steps += [r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')", strip("text")]
    ctes, previous = [], source
    for i, step in enumerate(steps, 1):
        this = name if i == len(steps) else f"{name}_{i}"
        ctes.append(f"{this} AS (SELECT * REPLACE ({step} AS text) FROM {previous})")
        previous = this
    return ",\n".join(ctes)


CORPUS = """corpus AS (
    SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'real' ELSE 'fake' END AS "Binary_label",
           d.source AS "Category", 'text' AS domain, d.text, 0 AS is_synthetic, d.lang AS source,
           CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS y, l.toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

GEN = f"""gen0 AS (
    SELECT doc_id AS id, source AS "Category", lang AS model, {decorated('text', 'doc_id')} AS text,
           CASE WHEN doc_id & 1 = 0 THEN 'short' ELSE 'long' END AS length,
           CASE WHEN (doc_id >> 1) & 1 = 0 THEN 'positive' ELSE 'negative' END AS sentiment,
           CASE WHEN (doc_id >> 2) & 1 = 0 THEN 'structured' ELSE 'unstructured' END AS structure,
           CASE WHEN (doc_id >> 3) & 1 = 0 THEN 'few_shot' ELSE 'zero_shot' END AS example_mode,
           doc_id >> 4 AS rep_index
    FROM documents),
gen1 AS (SELECT *, concat_ws('_', length, sentiment, structure, example_mode) AS cell_id FROM gen0),
gen AS (
    SELECT *, {move_draw("'12'", 'cell_id', 'rep_index')} AS opener_move, length(text) AS n_chars,
           CASE WHEN length = 'short' THEN (length(text) BETWEEN 130 AND 270)::INT
                ELSE (length(text) BETWEEN 455 AND 945)::INT END AS in_length_band,
           1 + rep_index % 2 AS n_attempts
    FROM gen1)"""

MANIFEST = """items AS (
    SELECT source AS item, row_number() OVER (ORDER BY source) - 1 AS ix
    FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
n AS (SELECT count(*) AS total, count(*) // 16 AS base, count(*) % 16 AS extra FROM documents),
cells AS (
    SELECT row_number() OVER (ORDER BY a.o, b.o, c.o, e.o) - 1 AS cell_ord,
           a.x AS length, b.x AS sentiment, c.x AS structure, e.x AS example_mode,
           concat_ws('_', a.x, b.x, c.x, e.x) AS cell_id
    FROM (VALUES (0, 'short'), (1, 'long')) a(o, x), (VALUES (0, 'positive'), (1, 'negative')) b(o, x),
         (VALUES (0, 'structured'), (1, 'unstructured')) c(o, x), (VALUES (0, 'few_shot'), (1, 'zero_shot')) e(o, x)),
sized AS (
    SELECT cells.*, base + CASE WHEN cell_ord < extra THEN 1 ELSE 0 END AS target FROM cells, n),
starts AS (
    SELECT *, coalesce(sum(target) OVER (ORDER BY cell_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized),
planned AS (SELECT *, unnest(range(target)) AS rep_index FROM starts),
manifest AS (
    SELECT p.*, start + rep_index AS ordinal, i.item
    FROM planned p JOIN items i ON i.ix = (start + rep_index) % (SELECT count(*) FROM items))"""

ASPECTS = f"""aspect_ranks AS (
    SELECT cell_id, rep_index, aspect,
           row_number() OVER (PARTITION BY cell_id, rep_index
               ORDER BY md5(concat_ws(':', '12', cell_id, rep_index, 'aspect', aspect)), aspect) AS r
    FROM manifest, (SELECT unnest([{', '.join(quoted(a) for a in cfg.ASPECT_PATTERNS)}]) AS aspect)
    WHERE structure = 'structured'),
aspects AS (
    SELECT cell_id, rep_index, list_sort(list(aspect)) AS aspects FROM aspect_ranks WHERE r <= 4
    GROUP BY cell_id, rep_index)"""

CLASSES = f"""classes AS (
    SELECT "Binary_label" AS class, id, text FROM corpus
    UNION ALL
    SELECT 'generated', conv_id, {decorated('text', 'conv_id + turn')} FROM conversations WHERE role = 'assistant')"""

CHARS = f"""chars AS (
    SELECT class, ch, count(*) AS n_texts
    FROM (SELECT class, unnest(list_distinct(regexp_extract_all(text, '(?s).'))) AS ch FROM classes)
    WHERE NOT regexp_matches(ch, '^{WS}$') GROUP BY class, ch),
separators AS (
    SELECT ch, n_texts FROM chars WHERE class = 'generated'
    AND ch NOT IN (SELECT ch FROM chars WHERE class <> 'generated'))"""

ATTEMPTS = f"""raw_attempts AS (
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'short' ELSE 'long' END AS cell_id, turn + 1 AS attempt_no,
           {decorated('text', 'conv_id + turn')} AS text,
           CASE WHEN conv_id % 2 = 0 THEN 130 ELSE 455 END AS lo,
           CASE WHEN conv_id % 2 = 0 THEN 270 ELSE 945 END AS hi
    FROM conversations),
{cleaned('raw_attempts', 'cleaned')},
attempts AS (
    SELECT *, length(text) AS nc, len({words('text')}) AS nw, {stray('text')} AS stray FROM cleaned),
judged AS (
    SELECT *, CASE WHEN nw < 10 THEN 'output too short (' || nw || ' words)'
                   WHEN stray <> '' THEN 'non-English output (' || substr(stray, 1, 20) || ')' END AS err,
           CASE WHEN nc BETWEEN lo AND hi THEN 0 ELSE least(abs(nc - lo), abs(nc - hi)) END AS distance
    FROM attempts),
chosen AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY distance, attempt_no) AS r
        FROM judged WHERE err IS NULL) WHERE r = 1),
per_sample AS (
    SELECT conv_id, any_value(cell_id) AS cell_id, max(attempt_no) AS last_no,
           arg_max(err, attempt_no) FILTER (err IS NOT NULL) AS last_error FROM judged GROUP BY conv_id),
windowed AS (
    SELECT p.conv_id, p.cell_id, c.text, c.hi, substr(c.text, 1, c.hi + 1) AS w,
           CASE WHEN c.distance = 0 THEN c.attempt_no ELSE p.last_no END AS n_attempts,
           CASE WHEN c.conv_id IS NULL THEN p.last_error END AS error
    FROM per_sample p LEFT JOIN chosen c ON p.conv_id = c.conv_id),
cut AS (
    SELECT *, CASE WHEN regexp_extract(w, '(?s)^(.*[.!?]) ', 1) <> '' THEN regexp_extract(w, '(?s)^(.*[.!?]) ', 1)
                   ELSE regexp_extract(w, '(?s)^(.*[.!?])', 1) END AS head
    FROM windowed),
best AS (
    SELECT conv_id, cell_id, n_attempts, error,
           CASE WHEN length(text) > hi AND length(head) > 1 THEN {strip('head')} ELSE text END AS text
    FROM cut)"""

TURNS = ATTEMPTS.replace("SELECT conv_id, CASE", "SELECT conv_id * 100 + turn AS conv_id, CASE", 1)

SPLIT = """ranked AS (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', '42', id)), id) AS r,
           count(*) OVER (PARTITION BY y) AS nc FROM corpus),
sizes AS (SELECT *, floor(nc * 0.7::DOUBLE) AS nt FROM ranked),
split AS (
    SELECT *, CASE WHEN r <= nt THEN 'train'
                   WHEN r <= nt + floor((nc - nt) * (0.15::DOUBLE / (1.0::DOUBLE - 0.7::DOUBLE))) THEN 'validation'
                   ELSE 'test' END AS split FROM sizes)"""

TERMS = f"""toks AS (SELECT id, split, regexp_extract_all(strip_accents(lower(text)), '{TOKEN}') AS t FROM split),
grams AS (
    SELECT id, split, unnest(t) AS term FROM toks
    UNION ALL
    SELECT id, split, t[i] || ' ' || t[i + 1] FROM (SELECT id, split, t, unnest(range(1, len(t))) AS i FROM toks)),
tf AS (SELECT id, split, term, count(*) AS tf FROM grams GROUP BY id, split, term),
n_train AS (SELECT count(*) AS n FROM split WHERE split = 'train'),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf WHERE split = 'train' GROUP BY term),
kept AS (
    SELECT term, df, cf, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf,
           row_number() OVER (ORDER BY cf DESC, term) AS place
    FROM stats, n_train WHERE df >= 2 AND df <= 0.95::DOUBLE * n),
vocab AS (
    SELECT term, df, cf, idf, row_number() OVER (ORDER BY term) - 1 AS term_id FROM kept WHERE place <= 100000)"""

POOL = """members AS (
    SELECT id, length(text) AS n_chars, "Category" AS category, 'real_positive' AS pool FROM corpus
    WHERE "Binary_label" = 'real' AND source = 'en'
    UNION ALL SELECT id, length(text), "Category", 'real_negative' FROM corpus
    WHERE "Binary_label" = 'real' AND source = 'fr'
    UNION ALL SELECT id, length(text), "Category", 'fake' FROM corpus
    WHERE "Binary_label" = 'fake' AND source = 'en'),
scoped AS (
    SELECT pool, category AS scope, id, n_chars FROM members WHERE category <> ''
    UNION ALL SELECT pool, '', id, n_chars FROM members),
bands AS (
    SELECT pool, scope, 'short' AS length, quantile_cont(n_chars, 0.0) AS lo, quantile_cont(n_chars, 0.25) AS hi
    FROM scoped GROUP BY pool, scope
    UNION ALL
    SELECT pool, scope, 'long', quantile_cont(n_chars, 0.25), quantile_cont(n_chars, 0.75)
    FROM scoped GROUP BY pool, scope),
placed AS (
    SELECT s.*, b.length, (n_chars BETWEEN lo AND hi) AS inside,
           count(*) FILTER (n_chars BETWEEN lo AND hi) OVER (PARTITION BY s.pool, s.scope, b.length) AS n_in
    FROM scoped s JOIN bands b ON s.pool = b.pool AND s.scope = b.scope),
pool AS (
    SELECT pool, scope, length, id, n_chars,
           count(*) OVER (PARTITION BY pool, scope, length) AS size,
           row_number() OVER (PARTITION BY pool, scope, length
               ORDER BY md5(concat_ws(':', '12', id, 'example')), id) AS rank
    FROM placed WHERE inside OR n_in = 0)"""

PICKS = f"""wants AS (
    SELECT cell_id, rep_index, kind, length, item,
           CASE kind WHEN 'real' THEN 'real_' || sentiment ELSE 'fake' END AS pool,
           {hash_number("md5(concat_ws(':', '12', cell_id, rep_index, kind))", 15)} AS draw
    FROM manifest, (VALUES ('real'), ('fake')) k(kind) WHERE example_mode = 'few_shot'),
groups AS (SELECT DISTINCT pool, scope, length, size FROM pool),
aimed AS (
    SELECT w.*, coalesce(o.scope, a.scope) AS scope, draw % coalesce(o.size, a.size) + 1 AS rank
    FROM wants w
    LEFT JOIN groups o ON o.pool = w.pool AND o.scope = w.item AND o.length = w.length
    LEFT JOIN groups a ON a.pool = w.pool AND a.scope = '' AND a.length = w.length),
picked AS (
    SELECT a.cell_id, a.rep_index, a.kind, p.id FROM aimed a
    LEFT JOIN pool p ON p.pool = a.pool AND p.scope = a.scope AND p.length = a.length AND p.rank = a.rank),
picks AS (
    SELECT m.*, r.id AS real_id, f.id AS fake_id FROM manifest m
    LEFT JOIN picked r ON r.cell_id = m.cell_id AND r.rep_index = m.rep_index AND r.kind = 'real'
    LEFT JOIN picked f ON f.cell_id = m.cell_id AND f.rep_index = m.rep_index AND f.kind = 'fake')"""

PROMPTS = f"""exampled AS (
    SELECT p.*, coalesce({strip('a.text')}, '') AS real_example, coalesce({strip('b.text')}, '') AS fake_example,
           x.aspects, {move_draw("'12'", 'p.cell_id', 'p.rep_index')} AS move
    FROM picks p LEFT JOIN corpus a ON a.id = p.real_id LEFT JOIN corpus b ON b.id = p.fake_id
    LEFT JOIN aspects x ON x.cell_id = p.cell_id AND x.rep_index = p.rep_index),
prompts AS (
    SELECT cell_id, rep_index, example_mode,
           concat_ws(chr(10), 'Describe ' || item || '.', 'Tone: ' || sentiment || '.',
               CASE length WHEN 'short' THEN 'Short, about 200 characters (20-35 words), within 130 and 270.'
                           ELSE 'Long, about 700 characters (110-140 words), within 455 and 945.' END,
               CASE structure WHEN 'structured' THEN 'Cover: ' || array_to_string(aspects, ', ') || '.' ELSE 'Free form.' END,
               'Open with ' || move || '.', 'Text only.') AS system,
           CASE WHEN example_mode = 'few_shot' AND real_example <> '' AND fake_example <> ''
                THEN 'First:' || chr(10) || real_example || chr(10) || chr(10) || 'Second:' || chr(10) || fake_example
                ELSE 'Begin.' END AS "user"
    FROM exampled)"""

DONE = "done AS (SELECT cell_id, rep_index FROM gen WHERE id IN (SELECT doc_id FROM labels))"

JUDGED = """judged AS (
    SELECT id, CASE WHEN id % 3 = 0 THEN 'negative' ELSE 'positive' END AS sentiment,
           CASE WHEN y = 1 AND toxic = 1 THEN 'error:Timeout' WHEN toxic = 1 THEN 'No idea'
                WHEN y = 0 THEN ' Positive.' || chr(10) ELSE 'It is NEGATIVE' END AS raw
    FROM corpus),
verdicts AS (
    SELECT *, CASE WHEN raw LIKE 'error:%' THEN raw WHEN lower(raw) LIKE '%positive%' THEN 'positive'
                   WHEN lower(raw) LIKE '%negative%' THEN 'negative' ELSE 'unknown' END AS verdict
    FROM judged)"""

LOGITS = """logits AS (
    SELECT vec_id, label % 2 AS y,
           1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)) AS score,
           1 / (1 + exp(embedding[3]::DOUBLE - embedding[4]::DOUBLE)) AS score_b FROM embeddings)"""

CONFUSION = """count(*) FILTER (y <> 1 AND pred <> 1) AS tn, count(*) FILTER (y <> 1 AND pred = 1) AS fp,
           count(*) FILTER (y = 1 AND pred <> 1) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"""
RATES = """(tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy,
           CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
           CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
           CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1"""
RATES_6 = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"

CURVE = """points AS (
    SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM logits GROUP BY score),
curve AS (
    SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM points),
areas AS (
    SELECT sum(neg * (cp - pos) + neg * pos / 2.0::DOUBLE) / (sum(pos) * sum(neg))::DOUBLE AS roc_auc,
           sum(pos * cp / (cp + cn)::DOUBLE) / sum(pos)::DOUBLE AS pr_auc FROM curve)"""

RUNS = f"""paired AS (
    SELECT 'model_a' AS model, 0 AS first_run, y, score FROM logits
    UNION ALL SELECT 'model_b', 5, y, score_b FROM logits),
thresholds AS (SELECT * FROM (VALUES (1, 0.3::DOUBLE), (2, 0.4::DOUBLE), (3, 0.5::DOUBLE), (4, 0.6::DOUBLE), (5, 0.7::DOUBLE)) t(i, threshold)),
counted AS (
    SELECT model, first_run + i AS run, threshold, {CONFUSION}
    FROM (SELECT *, (score >= threshold)::INT AS pred FROM paired, thresholds) GROUP BY model, first_run + i, threshold),
runs AS (SELECT *, {RATES} FROM counted)"""

STYLES = {
    "starts_with_i": f"{opener('text')} = 'i'",
    "starts_with_first_person": f"{opener('text')} IN ('i', 'we', 'my', 'our')",
    "contains_em_dash": "contains(text, '—')",
    "contains_en_dash": "contains(text, '–')",
    "contains_spaced_hyphen": "contains(text, ' - ')",
    "contains_hyphen": "contains(text, '-')",
    "contains_semicolon": "contains(text, ';')",
}

HITS = "list_filter([" + ", ".join(
    f"CASE WHEN {matches('text', p)} THEN {quoted(a)} END" for a, p in cfg.ASPECT_PATTERNS.items()
) + "], lambda a: a IS NOT NULL)"

NGRAMS6 = "array_to_string(w[i:i + 5], ' ')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _style_rows() -> str:
    pick = lambda c, e: f"round(100 * avg(CASE WHEN class = '{c}' THEN ({e})::INT END), 6) AS {c}"
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(pick(c, e) for c in ("generated", "real", "fake")) + " FROM classes"
        for m, e in STYLES.items()
    )


def statements() -> dict[str, str]:
    raw = f"raw AS (SELECT doc_id, {decorated('text', 'doc_id')} AS text FROM documents)"
    opener_flag = f"""CASE WHEN opener_move LIKE 'first person singular%' THEN {opener('text')} IN ('i', 'i''m', 'i''ve', 'my')
        WHEN opener_move LIKE 'first person plural%' THEN {opener('text')} IN ('we', 'we''ve', 'our', 'us')
        ELSE {opener('text')} NOT IN ('i', 'i''m', 'i''ve', 'we', 'my', 'our') END"""
    head = lambda w: f"CASE WHEN regexp_extract({w}, '(?s)^(.*[.!?]) ', 1) <> '' THEN regexp_extract({w}, '(?s)^(.*[.!?]) ', 1) ELSE regexp_extract({w}, '(?s)^(.*[.!?])', 1) END"
    merged = """merged AS (
    SELECT id, "Binary_label", "Category", domain, text, is_synthetic, source, NULL AS model, NULL AS cell_id, NULL AS rep_index FROM corpus
    UNION ALL
    SELECT id, 'generated', "Category", 'text', text, 1, NULL, model, cell_id, rep_index FROM gen)"""
    scan_columns = ['"Category"', "domain", "is_synthetic", "source", "model", "cell_id", "id"]
    long = "pairs AS (" + " UNION ALL ".join(
        f"""SELECT CASE WHEN "Binary_label" = 'generated' THEN 'generated' ELSE 'human' END AS label,
        '{c.strip('"')}' AS "column", {c}::VARCHAR AS value FROM merged""" for c in scan_columns
    ) + ")"
    return {
        "read_corpus": with_(CORPUS) + 'SELECT id, "Binary_label", "Category", source, text FROM corpus',
        "route_failures": with_(TURNS)
        + "SELECT conv_id, CASE WHEN error IS NULL THEN 'accepted' ELSE 'failed' END AS sink, n_attempts, error FROM best",
        "null_audit": """SELECT count(*) AS n_rows, count(*) FILTER (d.text IS NULL) AS null_text,
            count(*) FILTER (l.quality IS NULL) AS null_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        "normalize_labels": with_(CORPUS) + f"""SELECT id, {strip("chr(160) || ' ' || chr(10) || text || chr(9) || chr(12288)")} AS text,
            CASE WHEN id % 2 = 0 THEN upper("Binary_label") ELSE "Binary_label" END AS label, y FROM corpus""",
        "corpus_audit": with_(CORPUS) + """SELECT 'n_rows' AS metric, '' AS key1, '' AS key2, count(*) AS value FROM corpus
            UNION ALL SELECT 'missing_values', '', '', count(*) FILTER (text IS NULL OR "Binary_label" IS NULL) FROM corpus
            UNION ALL SELECT 'duplicate_texts', '', '', count(text) - count(DISTINCT text) FROM corpus
            UNION ALL SELECT 'class_count', "Binary_label", '', count(*) FROM corpus GROUP BY "Binary_label"
            UNION ALL SELECT 'source_by_label', s.source, l.label,
                (SELECT count(*) FROM corpus c WHERE c.source = s.source AND c."Binary_label" = l.label)
            FROM (SELECT DISTINCT source FROM corpus) s, (VALUES ('fake'), ('real')) l(label)""",
        "source_label_crosstab": with_(CORPUS) + """SELECT source, count(*) FILTER ("Binary_label" = 'fake') AS fake,
            count(*) FILTER ("Binary_label" = 'real') AS "real" FROM corpus GROUP BY source""",
        "merge_corpora": with_(CORPUS, GEN, merged) + "SELECT * REPLACE (rep_index::VARCHAR AS rep_index) FROM merged",
        "leakage_scan": with_(CORPUS, GEN, merged, long) + """SELECT "column", count(*) AS n_rows,
            count(DISTINCT value) + max((value IS NULL)::INT) AS n_values,
            (count(DISTINCT value) + max((value IS NULL)::INT) = 1)::INT AS is_constant,
            (count(DISTINCT value) + max((value IS NULL)::INT) > 0.5 * count(*))::INT AS near_unique,
            (max(mixed) = 0 AND count(DISTINCT value) + max((value IS NULL)::INT) > 1)::INT AS perfect_predictor,
            coalesce(count(DISTINCT label) FILTER (value IS NULL) = 1 AND count(DISTINCT label) FILTER (value IS NOT NULL) = 1
                AND max(label) FILTER (value IS NULL) <> max(label) FILTER (value IS NOT NULL), false)::INT AS null_predictor
            FROM (SELECT *, (min(label) OVER (PARTITION BY "column", value) <> max(label) OVER (PARTITION BY "column", value))::INT AS mixed
                  FROM pairs) GROUP BY "column" """,
        "split_overlap": with_(CORPUS, SPLIT) + """SELECT md5(text) AS text_md5, count(*) AS n_rows, max((split = 'train')::INT) AS in_train,
            max((split = 'validation')::INT) AS in_validation, max((split = 'test')::INT) AS in_test
            FROM split GROUP BY md5(text) HAVING count(DISTINCT split) > 1""",
        "text_counts": f"SELECT doc_id, length(text) AS n_chars, len({words('text')}) AS n_words FROM documents",
        "clean_response": with_(raw, cleaned("raw", "cleaned")) + "SELECT doc_id, text FROM cleaned",
        "fold_typography": with_(raw) + "SELECT doc_id, "
        + _nest_replace("text", cfg.TYPOGRAPHY) + " AS text FROM raw",
        "fold_accents": "SELECT doc_id, strip_accents(text) AS text FROM documents",
        "stray_characters": with_(raw) + f"SELECT doc_id, {stray('text')} AS stray FROM raw",
        "trim_to_sentence": f"""SELECT doc_id, CASE WHEN length(text) > 945 AND length({head('substr(text, 1, 946)')}) > 1
            THEN {strip(head('substr(text, 1, 946)'))} ELSE text END AS text FROM documents""",
        "length_band": """SELECT doc_id, 455 AS lo, 945 AS hi, (length(text) BETWEEN 455 AND 945)::INT AS in_band,
            CASE WHEN length(text) < 455 THEN 455 - length(text) WHEN length(text) > 945 THEN length(text) - 945 ELSE 0 END AS distance
            FROM documents""",
        "opener_words": with_(raw) + f"SELECT doc_id, {opener('text')} AS opener FROM raw",
        "aspect_tags": f"""SELECT doc_id, array_to_string(hits, '|') AS aspects, len(hits) AS n_aspects
            FROM (SELECT doc_id, {HITS} AS hits FROM documents)""",
        "word_ngrams": f"""WITH w AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents),
            g AS (SELECT doc_id, list_transform(range(1, len(w) - 4), lambda i: {NGRAMS6}) AS g FROM w)
            SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM g""",
        "filter_cells": with_(MANIFEST) + """SELECT cell_id, rep_index, item FROM manifest
            WHERE cell_id GLOB 'long_*_few_shot' OR contains(cell_id, 'long_*_few_shot')""",
        "parse_verdict": with_(CORPUS, JUDGED) + "SELECT id, raw, verdict FROM verdicts",
        "logit_scores": with_(LOGITS) + "SELECT vec_id, y, round(score, 6) AS score, (score >= 0.5)::INT AS pred FROM logits",
        "instruction_join": with_(GEN, MANIFEST, ASPECTS) + f"""SELECT g.id, g.cell_id, g.rep_index, m.item,
            {move_draw("'12'", 'm.cell_id', 'm.rep_index')} AS asked_opener, coalesce(array_to_string(a.aspects, '|'), '') AS aspects
            FROM gen g JOIN manifest m ON g.cell_id = m.cell_id AND g.rep_index = m.rep_index
            LEFT JOIN aspects a ON a.cell_id = m.cell_id AND a.rep_index = m.rep_index""",
        "remaining_work": with_(GEN, MANIFEST, DONE) + """SELECT cell_id, rep_index, item FROM manifest m
            WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.cell_id = m.cell_id AND d.rep_index = m.rep_index)""",
        "remaining_work_by_count": with_(GEN, MANIFEST, DONE) + """SELECT cell_id, rep_index, item FROM manifest m
            WHERE rep_index >= (SELECT count(*) FROM done d WHERE d.cell_id = m.cell_id)""",
        "ngram_copy": f"""WITH t AS (SELECT conv_id, turn, {words('lower(text)')} AS w FROM conversations),
            g AS (SELECT conv_id, turn, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM t)
            SELECT b.conv_id, b.turn, len(list_filter(b.g, lambda x: list_contains(a.g, x))) AS n_copied
            FROM g b JOIN g a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1""",
        "ngram_contamination": f"""WITH probe AS (
                SELECT DISTINCT unnest(list_transform(range(1, len(w) - 4), lambda i: {NGRAMS6})) AS gram
                FROM (SELECT {words('lower(text)')} AS w FROM benchmark)),
            grams AS (SELECT doc_id, list_transform(range(1, len(w) - 4), lambda i: {NGRAMS6}) AS g
                FROM (SELECT doc_id, {words('lower(text)')} AS w FROM documents)),
            pos AS (SELECT doc_id, len(g) AS n_grams, unnest(g) AS gram FROM grams)
            SELECT doc_id, n_grams, count(*) AS n_matched, count(DISTINCT gram) AS n_distinct_matched
            FROM pos WHERE gram IN (SELECT gram FROM probe) GROUP BY doc_id, n_grams""",
        "length_report": with_(GEN) + """SELECT length, count(*) AS n, round(avg(n_chars), 6) AS mean_chars,
            round(100 * avg(in_length_band), 6) AS pct_in_band, round(avg(n_attempts), 6) AS mean_attempts FROM gen GROUP BY length""",
        "length_adherence": with_(GEN) + """SELECT count(*) AS n, round(avg(in_length_band), 6) AS in_band,
            (avg(in_length_band) < 0.6)::INT AS poor FROM gen""",
        "sentiment_agreement": with_(CORPUS, JUDGED) + """SELECT sentiment, count(*) AS n, count(*) FILTER (verdict = sentiment) AS agreed,
            round(100 * count(*) FILTER (verdict = sentiment) / count(*)::DOUBLE, 6) AS pct_agreed,
            count(*) FILTER (verdict LIKE 'error%') AS errors FROM verdicts GROUP BY sentiment""",
        "aspect_coverage": with_(GEN, MANIFEST, ASPECTS) + f"""
            SELECT coalesce(length, 'all') AS length, sum(asked)::BIGINT AS asked, sum(hit)::BIGINT AS hit,
                   round(100 * sum(hit) / sum(asked)::DOUBLE, 6) AS pct
            FROM (SELECT g.length, len(a.aspects) AS asked, len(list_intersect(a.aspects, {HITS.replace('text', 'g.text')})) AS hit
                  FROM gen g JOIN manifest m ON g.cell_id = m.cell_id AND g.rep_index = m.rep_index
                  JOIN aspects a ON a.cell_id = m.cell_id AND a.rep_index = m.rep_index)
            GROUP BY ROLLUP (length)""",
        "aspect_mentions": with_(GEN)
        + f"SELECT structure, count(*) AS n, round(avg(len({HITS})), 6) AS mean_aspects FROM gen GROUP BY structure",
        "opener_compliance": with_(GEN)
        + f"SELECT opener_move, count(*) AS n, round(100 * avg(({opener_flag})::INT), 6) AS pct_ok FROM gen GROUP BY opener_move",
        "stylometry": with_(CORPUS, CLASSES) + _style_rows(),
        "top_openers": with_(CORPUS, CLASSES) + f"""SELECT {opener('text')} AS opener, count(*) AS n FROM classes
            WHERE class = 'generated' GROUP BY 1 ORDER BY n DESC, opener LIMIT 6""",
        "opener_bootstrap": with_(CORPUS, CLASSES) + f""", o AS (SELECT class, id, {opener('text')} AS opener FROM classes),
            size AS (SELECT count(*) AS n FROM o WHERE class = 'generated'),
            drawn AS (SELECT draw, opener, row_number() OVER (PARTITION BY draw
                    ORDER BY {hash_number("md5(concat_ws(':', '0', draw, id))", 15)}) AS r
                FROM o, (SELECT unnest(range(200)) AS draw) WHERE class = 'real'),
            counts AS (SELECT draw, count(DISTINCT opener) AS k FROM drawn, size WHERE r <= n GROUP BY draw),
            result AS (SELECT (SELECT n FROM size) AS n_sample, (SELECT count(DISTINCT opener) FROM o WHERE class = 'generated') AS observed,
                quantile_cont(k, 0.025) AS lo, quantile_cont(k, 0.975) AS hi FROM counts)
            SELECT n_sample, observed, round(lo, 6) AS lo, round(hi, 6) AS hi, (observed BETWEEN lo AND hi)::INT AS inside FROM result""",
        "char_document_frequency": with_(CORPUS, CLASSES, CHARS)
        + "SELECT class, upper(printf('%X', unicode(ch))) AS code_point, n_texts FROM chars",
        "perfect_separators": with_(CORPUS, CLASSES, CHARS) + """SELECT ch, upper(printf('%X', unicode(ch))) AS code_point, n_texts,
            round(100 * n_texts / (SELECT count(*) FROM classes WHERE class = 'generated')::DOUBLE, 6) AS pct FROM separators""",
        "language_purity": with_(GEN) + f"SELECT count(*) AS n_rows, count(*) FILTER ({stray('text')} <> '') AS n_impure FROM gen",
        "hygiene_report": with_(CORPUS, GEN) + f"""SELECT count(*) FILTER ({matches('text', cfg.PREAMBLE_LEAK_PATTERN)}) AS preamble_leaks,
            count(*) FILTER ({matches('text', cfg.DISCLOSURE_PATTERN)}) AS disclosures,
            count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT "Category") AS categories,
            (SELECT min(n) FROM (SELECT count(*) AS n FROM gen GROUP BY "Category")) AS min_n,
            (SELECT max(n) FROM (SELECT count(*) AS n FROM gen GROUP BY "Category")) AS max_n,
            (SELECT count(DISTINCT "Category") FROM corpus) AS known_categories FROM gen""",
        "copy_report": with_(CORPUS, GEN, MANIFEST, ASPECTS, POOL, PICKS, PROMPTS) + f""",
            pairs AS (SELECT {words('lower(g.text)')} AS w, {words('lower(p.user)')} AS u
                FROM gen g JOIN prompts p ON p.cell_id = g.cell_id AND p.rep_index = g.rep_index WHERE p.example_mode = 'few_shot'),
            grams AS (SELECT list_transform(range(1, len(w) - 4), lambda i: {NGRAMS6}) AS b,
                list_transform(range(1, len(u) - 4), lambda i: array_to_string(u[i:i + 5], ' ')) AS a FROM pairs),
            copied AS (SELECT len(list_filter(b, lambda x: list_contains(a, x))) AS n FROM grams)
            SELECT count(*) AS n_rows, count(*) FILTER (n > 0) AS n_with_copy, max(n) AS max_copied, (max(n) > 5)::INT AS warn FROM copied""",
        "dataset_gate": with_(CORPUS, CLASSES, CHARS) + f""", r AS (SELECT (SELECT count(*) FROM separators) AS n_separators,
            (SELECT count(*) FILTER ({stray('text')} <> '') FROM classes WHERE class = 'generated') AS n_impure)
            SELECT *, (n_separators = 0 AND n_impure = 0)::INT AS passed FROM r""",
        "cell_counts": with_(GEN) + "SELECT cell_id, count(*) AS n_rows, max(rep_index) + 1 AS target FROM gen GROUP BY cell_id",
        "failure_breakdown": with_(TURNS)
        + "SELECT cell_id, error, count(*) AS n FROM best WHERE error IS NOT NULL GROUP BY cell_id, error",
        "seed_summary": with_(CORPUS) + f""", ranked AS (
                SELECT seed, y, toxic AS pred, row_number() OVER (PARTITION BY seed, y ORDER BY md5(concat_ws(':', seed, id)), id) AS r,
                       count(*) OVER (PARTITION BY seed, y) AS nc FROM corpus, (SELECT unnest([42, 43, 44, 45, 46]) AS seed)),
            sizes AS (SELECT *, floor(nc * 0.7::DOUBLE) AS nt FROM ranked),
            counted AS (SELECT seed, {CONFUSION} FROM sizes
                WHERE r > nt + floor((nc - nt) * (0.15::DOUBLE / (1.0::DOUBLE - 0.7::DOUBLE))) GROUP BY seed),
            runs AS (SELECT *, {RATES} FROM counted)
            SELECT 'toxic_flag' AS model, count(*) AS n_seeds, {', '.join(f'round(avg({m}), 6) AS mean_{m}, round(stddev_samp({m}), 6) AS sd_{m}' for m in ('accuracy', 'precision', 'recall', 'f1'))} FROM runs""",
        "factorial_manifest": with_(MANIFEST) + "SELECT ordinal, cell_ord, cell_id, rep_index, item FROM manifest",
        "assign_aspects": with_(MANIFEST, ASPECTS) + """SELECT m.cell_id, m.rep_index, coalesce(array_to_string(aspects, '|'), '') AS aspects
            FROM manifest m LEFT JOIN aspects a ON a.cell_id = m.cell_id AND a.rep_index = m.rep_index""",
        "assign_openers": with_(MANIFEST) + f"SELECT cell_id, rep_index, {move_draw(chr(39) + '12' + chr(39), 'cell_id', 'rep_index')} AS opener_move FROM manifest",
        "example_pool": with_(CORPUS, POOL) + "SELECT pool, scope, length, id, n_chars, size, rank FROM pool",
        "pick_examples": with_(CORPUS, MANIFEST, POOL, PICKS) + "SELECT cell_id, rep_index, real_id::VARCHAR AS real_id, fake_id::VARCHAR AS fake_id FROM picks",
        "best_attempt": with_(ATTEMPTS) + "SELECT conv_id, text, n_attempts, error FROM best",
        "replay_check": with_(GEN) + f""", items AS (
                SELECT source AS item, row_number() OVER (ORDER BY source) - 1 AS ix FROM (SELECT DISTINCT source FROM documents)),
            t AS (SELECT cell_id, max(rep_index) + 1 AS target, min((length = 'long')::INT * 8 + (sentiment = 'negative')::INT * 4
                + (structure = 'unstructured')::INT * 2 + (example_mode = 'zero_shot')::INT) AS o FROM gen GROUP BY cell_id),
            s AS (SELECT cell_id, coalesce(sum(target) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
            SELECT g.cell_id, count(*) AS n_rows, 1 AS n_seeds, count(*) FILTER (i.item = g."Category") AS n_category_ok,
                   count(*) FILTER (g.opener_move = {move_draw("'12'", 'g.cell_id', 'g.rep_index')}) AS n_opener_ok
            FROM gen g JOIN s ON s.cell_id = g.cell_id JOIN items i ON i.ix = (s.start + g.rep_index) % (SELECT count(*) FROM items)
            GROUP BY g.cell_id""",
        "replay_prompts": with_(MANIFEST) + """SELECT cell_id, rep_index, CASE rep_index % 8 WHEN 1 THEN 'item' WHEN 2 THEN 'opener'
            WHEN 3 THEN 'aspects' WHEN 4 THEN 'examples' WHEN 5 THEN 'prompt' ELSE '' END AS first_difference FROM manifest""",
        "prompt_table": with_(CORPUS, MANIFEST, ASPECTS, POOL, PICKS, PROMPTS) + 'SELECT cell_id, rep_index, system, "user" FROM prompts',
        "split_assignment": with_(CORPUS, SPLIT) + "SELECT id, split FROM split",
        "split_counts": with_(CORPUS, SPLIT) + "SELECT y, split, count(*) AS n_rows FROM split GROUP BY y, split",
        "tokens": f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
            FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '{TOKEN}') AS t FROM documents)""",
        "term_frequency": with_(CORPUS, SPLIT, TERMS) + "SELECT id, term, tf FROM tf",
        "vocabulary": with_(CORPUS, SPLIT, TERMS) + "SELECT term, df, cf, round(idf, 6) AS idf, term_id FROM vocab",
        "tfidf": with_(CORPUS, SPLIT, TERMS) + """, w AS (
                SELECT tf.id, tf.split, tf.term, tf.tf, (1 + ln(tf.tf)) * v.idf AS w FROM tf JOIN vocab v ON v.term = tf.term)
            SELECT id, split, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""",
        "param_grid": with_(CORPUS, SPLIT) + f"""SELECT g.*, t.n_rows, t.n_positive FROM ({_grid_rows()}) AS g(family, run, params),
            (SELECT count(*) AS n_rows, sum(y)::BIGINT AS n_positive FROM split WHERE split = 'train') t""",
        "threshold_grid": with_(LOGITS, RUNS) + f"SELECT model, run, threshold, tn, fp, fn, tp, {RATES_6} FROM runs",
        "leaderboard": with_(LOGITS, RUNS) + """SELECT model, run, threshold, round(f1, 6) AS f1,
            row_number() OVER (PARTITION BY model ORDER BY round(f1, 9) DESC, run) AS place FROM runs""",
        "binary_metrics": with_(LOGITS) + f""", c AS (SELECT {CONFUSION} FROM (SELECT y, (score >= 0.5)::INT AS pred FROM logits)),
            m AS (SELECT *, {RATES} FROM c) SELECT tn, fp, fn, tp, {RATES_6} FROM m""",
        "roc_auc": with_(LOGITS, CURVE) + "SELECT round(roc_auc, 6) AS roc_auc FROM areas",
        "average_precision": with_(LOGITS, CURVE) + "SELECT round(pr_auc, 6) AS pr_auc FROM areas",
        "external_model_eval": with_(LOGITS, CURVE) + f""", c AS (SELECT {CONFUSION} FROM (SELECT y, (score >= 0.5)::INT AS pred FROM logits)),
            m AS (SELECT *, {RATES} FROM c)
            SELECT tn, fp, fn, tp, {RATES_6}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM m, areas""",
        "tfidf_vectors": with_(CORPUS, SPLIT, TERMS) + """, hits AS (
                SELECT tf.id, count(*) AS k FROM tf JOIN vocab v ON v.term = tf.term GROUP BY tf.id)
            SELECT s.id, s.split, coalesce(k, 0) AS n_terms, CASE WHEN k IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS squared_norm
            FROM split s LEFT JOIN hits h ON h.id = s.id""",
        "apply_scorer": """SELECT doc_id, CASE WHEN trim(text) = '' THEN 'error:ValueError'
            WHEN contains(lower(text), 'worthless') OR contains(lower(text), 'pathetic') THEN 'negative' ELSE 'positive' END AS verdict
            FROM documents""",
        "stream_ingest": f"""WITH raw AS (
                SELECT lang AS cell_id, doc_id AS rep_index, {decorated('text', 'doc_id')} AS text FROM documents),
            {cleaned('raw', 'cleaned')},
            g AS (SELECT *, length(text) AS n_chars, len({words('text')}) AS n_words, {stray('text')} AS stray FROM cleaned)
            SELECT cell_id, rep_index, n_words, n_chars,
                   CASE WHEN n_chars BETWEEN 455 AND 945 THEN 0 ELSE least(abs(n_chars - 455), abs(n_chars - 945)) END AS distance,
                   CASE WHEN n_words < 10 THEN 'output too short (' || n_words || ' words)'
                        WHEN stray <> '' THEN 'non-English output (' || substr(stray, 1, 20) || ')' ELSE '' END AS error
            FROM g""",
    }


def _grid_rows() -> str:
    """The declared grids written out, the last parameter fastest."""
    def rows(family: str, lists: list[tuple[str, list[str]]]) -> str:
        points = [[]]
        for name, values in lists:
            points = [[*p, f"{name}={v}"] for p in points for v in values]
        return ", ".join(f"('{family}', {i}, '{';'.join(sorted(p))}')" for i, p in enumerate(points, 1))

    svm = [("C", ["0.1", "1.0", "10.0"]), ("kernel", ["linear", "rbf"]), ("gamma", ["scale", "0.01", "0.001"]), ("class_weight", ["null", "balanced"])]
    trees = [
        ("n_estimators", ["200", "400", "800"]), ("max_depth", ["3", "5", "7"]), ("learning_rate", ["0.03", "0.1"]),
        ("subsample", ["0.8", "1.0"]), ("colsample_bytree", ["0.8", "1.0"]), ("min_child_weight", ["1", "3"]), ("reg_lambda", ["1", "5"]),
    ]
    transformer = [
        ("learning_rate", ["2e-05", "3e-05", "5e-05"]), ("batch_size", ["8", "16"]), ("num_train_epochs", ["3", "4"]), ("weight_decay", ["0.0", "0.01"]),
    ]
    return f"VALUES {rows('svm', svm)}, {rows('boosted_trees', trees)}, {rows('transformer', transformer)}"


def _nest_replace(x: str, mapping: dict[str, str]) -> str:
    for source, target in mapping.items():
        x = f"replace({x}, {quoted(source)}, {quoted(target)})"
    return x
