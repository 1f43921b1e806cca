"""The registered queries as plain SQL for DuckDB, written independently.

Word boundaries: DuckDB's ``\\b`` knows ASCII only, so texts and keywords are first
mapped to ASCII word characters (``FOLD``).  Counting runs every group's pattern
over the whole folded text, without the reduction the Spark side relies on.
"""

from __future__ import annotations

import re

from talkmill.functions.language import PROFILE_SIZE, SAMPLES
from talkmill.functions.taxonomy import DANISH_MARKERS, DEFAULT, VOICE_KEYWORDS
from talkmill.functions.text import WHITESPACE
from talkmill.operators.embed import SENTENCE_MODEL

HASH_DIM = 64
LABELS = ["main_category", "subcategory", "language", "complexity", "source_file"]


def _s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def fold(c: str) -> str:
    low = f"translate(lower({c}), 'ſı', 'si')"
    for ch, ascii_ch in [("å", "_q1"), ("æ", "_q2"), ("ø", "_q3")]:
        low = f"replace({low}, '{ch}', '{ascii_ch}')"
    return rf"regexp_replace({low}, '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', '_', 'g')"


def pattern(words: list[str]) -> str:
    folded = [w.lower().replace("å", "_q1").replace("æ", "_q2").replace("ø", "_q3") for w in words]
    return _s(r"\b(?:" + "|".join(re.escape(w) for w in folded) + r")\b")


def count(words: list[str], c: str = "f") -> str:
    return f"len(regexp_extract_all({c}, {pattern(words)}))"


HITS = "[" + ", ".join(count(list(g.keywords)) for g in DEFAULT.groups) + "]"
VOICE = f"regexp_matches(f, {pattern(VOICE_KEYWORDS)})"


def _sums() -> str:
    out = []
    for c in DEFAULT.categories:
        indexes = [DEFAULT.main_index(c), *DEFAULT.sub_indexes(c)]
        out.append(" + ".join(f"h[{i + 1}]" for i in indexes))
    return "[" + ", ".join(out) + "]"


def _main() -> str:
    whens = " ".join(
        f"WHEN t[{i + 1}] = list_max(t) THEN {_s(c)}" for i, c in enumerate(DEFAULT.categories)
    )
    return f"CASE WHEN list_max(t) = 0 THEN 'Other' {whens} END"


def _sub() -> str:
    whens = []
    for c in DEFAULT.categories:
        subs = DEFAULT.sub_indexes(c)
        best = "greatest(" + ", ".join(f"h[{i + 1}]" for i in subs) + ")"
        inner = " ".join(
            f"WHEN h[{i + 1}] = {best} THEN {_s(DEFAULT.groups[i].subcategory)}" for i in subs
        )
        whens.append(f"WHEN main_category = {_s(c)} THEN CASE {inner} END")
    return "CASE WHEN main_category = 'Other' THEN 'Uncategorized' " + " ".join(whens) + " END"


def scored(source: str) -> str:
    """CTEs that label the rows of ``source``, which has a ``text``."""
    return f"""
    src AS ({source}),
    folded AS (SELECT *, {fold("text")} AS f FROM src),
    hit AS MATERIALIZED (SELECT * EXCLUDE (f), {HITS} AS h, {VOICE} AS is_voice FROM folded),
    summed AS (SELECT *, {_sums()} AS t FROM hit),
    named AS (SELECT *, {_main()} AS main_category, list_max(t) AS confidence_score FROM summed),
    labelled AS (SELECT *, {_sub()} AS subcategory FROM named)"""


CLEAN = """SELECT CAST(doc_id AS VARCHAR) AS conversation_id, text, lang AS language,
    source AS source_file FROM documents"""
CLI = "CASE WHEN n = 0 THEN NULL WHEN n <= 100 THEN 'simple' WHEN n <= 500 THEN 'medium' ELSE 'complex' END"
UPLOAD = "CASE WHEN n <= 100 THEN 'simple' WHEN n <= 500 THEN 'medium' ELSE 'complex' END"
LENGTH = "CAST(length(text) AS BIGINT)"
PREVIEW = "CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END"

CATEGORIZED = f"""WITH {scored(CLEAN)},
    cat AS (SELECT *, n AS char_length, {CLI} AS complexity FROM (SELECT *, {LENGTH} AS n FROM labelled))"""
UPLOADED = f"""WITH {scored(CLEAN)},
    up AS (SELECT conversation_id, {PREVIEW} AS text_preview, language, source_file, main_category,
        subcategory, is_voice, confidence_score, n AS char_length, {UPLOAD} AS complexity
        FROM (SELECT *, {LENGTH} AS n FROM labelled))"""

QUESTIONS = "length(text) - length(replace(text, '?', ''))"
FOLLOW_UPS = "len(regexp_extract_all(lower(text), 'follow up|followup|additional'))"


def map_text(column: str, table: str, where: str = "TRUE") -> str:
    return f"""(SELECT string_agg(k || '=' || n, ';' ORDER BY n DESC, k) FROM
        (SELECT {column} AS k, count(*) AS n FROM {table}
         WHERE {where} AND {column} IS NOT NULL GROUP BY 1))"""


def distribution(prefix: str, table: str, column: str) -> str:
    return f"""{prefix} SELECT {column}, count(*) AS conversations FROM {table}
        WHERE {column} IS NOT NULL GROUP BY 1"""


# Python's rounding to one decimal: the tie is decided by the binary value.
def round_1(x: str) -> str:
    k = f"floor(({x}) * 10)"
    side = f"((({x}) * 16 - (2 * {k} + 1)) + ({x}) * 4)"
    return f"""(CASE WHEN {side} > 0 OR ({side} = 0 AND CAST({k} AS BIGINT) % 2 = 1)
        THEN {k} + 1 ELSE {k} END) / 10.0"""


TURNS = f"""said AS (SELECT conv_id, turn, {strip("text")} AS x FROM conversations WHERE text <> ''),
    joined AS (SELECT conv_id, string_agg(x, ' ' ORDER BY turn, x) AS text FROM said GROUP BY 1),
    conv AS MATERIALIZED (SELECT * FROM joined WHERE {strip("text")} <> '')"""


def letters(c: str) -> str:
    return rf"' ' || trim(regexp_replace(lower({c}), '[^\pL]+', ' ', 'g')) || ' '"


def grams(c: str = "c") -> str:
    """Sequences of one to three of the characters in a list, within words."""
    one = f"list_filter({c}, lambda x: x <> ' ')"
    two = f"list_filter(list_transform(range(1, len({c})), lambda i: {c}[i] || {c}[i + 1]), lambda x: x <> '  ')"
    three = f"""list_transform(list_filter(range(1, len({c}) - 1), lambda i: {c}[i + 1] <> ' '),
        lambda i: {c}[i] || {c}[i + 1] || {c}[i + 2])"""
    return f"list_concat({one}, {two}, {three})"


def profiles(source: str) -> str:
    """CTE ``profile(language, rank, gram)`` from rows with ``lang`` and ``text``."""
    return f"""
    train AS ({source}),
    gram AS (SELECT lang AS language, unnest({grams()}) AS gram
        FROM (SELECT lang, string_split({letters("text")}, '') AS c FROM train WHERE lang IS NOT NULL)),
    counted AS (SELECT language, gram, count(*) AS n FROM gram GROUP BY ALL),
    profile AS MATERIALIZED (SELECT language, row_number() OVER (PARTITION BY language ORDER BY n DESC, gram)
        AS rank, gram FROM counted QUALIFY rank <= {PROFILE_SIZE})"""


IDENTIFIED = f"""
    own AS (SELECT doc_id, unnest({grams()}) AS gram
        FROM (SELECT doc_id, string_split({letters("substr(text, 1, 1000)")}, '') AS c FROM documents)),
    own_count AS (SELECT doc_id, gram, count(*) AS n FROM own GROUP BY ALL),
    own_rank AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank
        FROM own_count QUALIFY rank <= {PROFILE_SIZE}),
    code AS (SELECT DISTINCT language FROM profile),
    apart AS (SELECT o.doc_id, k.language, count(p.rank) AS met,
        sum(CASE WHEN p.rank IS NULL THEN {PROFILE_SIZE} ELSE abs(o.rank - p.rank) END) AS distance
        FROM own_rank o CROSS JOIN code k LEFT JOIN profile p ON p.language = k.language AND p.gram = o.gram GROUP BY ALL),
    best AS MATERIALIZED (SELECT doc_id, CASE WHEN max(met) OVER (PARTITION BY doc_id) > 0 THEN language END AS language
        FROM apart QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, language) = 1),
    identified AS (SELECT d.doc_id, d.text, coalesce(b.language, 'unknown') AS language
        FROM documents d LEFT JOIN best b USING (doc_id))"""

TRAINING = "SELECT * FROM documents WHERE doc_id % 5 <> 0"

SAMPLE_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    f"({_s(k)}, {_s(v)})" for k, v in SAMPLES.items()
) + ") AS s(lang, text)"

HASH = "substr(md5(text), 1, 16)"
SHA = f"sha256({_s(SENTENCE_MODEL + '|')} || text)"
HASH_SHA = f"sha256('feature-hashing-{HASH_DIM}|' || text)"
LINES = "string_split(text, chr(10))"


def vector_text(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',')"


VECTORS = rf"""
    word AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w
        FROM documents WHERE {strip("text")} <> ''),
    place AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {HASH_DIM} AS b,
        CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s
        FROM word),
    cell AS (SELECT doc_id, b, sum(s) AS v FROM place GROUP BY ALL),
    norm AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM cell GROUP BY 1),
    every AS (SELECT doc_id, b FROM (SELECT doc_id FROM documents WHERE {strip("text")} <> ''),
        (SELECT unnest(range({HASH_DIM})) AS b)),
    vector AS (SELECT doc_id, string_agg(CAST(CAST(round(CASE WHEN norm > 0 THEN coalesce(v, 0) / norm
        ELSE 0 END * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY b) AS vector
        FROM every LEFT JOIN cell USING (doc_id, b) LEFT JOIN norm USING (doc_id) GROUP BY 1)"""

# Texts of one document's lines by message form: a text, a string item, an object item.
LIST_PARTS = f"""list_filter(list_transform({LINES}, lambda x, i:
    CASE WHEN (i - 1) % 3 = 1 THEN nullif({strip("x")}, '')
         WHEN x <> '' THEN {strip("x")} END), lambda x: x IS NOT NULL)"""
MAP_PARTS = f"""list_filter(list_transform({LINES}, lambda x, i:
    CASE WHEN (i - 1) % 3 = 0 THEN nullif({strip("x")}, '')
         WHEN (i - 1) % 3 = 1 AND x <> '' THEN {strip("x")} END), lambda x: x IS NOT NULL)"""


def joined(parts: str) -> str:
    return f"array_to_string({parts}, ' ')"


FALLBACK = f"""list_concat(
    list_filter([{strip(f"{LINES}[1]")}], lambda x: x <> ''),
    CASE WHEN len(below) > 0 THEN [array_to_string(below, ' ')] ELSE [] END)"""

# The documents as files, one conversation per line; see the query of the same name.
FILES = f"""
    numbered AS (SELECT 'f' || doc_id || '.json' AS source_file, lang, text,
        unnest({LINES}) AS line, unnest(range(len({LINES}))) AS i FROM documents),
    listed AS (SELECT source_file, i + 1 + CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS pos, i,
        {strip("line")} AS text FROM numbered WHERE lang IN ('en', 'es')),
    titled AS (SELECT CASE WHEN i % 2 = 0 THEN 'line ' || i
        ELSE 'conv_' || pos || '_' || source_file END AS conversation_id,
        text, source_file, pos, CAST(NULL AS VARCHAR) AS reject FROM listed),
    single AS (SELECT 'single' AS conversation_id, {joined(LIST_PARTS)} AS text,
        'f' || doc_id || '.json' AS source_file, 1 AS pos, CAST(NULL AS VARCHAR) AS reject
        FROM documents WHERE lang = 'fr'),
    bad AS (SELECT 'conv_1_f' || doc_id || '.json' AS conversation_id, CAST(NULL AS VARCHAR) AS text,
        'f' || doc_id || '.json' AS source_file, 1 AS pos,
        CASE WHEN lang = 'de' THEN 'malformed_json' ELSE 'not_an_object' END AS reject
        FROM documents WHERE lang IN ('de', 'es')),
    flat AS MATERIALIZED (SELECT * FROM titled UNION ALL SELECT * FROM single UNION ALL SELECT * FROM bad),
    ok AS (SELECT * FROM flat WHERE reject IS NULL AND {strip("text")} <> '')"""

UP_ROWS = f"{UPLOADED} SELECT * FROM up"


def _label_counts() -> str:
    parts = [
        f"SELECT '{c}' AS metric, {c} AS key, count(*) AS value FROM cat WHERE {c} IS NOT NULL GROUP BY 2"
        for c in LABELS
    ]
    return " UNION ALL ".join(parts) + (
        " UNION ALL SELECT 'total', NULL, count(*) FROM cat HAVING count(*) > 0"
    )


def _long_scores(hits: str) -> str:
    rows = ", ".join(
        f"({i + 1}, {_s(g.category)}, {'NULL' if g.subcategory is None else _s(g.subcategory)})"
        for i, g in enumerate(DEFAULT.groups)
    )
    return f"(SELECT * FROM (VALUES {rows}) AS g(i, category, subcategory)) g, {hits}"


def _tree() -> str:
    parts = []
    for n, c in enumerate(DEFAULT.categories):
        subs = " || ';' || ".join(
            f"{_s(DEFAULT.groups[i].subcategory)} || '=' || h[{i + 1}]"
            for i in DEFAULT.sub_indexes(c)
        )
        parts.append(
            f"""SELECT doc_id, {_s(c)} AS category, h[{DEFAULT.main_index(c) + 1}] AS main_score,
            {subs} AS sub_scores, t[{n + 1}] AS total_score FROM summed"""
        )
    return " UNION ALL ".join(parts)


def _sizes() -> str:
    rows = []
    for c_ord, c in enumerate(DEFAULT.categories, 1):
        for s_ord, i in enumerate([DEFAULT.main_index(c), *DEFAULT.sub_indexes(c)]):
            n = len(DEFAULT.groups[i].keywords)
            rows.append(
                f"SELECT {c_ord} AS cat_ord, {s_ord} AS sub_ord, {_s(c)} AS category, "
                f"CAST({n} AS BIGINT) AS keywords, CAST(sum(h[{i + 1}]) AS BIGINT) AS hits FROM hit"
            )
    return " UNION ALL ".join(rows)


DOCS = "SELECT * FROM documents"

# Texts made of keywords; see the query of the same name.
GROUP_TEXTS = "[" + ", ".join(_s(" ".join(g.keywords)) for g in DEFAULT.groups) + "]"
PLANTED_TEXT = f"""CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(9) || ' ' WHEN doc_id % 17 = 0 THEN 'qwrt zzz mnop'
    ELSE concat_ws(' ', {GROUP_TEXTS}[CAST(doc_id % {len(DEFAULT.groups)} AS INTEGER) + 1],
        CASE WHEN doc_id % 3 = 0 THEN {GROUP_TEXTS}[CAST(doc_id * 31 % {len(DEFAULT.groups)} AS INTEGER) + 1] END,
        CASE WHEN doc_id % 7 = 0 THEN {_s(" ".join(VOICE_KEYWORDS))} END,
        CASE WHEN doc_id % 5 = 0 THEN 'why? what?? follow up, additional' END) END"""
PLANTED = f"SELECT * REPLACE ({PLANTED_TEXT} AS text) FROM documents"


def on_planted(sql: str) -> str:
    """The same SQL over the planted texts."""
    return f"WITH planted AS ({PLANTED}), " + sql.strip().removeprefix(
        "WITH "
    ).replace("FROM documents", "FROM planted")


# Turns of which every fifth has lost its number.
UNPLACED = TURNS.replace(
    "SELECT conv_id, turn,", "SELECT conv_id, CASE WHEN (conv_id + turn) % 5 <> 0 THEN turn END AS turn,"
)
# One conversation per document, a message per line.
MESSAGES = f"""array_to_string(list_transform(list_filter({LINES}, lambda x: x <> ''), lambda x: {strip("x")}), ' ')"""
EXPORTED = f"""exported AS (SELECT doc_id, 'd' || doc_id AS conversation_id, {MESSAGES} AS text,
        row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS pos FROM documents),
    said AS (SELECT * FROM exported WHERE {strip("text")} <> '')"""

ORACLE: dict[str, str] = {
    "conv_text": f"WITH {TURNS} SELECT conv_id, text FROM conv",
    "conv_categorize": f"""WITH {TURNS}, {scored("SELECT * FROM conv")}
        SELECT conv_id, {LENGTH} AS char_length, main_category, subcategory, is_voice,
        confidence_score FROM labelled""",
    "conv_category_dist": distribution(
        f"WITH {TURNS}, {scored('SELECT * FROM conv')}", "labelled", "main_category"
    ),
    "text_hash": f"SELECT doc_id, {HASH} AS text_hash FROM documents",
    "hash_dupes": f"SELECT {HASH} AS text_hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "detection_prefix": "SELECT doc_id, substr(text, 1, 1000) AS prefix FROM documents",
    "stripped": f"SELECT conv_id, turn, {strip('text')} AS text FROM conversations",
    "voice_flag": f"SELECT doc_id, {VOICE} AS is_voice FROM (SELECT doc_id, {fold('text')} AS f FROM documents)",
    "danish_flag": f"""SELECT doc_id, {count(DANISH_MARKERS)} AS markers,
        {count(DANISH_MARKERS)} >= 2 AS is_danish
        FROM (SELECT doc_id, {fold("text")} AS f FROM documents)""",
    "complexity_cli": f"SELECT doc_id, n AS char_length, {CLI} AS complexity FROM (SELECT doc_id, {LENGTH} AS n FROM documents)",
    "complexity_upload": f"SELECT doc_id, n AS char_length, {UPLOAD} AS complexity FROM (SELECT doc_id, {LENGTH} AS n FROM documents)",
    "preview": f"SELECT doc_id, {PREVIEW} AS text_preview FROM documents",
    "interaction_counts": f"SELECT doc_id, {QUESTIONS} AS questions, {FOLLOW_UPS} AS follow_ups FROM documents",
    "interaction_patterns": f"""SELECT CAST(sum({QUESTIONS}) AS BIGINT) AS questions,
        CAST(sum({FOLLOW_UPS}) AS BIGINT) AS follow_ups FROM documents""",
    "default_fill": f"""SELECT 'row_' || n AS conversation_id, text, 'unknown' AS language
        FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE {strip("text")} <> ''""",
    "taxonomy_table": f"WITH {scored(DOCS)} {_sizes()}",
    "category_scores": f"""WITH {scored(DOCS)} SELECT doc_id, category, subcategory, h[i] AS hits
        FROM {_long_scores("hit")}""",
    "score_tree": f"WITH {scored(DOCS)} {_tree()}",
    "categorize": f"WITH {scored(DOCS)} SELECT doc_id, main_category, subcategory, is_voice, confidence_score FROM labelled",
    "categorize_benchmark": f"""WITH {scored("SELECT * FROM benchmark")}
        SELECT item_id, main_category, subcategory, is_voice, confidence_score FROM labelled""",
    "categorized_rows": f"""{CATEGORIZED} SELECT conversation_id, language, source_file, main_category,
        subcategory, is_voice, confidence_score, char_length, complexity FROM cat""",
    "upload_rows": UP_ROWS,
    "language_dist": "SELECT lang AS language, count(*) AS conversations FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "category_dist": distribution(CATEGORIZED, "cat", "main_category"),
    "subcategory_dist": distribution(CATEGORIZED, "cat", "subcategory"),
    "complexity_dist": f"""SELECT c AS complexity, count(d.n) AS conversations
        FROM (SELECT unnest(['simple', 'medium', 'complex']) AS c)
        LEFT JOIN (SELECT n, {CLI} AS complexity FROM (SELECT {LENGTH} AS n FROM documents)) d
        ON c = d.complexity GROUP BY 1""",
    "label_counts": f"{CATEGORIZED} {_label_counts()}",
    "ingest_summary": f"""WITH src AS ({CLEAN}), ok AS (SELECT * FROM src WHERE {strip("text")} <> '')
        SELECT (SELECT count(DISTINCT source_file) FROM ok) AS total_files_processed,
        (SELECT count(*) FROM src) AS total_conversations,
        (SELECT count(*) FROM src) - (SELECT count(*) FROM ok) AS empty_conversations,
        count(*) AS valid_conversations, CAST(0 AS BIGINT) AS rejected_conversations,
        count(*) / (SELECT count(*) FROM src) * 100 AS success_rate,
        {map_text("language", "ok")} AS language_distribution,
        min({LENGTH}) AS length_min, max({LENGTH}) AS length_max,
        sum({LENGTH}) / count(*) AS length_avg FROM ok""",
    "metrics_cli": f"""{CATEGORIZED}
        SELECT count(*) AS total_conversations, sum(char_length) / count(*) AS avg_length,
        {map_text("main_category", "cat")} AS category_distribution,
        {map_text("subcategory", "cat")} AS subcategory_distribution,
        count(*) FILTER (is_voice) AS voice_conversations,
        'simple=' || count(*) FILTER (complexity = 'simple') || ';medium=' ||
        count(*) FILTER (complexity = 'medium') || ';complex=' ||
        count(*) FILTER (complexity = 'complex') AS complexity_scores,
        CAST(sum({QUESTIONS}) AS BIGINT) AS questions,
        CAST(sum({FOLLOW_UPS}) AS BIGINT) AS follow_ups,
        sum(confidence_score) / count(*) AS avg_confidence,
        count(*) FILTER (confidence_score > 5) AS high_confidence FROM cat""",
    "metrics_upload": f"""{UPLOADED}
        SELECT count(*) AS total_conversations,
        {round_1("CAST(sum(char_length) AS DOUBLE) / count(*)")} AS avg_length,
        {map_text("main_category", "up")} AS category_distribution,
        {map_text("subcategory", "up")} AS subcategory_distribution,
        {map_text("language", "up")} AS language_distribution,
        {map_text("complexity", "up")} AS complexity_distribution,
        count(*) FILTER (is_voice) AS voice_conversations,
        {round_1("CAST(sum(confidence_score) AS DOUBLE) / count(*)")} AS confidence_avg,
        {round_1("CAST(count(*) FILTER (confidence_score > 5) AS DOUBLE) / count(*) * 100")}
        AS confidence_high_pct,
        count(DISTINCT source_file) AS files_processed FROM up HAVING count(*) > 0""",
    "top_categories": f"""{CATEGORIZED}, per AS (SELECT main_category, count(*) AS conversations
        FROM cat GROUP BY 1)
        SELECT row_number() OVER (ORDER BY conversations DESC, main_category) AS rank, main_category,
        conversations, conversations / (SELECT count(*) FROM cat) * 100 AS share_pct FROM per
        QUALIFY rank <= 10""",
    "search": f"""{UP_ROWS} WHERE contains(lower(text_preview), 'the')
        OR contains(lower(conversation_id), 'the') OR contains(lower(main_category), 'the')""",
    "filter_category": f"{UP_ROWS} WHERE main_category = 'Technical Support'",
    "category_options": f"{UPLOADED} SELECT DISTINCT main_category FROM up",
    "filter_complexity": f"{UP_ROWS} WHERE complexity = 'medium'",
    "sort_rows": f"{UP_ROWS} ORDER BY char_length DESC, conversation_id",
    "sort_page": f"{UP_ROWS} ORDER BY confidence_score DESC, conversation_id LIMIT 25 OFFSET 25",
    "page_after": f"""{UP_ROWS} WHERE char_length > 400 OR (char_length = 400 AND conversation_id > '50')
        ORDER BY char_length, conversation_id LIMIT 25""",
    "voice_split": f"{UPLOADED} SELECT is_voice, count(*) AS conversations FROM up GROUP BY 1",
    "confidence_hist": f"""{UPLOADED} SELECT CASE WHEN confidence_score = 0 THEN '0'
        WHEN confidence_score <= 2 THEN '1-2' WHEN confidence_score <= 5 THEN '3-5'
        WHEN confidence_score <= 10 THEN '6-10' ELSE '>10' END AS bin, count(*) AS conversations
        FROM up GROUP BY 1""",
    "language_profile": f"WITH {profiles(DOCS)} SELECT language, rank, gram FROM profile",
    "language_id": f"WITH {profiles(TRAINING)}, {IDENTIFIED} SELECT doc_id, doc_id % 5 = 0 AS held_out, language FROM identified",
    "language_accuracy": f"""WITH {profiles(TRAINING)}, {IDENTIFIED} SELECT lang, language, count(*) AS documents
        FROM identified JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE doc_id % 5 = 0 GROUP BY 1, 2""",
    "language_samples": f"WITH {profiles(SAMPLE_ROWS)}, {IDENTIFIED} SELECT doc_id, language FROM identified",
    "language_misses": f"""SELECT DISTINCT {HASH} AS text_hash, substr(text, 1, 1000) AS prefix
        FROM documents WHERE {HASH} NOT IN (SELECT {HASH} FROM documents WHERE lang = 'en')""",
    "language_cached": f"""WITH {profiles(TRAINING)}, {IDENTIFIED}
        SELECT doc_id, {HASH} AS text_hash, language FROM identified""",
    "l2_norm": f"""WITH scaled AS (SELECT vec_id,
        list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 2)) AS v FROM embeddings)
        SELECT vec_id, {vector_text("list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z))))")}
        AS vector FROM scaled""",
    "embed_hash": f"WITH {VECTORS} SELECT doc_id, vector FROM vector",
    "embed_key": f"SELECT doc_id, {SHA} AS text_sha FROM documents",
    "cache_misses": f"""SELECT DISTINCT {SHA} AS text_sha, text FROM documents
        WHERE {strip("text")} <> '' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en')""",
    "embed_cached": f"""WITH {VECTORS} SELECT doc_id, 'feature-hashing-{HASH_DIM}' AS model, {HASH_SHA} AS text_sha,
        vector FROM documents JOIN vector USING (doc_id)""",
    "extract_list_dialect": f"SELECT doc_id, {joined(LIST_PARTS)} AS text, CAST(NULL AS VARCHAR) AS reject FROM documents",
    "extract_map_dialect": f"SELECT doc_id, {joined(MAP_PARTS)} AS text, CAST(NULL AS VARCHAR) AS reject FROM documents",
    "extract_fallback": f"""SELECT doc_id, array_to_string({FALLBACK}, ' ') AS text,
        CAST(NULL AS VARCHAR) AS reject FROM (SELECT *, list_filter(list_transform(
        {LINES}[1:20], lambda x: {strip("x")}), lambda x: x <> '')[1:6] AS below FROM documents)""",
    "conversation_id": """SELECT doc_id,
        CASE lang WHEN 'en' THEN 'd' || doc_id WHEN 'fr' THEN 'd' || doc_id
            WHEN 'de' THEN 'conv_' || (doc_id + 1) || '_' || source END AS id_cli,
        CASE WHEN lang IN ('en', 'fr', 'de') THEN 'd' || doc_id ELSE 'None' END AS id_upload
        FROM documents""",
    "file_conversations": f"WITH {FILES} SELECT * FROM flat",
    "clean_rows": f"""WITH {FILES} SELECT conversation_id, 'unknown' AS language, source_file, pos,
        {HASH} AS text_hash FROM ok""",
    "rejects": f"WITH {FILES} SELECT source_file, pos, reject AS reason FROM flat WHERE reject IS NOT NULL",
    "summary_of_files": f"""WITH {FILES}, good AS (SELECT * FROM flat WHERE reject IS NULL)
        SELECT (SELECT count(DISTINCT source_file) FROM ok) AS total_files_processed,
        (SELECT count(*) FROM good) AS total_conversations,
        (SELECT count(*) FROM good) - count(*) AS empty_conversations,
        count(*) AS valid_conversations,
        (SELECT count(*) FROM flat WHERE reject IS NOT NULL) AS rejected_conversations,
        count(*) / (SELECT count(*) FROM good) * 100 AS success_rate,
        max({LENGTH}) AS length_max FROM ok""",
    "json_lines_source": f"""SELECT 'd' || doc_id AS conversation_id, {joined(LIST_PARTS)} AS text,
        'unknown' AS language FROM documents WHERE {strip(joined(LIST_PARTS))} <> ''""",
    "csv_source": f"SELECT conversation_id, text, language, source_file FROM ({CLEAN}) WHERE text <> ''",
    "csv_embed_source": f"""SELECT conversation_id, text FROM ({CLEAN})
        WHERE language <> 'es' AND {strip("text")} <> ''""",
    "csv_upload_source": f"""SELECT conversation_id, text, 'unknown' AS language FROM ({CLEAN})
        WHERE language NOT IN ('es', 'de') AND {strip("text")} <> ''""",
    "union_sources": f"""WITH {FILES}, both_sources AS (SELECT source_file, text FROM ok
        UNION ALL SELECT source, text FROM documents)
        SELECT source_file, count(*) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars
        FROM both_sources GROUP BY 1""",
    "admission": """WITH files AS (SELECT source || '.json' AS name,
            CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1),
        run AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY name, bytes) AS BIGINT) AS running_bytes,
            count(*) OVER () AS n FROM files)
        SELECT name, bytes, running_bytes, CASE WHEN n > 20 THEN 'too_many_files'
            WHEN bytes > 150000 THEN 'file_too_large'
            WHEN running_bytes > 1000000 THEN 'total_too_large' END AS problem FROM run""",
}
ORACLE |= {
    "conv_text_null_turns": ORACLE["conv_text"].replace(TURNS, UNPLACED),
    "conv_categorize_null_turns": ORACLE["conv_categorize"].replace(TURNS, UNPLACED),
    "planted_scores": on_planted(ORACLE["category_scores"]),
    "planted_categorize": on_planted(ORACLE["categorize"]),
    "planted_interactions": f"""SELECT doc_id, {VOICE} AS is_voice, {QUESTIONS} AS questions, {FOLLOW_UPS} AS follow_ups
        FROM (SELECT *, {fold("text")} AS f FROM ({PLANTED}))""",
    "planted_summary": on_planted(ORACLE["ingest_summary"]),
    "planted_metrics_cli": on_planted(ORACLE["metrics_cli"]),
    "planted_metrics_upload": on_planted(ORACLE["metrics_upload"]),
    "categorized_sink": on_planted(f"""{CATEGORIZED} SELECT conversation_id, main_category, subcategory, is_voice,
        confidence_score, char_length, complexity FROM cat"""),
    "categorize_job": f"""SELECT *, total_conversations AS written_total, avg_length AS written_avg,
        total_conversations AS written_rows FROM ({ORACLE["metrics_cli"]})""",
    "embed_retry": ORACLE["embed_hash"],
    "embed_job": f"""WITH {VECTORS} SELECT CAST(doc_id AS VARCHAR) AS conversation_id,
        'feature-hashing-{HASH_DIM}' AS model, {HASH_SHA} AS text_sha, vector
        FROM documents JOIN vector USING (doc_id) WHERE lang <> 'es'""",
    "ingest_job": f"""WITH {profiles(SAMPLE_ROWS)}, {EXPORTED}, {IDENTIFIED.replace("FROM documents", "FROM said")}
        SELECT s.conversation_id, s.text, i.language, s.pos, substr(md5(s.text), 1, 16) AS text_hash
        FROM said s JOIN identified i USING (doc_id)""",
    "ingest_job_summary": f"""WITH {EXPORTED} SELECT count(DISTINCT doc_id // 100) AS total_files_processed,
        (SELECT count(*) FROM exported) AS total_conversations,
        (SELECT count(*) FROM exported) - count(*) AS empty_conversations, count(*) AS valid_conversations,
        CAST(0 AS BIGINT) AS rejected_conversations,
        count(*) / (SELECT count(*) FROM exported) * 100 AS success_rate,
        max({LENGTH}) AS length_max FROM said""",
    "language_unknown_script": "SELECT doc_id, 'unknown' AS language FROM documents",
}


def _analyze() -> str:
    """The upload analysis of exported conversations and of planted texts without ids and languages."""
    both = f"""SELECT conversation_id, s.text, language, 'exports' AS source_file
            FROM said s JOIN identified USING (doc_id)
        UNION ALL SELECT 'row', text, 'unknown', 'rows' FROM ({PLANTED}) WHERE {strip("text")} <> ''"""
    head = f"WITH {profiles(SAMPLE_ROWS)}, {EXPORTED}, {IDENTIFIED.replace('FROM documents', 'FROM said')}, "
    body = ORACLE["metrics_upload"].replace(CLEAN, both).strip().removeprefix("WITH ")
    return head + body.replace(",\n        count(DISTINCT source_file) AS files_processed", "")


ORACLE["analyze_job"] = _analyze()
EXPORTED_DOCS = f"SELECT doc_id, 'd' || doc_id AS conversation_id, {MESSAGES} AS text FROM documents WHERE {strip(MESSAGES)} <> ''"
ORACLE |= {
    "deep_page": f"{UP_ROWS} ORDER BY char_length DESC, conversation_id LIMIT 25 OFFSET 500",
    "metrics_merged": ORACLE["metrics_cli"],
    "upload_metrics_merged": ORACLE["metrics_upload"],
    "summary_merged": ORACLE["planted_summary"],
    "throughput": """SELECT count(*) AS rows, CAST(64 AS BIGINT) AS batch_size, CAST(0 AS BIGINT) AS too_large,
        CAST(0 AS BIGINT) AS not_timed, true AS all_reported FROM documents""",
    "stage_benchmark": f"""WITH {EXPORTED} SELECT stage, CASE WHEN stage = 'categorize' THEN 1 ELSE n END AS rows, true AS timed
        FROM (SELECT count(*) AS n FROM said), (SELECT unnest(['ingest', 'embed', 'categorize']) AS stage)""",
    "arriving_exports": f"""WITH {scored(EXPORTED_DOCS)} SELECT conversation_id, main_category, {LENGTH} AS char_length FROM labelled""",
}
