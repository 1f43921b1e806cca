"""Secret scans: key patterns, and sliding-window entropy per character class.

Everything is a row-local SQL expression; nothing is shuffled. A null text counts as empty and an empty
text has no spans; repeated rows give equal results; only the id and text columns are read, so other
columns cannot clash. Positions count code points and ends are exclusive.

Entropy of a window with counts c is log2(w) - sum(c log2 c) / w. Moving the window by one changes two
counts, so the sum is kept and corrected, in millionths as whole numbers: no rounding drifts along a
long string. Hot windows that touch or overlap become one span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from talkmill.llm.rows import narrow

#: Patterns of the base kinds, in their order: kind, pattern, least length of the match or of group 2.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Cheap tests that a text must pass before its matches are cut out.
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
SCALE = 1_000_000


@dataclass(frozen=True)
class EntropyClass:
    """A character class, the candidate strings made of it, and when a window of one is hot."""

    kind: str
    alphabet: str
    candidate: str
    window: int
    least_bits: float


CLASSES = (
    EntropyClass("entropy_hex", "0123456789abcdef", r"(?<![0-9a-f])[0-9a-f]{16,}+", 16, 3.0),
    EntropyClass(
        "entropy_base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=",
        r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
        20,
        3.8,
    ),
)
#: Candidates that are never secrets: no digit or no letter at all, UUIDs, dates and versions with words,
#: paths of words, documentation keys, digests of the empty string.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z_-]+$",
    r"^/?([a-z]+[/_-])+[a-z]*[0-9]{0,4}$",
    r"EXAMPLE",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
    r"^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",
)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL for an array of (s, e, m): every match with its code point positions."""
    p = _quoted(pattern)
    return f"""aggregate(
        arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)),
        (a, z) -> named_struct(
            'at', a.at + char_length(z['0']) + char_length(coalesce(z['1'], '')),
            'out', if(z['1'] is null, a.out, concat(a.out, array(named_struct(
                's', a.at + char_length(z['0']), 'e', a.at + char_length(z['0']) + char_length(z['1']), 'm', z['1']))))),
        a -> a.out)"""


def _hot(cls: EntropyClass) -> str:
    """SQL for the hot spans (s, e) of candidate c, relative to its start, by incremental counts.

    b is the state: counts n, their weighted sum t, spans out. q holds the places of the entering and
    the leaving character in the alphabet, f[c] is c log2 c, d is the state after the step.
    """
    w = cls.window
    f = "array(" + ", ".join(f"{round(n * math.log2(n) * SCALE) if n else 0}L" for n in range(w + 1)) + ")"
    most = math.floor((math.log2(w) - cls.least_bits) * w * SCALE)  # hot: the sum is at most this
    # p holds the place of every character in the alphabet, looked up once.
    places = f"transform(split(c.m, ''), x -> instr({_quoted(cls.alphabet)}, x) - 1)"
    place = "get(p, {} - 1)"
    enter = f"{f}[b.n[q.i] + 1] - {f}[b.n[q.i]]"
    leave = f"if(q.o >= 0, {f}[b.n[q.o]] - {f}[b.n[q.o] - 1], 0L)"
    spans = f"""case
        when j < {w} or d.t > {most}L then b.out
        when size(b.out) > 0 and element_at(b.out, -1).e >= j - {w}
          then concat(slice(b.out, 1, size(b.out) - 1), array(named_struct('s', element_at(b.out, -1).s, 'e', j)))
        else concat(b.out, array(named_struct('s', j - {w}, 'e', j))) end"""
    return f"""transform(array({places}), p -> aggregate(
        sequence(1, char_length(c.m)),
        named_struct('n', array_repeat(0, {len(cls.alphabet)}), 't', 0L, 'out', cast(array() as array<struct<s:int,e:int>>)),
        (b, j) -> transform(
            transform(
                array(named_struct('i', {place.format('j')}, 'o', if(j > {w}, {place.format(f'j - {w}')}, -1))),
                q -> named_struct(
                    'n', transform(b.n, (x, k) -> x + if(k = q.i, 1, 0) - if(k = q.o, 1, 0)),
                    't', b.t + if(q.i = q.o, 0L, {enter} - {leave}))),
            d -> named_struct('n', d.n, 't', d.t, 'out', {spans}))[0],
        b -> b.out))[0]"""


def _entropy_spans(text: str, order: int, cls: EntropyClass) -> str:
    allowed = " or ".join(f"rlike(c.m, {_quoted(p)})" for p in ALLOW)
    return f"""flatten(transform(filter({_matches(text, cls.candidate)}, c -> not ({allowed})),
        c -> transform({_hot(cls)}, h -> named_struct('s', c.s + h.s, 'k', {order}, 'e', c.s + h.e, 'kind', '{cls.kind}'))))"""


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, entropy): two sorted arrays of (s, k, e, kind) spans for each row.

    base holds the key patterns: assignments with a value of 6 characters or more, access keys of 20 or
    more, lower-case hex of 24 or more. entropy holds hot windows of candidate strings that are not on
    the allow-list and do not lie within one base span.
    """
    empty = "cast(array() as array<struct<s:int,k:int,e:int,kind:string>>)"

    def base(kind: str, k: int, pattern: str, hint: str, keep: str) -> str:
        return f"""if(rlike(text, {_quoted(hint)}),
            transform(filter({_matches('text', pattern)}, c -> {keep}),
                c -> named_struct('s', c.s, 'k', {k}, 'e', c.e, 'kind', '{kind}')), {empty})"""

    long_value = f"char_length(regexp_extract(c.m, {_quoted(ASSIGN)}, 2)) >= 6"
    kinds = (
        base("assign", 0, ASSIGN, ASSIGN_HINT, long_value),
        base("access", 1, ACCESS, ACCESS, "true"),
        base("hex", 2, HEX, HEX, "true"),
    )
    entropy = ", ".join(
        f"if(rlike(text, {_quoted(c.candidate)}), {_entropy_spans('text', 3 + n, c)}, {empty})"
        for n, c in enumerate(CLASSES)
    )
    docs = narrow(df, id_col, text_col)
    found = docs.select("doc_id", F.expr(f"array_sort(concat({', '.join(kinds)}))").alias("base"), F.expr(f"concat({entropy})").alias("hot"))
    return found.select(
        "doc_id",
        "base",
        F.expr("array_sort(filter(hot, h -> not exists(base, b -> b.s <= h.s and h.e <= b.e)))").alias("entropy"),
    )


def span_text(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def secrets_query(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets for each document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = "cast(size(filter(base, b -> b.kind = '{0}')) as bigint) as n_{0}"
    return found.selectExpr(
        "doc_id",
        *(count.format(kind) for kind in ("assign", "access", "hex")),
        "cast(size(entropy) as bigint) as n_entropy",
        f"sha2({span_text('base')}, 256) as base_sha256",
        f"{span_text('array_sort(concat(base, entropy))')} as spans",
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def secrets_sql() -> str:
    """DuckDB SQL for secrets_query: windows one by one, with no running counts."""
    keys = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    assign = f"""(?:{keys})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""

    def found(kind: str, k: int, pattern: str, keep: str) -> str:
        return f"""SELECT doc_id, row_id, {k} AS k, '{kind}' AS kind, at_ AS s, at_ + length(m) AS e, m FROM (
            SELECT *, list_sum(list_transform(piece[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS at_, ms[i] AS m
            FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, row_id, string_split_regex(text, {quote(pattern)}) AS piece, regexp_extract_all(text, {quote(pattern)}) AS ms FROM docs))
        ) WHERE {keep}"""

    allowed = " OR ".join(f"regexp_matches(m, {quote(p)})" for p in ALLOW)
    candidates = " UNION ALL ".join(
        found(c.kind, 3 + n, f"[{c.candidate.split('[')[-1].split(']')[0]}]{{{c.candidate.split('{')[1].split(',')[0]},}}", f"NOT ({allowed})") for n, c in enumerate(CLASSES)
    )
    window = "CASE k " + " ".join(f"WHEN {3 + n} THEN {c.window}" for n, c in enumerate(CLASSES)) + " END"
    most = "CASE k " + " ".join(f"WHEN {3 + n} THEN {math.floor((math.log2(c.window) - c.least_bits) * c.window * SCALE)}" for n, c in enumerate(CLASSES)) + " END"
    weigh = "[" + ", ".join(str(round(n * math.log2(n) * SCALE) if n else 0) for n in range(max(c.window for c in CLASSES) + 1)) + "]"
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
    base AS MATERIALIZED (
        {found("assign", 0, assign, f"length(regexp_extract(m, {quote(assign)}, 1)) >= 6")}
        UNION ALL {found("access", 1, ACCESS, "TRUE")} UNION ALL {found("hex", 2, HEX, "TRUE")}),
    candidate AS MATERIALIZED ({candidates}),
    windows AS (SELECT *, {window} AS w, {most} AS most, unnest(range(length(m) - {window} + 1)) AS j FROM candidate),
    hot AS (SELECT * FROM windows WHERE list_sum(list_transform(list_distinct(string_split(substr(m, j + 1, w), '')),
        lambda c: {weigh}[w - length(replace(substr(m, j + 1, w), c, '')) + 1])) <= most),
    marked AS (SELECT *, coalesce(j - lag(j) OVER run > w, TRUE) AS fresh FROM hot WINDOW run AS (PARTITION BY row_id, k, s ORDER BY j)),
    island AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY row_id, k, s ORDER BY j) AS part FROM marked),
    entropy AS (SELECT doc_id, row_id, k, kind, s + min(j) AS s, s + max(j) + max(w) AS e FROM island GROUP BY doc_id, row_id, k, kind, s, part),
    added AS (SELECT * FROM entropy h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = h.row_id AND b.s <= h.s AND h.e <= b.e)),
    spans AS (SELECT row_id, k, kind, s, e FROM base UNION ALL SELECT row_id, k, kind, s, e FROM added)
    SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        count(*) FILTER (k > 2) AS n_entropy,
        sha256(coalesce({joined} FILTER (k < 3), '')) AS base_sha256, coalesce({joined}, '') AS spans
    FROM docs d LEFT JOIN spans USING (row_id) GROUP BY d.doc_id, row_id
    """
