import math
import random
import re
import string

from talkmill.llm import secret_scan

BASE = {
    "assign": (r"(?a:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]+", 0),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def base_spans(text):
    found = []
    for k, (kind, (pattern, flags)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, flags):
            if len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def entropy_spans(text):
    base, found = base_spans(text), []
    for n, cls in enumerate(secret_scan.CLASSES):
        for m in re.finditer(f"[{re.escape(cls.alphabet)}]+", text):
            word = m[0]
            if len(word) < (16 if n == 0 else 20) or any(re.search(p, word) for p in secret_scan.ALLOW):
                continue
            hot = set()
            for at in range(len(word) - cls.window + 1):
                part = word[at : at + cls.window]
                bits = -sum(part.count(c) / cls.window * math.log2(part.count(c) / cls.window) for c in set(part))
                if bits >= cls.least_bits - 1e-7:
                    hot.update(range(at, at + cls.window))
            for at in sorted(hot):
                if at - 1 not in hot:
                    end = next(e for e in range(at + 1, len(word) + 1) if e not in hot)
                    s, e = m.start() + at, m.start() + end
                    if not any(b[0] <= s and e <= b[2] for b in base):
                        found.append((s, 3 + n, e, cls.kind))
    return sorted(found)


def texts():
    rng = random.Random(3)
    key = lambda letters, n: "".join(rng.choices(letters, k=n))
    out = [
        "",
        None,
        "password=abc",
        'Token: "token": abcdefgh',
        "api_key='zzzzzz' APIKEY = qwerty123 é secret:=",
        "née passwd  :   \"abc.def-ghi\" token=secret=abcdefgh",
        "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C7" * 8,
        "😀 " + key("0123456789abcdef", 40) + " tail",
        "x" + key("0123456789abcdef", 23) + "g" + key("0123456789abcdef", 24),
        "id 123e4567-e89b-12d3-a456-426614174000 and 2024-01-02T-backup-of-the-archive-folder",
        "run " + "a1" * 30 + " " + "/usr/local/share/some/long/path/name12",
        "EXAMPLE" + key(string.ascii_letters + string.digits, 30),
        "ſecret=abcdefgh PAſſWD=abcdefgh KEY tokEN=abcdefgh",
        "a" * 30 + key(string.ascii_letters + string.digits, 24) + "b" * 30 + key(string.ascii_letters + string.digits, 24) + "c" * 30,
        "1" * 5000,
    ]
    for _ in range(60):
        out.append(" ".join(rng.choice([key(string.ascii_letters + string.digits + "+/_=-", rng.randint(3, 45)), key("0123456789abcdef", rng.randint(3, 45)), "token = ", "word", "ñandú"]) for _ in range(20)))
    return out


def test_spans_against_brute_force(spark):
    given = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id long, text string, base string, spans int")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    for i, text in given:
        assert [tuple(x) for x in got[i].base] == base_spans(text or ""), (i, text)
        assert [tuple(x) for x in got[i].entropy] == entropy_spans(text or ""), (i, text)


def test_something_is_found_and_rows_are_kept(spark):
    df = spark.createDataFrame([(None, "token=abcdefg"), (7, "token=abcdefg"), (7, "token=abcdefg")], "doc_id long, text string")
    assert [[tuple(s) for s in r.base] for r in secret_scan.scan_secrets(df).collect()] == [[(0, 0, 13, "assign")]] * 3
    assert secret_scan.scan_secrets(df.filter("false")).count() == 0
    hot = spark.createDataFrame([(1, "key xJ3k9QpLm2Zr8TvW5yBn7Cd4 end")], "doc_id long, text string")
    assert [s.kind for s in secret_scan.scan_secrets(hot).first().entropy] == ["entropy_base64"]


def test_query(spark):
    rows = secret_scan.secrets_query(spark, "/root/testdata/sf0.001").collect()
    texts_of = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts_of)
    for r in rows:
        base = base_spans(texts_of[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in base) for k in BASE]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base + entropy_spans(texts_of[r.doc_id])))


def test_a_long_run(spark):
    """One candidate of 200,000 characters: hot but for a stretch of one letter."""
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    run = "".join(rng.choices(letters, k=100_000)) + "a" * 1000 + "".join(rng.choices(letters, k=99_000))
    row = secret_scan.scan_secrets(spark.createDataFrame([(1, run)], "doc_id long, text string")).first()
    spans = [(x.s, x.e) for x in row.entropy]
    assert spans and spans[0][0] < 100 and spans[-1][1] > 199_900
    assert not any(s < 100_500 < e for s, e in spans)
