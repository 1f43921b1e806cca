import random
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from talkmill.functions import language as L


def batch_of(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["language", "letters"])


def counts(batches):
    out = Counter()
    for batch in batches:
        for language, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[language, gram] += n
    return out


def plain(rows):
    out = Counter()
    for language, letters in rows:
        for size in (1, 2, 3):
            for at in range(len(letters or "") - size + 1):
                gram = letters[at : at + size]
                if " " not in (gram if size == 1 else gram[1:-1]) and gram != "  ":
                    out[language, gram] += 1
    return out


def test_sequences_counted_in_parts_against_loops():
    """Texts cut at every place, and rows taken a few at a time, count as they do in one piece."""
    words = ["ærø", "a", "der", "straße", "день", "𝒳y", "la", "niño"]
    rows = [("da" if i % 3 else "es", " " + " ".join(words[(i * k) % 8] for k in range(i % 11)) + " ") for i in range(60)]
    rows += [("da", None), ("es", "  "), ("de", " e ")]
    want = plain(rows)
    for together in (1, 2, 3, 7, 50, 10_000):
        task = L._counting(10_000, together=together, rows=4)
        assert counts(task([batch_of(rows[:40]), batch_of(rows[40:])])) == want
    assert counts(L._counting(5, together=3)([batch_of(rows)])) == want


def test_memory_does_not_grow_with_the_rows_of_a_batch():
    text = " " + "ord som går igen og igen " * 60
    peaks = []
    for many in (500, 4000):
        batch = batch_of([("da", text)] * many)
        tracemalloc.start()
        for _ in L._counting(L.COUNTED)([batch]):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 60e6


def test_ranks_as_plain_strings(spark):
    """The language is that of sequences counted one by one as strings, also beyond the basic plane and for texts of one letter."""
    rng = random.Random(8)
    texts = ["", " ", "a", "Aa aA", "١٢", "𐐷𐐨 𐐷", "日本 語", *(" ".join("".join(rng.choices("aeinrstüж𐐨", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 80))) for _ in range(200))]
    given = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    trained = given.withColumn("lang", F.expr("concat('l', n % 3)"))
    profiles = L.model(L.profile(trained))
    rows = given.select("text", L.letters(F.substring("text", 1, 1000)).alias("letters"), L.identify("text", profiles).alias("got")).collect()
    for r in rows:
        s = r.letters
        counts = Counter(s) + Counter(s[i : i + 2] for i in range(len(s) - 1)) + Counter(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
        del counts[" "]
        own = sorted(counts, key=lambda g: (-counts[g], g))[: L.PROFILE_SIZE] if s.strip() else []
        far = {code: sum(abs(grams.index(g) - k) if g in grams else L.PROFILE_SIZE for k, g in enumerate(own)) for code, grams in profiles.items()}
        met = any(g in grams for grams in profiles.values() for g in own)
        assert r.got == (min(sorted(far), key=far.__getitem__) if met else L.UNKNOWN), r.text
