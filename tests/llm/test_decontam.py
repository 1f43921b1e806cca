import random

import numpy as np

from talkmill.llm import decontam

SCHEMA = "doc_id long, text string, cosine double, item_id string"


def invented(seed=3):
    rng = random.Random(seed)
    common = ["the", "of", "and", "in", "to", "is"]
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=2)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bcdfglmnprst", k=2))
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [prose(rng.choice([15, 30, 59, 120])) for _ in range(40)]
    docs, leaks = [], set()
    for i in range(240):
        text = prose(rng.randint(5, 400))
        if i % 4 == 0:
            k = rng.randrange(40)
            part = list(items[k])
            if i % 8 == 0:  # a paraphrase: one word in eight changed
                for at in rng.sample(range(len(part)), len(part) // 8):
                    part[at] = word()
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
            leaks.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)], leaks


def test_planted_leaks_and_nothing_else(spark):
    docs, items, leaks = invented()
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()}
    assert found == leaks
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench, items=15).collect()} == leaks
    clean = decontam.without_leaks(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in leaks}


def test_recall_of_the_latent_space(spark):
    """Against all passages checked by the longest common subsequence alone."""
    docs, items, _ = invented(9)
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench, rank=48).collect()}
    model = decontam.Benchmark(items)
    numbers, seen = decontam.Numbers(model.vocabulary), np.zeros(len(model.vocabulary))
    ids = {i: numbers.of(t) for i, t in docs}
    for x in ids.values():
        seen[np.unique(x[x >= 0])] += 1
    model.weigh(len(docs), seen)
    want = set()
    for i, x in ids.items():
        for start in range(0, max(1, len(x) - 15), 16):
            for k, item in enumerate(model.passages):
                passage = x[start : start + 64]
                share = decontam.common_weight(item, passage, model.idf) / model.weight[k]
                if share >= 0.8 or share >= 0.6 and np.isin(item[-max(1, len(item) // 4) :], passage).mean() >= 0.5:
                    want.add((i, model.item[k]))
    assert len(found & want) >= 0.9 * len(want) and not found - want


def test_paraphrases_are_found_in_the_latent_space(spark, monkeypatch):
    """Clauses in another order, and one word in ten another one: too little in order for the rare words' rule."""
    docs, items, _ = invented(13)
    rng = random.Random(8)
    long = [(k, words.split()) for k, words in items if len(words.split()) >= 30]
    moved, want = [], set()
    for i, (k, words) in enumerate(long * 3):
        quarter = len(words) // 4
        clauses = [words[:quarter], words[quarter : 2 * quarter], words[2 * quarter : 3 * quarter], words[3 * quarter :]]
        part = [w for c in (1, 0, 3, 2) for w in clauses[c]]
        for at in rng.sample(range(len(part)), len(part) // 10):
            part[at] = f"other{at}"
        moved.append((1000 + i, " ".join(docs[(4 * i + 1) % 240][1].split()[:60] + part)))
        want.add((1000 + i, k))
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs + moved], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.common for r in decontam.find_leaks(df, bench).collect()}
    assert len(want & set(found)) >= 0.9 * len(want)
    assert {pair for pair in found if pair[0] >= 1000} <= want
    assert sum(found[pair] < decontam.SHARE for pair in want & set(found)) > len(want) / 2
    monkeypatch.setattr(decontam, "_near", lambda ids, bench: iter(()))
    without = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()}
    assert len(want & without) < 0.5 * len(want)


def test_near_passages_against_all_pairs(monkeypatch):
    docs, items, _ = invented(22)
    model = decontam.Benchmark(items)
    numbers, seen = decontam.Numbers(model.vocabulary), np.zeros(len(model.vocabulary))
    ids = [numbers.of(t) for _, t in docs]
    for x in ids:
        seen[np.unique(x[x >= 0])] += 1
    model.weigh(len(docs), seen)
    model.project(np.linalg.qr(np.random.default_rng(3).standard_normal((len(model.idf), 60)))[0])
    plain = [{(step, k) for step, near in decontam._near(x, model) for k in near} for x in ids]
    monkeypatch.setattr(decontam, "HELD", 64)
    for x, got in zip(ids, plain, strict=True):
        assert {(step, k) for step, near in decontam._near(x, model) for k in near} == got
        for step in range(-(-len(x) // 16)):
            passage = x[step * 16 : step * 16 + 64]
            latent = model.rows[passage].sum(axis=0)
            cosine = model.latent @ latent / max(np.linalg.norm(latent), 1e-9)
            near = (cosine >= decontam.COSINE) & (model.mass[passage].sum() >= decontam.NEAR * model.weight)
            sure = np.abs(cosine - decontam.COSINE) > 1e-4
            assert {k for k in np.flatnonzero(near & sure)} <= {k for s, k in got if s == step} <= set(np.flatnonzero(near | ~sure))


def test_weighted_subsequence_by_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    idf = rng.random(6) + 0.1
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(-1, 6, rng.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + idf[a[i]] if a[i] == b[j] else 0)
        assert np.isclose(decontam.common_weight(a, b, idf), table[-1, -1])


def test_odd_rows(spark):
    docs, items, _ = invented(5)
    text = items[1][1]
    rows = [(1, text, 0.5, "x"), (1, text, 0.5, "x"), (None, "so " + text, 0.5, "x"), (2, None, 0.5, "x"), (3, "", 0.5, "x"), (4, "... !!", 0.5, "x")]
    rows += [(100 + i, t, 0.5, "x") for i, t in docs if i % 4]
    df = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "?!"), (1, text)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.find_leaks(df, bench).collect()) == [("1", 1), ("None", 1)]
    assert decontam.find_leaks(df, bench.filter("false")).count() == 0
    assert decontam.find_leaks(df.filter("false"), bench).count() == 0


def test_given_tables(spark):
    """Every document that holds a benchmark text verbatim is found."""
    sf = "/root/testdata/sf0.01"
    found = {(r.doc_id, r.item_id) for r in decontam.decontam_query(spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    verbatim = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    assert verbatim <= found and len({d for d, _ in found}) <= len({d for d, _ in verbatim}) + 3


def test_word_for_word_copies_of_every_length(spark):
    """Against a plain search for the words of each of 200 items."""
    sf = "/root/testdata/sf0.1"
    plain = lambda text: f" {' '.join(decontam.words_of(text))} "
    items = [(b.item_id, plain(b.text)) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    copies = set()
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = plain(d.text or "")
        copies |= {(d.doc_id, k, len(item.split()) // 10) for k, item in items if item in text}
    found = {(r.doc_id, r.item_id) for r in decontam.decontam_query(spark, sf).collect()}
    missed = [x for x in copies if x[:2] not in found]
    assert {n for *_, n in copies} >= {1, 2, 3} and not missed


def test_candidates_in_groups_against_all_pairs(monkeypatch):
    """Every pair whose words in common weigh enough is a candidate, items of common words alone included."""
    monkeypatch.setattr(decontam, "TOGETHER", 20)
    docs, items, _ = invented(21)
    model = decontam.Benchmark([*items, (90, "the of and in"), (91, "is to the"), (92, "the the the")])
    numbers, seen = decontam.Numbers(model.vocabulary), np.zeros(len(model.vocabulary))
    ids = [numbers.of(t) for _, t in docs]
    for x in ids:
        seen[np.unique(x[x >= 0])] += 1
    model.weigh(len(docs), seen)
    for x in ids:
        got = {(step, k) for step, near in decontam._candidates(x, model) for k in near}
        for step in range(-(-len(x) // 16)):
            passage = x[step * 16 : step * 16 + 64]
            for k, item in enumerate(model.passages):
                held = min(model.idf[item[np.isin(item, passage)]].sum(), model.mass[passage].sum())
                assert held < model.limit[k] + 1e-6 or (step, k) in got


def plain_basis(passages, idf, unknown, rank):
    """Power steps on the whole matrix of passages, from the start that the operator takes."""
    rows = np.zeros((len(passages), len(idf)))
    for row, ids in zip(rows, passages, strict=True):
        for i in ids[ids >= 0]:
            row[i] += idf[i]
        row /= max(np.sqrt((row**2).sum() + (ids < 0).sum() * unknown**2), 1e-9)
    q = np.linalg.qr(np.random.default_rng(17).standard_normal((len(idf), min(len(idf), rank + decontam.SPARE))))[0]
    for _ in range(decontam.POWERS):
        q = np.linalg.svd(rows.T @ (rows @ q), full_matrices=False)[0]
    return q[:, :rank]


def test_the_latent_space_is_that_of_all_documents(spark):
    """More documents than any sample took, copies among them: cosines equal those of the whole matrix."""
    docs, items, _ = invented(31)
    rng = random.Random(4)
    own = [w for _, t in items for w in t.split()]
    more = [" ".join(rng.choices(own, k=rng.randint(3, 150))) for _ in range(2000)]
    rows = docs + [(1000 + i, t) for i, t in enumerate([*more, *more[:20] * 60])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, rank=20).collect()
    model = decontam.Benchmark(items)
    numbers, seen = decontam.Numbers(model.vocabulary), np.zeros(len(model.vocabulary))
    ids = {i: numbers.of(t) for i, t in rows}
    for x in ids.values():
        seen[np.unique(x[x >= 0])] += 1
    model.weigh(len(rows), seen)
    cut = [x[k : k + 64] for x in ids.values() for k in range(0, len(x), 64)]
    model.project(plain_basis([*cut, *model.passages], model.idf, model.unknown, 20))
    assert len({r.doc_id for r in found}) >= 50
    for r in found:
        x = ids[r.doc_id]
        cosines = []
        for k in [k for k, item in enumerate(model.item) if item == r.item_id]:
            for step in range(-(-len(x) // 16)):
                latent = model.rows[x[step * 16 : step * 16 + 64]].sum(axis=0)
                cosines.append(float(latent @ model.latent[k] / max(np.linalg.norm(latent), 1e-9)))
        assert min(abs(r.cosine - c) for c in cosines) < 1e-4


def test_documents_together_as_one_at_a_time(monkeypatch):
    """Put end to end, no passage reaches into the next document."""
    docs, items, _ = invented(41)
    model = decontam.Benchmark(items)
    numbers, seen = decontam.Numbers(model.vocabulary), np.zeros(len(model.vocabulary))
    # an item cut in two neighbouring documents is in neither
    words = items[3][1].split()
    texts = [t for _, t in docs[:80]] + ["", "?!", " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :]), "zz yy", items[5][1], items[5][1]]
    ids = [numbers.of(t) for t in texts]
    for x in ids:
        seen[np.unique(x[x >= 0])] += 1
    model.weigh(len(texts), seen)
    model.project(np.linalg.qr(np.random.default_rng(3).standard_normal((len(model.idf), 60)))[0])
    able = [n for n, x in enumerate(ids) if len(x) and x.max() >= 0]

    def leaks(groups):
        return sorted((g[place], item, round(cosine, 4), round(share, 6), answer) for g in groups for place, item, cosine, share, answer in decontam._leaks_of([ids[n] for n in g], model))

    alone = leaks([n] for n in able)
    assert len(alone) > 20
    for held in (64, 1024, 16_384):
        monkeypatch.setattr(decontam, "HELD", held)
        groups = list(decontam._groups(ids))
        assert [n for g in groups for n in g] == able and leaks(groups) == alone
    monkeypatch.setattr(decontam, "PAIRS", 2)
    assert leaks(decontam._groups(ids)) == alone


def test_numbers_of_odd_texts(monkeypatch):
    """Split, lowered and stripped by Arrow as by Python, at every character that may part words, whatever is split together."""
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() or c in (0x180E, 0x200B, 0x2060, 0xFEFF))
    rng = random.Random(4)
    vocabulary = {w: n for n, w in enumerate(["the", "of", "don't", "é", "i̇x", "ς", "σ", "ß", "a​b", "x-y", "\U0001f600"])}
    pieces = [*vocabulary, *(w.upper() for w in vocabulary), "İX", "ΟΔΟΣ", "…", *decontam.STRIPPED, "(the)", "--", "'don't'", *blanks]
    texts = ["", "   ", "?!", "\x1f the\u0085of\x1c", *("".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(300))]
    texts += [rng.choice(blanks).join(rng.choices(pieces, k=rng.randint(0, 90))) for _ in range(300)]
    want = [[vocabulary.get(w, -1) for w in decontam.words_of(t)] for t in texts]
    numbers = decontam.Numbers(vocabulary)
    for split in (1, 200, 1 << 20):
        monkeypatch.setattr(decontam, "SPLIT", split)
        assert [x.tolist() for x in numbers.of_all(texts)] == want
    assert sum(k >= 0 for x in want for k in x) > 1000
    for _ in range(30):  # blanks at the end of what is split together, whatever stands behind in memory
        assert [numbers.of(t).tolist() for t in texts] == want


def test_rows_by_plain_counts():
    rng = np.random.default_rng(6)
    idf = rng.random(9) + 0.1
    found = [rng.integers(-1, 9, n).astype(np.int32) for n in (1, 64, 65, 200, 7)] + [np.full(70, -1, np.int32)]
    row, word, values, rows = decontam._rows(found, idf, 2.0)
    got = np.zeros((rows, 9))
    got[row, word] = values
    passages = [x[k : k + 64] for x in found for k in range(0, len(x), 64)]
    assert rows == len(passages)
    for line, ids in zip(got, passages, strict=True):
        plain = np.bincount(ids[ids >= 0], minlength=9) * idf
        assert np.allclose(line, plain / max(np.sqrt((plain**2).sum() + (ids < 0).sum() * 4.0), 1e-9))


def test_pairs_are_compared_together(monkeypatch):
    """Equal to one pair at a time, by a few calls for many copies."""
    docs, items, _ = invented(51)
    model = decontam.Benchmark(items)
    numbers, seen = decontam.Numbers(model.vocabulary), np.zeros(len(model.vocabulary))
    ids = [numbers.of(f"{text} {items[k % 40][1]}") for k, (_, text) in enumerate(docs)]
    for x in ids:
        seen[np.unique(x[x >= 0])] += 1
    model.weigh(len(ids), seen)
    model.project(np.linalg.qr(np.random.default_rng(3).standard_normal((len(model.idf), 60)))[0])
    calls, plain = [], decontam.common_weights
    monkeypatch.setattr(decontam, "common_weights", lambda *x: calls.append(len(x[0])) or plain(*x))
    groups = list(decontam._groups(ids))
    leaks = [leak for g in groups for leak in decontam._leaks_of([ids[n] for n in g], model)]
    assert len(leaks) > 400 and sum(calls) >= len(leaks) and len(calls) <= sum(calls) / decontam.WEIGHED + 2 * len(groups)
    monkeypatch.setattr(decontam, "WEIGHED", 1)
    assert [leak for g in groups for leak in decontam._leaks_of([ids[n] for n in g], model)] == leaks
