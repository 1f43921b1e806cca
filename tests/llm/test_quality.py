import math
import random

import numpy as np

from talkmill.llm import quality

SCHEMA = "doc_id long, text string, score double, pattern string"


def test_accuracies_are_recovered_without_labels():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.8
    rights = [0.95, 0.8, 0.9, 0.85]
    votes = []
    for rate in rights:
        vote = np.where((rng.random(len(truth)) < rate) == truth, quality.CLEAN, quality.JUNK)
        votes.append(np.where(rng.random(len(truth)) < 0.2, quality.ABSTAIN, vote))
    codes = np.zeros(len(truth), int)
    for v in votes:
        codes = codes * 3 + v
    model = quality.LabelModel(dict(zip(*map(np.ndarray.tolist, np.unique(codes, return_counts=True)), strict=True)), 4)
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.right - np.array(rights)).max() < 0.03
    guess = np.array([model.posterior[c] for c in codes.tolist()]) > 0.5
    assert (guess == truth).mean() > 0.93


def test_votes_round_trip():
    text = "THIS IS!! ALL!! SHOUTED!! AND!! ON!! IT!! GOES!! ON!! AND!! ON!!"
    votes = dict(zip(quality.LABELLERS, quality.votes_of(quality.pattern(text)), strict=True))
    assert votes[quality.symbols] == votes[quality.capitals] == quality.JUNK
    assert set(quality.votes_of(quality.pattern(""))) == {quality.ABSTAIN}


def test_agreement_with_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.quality_query(spark, sf).toPandas()
    assert len(out) == 1000
    seen = out.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    clean, junk = seen[seen["quality"] == 1], seen[seen["quality"] == 0]
    assert clean["keep"].mean() > 0.97
    assert junk["keep"].mean() < 0.25


def test_rows_and_columns(spark):
    prose = "The quiet river runs past the old mill. Nobody has worked there since the flood, and the wheel stands still. "
    rows = [(i, prose * 2 + f"Note {i} ends here.", 0.5, "x") for i in range(40)]
    rows += [(50, "Buy !!! NOW $$$ %%% " * 30, 0.5, "x"), (51, None, 0.5, "x"), (52, "", 0.5, "x"), (None, prose, 0.5, "x"), (3, rows[3][1], 0.5, "x"), (53, prose * 3000, 0.5, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert quality.score_quality(df).count() == len(rows)
    kept = quality.keep_clean(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 2 and None in ids and set(range(40)) <= set(ids) and 53 in ids
    assert quality.keep_clean(df.filter("false")).count() == 0


def test_repeats_after_a_varied_opening():
    """Variety is judged over the whole text, not over its first hundred words."""
    opening = [f"{a}{b}" for a in ("river", "mill", "flood", "stone", "quiet") for b in "abcdefghijklmnopqrst"]
    ended = [w + "." if k % 10 == 9 else w for k, w in enumerate(opening)]
    text = " ".join(ended + "the wheel stands still again.".split() * 300)
    votes = dict(zip(quality.LABELLERS, quality.votes_of(quality.pattern(text)), strict=True))
    assert votes[quality.prose] == votes[quality.plain_words] == quality.ABSTAIN
    votes = dict(zip(quality.LABELLERS, quality.votes_of(quality.pattern(" ".join(ended))), strict=True))
    assert votes[quality.prose] == votes[quality.plain_words] == quality.CLEAN


def test_a_text_without_blanks_counts_whole():
    """Features of a long token come from all of it; those of other words are as they were."""
    hasher, opening = quality.Hasher(), "a" * 40
    same, other = (dict(zip(*map(list, hasher(opening + rest * 50 + "zz")), strict=True)) for rest in ("junk$", "mill."))
    assert same.keys() != other.keys()
    token = "".join(f"{k:05d}-" for k in range(1000))
    ids, _ = hasher(token)
    crc = lambda part: quality.zlib.crc32(part.encode()) % quality.DIMENSIONS
    assert {crc("w" + token[k : k + 40]) for k in range(0, 6000, 40)} <= set(ids.tolist())
    short = hasher("a quiet river " + "x" * 40)
    assert np.allclose(hasher("a quiet river " + "x" * 40)[1], short[1]) and crc("w" + "x" * 40) in short[0]
    assert np.array_equal(hasher("y" * 40 + "river")[0], hasher("y" * 40 + " river")[0])


def plain_em(counts, labellers, rounds=200):
    """The same estimates one pattern, one labeller, one vote at a time."""
    prior, right = 0.9, [0.95] * labellers

    def posterior(code):
        odds = prior / (1 - prior)
        for vote, rate in zip(quality.votes_of(code, labellers), right, strict=True):
            odds *= rate / (1 - rate) if vote == quality.CLEAN else (1 - rate) / rate if vote == quality.JUNK else 1
        return odds / (1 + odds)

    for _ in range(rounds):
        after = {code: posterior(code) for code in counts}
        total = sum(counts.values())
        new = [0.0] * labellers
        for k in range(labellers):
            agreed = votes = 0.0
            for code, n in counts.items():
                vote = quality.votes_of(code, labellers)[k]
                if vote != quality.ABSTAIN:
                    votes += n
                    agreed += n * (after[code] if vote == quality.CLEAN else 1 - after[code])
            new[k] = min(max((agreed + 19) / (votes + 20), 0.6), 0.995)
        prior = min(max((sum(n * after[code] for code, n in counts.items()) + 9) / (total + 10), 0.05), 0.95)
        moved = max(abs(a - b) for a, b in zip(new, right, strict=True))
        right = new
        if moved < 1e-9:
            break
    return prior, right, {code: posterior(code) for code in counts}


def test_estimates_by_plain_loops():
    rng = random.Random(12)
    for labellers in (2, 3, 4):
        counts = {code: rng.randint(1, 50) for code in rng.sample(range(3**labellers), min(3**labellers, 12))}
        model = quality.LabelModel(counts, labellers)
        prior, right, posterior = plain_em(counts, labellers)
        assert math.isclose(model.prior, prior, rel_tol=1e-9)
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(model.right, right, strict=True))
        assert all(math.isclose(model.posterior[c], posterior[c], rel_tol=1e-6, abs_tol=1e-12) for c in counts)


def test_scorer_by_plain_gradient_steps(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["good", "plain", "words", "!!", "buy", "now"], k=rng.randint(1, 9))) for _ in range(25)]
    hasher = quality.Hasher()
    found = [(*hasher(t), rng.random()) for t in texts]
    rows = [(ids.astype("int64").tobytes(), values.tobytes(), truth) for ids, values, truth in found]
    sample = spark.createDataFrame(rows, "ids binary, counts binary, posterior double").repartition(3)
    weights, bias = quality._train(sample, rounds=6)
    own, squares, at, at_squares = {}, {}, 0.0, 1e-3
    for _ in range(6):
        gradient, slope = {i: -0.05 * w for i, w in own.items()}, 0.0
        for ids, values, truth in found:
            z = at + sum(own.get(int(i), 0.0) * v for i, v in zip(ids, values, strict=True))
            gap = truth - 1 / (1 + math.exp(-z))
            slope += gap
            for i, v in zip(ids, values, strict=True):
                gradient[int(i)] = gradient.get(int(i), 0.0) + gap * v
        at_squares += slope**2
        for i, g in gradient.items():
            squares[i] = squares.get(i, 1e-3) + g * g
            own[i] = own.get(i, 0.0) + g / math.sqrt(squares[i])
        at += 0.5 * slope / math.sqrt(at_squares)
    assert math.isclose(bias, at, rel_tol=1e-9)
    assert all(math.isclose(weights[i], w, rel_tol=1e-7, abs_tol=1e-12) for i, w in own.items())
    assert set(weights.nonzero()[0].tolist()) <= set(own)


def test_all_texts_train_the_scorer(spark, monkeypatch):
    """Every different text is in the training, however many there are; copies count once."""
    trained = []
    train = quality._train

    def seen(labelled, *args, **options):
        trained.append(labelled.count())
        return train(labelled, *args, **options)

    monkeypatch.setattr(quality, "_train", seen)
    monkeypatch.setattr(quality, "ROUNDS", 1)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('the quiet river runs past mill ', id) AS text")
    out = quality.score_quality(docs.union(docs.limit(500)))
    assert trained == [20_000] and out.count() == 20_500


def test_steps_are_alike_at_any_size(spark):
    """Texts given many times over lead to the same scorer, beyond the strength of a gradient."""
    rng = random.Random(5)
    rows = []
    for _ in range(quality.STRENGTH // 4):
        ids, values = quality.Hasher()(" ".join(rng.choices(["good", "plain", "!!", "buy"], k=4)))
        rows.append((ids.astype("int64").tobytes(), values.tobytes(), rng.random()))
    one = spark.createDataFrame(rows * 4, "ids binary, counts binary, posterior double")
    weights, bias = quality._train(one, rounds=3)
    more, more_bias = quality._train(one.union(one).union(one), rounds=3)
    assert math.isclose(bias, more_bias, rel_tol=1e-6) and np.allclose(weights, more, rtol=1e-6)


def test_written_features_are_those_of_the_texts(spark):
    texts = ["", "a quiet river", "x " * 70_000 + "end", "y" * 5000, "Ünïcode wörds, 12 of them!"] * 2
    docs = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "key string, doc_id long, text string")
    read = quality._looked_at(docs).toPandas().sort_values("doc_id")
    (part, ids, values, text), = quality._features_of([read])
    hasher = quality.Hasher()
    for k, given in enumerate(texts):
        own, counts = hasher(given)
        assert np.array_equal(ids[text == k], own) and np.array_equal(values[text == k], counts)
