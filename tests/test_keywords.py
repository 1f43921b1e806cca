import random

import pytest
from pyspark.sql import functions as F

from brute import counts, label
from talkmill.functions.taxonomy import DEFAULT, Group, Taxonomy
from talkmill.operators import categorize as C
from talkmill.operators import conversations as V

BOUNDARIES = [
    "forståelse",
    "forstå²",
    "data½ data",
    "data_1 data-1 data.",
    "ådata",
    "DALL-E and dall-e, dalle",
    "what iſ a deſign, lınkedın",
    "cafédata",
    "find information about it",
    "can you find information about this",
    "what is what is",
    "what  is",
    "what\nis",
    "what is this",
    "LinkedIn Twitter LINKEDIN",
    "İdea ideİ",
    "how to use how to make how to",
    "help me with help me understand",
    "tell me with",
    "",
    "qwrt zzz mnop",
    "My script crashes: the compiler shows an error, and the function has a bug.",
    "Which dish could I bake tonight? The oven recipe needs food for a whole meal.",
    "Explain the homework to me, the course and its tutorial are hard to understand.",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    words = sorted({w for k in DEFAULT.keywords for w in k.replace("-", " ").split()})
    other = ["the", "ådata", "x²", "forstået", "İ", "data_", "audio", "ſ"]
    seps = [" "] * 12 + ["  ", "\n", "-", ", ", ".", "_", "'", " ", "½"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 25)):
            word = rng.choice(rng.choice([words, DEFAULT.keywords, words, other]))
            text += rng.choice([word, word, word.upper(), word.title()]) + rng.choice(seps)
        out.append(text)
    return out


def test_counts_and_labels_match_brute_force(spark):
    texts = BOUNDARIES + random_texts(600, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    hits = {r["i"]: r[C.HITS] for r in C.with_hits(df).select("i", C.HITS).collect()}
    for i, text in enumerate(texts):
        assert hits[i] == counts(text), text
    for r in C.categorize(df).collect():
        assert (r["main_category"], r["subcategory"], r["confidence_score"]) == label(r["text"])


def test_every_label_is_reachable(spark):
    texts = [f"{g.keywords[0]} {g.keywords[-1]}" for g in DEFAULT.groups] + ["nothing here"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {tuple(r) for r in C.categorize(df).select("text", "main_category").collect()}
    assert got == {(t, label(t)[0]) for t in texts}


def test_ties_and_missing_sub_hits(spark):
    # One hit each for two categories; a main hit alone takes the first subcategory.
    rows = {"python hobby": ("Code Development", "Bug Fixing", 1), "kitchen": ("Cooking/Food", "Recipe Help", 1)}
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = C.categorize(df).collect()
    assert {r["text"]: (r["main_category"], r["subcategory"], r["confidence_score"]) for r in got} == rows


def test_null_text_and_empty_input(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert C.categorize(df).select("main_category", "is_voice").first() == ("Other", False)
    assert C.categorize(df.limit(0)).count() == 0


def test_score_tree(spark):
    df = spark.createDataFrame([("debug my python code",)], "text string")
    tree = C.categorize(df, all_scores=True).first()["all_scores"]
    assert list(tree) and len(tree) == 12
    code = tree["Code Development"]
    assert (code["main_score"], code["total_score"]) == (3, 4)
    assert code["sub_scores"] == {"Bug Fixing": 1, "Feature Development": 0, "Code Review": 0}


def test_other_taxonomies(spark):
    mine = Taxonomy(
        [
            Group("A", None, ("alpha", "alpha beta")),
            Group("B", None, ("beta", "gamma's")),
            Group("B", "B1", ("gamma",)),
        ]
    )
    df = spark.createDataFrame([("alpha beta",), ("gamma's",), ("none",)], "text string")
    got = C.categorize(df, taxonomy=mine).select("main_category", "subcategory", "confidence_score")
    assert [tuple(r) for r in got.collect()] == [
        ("A", "Uncategorized", 1),
        ("B", "B1", 2),
        ("Other", "Uncategorized", 0),
    ]
    again = Taxonomy.from_table(DEFAULT.table(spark).repartition(3))
    assert again.groups == DEFAULT.groups
    with pytest.raises(ValueError):
        Taxonomy([Group("A", None, ("c++",))])


def test_taxonomy_is_whole():
    assert len(DEFAULT.categories) == 12
    assert len(DEFAULT.groups) == 57
    assert sum(len(g.keywords) for g in DEFAULT.groups) == 335
    assert len(DEFAULT.keywords) == 236
    assert all(DEFAULT.sub_indexes(c) for c in DEFAULT.categories)


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_turns_score_like_their_joined_text(spark, chunk):
    rng = random.Random(7)
    rows = []
    for conv in range(120):
        words = " ".join(random_texts(rng.randint(1, 2), conv)).split(" ")
        words = (words + ["what", "is", "this", "can", "you", "find", "information", "about"]) * 2
        while words:
            n = rng.choice([0, 1, 1, 2, 3, 9])
            turn = rng.choice([" ".join(words[:n]), " ".join(words[:n]), f" {' '.join(words[:n])}\n"])
            rows.append((conv, len(rows), rng.choice([turn, turn, turn, "", "  ", None])))
            words = words[n:]
    rows += [(500, 1, ""), (501, 1, " \n"), (502, 3, "tell me"), (502, 4, "about")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string").repartition(5)
    texts = {r["conv_id"]: r["text"] for r in V.conversation_text(df).collect()}
    for conv in {r[0] for r in rows}:
        said = [t.strip() for c, _, t in rows if c == conv and t]
        assert texts[conv] == " ".join(said)
    got = {r["conv_id"]: r for r in V.categorize_conversations(df, chunk_turns=chunk).collect()}
    assert set(got) == {c for c, t in texts.items() if t.strip()}
    for conv, r in got.items():
        expected = label(texts[conv])
        assert (r["main_category"], r["subcategory"], r["confidence_score"]) == expected
        assert r["char_length"] == len(texts[conv])
    df = spark.createDataFrame(list(texts.items()), "conv_id int, text string")
    for r in C.categorize(df.filter(F.trim("text") != "")).collect():
        if r["conv_id"] in got:
            assert got[r["conv_id"]]["is_voice"] == r["is_voice"]
