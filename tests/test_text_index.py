"""Similar texts by the trigram index are those of a look at all texts."""

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.similarity import similarity
from cohortspark.operators import text_index
from cohortspark.operators.predicates import apply_filter
from cohortspark.operators.ranking import rank_by_filter, rank_by_similarity

WORDS = "alpha beta gamma delta blue bolts green gear steel wheel the of and in on éclair ünder x1 7 a".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[1] * 10 + [9] * 5 + [1] * 5, k=rng.randint(0, 9))), rng.choice(WORDS)) for i in range(400)]
    rows += [(400 + i, "the same text twice", "x") for i in range(30)] + [(500, None, "x"), (501, "", "x"), (502, "?!.", "x"), (503, "the " * 500, "x")]
    return spark.createDataFrame(rows, "id long, text string, more string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return text_index.build(texts, "id", "text", str(tmp_path_factory.mktemp("index") / "texts"), parts=5)


@pytest.mark.parametrize("wanted", ["blue bolts", "the of", "the same text", "éclair", "zzz qqq", "", "7", "green gear the of and in on steel"])
def test_similar_and_best_equal_the_scan(texts, index, wanted):
    scores = {r.id: r.s for r in texts.select("id", similarity(F.col("text"), F.lit(wanted)).alias("s")).collect() if r.s}
    for at in (0.1, 0.3, 1 / 3, 0.5, 0.99, 1.0):
        got = {r.key: r.similarity for r in index.similar(wanted, at).collect()}
        assert got == {i: s for i, s in scores.items() if s >= at}, at
    for k in (1, 5, 40):
        best = index.best(wanted, k)
        if len(scores) < k:
            assert best is None
        else:
            got = {r.key: r.similarity for r in best.collect()}
            kth = sorted(scores.values())[-k]
            assert all(scores[i] == s for i, s in got.items()) and {i for i, s in scores.items() if s >= kth} <= set(got)


@pytest.mark.parametrize("limit", [1, 7, 35, 1000])
@pytest.mark.parametrize("wanted", ["the same text", "blue bolts", "qqq", " ~gamma? "])
def test_ranking_is_the_same_with_an_index(texts, index, wanted, limit):
    pairs = [("text", wanted), ("more", "blue")]
    plain = rank_by_similarity(texts, pairs, limit=limit, tie=["id"]).collect()
    assert rank_by_similarity(texts, pairs, limit=limit, tie=["id"], indexes={"text": ("id", index)}).collect() == plain


def test_filters_are_the_same_with_an_index(texts, index):
    leaf = {"field": "text", "operator": "%", "value": "the same text"}
    both = {"operator": "and", "items": [leaf, {"field": "more", "operator": "=", "value": "x"}]}
    either = {"operator": "or", "items": [leaf, {"field": "id", "operator": "<", "value": 5}]}
    for tree in (leaf, both, either):
        rows = lambda **how: sorted(r.id for r in apply_filter(texts, tree, **how).collect())  # noqa: E731, B023
        assert rows(indexes={"text": ("id", index)}) == rows() != []
    assert [r.id for r in rank_by_filter(texts, both, limit=3, tie=["id"], indexes={"text": ("id", index)}).collect()] == [400, 401, 402]


def test_a_question_reads_its_folders_only(index):
    plan = index._postings(index.grams_of("7"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "In(gram" in plan or "EqualTo(gram" in plan


def test_index_of_nothing(texts, tmp_path):
    empty = text_index.build(texts.limit(0), "id", "text", str(tmp_path / "none"))
    assert empty.similar("blue", 0.3).collect() == [] and empty.best("blue", 1) is None
