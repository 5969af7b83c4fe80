"""Words that go with the label are found with few labelled examples, and where they are rare."""

import random
from math import comb

import pytest

from ashlar.llm import toxicity


def test_by_chance():
    for hits, df, positive, n in ((4, 4, 7, 70), (2, 5, 6, 20), (6, 6, 10, 30), (3, 3, 3, 5)):
        exact = sum(comb(positive, x) * comb(n - positive, df - x) for x in range(hits, min(df, positive) + 1)) / comb(n, df)
        found = toxicity.by_chance(hits, df, positive, n)
        assert found == pytest.approx(exact) if exact <= toxicity.CHANCE else found > toxicity.CHANCE


def examples(n, toxic):
    """Rows whose toxic words are given: {number: word}."""
    rng = random.Random(5)
    return [(i, " ".join([f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}" for _ in range(12)] + toxic.get(i, [])), int(i in toxic)) for i in range(n)]


def test_few_labels():
    rows = examples(30, {i: ["zvileness"] for i in range(0, 24, 3)})
    model = toxicity.Model(rows)
    assert "zvileness" in model.terms
    assert model.score("a zvileness")[0] >= 0.5 > model.score("a kindness")[0]
    rows = examples(70, {i: ["zvileness"] if i < 40 else ["other"] for i in range(0, 70, 10)})
    model = toxicity.Model(rows)
    assert "zvileness" in model.terms and model.score("a zvileness")[0] >= 0.5


def test_rare_toxic_words():
    rows = examples(8000, {i: ["xrare"] if i < 40 else ["zvileness"] for i in range(0, 8000, 10)})
    model = toxicity.Model(rows)
    assert {"xrare", "zvileness"} <= set(model.terms)
    assert model.score("a xrare")[0] >= 0.5 > model.score("a kindness")[0]
