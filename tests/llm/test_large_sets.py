"""Near duplicates among large texts: what shares a passage only is told apart before its n-grams are moved."""

import random
from fractions import Fraction

import numpy as np
import pytest

from sievenet.llm import components, jaccard
from sievenet.llm.tables import saved


def words(rng, n):
    return [f"w{rng.randrange(1 << 40)}" for _ in range(n)]


@pytest.fixture
def stored(monkeypatch):
    """The rows and plan of each table that a join stores, by name."""
    found = {}

    def kept(frame, name):
        out = saved(frame, name)
        found.setdefault(name, []).append((frame._jdf.queryExecution().executedPlan().toString(), out))
        return out

    monkeypatch.setattr(jaccard, "saved", kept)
    monkeypatch.setattr(components, "saved", kept)
    return found


def test_only_large_sets_that_may_link_are_verified(spark, stored):
    rng = random.Random(3)
    passage = words(rng, 1500)
    texts = [passage + words(rng, 1500) for _ in range(8)]
    texts += [texts[0][:-60] + words(rng, 60), texts[1][20:] + words(rng, 400)]  # linked with the first two
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 5, 80, 100).collect()}
    assert rows == {**{i: i for i in range(8)}, 8: 0, 9: 1}
    pairs = {(r.a, r.b) for _, t in stored["pairs"] for r in t.select("a", "b").collect()}
    assert len(pairs - {(0, 8), (1, 9)}) >= 5  # short sketches let these pass
    assert {r.doc_id for _, t in stored["parts"] for r in t.select("doc_id").distinct().collect()} == {0, 1, 8, 9}


def test_signatures_are_shuffled_once(spark, stored):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 30))) for i in range(20)], "doc_id bigint, text string")
    assert jaccard.jaccard_components(docs).where("doc_id = component_id").count() == 20
    ((plan, table),) = stored["postings"]
    assert plan.count("Exchange hashpartitioning(s#") == 1 and table.isEmpty()


def test_a_large_group_that_stays_apart_takes_two_rounds(spark, stored):
    """Many sets share fragments but don't link: 50 of 62 n-grams; copies of a few of them with one word more do."""
    rng = random.Random(6)
    common = words(rng, 52)
    texts = [common + words(rng, 6) for _ in range(600)]
    texts += [[*texts[i], f"x{i}"] for i in range(5)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert rows == {i: i % 600 for i in range(605)}
    assert len(stored["pairs"]) == 2


def test_a_small_link_table_is_not_shuffled(spark, stored):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint").repartition(3)
    rows = {r.node: r.component for r in components.components(links).collect()}
    assert rows == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert len(stored["edges"]) > 2 and not any("Exchange hashpartitioning" in plan for plan, _ in stored["edges"][1:])


@pytest.mark.parametrize("size", [500, 512, 700, 5000])
def test_long_sketches_differ_in_no_more_bits_than_sets(size):
    rng = np.random.default_rng(size)
    one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    two = np.unique(np.concatenate([one[size // 9 :], rng.integers(0, 1 << 63, 9, dtype=np.uint64)]))
    for level in jaccard._levels(size, Fraction(8, 10), jaccard.SKETCH * 64):
        differ = int(np.bitwise_count(jaccard._parities(one, level).view(np.uint64) ^ jaccard._parities(two, level).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(one, two)) and (level == 0 or jaccard.SKETCH * 64 << level > size)
