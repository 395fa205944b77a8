"""Operators on documents against straightforward versions: edge cases, skew, empty tables, clashing columns."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievenet.llm import decontaminate, jaccard, language, licences, lines, mixing, substrings

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark bigint, copies string, row string, spans int, lang_pred string, score string, copy string, gone int"
RNG = random.Random(5)
VOCABULARY = [a + b + c for a in "bcdfg" for b in "aeiouäß" for c in ("n", "rt", "x", "")]


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(VOCABULARY).title() if rng.random() < 0.1 else rng.choice(VOCABULARY) for _ in range(n))


def edited(text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[RNG.randrange(len(words))] = prose(1)
    return " ".join(words)


BASE, PASSAGE, BLOCK = prose(200), prose(40), "\n".join(prose(6) for _ in range(12))
BENCHMARK = [(1, prose(30)), (2, "Rare Short item"), (3, PASSAGE), (3, PASSAGE), (None, prose(15)), (10, None), (11, ""), (12, "!!! ...")]
TEXTS = [
    None, "", "   \n\t ", "...", "x", "Two words", BASE, BASE, BASE.upper(), *[edited(BASE, k) for k in (1, 1, 2, 3, 5, 9, 20)],
    *[prose(60) + " " + PASSAGE + "\u2028 " + prose(60) for _ in range(4)], PASSAGE, "a " * 400, "a " * 399 + "b",
    BENCHMARK[0][1], prose(500) + " " + BENCHMARK[0][1], "the RARE, short-Item here", prose(30_000), BLOCK, prose(5) + "\n" + BLOCK + "\n" + prose(5),
    "\n".join([BLOCK, BLOCK]), "\n" * 50, "same line\n" * 30, *[prose(RNG.randrange(3, 80)) for _ in range(30)],
]
DOCS = [(3 + (i * 7) % 101, t) for i, t in enumerate(TEXTS)]
DOCS += [DOCS[6], DOCS[20], (None, BASE), (None, None)]  # repeated rows, and rows without an id


@pytest.fixture(scope="module")
def docs(spark):
    langs, sources = ["en", "de", None], ["s1", "s2", None, "s1", "S"]
    rows = [(d, t, langs[k % 3], sources[k % 5], None if t is None else len(t), 5, "c", "r", 1, "lp", "sc", "cp", 2) for k, (d, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id bigint, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, expected):
    got = Counter(tuple(r) for r in frame.collect())
    assert got == Counter(map(tuple, expected))


def test_decontamination(docs, benchmark, empty):
    expected = brute.decontaminate(DOCS, BENCHMARK)
    same(decontaminate.report(docs, benchmark), expected)
    assert sum(r[2] > 0 for r in expected) >= 7
    blocks = decontaminate.find_contamination(docs, benchmark, block_bytes=100).select("doc_id", "n_words", decontaminate.n_hit(), F.size("items"))
    same(blocks, [r[:4] for r in expected])
    assert decontaminate.report(empty, benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_decontamination_judges_rows(spark, benchmark):
    """Rows without an id and rows that share one are judged by their own text, in one pass or many."""
    rows = [(None, PASSAGE), (None, "clean words"), (1, PASSAGE), (1, "more clean words"), (1, PASSAGE), (2, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(decontaminate.decontaminate(frame, benchmark), [r for r in rows if r[1] != PASSAGE])
    many = decontaminate.find_contamination(frame, benchmark, block_bytes=50)
    same(many.select("doc_id", "n_words", decontaminate.n_hit(), F.size("items")), [r[:4] for r in brute.decontaminate(rows, BENCHMARK)])


def test_large_benchmark_index(spark):
    """An index takes about five times its text, and windows that items repeat are kept once."""
    import pickle

    items = [(k, " ".join(f"w{RNG.randrange(20_000)}" for _ in range(2_000)).encode()) for k in range(150)] + [(900, b"so it goes " * 20_000)]
    made = decontaminate.TestGrams(items, 13)
    assert len(pickle.dumps(made)) < 6 * sum(len(t) for _, t in items)
    hit, found = made.scan(b"x so it goes so it goes so it goes so it goes so it y".split())
    assert found == {"900"} and hit.tolist() == [False, *[True] * 14, False]
    assert len(made.windows[13][0]) == sum(2_000 - 12 for _ in range(150)) + 3


def test_decontamination_removes(docs, benchmark):
    verdicts = brute.decontaminate(DOCS, BENCHMARK)
    assert any(r[5] for r in verdicts)
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    same(kept.select("doc_id", "text"), [r for r, v in zip(DOCS, verdicts, strict=True) if not v[5]])
    cut = decontaminate.decontaminate(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), benchmark, remove="spans")
    text = cut.where(F.col("text").contains("Item here") | F.col("text").contains(" here")).select("text").first()[0]
    assert text == "the  here"


@pytest.mark.parametrize(("words", "numerator"), [(3, 90), (5, 80)])
def test_jaccard(docs, empty, words, numerator):
    expected = brute.jaccard(DOCS, words, numerator)
    same(jaccard.jaccard_components(docs, words, numerator), expected)
    assert sum(r[0] != r[2] for r in expected) >= 5
    kept = jaccard.one_per_group(docs, words, numerator)
    same(kept.select("doc_id"), [(d,) for d, _, c in expected if d is None or d == c])
    assert kept.columns == docs.columns
    if words == 3:
        assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_large_group(spark):
    rows = [(i, edited(BASE, RNG.randrange(0, 14))) for i in range(150)] + [(200 + i, prose(RNG.choice([12, 200]))) for i in range(40)]
    rows += [(300 + i, " ".join(sorted(set(prose(3000).split()), key=lambda w: RNG.random())) + " " + PASSAGE) for i in range(3)]
    same(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")), brute.jaccard(rows))


def test_signatures_meet():
    made = jaccard.Signatures(9, 10)
    rng = np.random.default_rng(3)
    for size in (10, 25, 60, 200, 3000):
        for _ in range(20):
            one = rng.integers(0, 1 << 63, size).astype(np.uint64)
            gone = int(rng.integers(0, size * 5 // 100 + 1))
            two = np.concatenate([one[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)])
            if 10 * (size - gone) >= 9 * (size + gone) and gone:
                assert set(made.of(np.unique(one))) & set(made.of(np.unique(two)))
                bits = sum(int(a ^ b).bit_count() for a, b in zip(jaccard._parities(one).view(np.uint64).tolist(), jaccard._parities(two).view(np.uint64).tolist(), strict=True))
                assert bits <= 2 * gone


def test_substrings(docs, empty, monkeypatch):
    expected = brute.substrings(DOCS)
    same(substrings.report(docs), expected)
    assert sum(r[2] > 0 for r in expected) >= 8
    same(substrings.report(docs, 3), brute.substrings(DOCS, 3))
    monkeypatch.setattr(substrings, "SHARD", 0)  # every anchor counts as crowded
    same(substrings.report(docs), expected)
    assert substrings.report(empty).count() == 0


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(30):
        rows = [([rng.randrange(3) for _ in range(rng.randrange(1, 15))], label) for label in range(5)]
        made = substrings.SuffixAutomaton()
        for row, label in rows:
            made.add(row, label)
        made.finish()
        asked = [rng.randrange(4) for _ in range(12)]
        holds = lambda w: min((label for row, label in rows if any(row[i : i + 4] == w for i in range(len(row) - 3))), default=substrings.NEVER)
        assert made.lows(asked, 4) == [holds(asked[i : i + 4]) for i in range(9)]


def test_lines(docs, empty):
    expected = brute.lines(DOCS)
    same(lines.report(docs), expected)
    assert sum(r[2] > 0 for r in expected) >= 3
    new = lines.dedup_lines(docs)
    assert new.columns == docs.columns and new.count() == docs.count()
    same(new.where("text is not null").select("doc_id", F.sha2("text", 256)), [(r[0], r[3]) for r in expected if r[3]])
    assert new.where("n_chars != length(text)").count() == 0
    assert lines.report(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.report(docs).collect()
    sources = defaultdict(int)
    for r in docs.collect():
        sources[r.source] += len(brute.SPACED.findall(r.text or ""))
    goal = brute.targets(sources)
    same(mixing.report(docs).select("doc_id", "size"), [(d, len(brute.SPACED.findall(t or ""))) for d, t in DOCS])
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sources[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    longest = max(len(brute.SPACED.findall(t or "")) for _, t in DOCS)
    for s in sources:
        assert abs(taken[s] - goal[s]) <= max(20, longest / 2 if sources[s] > longest else 0)
    assert rows and Counter(map(tuple, rows)) == Counter(map(tuple, mixing.report(docs.repartition(5)).collect()))
    assert mixing.report(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == [*[c for c in docs.columns if c != "copy"], "copy"]
    assert out.count() == sum(r.copies for r in rows)


def test_tilts_meet_goals(spark):
    sizes = spark.createDataFrame([("a", 100, 1.0), ("a", 300, 0.2), ("b", 50, 3.0), ("b", 500, 0.01), ("c", 10, 1.0)], "source string, size bigint, prior double")
    goals = spark.createDataFrame([("a", 700.0), ("b", 105.0), ("c", 0.0)], "source string, target double")
    for s, tilt, none in mixing.tilts(sizes, goals).collect():
        made = sum(r.size * min(2.0, r.prior * np.exp(tilt)) for r in sizes.collect() if r.source == s)
        assert none == (s == "c") and (none or abs(made - {"a": 700, "b": 105}[s]) < 1e-4)


def test_language(spark, docs, empty):
    words = {"en": "the of and to house water", "de": "der die und haus wasser nicht", "el": "και το νερό σπίτι δεν"}
    rows = [(i, " ".join(RNG.choices(words[x].split(), k=RNG.randrange(4, 60))), x) for i in range(400) for x in [RNG.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "de"), (1003, "das Wasser und nicht das Haus" * 3000, None), (1004, "νερό", None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.report(made).collect()}
    tested = [got[i].lang_pred == x for i, _, x in rows if i < 1000 and got[i].held_out]
    assert len(tested) > 80 and np.mean(tested) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert (got[1003].lang_pred, got[1004].lang_pred) == ("de", "el")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.report(empty).count() == 0
    assert {r.lang_pred for r in language.report(made.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id", "text", "lang_pred"), [(d, t, "lp") for d, t in DOCS if t and any(c.isalpha() for c in t)])


def test_licences(spark, docs, empty):
    notes = {
        "Apache": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 2.",
        "CC": "Licensed under CC BY-NC 4.0.", "BSD": "Released under the BSD 3-Clause License.", "MPL": "Licensed under the Mozilla Public License, version 2.0.",
    }
    rows = [(i, prose(30) + "\n" + note + "\n\n" + prose(20), name) for i, (name, note) in enumerate(notes.items())]
    rows += [(20, "\n".join(notes.values()), ",".join(sorted(notes))), (21, None, ""), (22, "", ""), (23, "The licensed electrician came.\nShe has a driving license.\nAsk for permission first.", "")]
    rows += [(24, prose(40), ""), rows[0]]
    got = licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"))
    same(got.select("doc_id", "families"), [(r[0], r[2]) for r in rows])
    assert {r.n_licences for r in got.where("doc_id < 6").collect()} == {1}
    assert licences.scan(empty).count() == 0
    assert licences.scan(docs).where("n_licences > 0").count() == 0
