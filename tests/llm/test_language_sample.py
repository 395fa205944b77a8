"""The training sample keeps every language."""

import numpy as np

from sievenet.llm import language


def test_every_language_has_texts(spark):
    long = [(f"{k} " + "ord hus vatten " * 400, "sv") for k in range(3)]  # far over the limit of characters
    copies = [("the same words again", "en")] * 3000 + [(f"text number {k} of english", "en") for k in range(60)]
    frame = spark.createDataFrame(long + copies, "text string, lang string")
    for chars in (1, 500, 20_000):
        got = language.sample(frame, per_language=60, chars=chars).collect()
        own = {x: [r.text for r in got if r.lang == x] for x in ("sv", "en")}
        assert len(own["en"]) >= min(language.LEAST, 50) if chars > 500 else own["en"]
        assert own["sv"] and all(any(t.startswith(r) for t, _ in long + copies) for r in own["sv"] + own["en"])
        if chars == 20_000:
            assert len(own["sv"]) == 3


def test_sample_is_bounded_for_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "TOTAL_TEXTS", 900)
    monkeypatch.setattr(language, "TOTAL_CHARS", 30_000)
    rows = [(f"text {k} of label {x} " + "word " * 200, f"l{x}") for x in range(300) for k in range(8)]
    got = language.sample(spark.createDataFrame(rows, "text string, lang string")).collect()
    assert len({r.lang for r in got}) == 300 and len(got) <= 2 * 900 and sum(len(r.text) for r in got) <= 3 * 30_000


def test_model_is_kernel_ridge_regression():
    """Scores equal those of a plain dense version: kernel matrices, whitened landmarks, weighted ridge regression."""
    rng = np.random.default_rng(3)
    words = {"a": "one two three four five".split(), "b": "eins zwei drei vier fuenf".split(), "c": "uno due tre quattro cinque".split()}
    rows = sorted((x, " ".join(rng.choice(own, 12))) for x, own in words.items() for _ in range(15))
    made = language.Model(rows, 9, 0.1)
    grams_of = lambda text: {text[i : i + n] for n in language.ORDERS for i in range(len(text) - n + 1)}
    kernel = lambda a, b: len(grams_of(a) & grams_of(b)) / np.sqrt(len(grams_of(a)) * len(grams_of(b)))
    texts = [t for _, t in rows]
    marks = [t for x in words for t in [t for y, t in rows if y == x][::5][:3]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    white = (vectors / np.sqrt(values))[:, values > 1e-8 * values.max()]
    features = np.array([[kernel(a, b) for b in marks] for a in texts]) @ white
    goal = np.array([[float(x == y) for y in sorted(words)] for x, _ in rows])
    centred = features - features.mean(0)
    solved = np.linalg.solve(centred.T @ centred + 0.1 * np.eye(white.shape[1]), centred.T @ (goal - goal.mean(0)))
    asked = ["two drei uno", "eins zwei", "quattro", *texts[:5], "xyz"]
    dense = (np.array([[kernel(a, b) for b in marks] for a in asked]) @ white - features.mean(0)) @ solved + goal.mean(0)
    assert np.allclose(made.scores(asked), dense, atol=1e-8)
    language.PRODUCT, held = 64, language.PRODUCT
    assert np.allclose(made.scores(asked), dense, atol=1e-8)  # many small products
    language.PRODUCT = held


def test_stage_without_labels_keeps_documents(spark, monkeypatch):
    rows = [(1, "words of some text", None), (2, "12 34", None), (3, None, None), (4, "другие слова", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in language.keep_known(frame).collect()} == {1, 4}
    taught = []
    real = language.train
    monkeypatch.setattr(language, "train", lambda docs, **limits: taught.append(docs.count()) or real(docs, **limits))
    language.keep_known(frame.withColumn("lang", language.F.lit("en"))).count()
    assert taught == [4]
