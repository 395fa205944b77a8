"""Licence notices without a cue word, and the prefilter against the agreement of every template."""

import math
import random
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sievenet.llm import licences

NOTICES = [
    (1, "Content is available under CC BY-SA 4.0.", "CC"), (2, "Available under the GPL version 2 or later.", "GPL"), (3, "This program is free software: you can", "GPL"),
    (4, 'of this software and associated documentation files (the "Software"), to deal', "MIT"), (5, "The poets of this valley came to the house by the river and stayed.", ""), (6, "Licensed under CC BY 4.0.", "CC"),
]


def agreement(paragraph, template):
    own, model = (set(re.findall("[a-z]+", x.lower())) for x in (paragraph, template))
    both = len(own & model)
    return max(both / len(model), both / len(own) if len(own) >= 4 else 0)


def test_notices_without_cue(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(12))
    rows = [(i, "\n".join([prose(), note, prose()])) for i, note, _ in NOTICES]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i].families for i in (1, 2, 5, 6)} == {1: "CC", 2: "GPL", 5: "", 6: "CC"}
    assert [got[i].n_licences for i in (1, 2, 5, 6)] == [1, 1, 0, 1]
    assert all(got[i].families in ("", family) for i, _, family in NOTICES)  # fragments of a notice may stay unknown, never wrong
    scored = spark.createDataFrame(NOTICES, "id int, paragraph string, family string").where(licences.may_agree(F.col("paragraph")))
    assert {r.id for r in scored.collect()} == {1, 2, 3, 4, 6}


def test_prefilter_is_exact(spark):
    rng = random.Random(8)
    every = [t for family, texts in licences.TEMPLATES.items() if family != licences.UNKNOWN for t in texts]
    pool = sorted({w for t in every for w in re.findall("[A-Za-z]+", t)})
    made = [" ".join(rng.sample(re.findall("[A-Za-z0-9]+", t), k=max(1, int(len(re.findall("[A-Za-z0-9]+", t)) * rng.uniform(0.3, 1)))) + ["zzz%d" % k for k in range(rng.randrange(8))]) for t in every for _ in range(25)]
    made += [" ".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(400)] + [n[1] for n in NOTICES] + ["", "12 3", "the of to"]
    rows = spark.createDataFrame([(p,) for p in made], "paragraph string").select("paragraph", licences.may_agree(F.col("paragraph")).alias("may")).collect()
    wrong = [r for r in rows if r.may != any(agreement(r.paragraph, t) >= licences.AGREE for t in every)]
    assert not wrong
    assert 100 < sum(r.may for r in rows) < len(rows) - 100


def plain_scan(text, weights, by):
    """n_paragraphs, n_licences, families and score of a text: softmax over gram weights, the limit, and a template of the family that agrees."""
    found = []
    paragraphs = [p for p in (text or "").split("\n") if p.strip(" ")]
    for p in paragraphs:
        own = re.findall("[a-z]+|[0-9]+", p.lower())
        grams = set(own) | {" ".join(own[i : i + 2]) for i in range(len(own) - 1)}
        logits = [b + sum(weights[g][k] for g in grams if g in weights) for k, b in enumerate(by.bias)]
        powers = [math.exp(x - max(logits)) for x in logits]
        known = {name: x for name, x in zip(by.names, powers, strict=True) if name != licences.UNKNOWN}
        family, share = max(known, key=known.get), sum(known.values()) / sum(powers)
        if share >= by.limit and any(agreement(p, t) >= licences.AGREE for t in licences.TEMPLATES[family]):
            found.append((family, share))
    return len(paragraphs), len(found), ",".join(sorted({f for f, _ in found})), max((s for _, s in found), default=0.0)


def test_scan_against_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    every = [t for family, texts in licences.TEMPLATES.items() for t in texts]
    prose = lambda: " ".join("".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(9))
    rows = [(i, "\n".join(rng.choice([prose(), rng.choice(every), "", " ", " ".join(rng.choice(every).split()[:8])]) for _ in range(6))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, every[0]), rows[0], rows[0], (0, every[1]), (102, "\n".join([every[2]] * 300))]
    made, train = [], licences.train
    monkeypatch.setattr(licences, "train", lambda *a: made.append(train(*a)) or made[-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = licences.scan(docs.withColumn("paragraph", F.lit("x")).withColumn("known", F.lit(1))).collect()
    by = made[0]
    weights = {r[0]: r[1:] for r in by.weights.collect()}
    expected = [(d, *plain_scan(text, weights, by)) for d, text in rows]
    rounded = lambda found: sorted(((*r[:4], round(r[4], 9)) for r in found), key=str)
    assert rounded(got) == rounded(expected)
    assert sum(r[2] > 0 for r in expected) > 20 and any(r[2] == 0 and r[1] > 3 for r in expected)


def test_every_paragraph_teaches(spark, monkeypatch):
    """Weights and limit are those of a fit by every distinct paragraph that no template agrees with, however many."""
    rng = random.Random(11)
    pool = sorted({w for family, texts in licences.TEMPLATES.items() for t in texts for w in re.findall("[A-Za-z]+", t)})
    prose = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3))
    made = [" ".join(rng.choices(pool, k=rng.randrange(9)) + [prose() for _ in range(rng.randrange(9))]) for _ in range(1500)]
    made += ["The licence of car %d was withdrawn." % k for k in range(60)] + [made[0].upper(), made[1] + "."] + made[:40] + ["12 - 4", "--", " "]
    docs = spark.createDataFrame([(i, "\n".join(made[i::500])) for i in range(500)] + [(900, None)], "doc_id bigint, text string")
    taught, train = [], licences.train
    monkeypatch.setattr(licences, "train", lambda *a: taught.append(train(*a)) or taught[-1])
    licences.scan(docs)
    by = taught[0]

    every = [t for family, texts in licences.TEMPLATES.items() if family != licences.UNKNOWN for t in texts]
    plain = {p for p in made if re.search("[a-z0-9]", p.lower()) and not any(agreement(p, t) >= licences.AGREE for t in every)}
    assert len(plain) > 1200 and sum("licence" in p for p in plain) == 60
    rows = [(licences.UNKNOWN, re.findall("[a-z]+|[0-9]+", p.lower()), 500 / len(plain)) for p in plain]
    for family, texts in licences.TEMPLATES.items():
        for own in (re.findall("[a-z]+|[0-9]+", t.lower()) for t in texts):
            for size in {len(own), max(3, math.ceil(len(own) * 0.8)), max(3, math.ceil(len(own) * 0.6))}:
                rows += [(family, own[at : at + size], 1.0) for at in range(max(0, len(own) - size) + 1)]
    weights = {r[0]: r[1:] for r in by.weights.collect()}
    order = {g: k for k, g in enumerate(sorted(weights))}
    held = lambda own: sorted({order[g] for g in [*own, *(" ".join(own[i : i + 2]) for i in range(len(own) - 1))] if g in order})
    table = [(float(by.names.index(f)), Vectors.sparse(len(order), held(own), [1.0] * len(held(own))), w, own) for f, own, w in rows]
    ready = spark.createDataFrame(table, ["label", "features", "weight", "words"]).withColumn("fold", F.expr("pmod(xxhash64(words, 3), 5)")).cache()
    alike = ready.where("weight < 1").groupBy("label", "features", "fold").agg(F.sum("weight").alias("weight")).unionByName(ready.where("weight = 1").drop("words"))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, weightCol="weight").fit(alike.where("fold != 0").coalesce(1))
    assert max(abs(a - b) for a, b in zip(model.interceptVector, by.bias, strict=True)) < 1e-3
    fitted = model.coefficientMatrix.toArray()
    assert max(abs(fitted[k, order[g]] - w) for g, own in weights.items() for k, w in enumerate(own)) < 1e-3
    unknown = by.names.index(licences.UNKNOWN)
    known = sorted(1 - r.probability[unknown] for r in model.transform(ready.where(f"fold = 0 AND label = {unknown}")).collect())
    at = 0.99 * (len(known) - 1)
    expected = known[int(at)] + (at % 1) * (known[min(int(at) + 1, len(known) - 1)] - known[int(at)])
    assert len(known) > 250 and abs(by.limit - min(0.9, max(0.5, expected))) < 1e-3
