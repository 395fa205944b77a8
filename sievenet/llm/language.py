"""Language ID by string kernels: presence of character n-grams, Nyström landmarks, kernel ridge regression.

The blended-spectrum presence kernel of two texts is the share of character 1- to 4-grams they
have in common.  Landmarks are some training texts; a text's kernel values with all
landmarks, whitened by the landmarks' own kernel, are its features, and one ridge regression per
language scores them.  As kernel values are products of presence vectors, a batch of texts is scored by
a sparse product of its n-grams with one table: n-gram weights per language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sievenet.llm.tables import saved, sized_join, small_enough
from sievenet.llm.words import U64, mix

ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 600  # training texts of a language, on average at most
CHARS_PER_LANGUAGE = 1_500_000  # and their characters
LEAST = 50  # distinct texts of a language that are taken in any case, while there are few languages
TOTAL_TEXTS = 24_000  # of all languages: what each may have falls beyond 40 languages (480 for LEAST)
TOTAL_CHARS = 24_000_000  # the same for characters, beyond 16 languages
LANDMARKS = 400
RIDGE = 0.1
UNKNOWN = "und"
PRODUCT = 1 << 20  # weights that a product reads at once
PIECE = 1 << 18  # characters whose n-grams are listed at once


def presence(text: str) -> np.ndarray:
    """Sorted hashes of the distinct 1- to 4-grams of a lower-cased text, white space runs being one space."""
    points = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    found = []
    for at in range(0, max(1, len(points)), PIECE):
        piece, own = points[at : at + PIECE + max(ORDERS) - 1], []
        for n in ORDERS:
            count = len(piece) - n + 1
            if count > 0:
                value = np.full(count, n, U64)
                for k in range(n):
                    value = (value << U64(21 if n < 4 else 15)) ^ piece[k : k + count]
                own.append(value)
        if own:
            found.append(np.unique(mix(np.concatenate(own))))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, U64)


class Model:
    """languages; vocabulary: sorted n-gram hashes of the landmarks; weights: of each per language; bias per language."""

    def __init__(self, rows: list[tuple[str, str]], landmarks: int, ridge: float):
        rows = sorted(rows)
        self.languages = sorted({language for language, _ in rows})
        self.vocabulary, self.weights, self.bias = np.zeros(0, U64), np.zeros((0, 0)), np.zeros(0)
        if not rows:
            return
        sets = [presence(text) for _, text in rows]
        norms = np.sqrt(np.maximum(1, [len(s) for s in sets]))
        by_language = {x: [i for i, (language, _) in enumerate(rows) if language == x] for x in self.languages}
        each = max(2, landmarks // max(1, len(self.languages)))
        chosen = [i for own in by_language.values() for i in own[:: max(1, len(own) // each)][:each]]
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
        # landmarks that hold each n-gram, as one list cut at firsts
        grams_of = np.concatenate([np.searchsorted(self.vocabulary, sets[i]) for i in chosen])
        holder = np.repeat(np.arange(len(chosen)), [len(sets[i]) for i in chosen])
        order = np.argsort(grams_of, kind="stable")
        grams_of, holder = grams_of[order], holder[order]
        firsts = np.searchsorted(grams_of, np.arange(len(self.vocabulary) + 1))
        kernel = np.zeros((len(rows), len(chosen)))
        scale = norms[chosen]
        for i, own in enumerate(sets):
            known = self._known(own)
            sizes = firsts[known + 1] - firsts[known]
            at = np.repeat(firsts[known] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            kernel[i] = np.bincount(holder[at], minlength=len(chosen)) / (norms[i] * scale)
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-8 * max(values.max(initial=0), 1e-12)
        white = vectors[:, good] / np.sqrt(values[good])
        features = kernel @ white
        goal = np.array([[1.0 if language == x else 0.0 for x in self.languages] for language, _ in rows])
        balance = np.array([len(rows) / (len(self.languages) * len(by_language[language])) for language, _ in rows])[:, None]
        middle = (balance * features).sum(0) / max(1e-12, balance.sum())
        centred = features - middle
        base = (balance * goal).sum(0) / max(1e-12, balance.sum())
        solved = np.linalg.solve(centred.T @ (balance * centred) + ridge * np.eye(white.shape[1]), centred.T @ (balance * (goal - base)))
        self.bias = base - middle @ solved
        self.weights = np.zeros((len(self.vocabulary), len(self.languages)))
        np.add.at(self.weights, grams_of, ((white @ solved) / scale[:, None])[holder])

    def _known(self, own: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == own]

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per language: the product of a sparse matrix, a row of scaled presences per text, and the weights."""
        out = np.tile(self.bias, (len(texts), 1))
        rows, scales, indices, held = [], [], [], 0

        def multiply() -> None:
            starts = np.cumsum([0, *map(len, indices)])[:-1]
            out[rows] += np.add.reduceat(self.weights[np.concatenate(indices)], starts, axis=0) * np.array(scales)[:, None]
            rows.clear(), scales.clear(), indices.clear()

        for i, text in enumerate(texts):
            own = presence(text)
            known = self._known(own)
            if not len(known):
                continue
            if held and (held + len(known)) * len(self.languages) > PRODUCT:
                multiply()
                held = 0
            rows.append(i), scales.append(1 / np.sqrt(len(own))), indices.append(known)
            held += len(known)
        if rows:
            multiply()
        return out


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> DataFrame:
    """lang and text of a sample of distinct labelled texts: by a hash, at a rate per language that meets both limits.

    The LEAST texts of a language that come first by hash are taken anyway, cut to an equal part of chars each.
    With many languages both limits and LEAST shrink (to one text at least), so that the sample stays within about twice
    TOTAL_TEXTS and TOTAL_CHARS.  Ties of a hash are broken by a second one.
    """
    draw, ident = F.pmod(F.xxhash64("text"), F.lit(1 << 30)), F.xxhash64("text")
    rows = docs.where("lang is not null and text is not null").where(_letter()).select("lang", "text", draw.alias("draw"), ident.alias("ident"))
    distinct = saved(rows.groupBy("lang", "draw", "ident").agg(F.max(F.length("text")).alias("size")), "distinct")
    sizes = saved(distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")), "sizes")
    languages = max(1, sizes.count())
    per_language, chars = max(1, min(per_language, TOTAL_TEXTS // languages)), max(1, min(chars, TOTAL_CHARS // languages))
    least = max(1, min(LEAST, TOTAL_TEXTS // languages))
    rate = F.least(F.lit(1.0), per_language / F.col("n"), chars / F.greatest("chars", F.lit(1)))
    sizes = saved(sizes.select("lang", rate.alias("rate")), "languages")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "ident"))
    first = distinct.withColumn("place", place).where(F.col("place") <= least).select("lang", "draw", "ident")
    drawn = sized_join(distinct, sizes, "lang", "inner", 128).where(F.col("draw") < F.col("rate") * (1 << 30)).select("lang", "draw", "ident", F.lit(True).alias("whole"))
    taken = saved(drawn.unionByName(first.withColumn("whole", F.lit(False))).groupBy("lang", "draw", "ident").agg(F.max("whole").alias("whole")), "taken")
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.left("text", F.lit(max(1, chars // least))))
    keys = ["lang", "draw", "ident"]
    return rows.join(F.broadcast(taken) if small_enough(taken, 128) else taken, keys).select("lang", text.alias("text")).distinct()


def _letter() -> Column:
    return F.col("text").rlike(r"\p{L}")


def train(docs: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE, **limits: int) -> Model:
    """A model of the labelled rows of docs, fitted on the driver to the bounded sample."""
    return Model([(r["lang"], r["text"]) for r in sample(docs, **limits).collect()], landmarks, ridge)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred and score (0 to 1); only text is used.

    A text that is null or without any letter is `und` with score 0; so is every text if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = pickle.loads(shared.value)
        for batch in batches:
            texts, letters = batch.column("text").to_pylist(), batch.column("letter").to_pylist()
            found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, letter in enumerate(letters) if letter and learned.languages]
            if some:
                values = learned.scores([texts[i] for i in some])
                for i, row in zip(some, values, strict=True):
                    best = int(row.argmax())
                    found[i], score[i] = learned.languages[best], min(1.0, max(0.0, float(row[best])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), F.coalesce(_letter(), F.lit(False)).alias("letter"))
    schema = StructType([given.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return given.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, learned from rows that are not held out."""
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is unknown: null texts and texts without a letter.  Columns stay.

    All labelled rows teach.  If nothing can be learned, texts with a letter stay.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(_letter())
    return predict(docs, model).where(F.col("lang_pred") != UNKNOWN).select("row.*")
