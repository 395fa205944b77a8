"""Line dedup: runs of lines that repeat anywhere, or content-defined chunks of them, removed.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievenet.llm.tables import BROADCAST_BYTES, saved, sized_join

SPACING = 4  # lines of a chunk on average: a boundary follows a line where the rolling hash is a multiple of it
LEAST = 2  # lines of a chunk that may be removed

SAME = ["a", "b", "size"]  # what equal chunks share
KEY = ["doc_id", "mark"]  # mark: hash of the text, so that rows which share a doc_id stay apart


def _lined(docs: DataFrame) -> DataFrame:
    """doc_id, mark, lines and the hash of each line."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n", -1).alias("lines"))
    return rows.withColumn("hashes", F.transform("lines", lambda line: F.xxhash64(line)))


def _chunks(docs: DataFrame, spacing: int) -> DataFrame:
    """doc_id, mark, start, size and two hashes of each chunk.

    The rolling hash covers a line and the one before it; the last line of a text always ends a chunk.
    So a chunk's bounds depend on its own lines and the line before it.
    """
    rolling = lambda i: F.xxhash64(F.coalesce(F.get("hashes", i - 1), F.lit(0).cast("long")), F.get("hashes", i))
    last = F.size("hashes") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(rolling(i), F.lit(spacing)) == 0))
    cut = _lined(docs).select(*KEY, "hashes", ends.alias("ends"))
    start = lambda k: F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))
    spans = F.transform("ends", lambda end, k: F.struct(start(k).alias("start"), (end - start(k) + 1).alias("size")))
    chunk = cut.select(*KEY, "hashes", F.explode(spans).alias("c")).select(*KEY, "c.*", F.slice("hashes", F.col("c.start") + 1, F.col("c.size")).alias("own"))
    return chunk.select(*KEY, "start", "size", F.xxhash64("own").alias("h1"), F.xxhash64(F.lit(1), "own").alias("h2"))


def _attached(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """Rows (doc_id, text, ...) with mark, joined to a stored table of lists by row; lists are broadcast where their counted size allows it."""
    weight = lists.agg(F.sum(F.size(column) * 40 + 64)).first()[0] or 0
    return docs.withColumn("mark", F.xxhash64("text")).join(F.broadcast(lists) if weight <= BROADCAST_BYTES else lists, KEY, how)


def _text(start: str | Column, size: str | Column) -> Column:
    return F.array_join(F.slice("lines", F.col(start) + 1, F.col(size)), "\n")


def removable(docs: DataFrame, spacing: int = SPACING, least: int = LEAST) -> DataFrame:
    """Chunks to remove: doc_id, mark and gone, an array of (start, size).

    Of chunks of at least `least` lines with equal hashes the first, by doc_id and line, stays.  Those
    with the same bytes as the first go.
    """
    chunks = saved(_chunks(docs.where("doc_id is not null"), spacing).where(F.col("size") >= least), "chunks")
    same = ["h1", "h2", "size"]
    firsts = chunks.groupBy(*same).agg(F.min(F.struct("doc_id", "start", "mark")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = chunks.join(firsts.select(*same, "first"), same)
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("mark") == F.col("first.mark"))
    lists = saved(repeated.groupBy(*KEY).agg(F.collect_set(F.struct("start", *same, is_first.alias("first"))).alias("spans")), "repeated")
    rows = _attached(docs.where("doc_id is not null").select("doc_id", "text"), lists, "spans", "inner").select(*KEY, F.split("text", "\n", -1).alias("lines"), "spans")
    texts = saved(rows.select(*KEY, "lines", F.explode("spans").alias("s")).select(*KEY, "s.*", F.array_join(F.slice("lines", F.col("s.start") + 1, F.col("s.size")), "\n").alias("chunk")), "texts")
    models = texts.where("first").select(*same, F.col("chunk").alias("model")).dropDuplicates(same)
    equal = texts.where("not first").join(models, same).where("chunk = model")
    return equal.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("gone"))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _linked_chunks(docs: DataFrame, spacing: int) -> DataFrame:
    """doc_id, mark, start, size, two hashes (a, b) and the lines' hashes (own, more) of each chunk.

    A chunk ends with a line where the rolling hash over its own hash and the one before is a multiple of spacing,
    and at the end of a text; that line also begins the next chunk.  So each pair of adjacent lines lies in exactly one
    chunk, and a chunk's bounds depend on its own lines alone.
    """
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n", -1).alias("lines"))
    n = F.size("lines")
    hashed = rows.where(n > 1).select(*KEY, F.transform("lines", lambda x: _hashes(x)[0]).alias("own"), F.transform("lines", lambda x: _hashes(x)[1]).alias("more"), n.alias("n"))
    bound = lambda i: F.pmod(F.xxhash64(F.get("own", i - 1), F.get("own", i)), F.lit(spacing)) == 0
    ends = F.filter(F.sequence(F.lit(1), F.col("n") - 1), lambda i: (i == F.col("n") - 1) | bound(i))
    start = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    spans = F.transform("ends", lambda end, k: F.struct(start(k).alias("start"), (end - start(k) + 1).alias("size")))
    each = hashed.withColumn("ends", ends).select(*KEY, "own", "more", F.explode(spans).alias("c"))
    part = [F.slice(c, F.col("c.start") + 1, F.col("c.size")).alias(c) for c in ("own", "more")]
    return each.select(*KEY, "c.*", *part).select(*KEY, "start", "size", F.xxhash64("own").alias("a"), F.xxhash64("more").alias("b"), "own", "more")


def _repeats(spots: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, mark, start, size, a, b and later of all spots of keys that occur again; firsts: a, b, size, first and n, stored."""
    again = firsts.where("n > 1").select("a", "b", "size", F.struct("first.doc_id", "first.start", "first.mark").alias("first"))
    found = sized_join(spots.select(*KEY, "start", *SAME), again, SAME, "inner", 128)
    return found.select(*KEY, "start", *SAME, (F.struct("doc_id", "start", "mark") != F.col("first")).alias("later"))


def _unequal(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Keys (a, b, size) of stored spans whose lines aren't the same bytes everywhere: the least and the largest text of a key differ."""
    lists = saved(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", *SAME)).alias("spans")), "lists")
    rows = _attached(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), lists, "spans", "inner")
    each = rows.select(F.split("text", "\n", -1).alias("lines"), "spans").select("lines", F.explode("spans").alias("s"))
    texts = each.select("s.a", "s.b", "s.size", _text("s.start", "s.size").alias("chunk"))
    return texts.groupBy(*SAME).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low != high").select(*SAME)


def repeated_runs(docs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """Lines to remove: doc_id, mark and gone, an array of (start, size).

    A line goes if it lies in a run of two lines or more that begins earlier, by doc_id and line, as well.
    Content-defined chunks that came before go whole.  Each distinct chunk's first copy is then cut into its pairs of
    adjacent lines, and pairs that came before go: a run in other surroundings, whose outer lines lie in chunks of their
    own, is a chain of such pairs.  Pairs of later copies needn't be looked at, as the first copy has them earlier.
    Chunks and pairs are found by 128-bit hashes and compared byte by byte; those of a hash with different texts stay.
    A line that goes has an equal one before it: one of each stays.
    """
    spot = ["doc_id", "start", "mark"]
    chunks = saved(_linked_chunks(docs, spacing), "chunks")
    firsts = saved(chunks.groupBy(*SAME).agg(F.min(F.struct(*spot, "own", "more")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    two = lambda c: lambda i: F.xxhash64(F.get(c, i), F.get(c, i + 1))
    each = firsts.select("first.*", F.explode(F.sequence(F.lit(0), F.col("size") - 2)).alias("i"))
    pairs = saved(each.select(*KEY, (F.col("start") + F.col("i")).alias("start"), F.lit(2).alias("size"), two("own")(F.col("i")).alias("a"), two("more")(F.col("i")).alias("b")), "pairs")
    pair_firsts = saved(pairs.groupBy(*SAME).agg(F.min(F.struct(*spot)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pair_firsts")
    spans = saved(_repeats(chunks, firsts).unionByName(_repeats(pairs, pair_firsts)), "spans")
    later = sized_join(spans.where("later"), saved(_unequal(docs, spans), "unequal"), SAME, "left_anti")
    index = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda s: F.sequence(s.start, s.start + s.size - 1))))
    return later.groupBy(*KEY).agg(F.transform(index, lambda i: F.struct(i.alias("start"), F.lit(1).alias("size"))).alias("gone"))


def without_repeats(docs: DataFrame, spacing: int = SPACING, least: int = LEAST) -> DataFrame:
    """As without, for chunks: passages between other lines lose only the chunks whose bounds agree."""
    return without(docs, removable(docs, spacing, least))


def without_runs(docs: DataFrame) -> DataFrame:
    """As without, for all repeated runs of two lines or more."""
    return without(docs, repeated_runs(docs))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs), n_lines, n_removed and kept_text; gone: doc_id, mark and lists of (start, size).

    A text's lines are what newlines part: an empty text is one empty line, a null text has none and its
    kept_text is null.  Rows without a doc_id keep all lines and take none from others.  Rows with the
    same doc_id and text count as one, so both keep what one keeps.
    """
    gone = saved(gone, "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    rows = _attached(packed, gone, "gone", "left").withColumn("lines", F.split("text", "\n", -1))
    index = F.flatten(F.transform("gone", lambda g: F.sequence(g.start, g.start + g.size - 1)))
    rows = rows.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), index))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(index)).cast("long")
    return rows.select("row", n.alias("n_lines"), removed.alias("n_removed"), kept.alias("kept_text"))


def report(docs: DataFrame, cut: Callable[[DataFrame], DataFrame] = without_repeats) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (null for a null text) of each row of docs."""
    return cut(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, cut: Callable[[DataFrame], DataFrame] = without_repeats) -> DataFrame:
    """docs with text replaced by its kept lines, and n_chars by the new length where lines went.  Other columns stay."""
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut(docs).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
