"""Line dedup against a brute force over all repeated runs of lines."""

import hashlib
import random
from collections import Counter

from sievenet.llm import lines


def brute_runs(docs):
    """Every run of two lines or more goes, but for the first place it has."""
    spots = {}
    for d, text in dict.fromkeys(docs):
        own = [] if d is None or text is None else text.split("\n")
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                spots.setdefault(tuple(own[i:j]), []).append((d, i, text))
    gone = {}
    for run, own in spots.items():
        for d, i, text in sorted(set(own))[1:]:
            gone.setdefault((d, text), set()).update(range(i, i + len(run)))
    out = []
    for d, text in docs:
        if text is None:
            out.append((d, 0, 0, None))
            continue
        cut = gone.get((d, text), ())
        kept = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in cut)
        out.append((d, text.count("\n") + 1, len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_every_repeated_run_goes(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"own {rng.random()}" for _ in range(n)]
    passages = [fresh(k) for k in (2, 2, 3, 3, 4, 5, 6, 8, 10) for _ in range(4)]
    docs = [(1000 + 10 * k + at, "\n".join(fresh(3) + p + fresh(2))) for k, p in enumerate(passages) for at in range(2)]
    docs += [(i, "\n".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    docs += [(100, "\n" * 20), (101, "same\n" * 15), (102, ""), (103, None), (None, "a\nb\nc"), docs[0], docs[0], (104, docs[0][1])]
    got = lines.report(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), lines.without_runs)
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(brute_runs(docs))
    removed = {r[0]: r[2] for r in rows}
    assert all(removed[1000 + 10 * k + 1] == len(p) for k, p in enumerate(passages))
    new = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), lines.without_runs)
    assert {hashlib.sha256(r.text.encode()).hexdigest() for r in new.collect() if r.text is not None} == {r[3] for r in rows if r[3]}


def test_query_and_stage_remove_runs(spark, tmp_path):
    import corpus_pipeline

    from sievenet.llm import queries

    docs = [(k, f"first {k}\nshared one\nshared two\nlast {k}") for k in range(1, 30)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.n_removed for r in queries.op10_line_dedup(spark, str(tmp_path)).where("doc_id > 1").collect()} == {2}
    stage = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert stage.where("text like '%shared%'").count() == 1


def test_chunks_go_first_and_pairs_after(spark):
    """Long shared passages hold whole chunks that repeat; short ones are found by their pairs alone; every spacing gives the same lines."""
    rng = random.Random(11)
    fresh = lambda n: [f"own {rng.random()}" for _ in range(n)]
    long, short = fresh(40), fresh(2)
    docs = [(i, "\n".join(fresh(2) + (long if i % 2 else short) + fresh(3) + (long[7:19] if i % 3 else []))) for i in range(12)]
    docs += [(50, "\n".join(["same"] * 300)), (51, "\n".join(["", "x"] * 40)), (52, "\n\n\n"), (53, "\r\n\r\n")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    expected = Counter(brute_runs(docs[:12]))
    for spacing in (1, 4, 1 << 40):
        few = spark.createDataFrame(docs[:12], "doc_id bigint, text string")
        cut = lambda d: lines.without(d, lines.repeated_runs(d, spacing))  # noqa: E731, B023
        assert Counter(map(tuple, lines.report(few, cut).collect())) == expected
    chunks = lines._linked_chunks(frame, 4)
    assert chunks.where("doc_id < 12").groupBy("a", "b", "size").count().where("size > 2 and count > 5").count() > 2
    assert chunks.where("size < 2").count() == 0
    removed = {r.doc_id: r.n_removed for r in lines.report(frame, lines.without_runs).collect()}
    assert removed[50] == 299 and removed[51] == 78


def test_equal_hashes_of_other_bytes_stay(spark, monkeypatch):
    """With a hash that can't tell lines of one length apart, only runs whose every occurrence is equal go."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "_hashes", lambda line: (F.length(line).cast("long"), F.length(line).cast("long")))
    docs = [(1, "aa\nbbb\nc"), (2, "xx\nyyy\nz"), (3, "equal one\nequal lines"), (4, "equal one\nequal lines")]
    rows = {r.doc_id: r.n_removed for r in lines.report(spark.createDataFrame(docs, "doc_id bigint, text string"), lines.without_runs).collect()}
    assert rows == {1: 0, 2: 0, 3: 0, 4: 2}


def test_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lines int, own int, a string, n_chars int")
    assert lines.dedup_lines(none, lines.without_runs).columns == none.columns and lines.dedup_lines(none, lines.without_runs).count() == 0
    clash = spark.createDataFrame([(1, "a\nb", 5, 6, "x", 3), (2, "a\nb\nc", None, 7, None, 5), (None, "a\nb", 1, 1, "y", 3)], none.schema)
    got = {(r.doc_id, r.text, r.lines, r.own, r.a, r.n_chars) for r in lines.dedup_lines(clash, lines.without_runs).collect()}
    assert got == {(1, "a\nb", 5, 6, "x", 3), (2, "c", None, 7, None, 1), (None, "a\nb", 1, 1, "y", 3)}
