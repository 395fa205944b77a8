"""Queries on tables as they lie on a cluster: folders of part files, many rows a task."""

from pathlib import Path

from pyspark.sql import functions as F

from __spark_entry__ import queries
from sievenet import normalize_captures, read_saved_scans
from sievenet.operators.crawl import build_edges
from sievenet.operators.links import with_resolved_links

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(spark, path, rows, parts):
    spark.createDataFrame(rows, DOCUMENTS).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stream_reads_folders_of_parts(spark, tmp_path):
    rows = [(i, None if i == 3 else f"mail a{i}@example.org\nthe year {1990 + i}", "en", "web", 0) for i in range(6)]
    sf = _documents(spark, tmp_path, rows, 3)
    found = queries()["scan_stream"](spark, sf)
    assert {r["matched_value"] for r in found.where("pattern_name = 'email'").collect()} == {f"a{i}@example.org" for i in range(6) if i != 3}
    assert found.where("resource_url LIKE '%/0.txt' AND line = 2").count() == 2


def test_stream_without_rows_has_columns(spark, tmp_path):
    found = queries()["scan_stream"](spark, _documents(spark, tmp_path, [], 1))
    assert found.count() == 0 and "matched_value" in found.columns


def test_encoded_bodies_reach_python_in_short_batches(spark):
    import gzip

    raw = spark.createDataFrame([("u", "gzip", bytearray(gzip.compress(b"x" * 5000))), ("v", "deflate", bytearray(b"no"))], "url string, content_encoding string, body binary")
    read = normalize_captures(raw, max_body=3000)
    assert [(r["url"], r["truncated"], bytes(r["body"])) for r in read.collect()] == [("u", True, b"x" * 3000)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_listing_of_many_files_is_a_few_parts(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 8).select(F.col("id").alias("dir"), F.concat(F.lit("body "), "id").alias("value"))
    rows.write.partitionBy("dir").text(f"{tmp_path}/saved")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(shared.glob("listing-*"))
    found = read_saved_scans(spark, f"{tmp_path}/saved", discover=True).where("scan_dir <> ''")
    assert found.select("scan_dir", F.expr("CAST(body AS STRING)")).distinct().count() == 2000
    (listing,) = set(shared.glob("listing-*")) - known
    assert len(list(listing.glob("*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.col("id").alias("dir"), F.concat(F.lit("body "), "id").alias("value"))
    rows.write.partitionBy("dir").text(f"{tmp_path}/saved")
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(conf), spark.sparkContext
    context.setJobGroup("listing", "")
    found = read_saved_scans(spark, f"{tmp_path}/saved", discover=True).where("scan_dir <> ''")
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(job).stageIds]
    listed = [s.numTasks for s in stages if s and s.name.startswith("load at")]
    assert listed and max(listed) <= 4 * context.defaultParallelism
    assert spark.conf.get(conf) == before
    assert {r[0] for r in found.select(F.expr("CAST(body AS STRING)")).collect()} == {f"body {k}\n" for k in range(400)}


def test_links_of_a_page_are_found_once(spark):
    rows = [("https://a.test/1", '<a href="/2">2</a><a href="x.js">x</a>'), ("https://a.test/2", "nothing"), ("https://a.test/3", None)]
    pages = normalize_captures(spark.createDataFrame([(url, "text/html", body and body.encode()) for url, body in rows], "url string, content_type string, body binary"))
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("sourceMappingURL")
    edges = build_edges(pages)
    assert plan(edges) == plan(with_resolved_links(pages)) > 0
    found = edges.orderBy("page", "link_ord").select("page", "link_ord", "link_url").collect()
    assert [tuple(r) for r in found] == [("https://a.test/1", 0, "https://a.test/2"), ("https://a.test/1", 1, "https://a.test/x.js")]
