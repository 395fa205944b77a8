"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievenet.llm import alignment, collocations, decontaminate, jaccard, language, licences, lines, mixing, passages, substrings, urlgraph, vectors, warc
from sievenet.llm.tables import table


def op1_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"), lines.without_runs)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measures(table(spark, sf_dir, "documents"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_licence_scans,
    op2_mixing,
    op3_language_id,
    op4_benchmark_decontamination,
    op5_ngram_jaccard_join,
    op6_substring_dedup,
    op7_embedding_near_dedup,
    op8_warc,
    op9_url_filters,
    op10_line_dedup,
    op11_phrase_collocations,
    op12_tokenizer_alignment,
    op13_suffix_array_dedup,
)}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEST_WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
FOLDED = f"regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"
PLAIN = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": f"""
        WITH items AS (SELECT item_id, coalesce({TEST_WORDS}, []) AS w FROM benchmark),
        grams AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        docs AS (SELECT doc_id, coalesce({TEST_WORDS}, []) AS w FROM documents),
        spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN grams b ON s.n = b.n AND s.g = b.g),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id""",
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, coalesce({FOLDED}, []) AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT doc_id, b FROM reach JOIN ways ON to_id = a)
        SELECT r.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(to_id) AS component_id FROM reach r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id""",
    "op6_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, coalesce({PLAIN}, []) AS w FROM documents),
        spots AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
        least_of AS (SELECT g, min(doc_id) AS low FROM spots GROUP BY 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spots JOIN least_of USING (g) WHERE low < doc_id),
        lists AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY 1),
        words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs d LEFT JOIN lists ON d.doc_id = lists.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op11_phrase_collocations": f"""
        WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
        pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
        lists AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
        spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY 1),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM spots, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        inner_parts AS (SELECT DISTINCT lang, f, unnest([array_to_string(string_split(g, ' ')[1:k - 1], ' '), array_to_string(string_split(g, ' ')[2:k], ' ')]) AS g FROM grams WHERE k > 2),
        candidates AS (SELECT * FROM grams c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.g = c.g AND i.f = c.f)),
        cuts AS (SELECT lang, g, k, f, string_split(g, ' ') AS w, unnest(range(1, k)) AS cut FROM candidates),
        scored AS (SELECT c.lang, c.g, c.f AS a, cut, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
          FROM cuts c JOIN totals t ON c.lang = t.lang JOIN grams x ON x.lang = c.lang AND x.g = array_to_string(w[1:cut], ' ') JOIN grams y ON y.lang = c.lang AND y.g = array_to_string(w[cut + 1:c.k], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM lowest)
        SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
