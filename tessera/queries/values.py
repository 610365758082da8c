"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import query as q
from tessera.functions import text as t
from tessera.queries.understanding import TASK
from tessera.session import table

WORDS = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(name, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu}+)(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("identifier_variants", f"SELECT DISTINCT name, words, replace(words, ' ', '') AS compact, replace(words, ' ', '_') AS snake, replace(words, ' ', '-') AS kebab FROM (SELECT name, {WORDS} AS words FROM chunks WHERE name IS NOT NULL)")
def identifier_variants(spark: SparkSession, root: str) -> DataFrame:
    w = F.col("words")
    rows = table(spark, root, "chunks").where("name IS NOT NULL").select("name", t.identifier_words("name").alias("words")).distinct()
    return rows.select("name", "words", F.replace(w, F.lit(" "), F.lit("")).alias("compact"), F.replace(w, F.lit(" "), F.lit("_")).alias("snake"), F.replace(w, F.lit(" "), F.lit("-")).alias("kebab"))


@query("task_types", rf"""
WITH d AS (SELECT doc_id, text AS query FROM documents WHERE text IS NOT NULL) SELECT doc_id, {TASK} AS task FROM d""")
def task_types(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", q.task_type(F.col("text")).alias("task"))


@query("path_functions", r"""
SELECT DISTINCT repo, file_path, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') END AS parent, len(string_split(file_path, '/'))::INTEGER AS depth, string_split(file_path, '/')[1] AS top,
  regexp_matches('/' || file_path, '/tests/|__tests__|\.test\.|\.spec\.|/docs/|README|CHANGELOG|\.md') AS test_or_doc FROM source_files""")
def path_functions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_files").select("repo", "file_path", t.parent_path("file_path").alias("parent"), t.depth("file_path").alias("depth"), F.split("file_path", "/")[0].alias("top"), t.is_test_or_doc("file_path").alias("test_or_doc")).distinct()


@query("languages", "SELECT CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.LANGUAGES.items()) + " ELSE 'unknown' END AS language, count(DISTINCT file_id)::BIGINT AS files FROM source_files GROUP BY ALL")
def languages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_files").groupBy(t.language_of("file_path").alias("language")).agg(F.count_distinct("file_id").cast("bigint").alias("files"))


@query("token_estimates", "SELECT pending_id, any_value(ceil(length(text) / 4.0)::BIGINT) AS tokens, any_value(length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g'))::BIGINT) AS solid, any_value(length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) > 2000) AS over_budget FROM pending_chunks WHERE text IS NOT NULL GROUP BY pending_id")
def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    solid = F.length(F.regexp_replace("text", r"[ \t\r\n]", "")).cast("bigint")
    return table(spark, root, "pending_chunks").where("text IS NOT NULL").select("pending_id", t.estimated_tokens("text").alias("tokens"), solid.alias("solid"), (solid > 2000).alias("over_budget")).distinct()


@query("embedding_texts", f"SELECT pending_id, md5(left(concat_ws(chr(10), 'file: ' || file_path, 'symbol: ' || name, 'terms: ' || {WORDS}, text), 2000)) AS digest FROM (SELECT DISTINCT pending_id, file_path, symbol_name AS name, text FROM pending_chunks)")
def embedding_texts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pending_chunks").select("pending_id", "file_path", "symbol_name", "text").distinct()
    return rows.select("pending_id", F.md5(t.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("text"), 2000).cast("binary")).alias("digest"))


@query("chunk_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, ((n - 1) // 20)::INTEGER AS window_no, min(n)::INTEGER AS start_line, max(n)::INTEGER AS end_line, sum(length(line))::BIGINT AS chars FROM l GROUP BY ALL""")
def chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    """Windows of twenty lines that tile each text."""
    lines = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("doc_id", F.floor(F.col("n") / 20).cast("int").alias("window_no")).agg(F.min(F.col("n") + 1).alias("start_line"), F.max(F.col("n") + 1).alias("end_line"), F.sum(F.length("line")).cast("bigint").alias("chars"))


@query("extracted_calls", r"""
WITH f AS (SELECT DISTINCT file_id, content FROM source_files WHERE content IS NOT NULL), c AS (SELECT file_id, unnest(regexp_extract_all(content, '([A-Za-z_]\w*)\(', 1)) AS callee FROM f)
SELECT file_id, callee, count(*)::BIGINT AS sites FROM c WHERE callee NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'def', 'func', 'fn') GROUP BY ALL""")
def extracted_calls(spark: SparkSession, root: str) -> DataFrame:
    """Names that stand before an opening bracket, keywords left out."""
    rows = table(spark, root, "source_files").where("content IS NOT NULL").select("file_id", "content").distinct()
    out = rows.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)\("), F.lit(1))).alias("callee"))
    return out.where(~F.col("callee").isin("if", "for", "while", "switch", "catch", "return", "function", "def", "func", "fn")).groupBy("file_id", "callee").agg(F.count("*").alias("sites"))


@query("query_jaccard", r"""
WITH n AS (SELECT DISTINCT symbol_name AS a, list_distinct(list_filter(string_split(""" + WORDS.replace("name", "symbol_name") + r""", ' '), lambda x: x <> '')) AS wa FROM pending_chunks WHERE symbol_name IS NOT NULL),
c AS (SELECT DISTINCT name AS b, list_distinct(list_filter(string_split(""" + WORDS + r""", ' '), lambda x: x <> '')) AS wb FROM chunks WHERE name IS NOT NULL)
SELECT a, b, round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE, 6) AS similarity FROM n JOIN c ON a <> b AND len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE >= 0.85""")
def query_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """Names whose word sets overlap by 0.85 or more. Sets that alike share one of their rarest words, so names meet on
    the first (1 - 0.85) share of their words in order of rarity, not on all pairs."""
    words = lambda df, c: df.where(F.col(c).isNotNull()).select(F.col(c).alias("n"), F.array_distinct(F.filter(F.split(t.identifier_words(c), " "), lambda x: x != "")).alias("w")).distinct()
    a, b = words(table(spark, root, "pending_chunks"), "symbol_name"), words(table(spark, root, "chunks"), "name")
    both = a.unionByName(b).distinct()
    rarity = both.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame) -> DataFrame:
        ranked = df.select("n", "w", F.explode("w").alias("x")).join(rarity, "x").groupBy("n", "w").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
        keep = F.size("w") - F.ceil(F.size("w") * 0.85).cast("int") + 1
        return ranked.select("n", "w", F.explode(F.slice("o", F.lit(1), keep)).alias("p")).select("n", "w", "p.x")

    met = prefix(a).alias("a").join(prefix(b).alias("b"), "x").where("a.n <> b.n").select(F.col("a.n").alias("a"), F.col("b.n").alias("b"), F.col("a.w").alias("wa"), F.col("b.w").alias("wb")).distinct()
    scored = met.withColumn("similarity", t.jaccard(F.col("wa"), F.col("wb"))).where("similarity >= 0.85")
    return scored.select("a", "b", F.round("similarity", 6).alias("similarity"))
