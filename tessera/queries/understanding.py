"""Query understanding and reranking over the result lists of search_results. Each query text is made of the names and paths of its
own candidates by one of sixteen forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import identifiers as i
from tessera.functions import intent
from tessera.operators import evaluate, reports
from tessera.operators import rerank as r
from tessera.plans import indexing
from tessera.plans.search import rank_hybrid, rank_one_lane
from tessera.queries.catalog import LIVE, live
from tessera.session import clean_key, table

FORMS = [
    "who calls {n}", "where is {n} defined", "what does {n} call", "callers of `{n}`?", "where is the {n} used", "what tests cover {n}", "{n} throws TypeError", "{n} should return but fails", "how does {n} work in {p}",
    "function {n} in {p}", "what type represents {n} options", "where are the {n} tests", "docs for {n}", "which module handles {n}", "what is the default config of {n}", "find {n} and parse results in {p}",
]
CANDIDATES = (
    LIVE
    + """, sr AS (SELECT query_id, lower(trim(chunk_id, chr(9)||chr(10)||chr(13)||' ')) AS id, max(base_score) AS score FROM search_results GROUP BY ALL HAVING max(base_score) IS NOT NULL),
ct AS (SELECT lower(trim(content_hash)) AS content_hash, max(chunk_text) AS content FROM chunk_embeddings GROUP BY ALL),
cj AS (SELECT sr.query_id, sr.id, round(sr.score, 6) AS score, lc.file_path AS path, lc.name, lower(lc.symbol_kind) AS kind, lc.chunk_kind, lc.symbol_kind, lc.symbol_aliases AS aliases, lc.content_hash FROM sr JOIN lc ON lc.chunk_id = sr.id),
qt AS (SELECT query_id, coalesce(min(name), 'nothing') AS n, min(path) AS p FROM cj GROUP BY ALL),
qq AS (SELECT query_id, CASE query_id % 16 """
    + " ".join(f"WHEN {k} THEN replace(replace('{form}', '{{n}}', n), '{{p}}', p)" for k, form in enumerate(FORMS))
    + """ END AS query FROM qt),
ca AS (SELECT cj.*, qq.query, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM cj JOIN qq USING (query_id))
"""
)


def candidates(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").groupBy("query_id", clean_key("chunk_id").alias("id")).agg(F.round(F.max("base_score"), 6).alias("score")).where("score IS NOT NULL")
    meta = live(spark, root).select(F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), "name", F.lower("symbol_kind").alias("kind"), "chunk_kind", "symbol_kind", F.col("symbol_aliases").alias("aliases"), "content_hash")
    joined = rows.join(meta, "id")
    texts = joined.groupBy("query_id").agg(F.coalesce(F.min("name"), F.lit("nothing")).alias("n"), F.min("path").alias("p"))
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("query_id") % 16 + 1).cast("int"))
    texts = texts.select("query_id", F.replace(F.replace(form, F.lit("{n}"), F.col("n")), F.lit("{p}"), F.col("p")).alias("query"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return joined.join(texts, "query_id").withColumn("position", place)


def questions(spark: SparkSession, root: str) -> DataFrame:
    return candidates(spark, root).select("query_id", "query").distinct()


# the rules once more, in SQL
def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def matching(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(text, p.replace("'", "''")) for p in patterns) + ")"


STOP = words(i.STOP_WORDS)
LOW = "lower(trim(query))"
kept = lambda tokens: f"list_distinct(list_filter({tokens}, lambda t: length(t) > 1 AND t NOT IN ({STOP})))"
tokens_of = lambda text: kept(rf"regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), '[^\w\s]', ' ', 'g'), '\s+')")
plain_of = lambda text: rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), '[^\w\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1))"
names_of = lambda name: kept(rf"list_concat(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce({name}, ''), '[_./\\-]+', ' ', 'g'), '[^\w\s]', ' ', 'g')), '\s+'), [regexp_replace(lower(coalesce({name}, '')), '[^\w]', '', 'g')])")
paths_of = lambda path: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({path}), '[^a-z0-9/._-]', ' ', 'g'), '[/._-]+'), lambda t: length(t) > 1))"
WORDS = "regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*')"
HINTS = f"list_transform(list_filter({WORDS}, lambda w: length(w) >= 3 AND lower(w) NOT IN ({STOP}) AND (regexp_matches(w, '[A-Z]') OR contains(w, '_') OR ends_with(w, 'Results') OR ends_with(w, 'Result'))), lambda w: lower(w))"
TERMS = f"list_filter(list_transform({WORDS}, lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN ({STOP}))"
FILE_HINT = i.FILE_HINT.replace("'", "''")
RAW_HINT = rf"regexp_replace(nullif(regexp_extract(query, '{FILE_HINT}', 1), ''), '^\./', '')"
DIRECTION = f"CASE WHEN {matching(LOW, intent.CALLEES)} THEN 'callee' WHEN {matching(LOW, intent.CALLERS)} THEN 'caller' END"
_cleaned = lambda p: r"""nullif(regexp_replace(regexp_replace(trim(regexp_extract(trim(query), '{}', 1)), '^[`"''(\[{{<\s]+', ''), '[`"'')\]}}>?,.;:!\s]+$', ''), '')""".format(p)
TARGET = "coalesce(" + ", ".join(_cleaned(p) for p in intent.TARGETS) + ")"
ERRORS = "(" + " OR ".join(r"len(list_filter(string_split_regex(query, '\r?\n'), lambda x: regexp_matches(trim(x), '{}'))) > 0".format(p) for p in intent.ERROR_LINES) + ")"
SHOULD = "(strpos(lower(query), 'should') > 0 AND strpos(substr(lower(query), strpos(lower(query), 'should') + 6), 'but') > 0 AND strpos(substr(lower(query), strpos(lower(query), 'should') + 6), 'but') + 5 <= 80)"
SIGNALS = rf"({matching('lower(query)', intent.TESTS)} OR (regexp_matches(lower(query), '\bcoverage\b') AND regexp_matches(lower(query), '\b(?:test|tests|spec|specs|cover|covers|covering)\b')) OR ((contains(query, '?') OR regexp_matches(lower(query), '^\s*(?:what|where|which|how|why)\b')) AND regexp_matches(lower(query), '\b(?:describe|it block|beforeeach)\b')))"
TASK = f"CASE WHEN {DIRECTION} IS NOT NULL THEN 'definition' WHEN {SIGNALS} THEN 'test_debug' WHEN {matching('lower(query)', intent.BUGS)} OR {ERRORS} OR {SHOULD} THEN 'bug' ELSE 'general' END"
_count = lambda values: " + ".join(rf"regexp_matches(lower(query), '\b{w}\b')::INT" for w in values)
_tokens = lambda values: f"len(list_filter(words, lambda t: t IN ({words(values)})))"
SOURCE = rf"CASE WHEN ({_count(intent.DOC_TEST_HINTS)}) > ({_count(intent.SOURCE_WORDS)}) THEN 'doc_test' WHEN ({_count(intent.SOURCE_WORDS)}) > ({_count(intent.DOC_TEST_HINTS)}) THEN 'source' WHEN regexp_matches(lower(query), '\bwhere\s+is\b') AND len(hints) > 0 AND ({_count(intent.DOC_TEST_HINTS)}) = 0 THEN 'source' WHEN {_tokens(intent.SOURCE_HINTS)} >= {_tokens(intent.DOC_TEST_HINTS)} THEN 'source' ELSE 'doc_test' END"
DOC = f"CASE WHEN {_tokens(intent.DOC_HINTS)} > 0 AND {_tokens(intent.TEST_HINTS)} = 0 THEN 'docs' WHEN {_tokens(intent.TEST_HINTS)} > 0 AND {_tokens(intent.DOC_HINTS)} = 0 THEN 'test' WHEN {_tokens(intent.DOC_HINTS)} + {_tokens(intent.TEST_HINTS)} > 0 THEN 'mixed' ELSE 'none' END"
TEST_DOC = "(" + " OR ".join(f"contains(path, '{s}')" for s in i.TEST_OR_DOC) + ")"
IMPLEMENTATION_PATH = "(NOT (" + " OR ".join(f"contains(lower(path), '{s}')" for s in i.NOT_IMPLEMENTATION) + f") AND string_split(lower(path), '.')[-1] NOT IN ({words(i.NOT_SOURCE)}))"
IMPLEMENTATION_TYPE = f"coalesce(kind IN ({words(i.IMPLEMENTATION_TYPES)}), false)"
BOOST = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in i.BOOST.items()) + " ELSE 0.0 END"
VARIANTS = lambda h: f"list_distinct(list_filter([lower({h}), regexp_replace(lower({h}), '[^a-z0-9]', '', 'g')], lambda v: v <> ''))"
LNAME = "lower(coalesce(name, ''))"
UNNAMED = "coalesce((kind = 'other' AND trim(coalesce(name, '')) = '') OR (kind = 'module' AND (trim(coalesce(name, '')) = '' OR (starts_with(trim(name), '<') AND ends_with(trim(name), '>')))), false)"
PREPARED = CANDIDATES + f", pr AS (SELECT *, {tokens_of('query')} AS words, {HINTS} AS hints, {names_of('name')} AS names, {paths_of('path')} AS paths, {tokens_of('kind')} AS kinds, {TEST_DOC} AS test_doc, {IMPLEMENTATION_PATH} AS impl_path, {IMPLEMENTATION_TYPE} AS impl_type FROM ca), ps AS (SELECT *, {SOURCE} AS intent, {DOC} AS doc FROM pr)"


@query("query_relations", CANDIDATES + f"SELECT query_id, {DIRECTION} AS direction, {TARGET} AS target FROM qq")
def query_relations(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("query")
    return questions(spark, root).select("query_id", intent.relation(q).alias("direction"), intent.relation_target(q).alias("target"))


@query("task_routing", CANDIDATES + f"SELECT query_id, {TASK} AS task FROM qq")
def task_routing(spark: SparkSession, root: str) -> DataFrame:
    return questions(spark, root).select("query_id", intent.task_type(F.col("query")).alias("task"))


SOUGHT = matching("lower(query)", intent.IMPLEMENTATION)
DECLARED = rf"({matching('lower(query)', intent.DECLARATIVE)} OR (regexp_matches(lower(query), '\b(?:config|configuration|options?|params?|props?)\b') AND regexp_matches(lower(query), '\b(?:type|interface|schema|shape|represents?)\b')))"
FRAMED = r"(regexp_matches(lower(query), '\bwhere\s+is\b.+\bdefined\b') OR (regexp_matches(lower(query), '^\s*where\s+is\s+the\b') AND regexp_matches(lower(query), '\bdefined\s*$')))"
BUG_SOURCE = rf"""({ERRORS} OR regexp_matches(query, '[`"''“”][^`"''“”]{{3,}}[`"''“”]') OR {matching('lower(query)', intent.BUG_SOURCES)} OR (regexp_matches(lower(query), '\b(?:throws?|exception|error(?:\s+message)?)\b') AND regexp_matches(query, '\b(?:[A-Z][A-Za-z0-9]+(?:Error|Exception)|[a-z_]+error)\b')))"""


@query(
    "sub_intents",
    CANDIDATES
    + f""", qx AS (SELECT query_id, query, unnest(['general', 'definition', 'bug', 'test_debug', 'semantic']) AS task FROM qq)
SELECT query_id, task, CASE WHEN trim(query) = '' THEN NULL WHEN task IN ('general', 'semantic') AND {matching('lower(query)', intent.CONFIG_FRAMES)} AND {matching('lower(query)', intent.CONFIG_SIGNS)} THEN 'definition:declarative'
WHEN task = 'definition' AND {FRAMED} AND {SOUGHT} THEN 'definition:executable' WHEN task = 'definition' AND ({DIRECTION}) = 'caller' THEN 'relationship:caller'
WHEN task = 'definition' AND (coalesce(({DIRECTION}) = 'callee', false) OR {matching('lower(query)', intent.BRIDGES)}) THEN 'relationship:callee' WHEN task = 'definition' AND {SOUGHT} THEN 'definition:executable' WHEN task = 'definition' AND {DECLARED} THEN 'definition:declarative'
WHEN task = 'bug' AND {BUG_SOURCE} THEN 'bug:error-source' WHEN task = 'bug' AND {matching('lower(query)', intent.BUG_OWNERS)} THEN 'bug:behavior-owner' WHEN task = 'test_debug' AND {matching('lower(query)', intent.DISCOVERY)} THEN 'test:discovery'
WHEN task IN ('general', 'semantic') AND {matching('lower(query)', intent.OWNERS)} THEN 'concept:architecture' WHEN task IN ('general', 'semantic') AND {matching('lower(query)', intent.WORKINGS)} THEN 'concept:implementation' END AS sub_intent FROM qx""",
)
def sub_intents(spark: SparkSession, root: str) -> DataFrame:
    tasks = F.explode(F.array(*[F.lit(t) for t in ("general", "definition", "bug", "test_debug", "semantic")]))
    return questions(spark, root).withColumn("task", tasks).select("query_id", "task", intent.sub_intent(F.col("query"), F.col("task")).alias("sub_intent"))


@query("source_intents", CANDIDATES + f", qx AS (SELECT *, {tokens_of('query')} AS words, {HINTS} AS hints FROM qq) SELECT query_id, {SOURCE} AS source_intent, {DOC} AS doc_intent FROM qx")
def source_intents(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("query")
    return questions(spark, root).select("query_id", intent.source_intent(q, i.tokens(q), i.hints(q)).alias("source_intent"), intent.doc_intent(i.tokens(q)).alias("doc_intent"))


@query("identifier_hints", CANDIDATES + f"SELECT query_id, array_to_string({HINTS}, ' ') AS hints, array_to_string({TERMS}, ' ') AS terms, coalesce(({HINTS})[1], list_filter({TERMS}, lambda t: length(t) >= 6)[1]) AS first FROM qq")
def identifier_hints(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("query")
    return questions(spark, root).select("query_id", F.array_join(i.hints(q), " ").alias("hints"), F.array_join(i.term_hints(q), " ").alias("terms"), i.primary_hint(q).alias("first"))


@query("file_path_hints", CANDIDATES + f"SELECT query_id, {RAW_HINT} AS file_hint, coalesce(nullif(trim(regexp_replace(query, '{FILE_HINT}', '')), ''), query) AS rest FROM qq")
def file_path_hints(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("query")
    return questions(spark, root).select("query_id", i.file_hint(q).alias("file_hint"), i.without_file_hint(q).alias("rest"))


@query("identifier_match_scores", PREPARED + f", v AS (SELECT query_id, id, name, path, unnest(flatten(list_transform(hints, lambda h: {VARIANTS('h')}))) AS v FROM pr) SELECT query_id, id, max(CASE WHEN {LNAME} = v THEN 1.0 WHEN contains({LNAME}, v) THEN 0.8 WHEN contains(lower(path), v) THEN 0.6 ELSE 0.0 END)::DOUBLE AS match FROM v GROUP BY ALL")
def identifier_match_scores(spark: SparkSession, root: str) -> DataFrame:
    rows = candidates(spark, root).withColumn("hints", i.hints(F.col("query"))).where(F.size("hints") > 0)
    return rows.select("query_id", "id", i.match_score(F.col("name"), F.col("path"), F.col("hints")).alias("match"))


KIND = """CASE WHEN n = v OR regexp_replace(n, '[^a-z0-9]', '', 'g') = regexp_replace(v, '[^a-z0-9]', '', 'g') THEN 0
 WHEN len(list_filter(coalesce(aliases, []), lambda a: lower(a) = v OR regexp_replace(lower(a), '[^a-z0-9]', '', 'g') = regexp_replace(v, '[^a-z0-9]', '', 'g'))) > 0 THEN 1 WHEN contains(n, v) THEN 2 WHEN contains(lower(path), v) THEN 3 ELSE 4 END"""


@query(
    "identifier_quality",
    PREPARED
    + f""", h AS (SELECT query_id, id, kind, aliases, path, {LNAME} AS n, intent, query, unnest(list_distinct(hints)) AS h FROM ps), v AS (SELECT *, unnest({VARIANTS('h')}) AS v FROM h), kk AS (SELECT *, {KIND} AS k FROM v),
g AS (SELECT query_id, id, kind, intent, query, count(DISTINCT h) FILTER (WHERE k = 0) AS exact, count(DISTINCT h) FILTER (WHERE k = 1) AS alias, count(DISTINCT h) FILTER (WHERE k = 2) AS part, count(DISTINCT h) FILTER (WHERE k = 3) AS inpath,
 count(DISTINCT h) FILTER (WHERE k = 2 AND (length(regexp_replace(h, '[^a-z0-9]', '', 'g')) <= 4 OR regexp_replace(h, '[^a-z0-9]', '', 'g') IN ({words(i.GENERAL_TERMS)}))) AS general FROM kk GROUP BY ALL)
SELECT query_id, id, CASE WHEN intent = 'source' AND regexp_matches(lower(query), '{i.SEEKING}') AND coalesce(kind IN ('interface', 'type'), false) THEN 'type-only' WHEN exact > 0 THEN 'exact-symbol' WHEN alias > 0 THEN 'alias-symbol' WHEN part >= 2 THEN 'compound-symbol' WHEN part = 0 AND inpath > 0 THEN 'path-only' ELSE 'weak-substring' END AS quality,
 CASE WHEN part < 2 THEN 'not-compound' WHEN general = part THEN 'generic-compound' WHEN general = 0 THEN 'strong-compound' ELSE 'mixed-compound' END AS specificity FROM g""",
)
def identifier_quality(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("query")
    rows = candidates(spark, root).withColumns({"words": i.tokens(q), "hints": i.hints(q)}).where(F.size("hints") > 0)
    rows = rows.withColumn("details", i.match_details(F.col("name"), F.col("path"), F.col("hints"), F.col("aliases")))
    seeking = (intent.source_intent(q, F.col("words"), F.col("hints")) == "source") & F.lower(q).rlike(i.SEEKING)
    return rows.select("query_id", "id", i.quality(F.col("kind"), F.col("details"), seeking, F.lit(False)).alias("quality"), i.compound_specificity(F.col("details")["part"]).alias("specificity"))


@query("risk_policies", PREPARED + ", s AS (SELECT query_id, id, score, unnest(['weak-substring', 'path-only', 'type-only', 'exact-symbol']) AS label FROM pr) SELECT query_id, id, label, round(CASE label WHEN 'weak-substring' THEN least(0.95, greatest(score, 0.9)) WHEN 'path-only' THEN least(0.95, greatest(score, 0.88)) WHEN 'type-only' THEN least(0.95, greatest(score, 0.86) - 0.04) ELSE 0.95 END, 9)::DOUBLE AS as_set, round(CASE label WHEN 'weak-substring' THEN score + 0.4 * 0.25 WHEN 'path-only' THEN score + 0.4 * 0.15 WHEN 'type-only' THEN score - 0.04 ELSE score + 0.4 END, 9)::DOUBLE AS as_added FROM s")
def risk_policies(spark: SparkSession, root: str) -> DataFrame:
    rows = candidates(spark, root).withColumn("label", F.explode(F.array(*[F.lit(x) for x in ("weak-substring", "path-only", "type-only", "exact-symbol")])))
    s = F.col("score")
    return rows.select("query_id", "id", "label", F.round(i.capped_set(s, F.lit(0.95), F.col("label")), 9).alias("as_set"), F.round(i.capped_add(s, s + 0.4, F.col("label")), 9).alias("as_added"))


@query("name_and_path_tokens", LIVE + f"SELECT DISTINCT name, file_path, array_to_string(list_sort({names_of('name')}), ' ') AS name_tokens, array_to_string(list_sort({paths_of('file_path')}), ' ') AS path_tokens FROM lc")
def name_and_path_tokens(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root).select("name", "file_path", F.array_join(F.array_sort(i.name_tokens(F.col("name"))), " ").alias("name_tokens"), F.array_join(F.array_sort(i.path_tokens(F.col("file_path"))), " ").alias("path_tokens")).distinct()


@query("path_classes", f"WITH f AS (SELECT DISTINCT file_path AS path FROM source_files) SELECT path, {TEST_DOC} AS test_or_doc, {IMPLEMENTATION_PATH} AS implementation, ({' OR '.join(f'contains(lower(path), {chr(39)}{s}{chr(39)})' for s in i.LIKELY_TEST)}) AS likely_test, (contains(lower(path), '/test/') OR contains(lower(path), '/tests/') OR contains(lower(path), '__tests__') OR regexp_matches(lower(path), '\\.(test|spec)\\.[tj]sx?$') OR ends_with(lower(path), 'test.py')) AS test_file FROM f")
def path_classes(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, root, "source_files").select(F.col("file_path").alias("path")).distinct()
    return rows.select("path", i.is_test_or_doc(p).alias("test_or_doc"), i.is_likely_implementation(p).alias("implementation"), i.is_likely_test(p).alias("likely_test"), i.is_test_file(p).alias("test_file"))


@query("chunk_type_boosts", LIVE + f", ks AS (SELECT DISTINCT lower(symbol_kind) AS kind FROM lc UNION SELECT unnest(['enum', 'struct', 'impl', 'trait', 'constant', 'function_declaration', 'other', 'module'])) SELECT kind, ({BOOST})::DOUBLE AS boost, {IMPLEMENTATION_TYPE} AS implementation FROM ks")
def chunk_type_boosts(spark: SparkSession, root: str) -> DataFrame:
    fixed = spark.createDataFrame([(k,) for k in "enum struct impl trait constant function_declaration other module".split()], "kind string")
    rows = live(spark, root).select(F.lower("symbol_kind").alias("kind")).union(fixed).distinct()
    return rows.select("kind", i.type_boost(F.col("kind")).alias("boost"), i.is_implementation_type(F.col("kind")).alias("implementation"))


RERANKED = (
    PREPARED
    + f""", hd AS (SELECT *, intent = 'source' AS src, position <= 20 AND len(words) > 0 AS head, contains(lower(path), 'readme') AS readme, len(list_filter(hints, lambda h: contains(lower(path), h) OR contains({LNAME}, h))) > 0 AS ident,
 len(list_filter(words, lambda t: len(list_filter(names, lambda n: n = t OR starts_with(n, t) OR starts_with(t, n))) > 0)) AS nh, len(list_intersect(words, paths)) AS ph, len(list_intersect(words, kinds)) AS kh FROM ps),
bo AS (SELECT *, nh * 0.08 + ph * 0.03 + kh * 0.02 + least(0.12, (nh + ph + kh) / greatest(len(words), 1) * 0.06) + CASE WHEN ident THEN 0.12 ELSE 0 END + CASE WHEN src AND impl_path THEN 0.08 ELSE 0 END - CASE WHEN src AND test_doc THEN 0.12 ELSE 0 END + CASE WHEN NOT src AND readme THEN 0.08 ELSE 0 END + {BOOST} AS boost,
 max(CASE WHEN head AND trim(coalesce(name, '')) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, path) AS named FROM hd),
sb AS (SELECT *, {UNNAMED} AND named = 1 AND head AS suppressed, CASE WHEN head THEN round(score + boost - CASE WHEN {UNNAMED} AND named = 1 THEN 0.10 ELSE 0 END, 9) END AS boosted FROM bo),
rr AS (SELECT query_id, id, suppressed, boosted::DOUBLE AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN CASE WHEN src THEN ident::INT WHEN doc = 'docs' THEN readme::INT ELSE 0 END END DESC NULLS LAST, CASE WHEN head AND src THEN impl_type::INT WHEN head THEN 0 END DESC NULLS LAST, CASE WHEN head AND src THEN impl_path::INT WHEN head THEN 0 END DESC NULLS LAST,
 CASE WHEN head AND src THEN -(test_doc::INT) WHEN head THEN 0 END DESC NULLS LAST, boosted DESC NULLS LAST, CASE WHEN head THEN score END DESC NULLS LAST, position, id)::BIGINT AS place FROM sb)
"""
)


@query("deterministic_rerank", RERANKED + "SELECT query_id, id, place FROM rr")
def deterministic_rerank(spark: SparkSession, root: str) -> DataFrame:
    return r.deterministic(candidates(spark, root), 20).select("query_id", "id", "place")


@query("sibling_suppression", RERANKED + "SELECT query_id, id, boosted FROM rr WHERE boosted IS NOT NULL")
def sibling_suppression(spark: SparkSession, root: str) -> DataFrame:
    """The scores of the first twenty after boosts and the fall of unnamed siblings."""
    return r.deterministic(candidates(spark, root), 20).where("boosted IS NOT NULL").select("query_id", "id", "boosted")


JOINT = (
    PREPARED
    + f""", jt AS (SELECT pr.*, coalesce(ct.content, '') AS content, {plain_of('query')} AS qw, {plain_of('name')} AS nw, list_distinct(list_filter(regexp_split_to_array(lower(path), '[/._-]+'), lambda t: length(t) > 1)) AS pw, {plain_of('content')} AS bw, CASE WHEN chunk_kind IS NOT NULL THEN chunk_kind = 'Test' ELSE contains(lower(path), 'test') OR contains(lower(path), 'spec') END AS is_test FROM pr LEFT JOIN ct USING (content_hash)),
jo AS (SELECT *, len(list_intersect(qw, nw)) AS nn, len(list_intersect(qw, pw)) AS pp, len(list_intersect(qw, bw)) AS bb, CASE WHEN {LNAME} <> '' AND contains(lower(query), {LNAME}) THEN 0.4 ELSE 0.0 END AS ex, CASE WHEN contains(lower(content), lower(query)) THEN 0.25 ELSE 0.0 END AS fr,
 CASE WHEN regexp_matches(lower(query), '\\b(?:error|exception|stack|trace|abort)\\b') AND regexp_matches(lower(content), '\\b(?:error|exception|throw|abort|fail)\\b') THEN 0.14 ELSE 0.0 END AS tr FROM jt),
js AS (SELECT query_id, id, score * 0.6 + bb * 0.06 + pp * 0.04 + nn * 0.08 + ex + fr AS common, ex + nn * 0.16 + pp * 0.05 AS d, bb * 0.12 + pp * 0.06 + nn * 0.05 + fr + ex * 0.5 + tr + CASE WHEN is_test THEN 0.04 ELSE 0 END AS b, bb * 0.1 + fr AS s, CASE WHEN is_test THEN 0.18 ELSE -0.04 END + bb * 0.08 + pp * 0.05 AS t FROM jo)
"""
)


@query("heuristic_joint_score", JOINT + "SELECT query_id, id, round(common + d, 6)::DOUBLE AS definition, round(common + b, 6)::DOUBLE AS bug, round(common + s, 6)::DOUBLE AS semantic, round(common + t, 6)::DOUBLE AS test_debug FROM js")
def heuristic_joint_score(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "chunk_embeddings").groupBy(clean_key("content_hash").alias("content_hash")).agg(F.max("chunk_text").alias("content"))
    rows = candidates(spark, root).join(texts, "content_hash", "left").withColumn("content", F.coalesce("content", F.lit("")))
    low = F.lower("path")
    is_test = F.when(F.col("chunk_kind").isNotNull(), F.col("chunk_kind") == "Test").otherwise(low.contains("test") | low.contains("spec"))
    score = lambda task: F.round(r.joint_score(F.col("query"), F.col("path"), F.col("name"), F.col("content"), F.col("score"), is_test, task), 6).alias(task)
    return rows.select("query_id", "id", *[score(t) for t in ("definition", "bug", "semantic", "test_debug")])


@query("post_rerank_factors", PREPARED + "SELECT query_id, id, (CASE WHEN coalesce(chunk_kind IN ('Test', 'Doc'), false) THEN 0.05 ELSE 1.0 END)::DOUBLE AS bug, (CASE WHEN coalesce(kind = 'module', false) OR coalesce(chunk_kind = 'File', false) OR coalesce(symbol_kind = 'Module', false) THEN 0.75 ELSE 1.0 END)::DOUBLE AS test_debug, round(score * CASE WHEN coalesce(chunk_kind IN ('Test', 'Doc'), false) THEN 0.5 ELSE 1 END, 9)::DOUBLE AS definition_score FROM pr")
def post_rerank_factors(spark: SparkSession, root: str) -> DataFrame:
    f = lambda task: r.task_factor(F.col("kind"), F.col("chunk_kind"), F.col("symbol_kind"), F.lit(task)).alias(task)
    return candidates(spark, root).select("query_id", "id", f("bug"), f("test_debug"), F.round(F.col("score") * r.chunk_kind_factor(F.col("chunk_kind"), "definition"), 9).alias("definition_score"))


@query(
    "identifier_lane",
    PREPARED
    + rf""", la AS (SELECT *, coalesce(hints[1], list_filter({TERMS}, lambda t: length(t) >= 6)[1]) AS first, {RAW_HINT} AS file_hint FROM ps), lb AS (SELECT *, list_filter(list_concat([first], hints, {TERMS}), lambda h: length(h) >= 3) AS every FROM la WHERE intent = 'source' AND first IS NOT NULL AND impl_path AND impl_type),
lw AS (SELECT *, list_filter(every, lambda h, n: list_position(every, h) = n)[:8] AS wanted, coalesce(contains(regexp_replace(lower(path), '^\./', ''), regexp_replace(lower(file_hint), '^\./', '')), false) AND regexp_replace({LNAME}, '[^a-z0-9]', '', 'g') = regexp_replace(first, '[^a-z0-9]', '', 'g') AS anchored FROM lb),
lv AS (SELECT query_id, id, score, anchored, name, path, unnest(flatten(list_transform(wanted, lambda h: {VARIANTS('h')}))) AS v FROM lw),
lm AS (SELECT query_id, id, score, anchored, max(CASE WHEN anchored OR {LNAME} = v THEN 1.0 WHEN contains({LNAME}, v) THEN 0.85 WHEN contains(lower(path), v) THEN 0.7 ELSE 0 END) AS match FROM lv GROUP BY ALL)
SELECT query_id, id, round(CASE WHEN anchored THEN 0.995 ELSE least(1.0, 0.9 + match * 0.09) END, 9)::DOUBLE AS score, match::DOUBLE AS match, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY anchored DESC, match DESC, score DESC, id)::BIGINT AS place FROM lm WHERE match >= 0.7) WHERE place <= 20""",
)
def identifier_lane(spark: SparkSession, root: str) -> DataFrame:
    return r.identifier_lane(candidates(spark, root), 10)


@query("coarse_suppression", PREPARED + f", fi AS (SELECT *, max((coalesce(chunk_kind <> 'File', true) AND len(list_filter(flatten(list_transform(hints, lambda h: {VARIANTS('h')})), lambda v: contains({LNAME}, v) OR contains(lower(path), v))) > 0)::INT) OVER (PARTITION BY query_id) AS found FROM pr) SELECT query_id, id FROM fi WHERE NOT (coalesce(chunk_kind = 'File', false) AND found = 1)")
def coarse_suppression(spark: SparkSession, root: str) -> DataFrame:
    return r.without_coarse(candidates(spark, root)).select("query_id", "id")


CATEGORY = r"""CASE WHEN regexp_matches(path, '(?i)(^|/)(__tests__|tests?|spec|test)(/|$)|\.(test|spec)\.[cm]?[tj]sx?$') THEN 'test' WHEN regexp_matches(path, '(?i)(^|/)(docs?|documentation)(/|$)|\.(md|mdx|rst)$') THEN 'doc' WHEN kind = 'module' AND starts_with(coalesce(name, ''), 'export{') THEN 'wrapper-export'
 WHEN kind IN ('type', 'interface') AND regexp_matches(coalesce(name, ''), '(Options|Config|Params|Args|Props)$') THEN 'options-shape' WHEN kind IN ('type', 'interface') THEN 'type-interface' WHEN kind = 'module' THEN 'module' WHEN kind IN ('function', 'method', 'class', 'constant') THEN 'implementation' ELSE 'other' END"""


@query("definition_policy", PREPARED + f", dc AS (SELECT *, {CATEGORY} AS category, {SOUGHT} AND count(*) OVER (PARTITION BY query_id) > 1 AS sought FROM pr), dp AS (SELECT *, CASE WHEN sought THEN CASE category WHEN 'wrapper-export' THEN 0.05 WHEN 'options-shape' THEN 0.08 WHEN 'type-interface' THEN 0.06 WHEN 'module' THEN 0.04 ELSE 0 END ELSE 0 END AS penalty FROM dc), db AS (SELECT *, CASE WHEN max(penalty) OVER (PARTITION BY query_id, path) > 0 AND category = 'implementation' THEN 0.06 ELSE 0 END AS bonus FROM dp) SELECT query_id, id, category, round(score - penalty + bonus, 9)::DOUBLE AS score FROM db")
def definition_policy(spark: SparkSession, root: str) -> DataFrame:
    return r.definition_policy(candidates(spark, root)).select("query_id", "id", "category", "score")


@query("relation_scores", PREPARED + f", re AS (SELECT pr.*, coalesce(ct.content, '') AS content, {DIRECTION} AS direction, lower({TARGET}) AS target, CASE WHEN position % 3 = 0 THEN 'caller' ELSE 'callee' END AS relation, count(*) OVER (PARTITION BY query_id) > 1 AS many FROM pr LEFT JOIN ct USING (content_hash)) SELECT query_id, id, round(score + CASE WHEN many AND direction = 'caller' AND target IS NOT NULL AND {LNAME} = target THEN -0.51 ELSE 0 END + CASE WHEN many AND direction = 'caller' AND {LNAME} <> target AND contains(lower(content), target) AND impl_type AND impl_path THEN 0.18 ELSE 0 END + CASE WHEN many AND relation = direction THEN CASE WHEN test_doc THEN 0.2 ELSE 0.6 END ELSE 0 END, 9)::DOUBLE AS score FROM re")
def relation_scores(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "chunk_embeddings").groupBy(clean_key("content_hash").alias("content_hash")).agg(F.max("chunk_text").alias("content"))
    rows = candidates(spark, root).join(texts, "content_hash", "left").withColumn("relation", F.when(F.col("position") % 3 == 0, "caller").otherwise("callee"))
    return r.relation_scores(rows).select("query_id", "id", "score")


@query("graph_seeds", PREPARED + f", se AS (SELECT *, coalesce(lower(name) = lower({TARGET}), false) AS exact FROM pr), sa AS (SELECT *, max(exact::INT) OVER (PARTITION BY query_id) AS any_ FROM se) SELECT query_id, id FROM sa WHERE CASE WHEN any_ = 1 THEN exact ELSE position = 1 END")
def graph_seeds(spark: SparkSession, root: str) -> DataFrame:
    return r.graph_seeds(candidates(spark, root)).select("query_id", "id")


@query("graph_expand_chunks", PREPARED + f", gs AS (SELECT query_id, id, path FROM pr WHERE position <= 3), gr AS (SELECT gs.query_id, lc.chunk_id AS id, lc.file_path AS path, abs(lc.start_line - s.start_line) % 3 AS depth FROM gs JOIN lc s ON s.chunk_id = gs.id JOIN lc ON lc.file_path = gs.path AND lc.repo = s.repo), fl AS (SELECT query_id, id, max(CASE WHEN {TEST_DOC} THEN 0.72 ELSE 0.97 END - greatest(0, depth - 1) * 0.08) AS floor FROM gr GROUP BY ALL), bo AS (SELECT coalesce(pr.query_id, fl.query_id) AS query_id, coalesce(pr.id, fl.id) AS id, score, floor FROM pr FULL JOIN fl ON pr.query_id = fl.query_id AND pr.id = fl.id) SELECT query_id, id, round(greatest(score, floor), 9)::DOUBLE AS score FROM bo")
def graph_expand_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Result lists with the chunks of the files of their first three, by how far they stand from the hit."""
    rows = candidates(spark, root)
    chunks = live(spark, root)
    lines = chunks.select(F.col("chunk_id").alias("id"), F.col("repo").alias("r"), F.col("start_line").alias("at"))
    seeds = rows.where("position <= 3").select("query_id", "id", F.col("path").alias("file_path")).join(lines, "id").drop("id")
    reached = seeds.join(chunks.select("chunk_id", "file_path", "repo", "start_line"), "file_path").where("repo = r")
    reached = reached.select("query_id", F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), (F.abs(F.col("start_line") - F.col("at")) % 3).alias("depth"))
    return r.with_graph(rows, reached).select("query_id", "id", "score")


@query("tasks_of_kinds", "SELECT kind, CASE WHEN kind IN ('definition', 'implementation-intent', 'config-constant-lookup', 'config-lookup', 'cross-file-relationship') THEN 'definition' WHEN kind = 'test-discovery' THEN 'test_debug' WHEN kind IN ('bug-report', 'bug-error-lookup') THEN 'bug' WHEN kind IN ('identifier-heavy', 'keyword-heavy') THEN 'general' ELSE 'semantic' END AS task FROM (SELECT unnest([" + words(list(intent.TASK_OF_KIND)) + "]) AS kind)")
def tasks_of_kinds(spark: SparkSession, root: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in intent.TASK_OF_KIND], "kind string")
    return kinds.select("kind", intent.task_of_kind(F.col("kind")).alias("task"))


META = ["query_id", "query", "id", "path", "name", "kind"]
FUSED = (
    RERANKED.replace("ca AS (SELECT cj.*, qq.query, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM cj JOIN qq USING (query_id))", """la0 AS (SELECT query_id, id, 'base' AS lane, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cj UNION ALL SELECT query_id, id, 'kind', row_number() OVER (PARTITION BY query_id ORDER BY length(path), id) FROM cj),
fu AS (SELECT query_id, id, round(sum((CASE lane WHEN 'base' THEN 0.6 ELSE 0.2 END)::DOUBLE / (60 + rank)) / (0.8::DOUBLE / 61), 6) AS fused FROM la0 GROUP BY ALL),
ca AS (SELECT * FROM (SELECT cj.* EXCLUDE (score), fu.fused AS score, qq.query, row_number() OVER (PARTITION BY cj.query_id ORDER BY fu.fused DESC, cj.id) AS position FROM cj JOIN qq ON cj.query_id = qq.query_id JOIN fu ON fu.query_id = cj.query_id AND fu.id = cj.id) WHERE position <= 60)""")
)


@query("rank_hybrid_results", FUSED + "SELECT rr.query_id, rr.id, round(ca.score, 6)::DOUBLE AS score, rr.place FROM rr JOIN ca ON ca.query_id = rr.query_id AND ca.id = rr.id WHERE rr.place <= 10")
def rank_hybrid_results(spark: SparkSession, root: str) -> DataFrame:
    """Two lanes fused with the weights of the general recipe, then reranked."""
    rows = candidates(spark, root)
    lane = lambda name, *order: rows.select("query_id", "id", "score", F.lit(name).alias("lane"), F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"))
    lanes = lane("base", F.col("score").desc(), "id").unionByName(lane("kind", F.length("path"), "id"))
    return rank_hybrid(lanes, rows.select(META), {"base": 0.6, "kind": 0.2}, 10, 20)


@query("rank_semantic_only", RERANKED.replace("WHERE head", "WHERE head").replace("AS position FROM cj JOIN qq USING (query_id))", "AS position FROM cj JOIN qq USING (query_id) QUALIFY position <= 40)").replace("intent = 'source' AS src", "true AS src") + "SELECT query_id, id, place FROM rr WHERE place <= 10")
def rank_semantic_only(spark: SparkSession, root: str) -> DataFrame:
    rows = candidates(spark, root)
    return rank_one_lane(rows.select("query_id", "id", "score"), rows.select(META), 10, 20).select("query_id", "id", "place")


@query("incremental_index", "SELECT true AS same_chunks, true AS same_states")
def incremental_index(spark: SparkSession, root: str) -> DataFrame:
    """An index of half the files with older contents, brought up to date, against a fresh one."""
    files = table(spark, root, "source_files").groupBy("file_id").agg(F.max("content").alias("content")).select(F.col("file_id").cast("string").alias("path"), "content")
    old = files.where("content IS NOT NULL").select("path", F.when(F.crc32("path") % 3 == 0, F.concat("content", F.lit("\n// older\n"))).otherwise(F.col("content")).alias("content")).where(F.crc32("path") % 5 != 0)
    index, fresh = indexing.hot_update(indexing.cold_start(old), files), indexing.cold_start(files)
    differ = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    return spark.createDataFrame([(differ(index.chunks, fresh.chunks), differ(index.state, fresh.state))], "same_chunks boolean, same_states boolean")


LANE = f""", dl AS (SELECT query_id, unnest(list_distinct({HINTS})) AS h FROM qq), dn AS (SELECT chunk_id, lower(name) AS n FROM lc WHERE name IS NOT NULL),
dm AS (SELECT query_id, chunk_id, max(CASE WHEN h = n THEN 0.99 ELSE 0.88 END)::DOUBLE AS score FROM dl JOIN dn ON regexp_replace(h, '[^a-z0-9]', '', 'g') = regexp_replace(n, '[^a-z0-9]', '', 'g') GROUP BY ALL),
dp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS place FROM dm) WHERE place <= 20)"""


def _lane(spark: SparkSession, root: str) -> DataFrame:
    named = live(spark, root).where("name IS NOT NULL")
    links = named.select(F.col("chunk_id").alias("symbol_id"), "chunk_id")
    return r.definition_lane(questions(spark, root), named.select(F.col("chunk_id").alias("id"), "name"), links, 20)


@query("symbol_definition_lane", CANDIDATES.rstrip() + LANE + " SELECT query_id, chunk_id, score, place FROM dp")
def symbol_definition_lane(spark: SparkSession, root: str) -> DataFrame:
    return _lane(spark, root)


@query("promoted_definitions", CANDIDATES.rstrip() + LANE + " SELECT coalesce(ca.query_id, dp.query_id) AS query_id, coalesce(ca.id, dp.chunk_id) AS id, greatest(ca.score, dp.score)::DOUBLE AS score FROM ca FULL JOIN dp ON ca.query_id = dp.query_id AND ca.id = dp.chunk_id")
def promoted_definitions(spark: SparkSession, root: str) -> DataFrame:
    return r.with_definitions(candidates(spark, root), _lane(spark, root)).select("query_id", "id", "score")


@query("expected_hits", CANDIDATES + ", gl AS (SELECT query_id, path AS wanted, name AS symbol FROM ca WHERE position = 2) SELECT ca.query_id, ca.id, coalesce((ca.path = wanted OR ends_with(ca.path, '/' || wanted) OR ends_with(wanted, '/' || ca.path)) AND (symbol IS NULL OR ca.name IS NOT DISTINCT FROM symbol), false) AS relevant FROM ca LEFT JOIN gl USING (query_id)")
def expected_hits(spark: SparkSession, root: str) -> DataFrame:
    rows = candidates(spark, root)
    golden = rows.where("position = 2").select("query_id", F.array("path").alias("paths"), F.col("name").alias("symbol"), F.lit(None).cast("int").alias("first_line"), F.lit(None).cast("int").alias("last_line"))
    results = rows.select("query_id", "id", "path", "name", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return evaluate.expected_hits(results, golden).select("query_id", "id", "relevant")


@query("result_positions", CANDIDATES + ", x AS (SELECT query_id, path, kind, name, position AS place FROM ca), y AS (SELECT query_id, path, kind, name, min(place) AS other FROM (SELECT query_id, path, kind, name, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS place FROM ca) WHERE place <= 30 GROUP BY ALL) SELECT x.query_id, x.place::BIGINT AS place, y.other::BIGINT AS other FROM x LEFT JOIN y ON x.query_id = y.query_id AND x.path = y.path AND x.kind IS NOT DISTINCT FROM y.kind AND x.name IS NOT DISTINCT FROM y.name")
def result_positions(spark: SparkSession, root: str) -> DataFrame:
    """Where each result stands in another run."""
    rows = candidates(spark, root).withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    left = rows.withColumn("place", F.col("position").cast("bigint"))
    right = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("id").desc())).cast("bigint")).where("place <= 30")
    return evaluate.same_results(left, right)


@query("symbol_candidates", LIVE + r", c AS (SELECT repo || '/' || file_path AS path, name AS symbol, coalesce(regexp_matches(t, '(?:^|\n)\s*export\s+') OR regexp_matches(t, 'module\.exports|exports\.'), false) AS exported FROM lc LEFT JOIN (SELECT lower(trim(content_hash)) AS h, max(chunk_text) AS t FROM chunk_embeddings GROUP BY ALL) ON h = content_hash WHERE name IS NOT NULL AND lower(symbol_kind) IN ('function', 'method', 'class')) SELECT path, symbol, bool_or(exported) AS exported FROM c GROUP BY ALL")
def symbol_candidates(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "chunk_embeddings").groupBy(clean_key("content_hash").alias("content_hash")).agg(F.max("chunk_text").alias("text"))
    rows = live(spark, root).join(texts, "content_hash", "left")
    return reports.symbol_candidates(rows.select(F.concat_ws("/", "repo", "file_path").alias("path"), "name", F.lower("symbol_kind").alias("kind"), "text"))
