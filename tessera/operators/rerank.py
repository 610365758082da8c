"""Reranking of result lists: deterministic boosts with sibling suppression, task factors, identifier lane, policies for
definitions and relations. A result list is a DataFrame with query_id, query, id, score, path, name, kind and position.

The rows of a query are a bounded pool (``pool``), so its windows are small however many queries there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identifiers as i
from tessera.functions import intent

# Boosts and penalties of the deterministic order, of relations and of definitions.
NAME_HIT, PATH_HIT, KIND_HIT, COVERAGE, COVERAGE_MOST = 0.08, 0.03, 0.02, 0.06, 0.12
IMPLEMENTATION_PATH, TEST_DOC, TEST_PATH, README, IDENTIFIER, SIBLING, TYPE_ON_DEFINITION = 0.08, 0.12, 0.16, 0.08, 0.12, 0.10, 0.15
CALLER_TARGET, CALLER_CONTENT, RELATION_SOURCE, RELATION_TEST_DOC, SEMANTIC_TEST_DOC = 0.51, 0.18, 0.6, 0.2, 0.35
GRAPH_SOURCE, GRAPH_TEST_DOC, GRAPH_DECAY = 0.97, 0.72, 0.08
LANE_EXACT_FILE, LANE_BASE, LANE_SCALE = 0.995, 0.9, 0.09
PENALTIES = {"wrapper-export": 0.05, "options-shape": 0.08, "type-interface": 0.06, "module": 0.04}
BONUS, SAME_FILE_BONUS = 0.035, 0.025
PENALTY_BY_TASK = {"definition": 0.5, "semantic": 0.45}
SYMBOL_EXACT, SYMBOL_FUZZY = 0.99, 0.88
POOL = 50


def pool_size(limit: int, filtered: bool = False) -> int:
    """How many candidates a lane fetches for a result list of ``limit``; filters applied afterwards need more."""
    size = max(POOL, 4 * limit)
    return max(100, 5 * size) if filtered else size


def pool(rows: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows of each query by position."""
    order = Window.partitionBy("query_id").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def with_signals(rows: DataFrame) -> DataFrame:
    """rows with what the query and each candidate have in common."""
    words, names, paths, kinds = i.tokens(F.col("query")), i.name_tokens(F.col("name")), i.path_tokens(F.col("path")), i.tokens(F.col("kind"))
    out = rows.withColumns({"words": words, "_names": names, "_paths": paths, "_kinds": kinds, "hints": i.hints(F.col("query"))})
    near = lambda t: F.exists("_names", lambda n: (n == t) | n.startswith(t) | t.startswith(n))
    low_name, low_path = F.lower(F.coalesce("name", F.lit(""))), F.lower("path")
    return out.withColumns(
        {
            "name_hits": F.size(F.filter("words", near)),
            "path_hits": F.size(F.array_intersect("words", "_paths")),
            "kind_hits": F.size(F.array_intersect("words", "_kinds")),
            "has_identifier": F.exists("hints", lambda h: F.contains(low_path, h) | F.contains(low_name, h)),
            "test_doc": i.is_test_or_doc(F.col("path")),
            "implementation_path": i.is_likely_implementation(F.col("path")),
            "implementation_type": i.is_implementation_type(F.col("kind")),
            "source": intent.source_intent(F.col("query"), F.col("words"), F.col("hints")) == "source",
            "readme": low_path.contains("readme"),
        }
    ).drop("_names", "_paths", "_kinds")


def deterministic(rows: DataFrame, top_n: int, task: str = "general", preference: str = "auto") -> DataFrame:
    """(query_id, id, boosted, place): the first top_n of each query in a new order, the others after them as they were.
    preference: auto (by the query), source, test or balanced. Unnamed siblings of named chunks of their file fall back."""
    r = with_signals(rows)
    source = F.lit(True) if preference == "source" else F.lit(False) if preference in ("test", "balanced") else F.col("source")
    tests = F.lit(preference == "test")
    flag = lambda cond, v: F.when(cond, v).otherwise(0.0)
    coverage = (F.col("name_hits") + F.col("path_hits") + F.col("kind_hits")) / F.greatest(F.size("words"), F.lit(1))
    boost = (
        F.col("name_hits") * NAME_HIT + F.col("path_hits") * PATH_HIT + F.col("kind_hits") * KIND_HIT + F.least(F.lit(COVERAGE_MOST), coverage * COVERAGE)
        + flag(F.col("has_identifier"), IDENTIFIER) + flag(source & F.col("implementation_path"), IMPLEMENTATION_PATH) - flag(source & F.col("test_doc"), TEST_DOC)
        + flag(tests & F.col("test_doc"), TEST_PATH) + flag(~source & F.col("readme"), README) + i.type_boost(F.col("kind"))
    )
    if task == "definition":
        boost = boost - flag(F.coalesce(F.col("kind").isin("interface", "type"), F.lit(False)), TYPE_ON_DEFINITION)
    r = r.withColumn("head", (F.col("position") <= top_n) & (F.size("words") > 0) & F.lit(top_n > 0))
    named = F.max(F.when(F.col("head") & (F.trim(F.coalesce("name", F.lit(""))) != ""), 1).otherwise(0)).over(Window.partitionBy("query_id", "path"))
    sibling = i.unnamed_sibling(F.col("kind"), F.col("name")) & (named == 1)
    r = r.withColumn("boosted", F.when(F.col("head"), F.round(F.col("score") + boost - flag(sibling, SIBLING), 9)))
    one = lambda c: F.when(c, 1).otherwise(0)
    docs = intent.doc_intent(F.col("words")) == "docs"
    first = F.when(source, one(F.col("has_identifier"))).when(tests, one(F.col("test_doc"))).when(docs, one(F.col("readme"))).otherwise(0)
    second = F.when(source, one(F.col("implementation_type"))).when(tests, one(F.col("has_identifier"))).otherwise(0)
    third = F.when(source, one(F.col("implementation_path"))).otherwise(0)
    fourth = F.when(source, -one(F.col("test_doc"))).otherwise(0)
    head = F.col("head")
    keys = [head.desc(), F.when(head, first).desc(), F.when(head, second).desc(), F.when(head, third).desc(), F.when(head, fourth).desc(), F.col("boosted").desc_nulls_last(), F.when(head, F.col("score")).desc_nulls_last(), F.col("position"), F.col("id")]
    return r.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)).cast("bigint")).select("query_id", "id", "boosted", "place")


def ordered(rows: DataFrame, score: Column) -> DataFrame:
    """(query_id, id, score, place) by a changed score; ties keep their order."""
    out = rows.withColumn("score", F.round(score, 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "position", "id")
    return out.withColumn("place", F.row_number().over(order).cast("bigint"))


def task_factor(kind: Column, chunk_kind: Column, symbol_kind: Column, task: Column) -> Column:
    """Multiplier after reranking: tests and documents hardly count for a bug, whole modules less for tests."""
    test_doc = F.coalesce(chunk_kind.isin("Test", "Doc"), F.lit(False))
    coarse = F.coalesce(kind == "module", F.lit(False)) | F.coalesce(chunk_kind == "File", F.lit(False)) | F.coalesce(symbol_kind == "Module", F.lit(False))
    return F.when((task == "bug") & test_doc, 0.05).when((task == "test_debug") & coarse, 0.75).otherwise(1.0)


def chunk_kind_factor(chunk_kind: Column, task: str) -> Column:
    return F.when(F.coalesce(chunk_kind.isin("Test", "Doc"), F.lit(False)), PENALTY_BY_TASK.get(task, 1.0)).otherwise(1.0)


def joint_score(query: Column, path: Column, name: Column, content: Column, base: Column, is_test: Column, task: str) -> Column:
    """The local reranker: a weighted sum of the base score and of the words a query shares with name, path and content."""
    if task == "general":
        return base
    words, n, body, low = i.plain_tokens(query), F.lower(F.coalesce(name, F.lit(""))), F.lower(content), F.lower(query)
    parts = F.array_distinct(F.filter(F.split(F.lower(path), r"[/._-]+"), lambda t: F.length(t) > 1))
    share = lambda other: F.size(F.array_intersect(words, other))
    in_name, in_path, in_body = share(i.plain_tokens(name)), share(parts), share(i.plain_tokens(content))
    exact = F.when((n != "") & F.contains(low, n), 0.4).otherwise(0.0)
    phrase = F.when(F.contains(body, low), 0.25).otherwise(0.0)
    trace = F.when(low.rlike(r"\b(?:error|exception|stack|trace|abort)\b") & body.rlike(r"\b(?:error|exception|throw|abort|fail)\b"), 0.14).otherwise(0.0)
    bias = {
        "definition": exact + in_name * 0.16 + in_path * 0.05,
        "bug": in_body * 0.12 + in_path * 0.06 + in_name * 0.05 + phrase + exact * 0.5 + trace + F.when(is_test, 0.04).otherwise(0.0),
        "semantic": in_body * 0.1 + phrase,
        "test_debug": F.when(is_test, 0.18).otherwise(-0.04) + in_body * 0.08 + in_path * 0.05,
    }[task]
    return base * 0.6 + in_body * 0.06 + in_path * 0.04 + in_name * 0.08 + exact + phrase + bias


def identifier_lane(rows: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, match, place): candidates of implementation files and types that match the query's identifiers, for
    queries that look for source; a name that fits the first identifier in the file the query names comes first."""
    q = F.col("query")
    r = rows.withColumns({"words": i.tokens(q), "hints": i.hints(q), "primary": i.primary_hint(q), "file_hint": i.file_hint(q)})
    r = r.where((intent.source_intent(q, F.col("words"), F.col("hints")) == "source") & F.col("primary").isNotNull() & i.is_likely_implementation(F.col("path")) & i.is_implementation_type(F.col("kind")))
    wanted = F.slice(F.filter(F.array_distinct(F.transform(F.concat(F.array("primary"), F.col("hints"), i.term_hints(q)), F.lower)), lambda h: F.length(h) >= 3), 1, 8)
    fits = i.compact(F.coalesce("name", F.lit(""))) == i.compact(F.col("primary"))
    anchored = F.coalesce(i.path_has_hint(F.col("path"), F.col("file_hint")), F.lit(False)) & fits
    r = r.withColumn("anchored", anchored).withColumn("match", F.when(F.col("anchored"), 1.0).otherwise(i.match_score(F.col("name"), F.col("path"), wanted, 1.0, 0.85, 0.7))).where("match >= 0.7")
    order = Window.partitionBy("query_id").orderBy(F.col("anchored").desc(), F.col("match").desc(), F.col("score").desc(), "id")
    score = F.when(F.col("anchored"), LANE_EXACT_FILE).otherwise(F.least(F.lit(1.0), LANE_BASE + F.col("match") * LANE_SCALE))
    ranked = r.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= max(2 * limit, 12))
    return ranked.select("query_id", "id", F.round(score, 9).alias("score"), "match", "place")


def without_coarse(rows: DataFrame) -> DataFrame:
    """Result lists without their File chunks where some finer chunk answers an identifier of the query (column chunk_kind)."""
    hints = i.hints(F.col("query"))
    coarse = F.coalesce(F.col("chunk_kind") == "File", F.lit(False))
    n, p = F.lower(F.coalesce("name", F.lit(""))), F.lower("path")
    answers = ~coarse & F.exists(hints, lambda h: F.exists(i.variants(h), lambda v: F.contains(n, v) | F.contains(p, v)))
    found = F.max(answers.cast("int")).over(Window.partitionBy("query_id"))
    return rows.withColumn("_found", found).where(~(coarse & (F.col("_found") == 1))).drop("_found")


def definition_category(path: Column, kind: Column, name: Column) -> Column:
    test = path.rlike(r"(?i)(^|/)(__tests__|tests?|spec|test)(/|$)|\.(test|spec)\.[cm]?[tj]sx?$")
    doc = path.rlike(r"(?i)(^|/)(docs?|documentation)(/|$)|\.(md|mdx|rst)$")
    shape = F.coalesce(kind.isin("type", "interface"), F.lit(False))
    n = F.coalesce(name, F.lit(""))
    module = F.coalesce(kind == "module", F.lit(False))
    return (
        F.when(test, "test").when(doc, "doc").when(module & n.startswith("export{"), "wrapper-export").when(shape & n.rlike(r"(Options|Config|Params|Args|Props)$"), "options-shape")
        .when(shape, "type-interface").when(module, "module").when(F.coalesce(kind.isin("function", "method", "class", "constant"), F.lit(False)), "implementation").otherwise("other")
    )


def definition_policy(rows: DataFrame) -> DataFrame:
    """Scores of queries that seek an implementation: shapes, wrappers and modules lose, an implementation in a file that lost gains."""
    category = definition_category(F.col("path"), F.col("kind"), F.col("name"))
    sought = intent.seeks_implementation(F.col("query")) & (F.count("*").over(Window.partitionBy("query_id")) > 1)
    penalty = F.when(sought, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv]), category), F.lit(0.0))).otherwise(0.0)
    r = rows.withColumn("category", category).withColumn("_penalty", penalty)
    lost = F.max("_penalty").over(Window.partitionBy("query_id", "path")) > 0
    bonus = F.when(lost & (F.col("category") == "implementation"), BONUS + SAME_FILE_BONUS).otherwise(0.0)
    return ordered(r.withColumn("_bonus", bonus), F.col("score") - F.col("_penalty") + F.col("_bonus"))


def relation_scores(rows: DataFrame) -> DataFrame:
    """Scores of relation queries (columns content, relation): the target itself loses in a search for its callers, sources that
    mention it gain, and so do direct relations."""
    q = F.col("query")
    direction, target = intent.relation(q), F.lower(intent.relation_target(q))
    many = F.count("*").over(Window.partitionBy("query_id")) > 1
    n = F.lower(F.coalesce("name", F.lit("")))
    calling = many & F.coalesce((direction == "caller") & target.isNotNull(), F.lit(False))
    mentions = calling & (n != target) & F.contains(F.lower(F.coalesce("content", F.lit(""))), target) & i.is_implementation_type(F.col("kind")) & i.is_likely_implementation(F.col("path"))
    direct = many & F.coalesce(F.col("relation") == direction, F.lit(False))
    change = F.when(calling & (n == target), -CALLER_TARGET).otherwise(0.0) + F.when(F.coalesce(mentions, F.lit(False)), CALLER_CONTENT).otherwise(0.0)
    change = change + F.when(direct, F.when(i.is_test_or_doc(F.col("path")), RELATION_TEST_DOC).otherwise(RELATION_SOURCE)).otherwise(0.0)
    return ordered(rows, F.col("score") + change)


def graph_seeds(rows: DataFrame) -> DataFrame:
    """The candidates a relation query's walk begins at: those named as its target, else the first one."""
    target = F.lower(intent.relation_target(F.col("query")))
    exact = F.coalesce(F.lower("name") == target, F.lit(False))
    r = rows.withColumn("_exact", exact).withColumn("_any", F.max(F.col("_exact").cast("int")).over(Window.partitionBy("query_id")))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    return r.where(F.when(F.col("_any") == 1, F.col("_exact")).otherwise(F.col("_n") == 1)).drop("_exact", "_any", "_n")


def with_graph(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """Result lists with what a walk reached (query_id, id, depth, path): each at least at the floor of its depth."""
    floor = F.when(i.is_test_or_doc(F.col("path")), GRAPH_TEST_DOC).otherwise(GRAPH_SOURCE) - F.greatest(F.lit(0), F.col("depth") - 1) * GRAPH_DECAY
    met = reached.groupBy("query_id", "id").agg(F.max(floor).alias("floor"))
    both = rows.select("query_id", "id", "score").join(met, ["query_id", "id"], "full")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return both.select("query_id", "id", F.round(F.greatest("score", "floor"), 9).alias("score")).withColumn("place", F.row_number().over(order).cast("bigint"))


def scored_stage(stages: Column, name: str, kind: str, before: Column, after: Column, reason: Column) -> Column:
    """The stages that explain a score with one more."""
    return F.array_append(stages, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), before.alias("before"), after.alias("after"), reason.alias("reason")))


def definition_lane(queries: DataFrame, symbols: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, score, place): symbols whose name is an identifier of the query (0.99), or is one but for its signs (0.88),
    with the chunk of each (symbols: id, name; chunks: symbol_id, chunk_id). Names meet by equality, hot ones as often as queries ask."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(i.hints(F.col("query")))).alias("h")).withColumn("key", i.compact(F.col("h")))
    named = symbols.select(F.col("id").alias("symbol_id"), F.lower("name").alias("n")).withColumn("key", i.compact(F.col("n")))
    met = wanted.join(named, "key").withColumn("s", F.when(F.col("h") == F.col("n"), SYMBOL_EXACT).otherwise(SYMBOL_FUZZY))
    rows = met.join(chunks, "symbol_id").groupBy("query_id", "chunk_id").agg(F.max("s").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= limit)


def with_definitions(rows: DataFrame, lane: DataFrame) -> DataFrame:
    """Result lists with the definition lane: each of its chunks at least at the lane's score, in a new order."""
    both = rows.select("query_id", "id", "score").join(lane.select("query_id", F.col("chunk_id").alias("id"), F.col("score").alias("floor")), ["query_id", "id"], "full")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return both.select("query_id", "id", F.greatest("score", "floor").alias("score")).withColumn("place", F.row_number().over(order).cast("bigint"))
