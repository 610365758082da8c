"""Identifiers in queries and how well a chunk answers them; path classes and ranking tokens. All Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the ranking leaves out, parts of paths, chunk types, general terms of compound identifiers, file extensions.
STOP_WORDS = "the and for with from that this into using where what when why how are was were be been being find show get run use code function implementation retrieve results result search pipeline top in on of to by as or an a".split()
TEST_OR_DOC = ["tests/", "__tests__/", "/test/", "fixtures/", "benchmark", "README", "ARCHITECTURE", "docs/"]
NOT_IMPLEMENTATION = ["tests/", "__tests__/", "/test/", "fixtures/", "_artifacts/", "skills/", "benchmark", "/bench/", "readme", "architecture", "docs/", "/www/", "/versioned_docs/", "examples/"]
NOT_SOURCE = ["md", "mdx", "txt", "rst", "adoc", "snap", "json", "yaml", "yml", "lock"]
LIKELY_TEST = ["tests/", "__tests__/", "/test/", ".spec.", ".test.", "fixtures/"]
IMPLEMENTATION_TYPES = "export_statement function function_declaration method method_definition class class_declaration interface type enum module constant".split()
BOOST = {**dict.fromkeys("function function_declaration method method_definition class class_declaration".split(), 0.2), **dict.fromkeys("interface type enum struct impl trait constant".split(), 0.1), "module": -0.1, "other": -0.12}
GENERAL_TERMS = "api app auth base builder cache call callback client config context core data default error event factory handler helper http impl implementation info input internal item json link manager message model module options output parser path proxy query request response result retry route router schema server service shape state transform transformer transport trpc type types utils validate validation wire".split()
HINT_EXTENSIONS = "ts tsx js jsx mjs cjs mts cts py rs go java kt kts swift rb php c h cc cpp cxx hpp cs scala lua sh bash zsh json yaml yml toml".split()
FILE_HINT = r"(?i)\s+\bin\s+[\"'`]?((?:\./)?(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+\.(?:" + "|".join(HINT_EXTENSIONS) + r"))[\"'`]?[\])}>.,;!?]*\s*$"
SEEKING = r"\b(?:function|method|helper|factory|routine|implementation|defined|where\s+does|throw|throws|build|builds|wrap|wraps|return|returns|create|creates|parse|parses|read|reads|call|calls)\b"


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _kept(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def tokens(text: Column) -> Column:
    """Distinct lower-case words longer than one character, without the words left out."""
    return _kept(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", " "), r"\s+"))


def name_tokens(name: Column) -> Column:
    """The words of a name and the name written together."""
    given = F.coalesce(name, F.lit(""))
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(given, r"[_./\\-]+", " "), r"[^\w\s]", " ")), r"\s+")
    return _kept(F.concat(words, F.array(F.regexp_replace(F.lower(given), r"[^\w]", ""))))


def path_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(path), r"[^a-z0-9/._-]", " "), r"[/._-]+"), lambda t: F.length(t) > 1))


def plain_tokens(text: Column) -> Column:
    """Words of the reranker and the query cache: longer than one character, none left out."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", " "), r"\s+"), lambda t: F.length(t) > 1))


def is_test_or_doc(path: Column) -> Column:
    return _any([path.contains(s) for s in TEST_OR_DOC])


def is_likely_test(path: Column) -> Column:
    return _any([F.lower(path).contains(s) for s in LIKELY_TEST])


def is_test_file(path: Column) -> Column:
    """Test files by folder or ending; null paths are none."""
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return p.rlike(r"/tests?/|__tests__|\.(?:test|spec)\.[tj]sx?$|test\.py$")


def is_likely_implementation(path: Column) -> Column:
    low = F.lower(path)
    return ~_any([low.contains(s) for s in NOT_IMPLEMENTATION]) & ~F.element_at(F.split(low, r"\."), -1).isin(*NOT_SOURCE)


def is_implementation_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(*IMPLEMENTATION_TYPES), F.lit(False))


def type_boost(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BOOST.items() for x in kv]), kind), F.lit(0.0))


def unnamed_sibling(kind: Column, name: Column) -> Column:
    """Chunks that give way to a named one of their file: others without a name, modules without or with a bracketed one."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(((kind == "other") & (n == "")) | ((kind == "module") & ((n == "") | (n.startswith("<") & n.endswith(">")))), F.lit(False))


def _words(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def hints(query: Column) -> Column:
    """Lower-case identifiers of a query: words of three or more characters with a capital or an underscore."""
    coded = lambda w: w.rlike("[A-Z]") | w.contains("_") | w.endswith("Results") | w.endswith("Result")
    return F.transform(F.filter(_words(query), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*STOP_WORDS) & coded(w)), F.lower)


def term_hints(query: Column) -> Column:
    return F.filter(F.transform(_words(query), F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def variants(identifier: Column) -> Column:
    """Lower case, and that without signs."""
    return F.array_distinct(F.filter(F.array(F.lower(identifier), compact(identifier)), lambda v: v != ""))


def primary_hint(query: Column) -> Column:
    """The first identifier, else the first longer word; null without either."""
    return F.coalesce(F.get(hints(query), 0), F.get(F.filter(term_hints(query), lambda t: F.length(t) >= 6), 0))


def file_hint(query: Column) -> Column:
    """The path of a query that ends in 'in path/to/file.ext', without a leading './'."""
    raw = F.regexp_extract(query, FILE_HINT, 1)
    return F.when(raw != "", F.regexp_replace(raw, r"^\./", ""))


def without_file_hint(query: Column) -> Column:
    rest = F.trim(F.regexp_replace(query, FILE_HINT, ""))
    return F.when(rest != "", rest).otherwise(query)


def path_has_hint(path: Column, hint: Column) -> Column:
    plain = lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), r"^\./", "")
    return F.contains(plain(path), plain(hint))


def match_score(name: Column, path: Column, wanted: Column, exact: float = 1.0, part: float = 0.8, in_path: float = 0.6) -> Column:
    """Best over the wanted identifiers: the name itself, a part of the name, a part of the path; else 0."""
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(path)
    one = lambda v: F.when(n == v, exact).when(F.contains(n, v), part).when(F.contains(p, v), in_path).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(F.flatten(F.transform(wanted, variants)), one)), F.lit(0.0))


def match_details(name: Column, path: Column, wanted: Column, aliases: Column) -> Column:
    """A struct of the wanted identifiers that are the name, an alias, a part of the name, a part of the path. An identifier
    may stand in several, by its variants."""
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(path)
    other = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower)
    is_name = lambda v: (n == v) | (compact(n) == compact(v))
    is_alias = lambda v: F.exists(other, lambda a: (a == v) | (compact(a) == compact(v)))
    kind = lambda v: F.when(is_name(v), 0).when(is_alias(v), 1).when(F.contains(n, v), 2).when(F.contains(p, v), 3).otherwise(4)
    lowered = F.array_distinct(F.transform(wanted, F.lower))
    having = lambda k: F.filter(lowered, lambda h: F.exists(variants(h), lambda v: kind(v) == k))
    return F.struct(having(0).alias("exact"), having(1).alias("alias"), having(2).alias("part"), having(3).alias("path"))


def compound_specificity(parts: Column) -> Column:
    """How telling several matched identifiers are together."""
    general = F.filter(parts, lambda t: (F.length(compact(t)) <= 4) | compact(t).isin(*GENERAL_TERMS))
    return F.when(F.size(parts) < 2, "not-compound").when(F.size(general) == F.size(parts), "generic-compound").when(F.size(general) == 0, "strong-compound").otherwise("mixed-compound")


def quality(kind: Column, details: Column, seeking: Column, anchored: Column) -> Column:
    """One of seven labels of how an identifier is matched; seeking: the query wants an implementation, anchored: file hint and name fit."""
    return (
        F.when(seeking & F.coalesce(kind.isin("interface", "type"), F.lit(False)), "type-only")
        .when(anchored, "file-anchored-symbol")
        .when(F.size(details["exact"]) > 0, "exact-symbol")
        .when(F.size(details["alias"]) > 0, "alias-symbol")
        .when(F.size(details["part"]) >= 2, "compound-symbol")
        .when((F.size(details["part"]) == 0) & (F.size(details["path"]) > 0), "path-only")
        .otherwise("weak-substring")
    )


def capped_set(before: Column, after: Column, label: Column) -> Column:
    """A score that is set, capped where the match is risky."""
    return F.when(label == "weak-substring", F.least(after, F.greatest(before, F.lit(0.9)))).when(label == "path-only", F.least(after, F.greatest(before, F.lit(0.88)))).when(label == "type-only", F.least(after, F.greatest(before, F.lit(0.86)) - 0.04)).otherwise(after)


def capped_add(before: Column, after: Column, label: Column) -> Column:
    """A score that is raised, less so where the match is risky."""
    gain = after - before
    return F.when(label == "weak-substring", before + gain * 0.25).when(label == "path-only", before + gain * 0.15).when(label == "type-only", before - 0.04).otherwise(after)
