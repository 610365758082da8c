"""Text, identifier and path functions as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import identifiers

RAW_TOKEN = r"[\p{L}\p{N}_/.\\-]+"
# Path parts and extensions the ranking treats apart, and languages by extension.
TEST_OR_DOC = ["/tests/", "__tests__", ".test.", ".spec.", "/docs/", "README", "CHANGELOG", ".md"]
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(RAW_TOKEN), F.lit(0))


def camel_words(text: Column) -> Column:
    """A space at every camel-case boundary, in two passes without lookaround."""
    return F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")


def token_variants(token: str | Column) -> Column:
    """Distinct lower-case forms of a raw token: whole, path, dotted, underscored and camel-case parts."""
    t = _col(token)
    parts = F.concat(F.array(t), F.split(t, r"[/\\]"), F.split(t, r"[/\\.]"), F.split(t, r"[/\\_\-]"), F.split(t, r"[/\\._\-]"), F.split(camel_words(t), r"[/\\._\- ]"))
    return F.filter(F.array_distinct(F.transform(parts, F.lower)), lambda p: p != "")


def identifier_words(name: str | Column) -> Column:
    """Lower-case words of an identifier, joined by blanks."""
    return F.btrim(F.regexp_replace(F.lower(camel_words(_col(name))), r"[^\p{L}\p{N}]+", " "))


def ranking_tokens(text: str | Column) -> Column:
    """See tessera.functions.identifiers."""
    return identifiers.tokens(_col(text))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_test_or_doc(path: str | Column) -> Column:
    p = F.concat(F.lit("/"), _col(path))
    out = F.lit(False)
    for part in TEST_OR_DOC:
        out = out | p.contains(part)
    return out


def language_of(path: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def parent_path(path: str | Column) -> Column:
    """Directory of a path; a top-level path has none."""
    p = _col(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", ""))


def depth(path: str | Column) -> Column:
    return F.size(F.split(_col(path), "/"))


def ancestors(path: str | Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** crosses directories, * doesn't, ? is any character, {a,b} a choice."""
    out, i, depth = "", 0, 0
    if pattern.startswith("**/"):
        out, i = "(?:.*/)?", 3
    while i < len(pattern):
        c = pattern[i]
        step = 1
        if pattern[i : i + 2] == "**":
            out, step = out + ".*", 2
        elif c in "*?":
            out += "[^/]*" if c == "*" else "."
        elif c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in ".+()[]^$|\\{}" else c
        i += step
    return f"^{out}$"


def content_id(prefix: str, *parts: str | Column) -> Column:
    """A stable id of some fields."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", *[_col(p).cast("string") for p in parts]).cast("binary")), 1, 16))


def estimated_tokens(text: str | Column) -> Column:
    return F.ceil(F.length(_col(text)) / 4).cast("bigint")


def embedding_text(path: Column, name: Column, text: Column, budget_chars: int) -> Column:
    """What an embedder gets of a chunk: file and symbol, the symbol's words, the text, within a budget."""
    head = F.concat_ws("\n", F.concat(F.lit("file: "), path), F.concat(F.lit("symbol: "), name), F.concat(F.lit("terms: "), identifier_words(name)), text)
    return F.substring(head, 1, budget_chars)
