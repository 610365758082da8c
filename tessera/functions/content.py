"""Contents, kinds, digests and paths of the index as Column expressions, and a few plain numbers."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk types and structural kinds of symbol kinds, starts of comment lines, forms of exports, tolerances.
TYPES = {"Function": "function", "Test": "function", "Method": "method", "Class": "class", "Interface": "interface", "Struct": "struct", "Type": "type", "Module": "module", "Constant": "constant"}
KINDS = {"function": "function", "test": "function", "method": "method", "class": "class", "interface": "class", "struct": "class", "trait": "class", "type": "class", "module": "class", "constant": "variable", "variable": "variable"}
COMMENTS = ("//", "#", "/*", "*", "<!--")
EXPORTS = [r"export\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)", r"export\s+(?:default\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)", r"export\s+(?:const|let|var|type|interface|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)", r"exports\.([A-Za-z_$][A-Za-z0-9_$]*)\s*="]
TOLERANCE_RERANKED, TOLERANCE_TOP, TOLERANCE_TAIL = 0.005, 0.005, 0.015


def _of(table: dict[str, str], key: Column, otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(otherwise))


def chunk_type(symbol_kind: Column) -> Column:
    return _of(TYPES, symbol_kind, "other")


def structural_kind(kind: Column) -> Column:
    return _of(KINDS, F.lower(kind), "unknown")


def signature(text: Column) -> Column:
    """The first line that is neither blank nor a comment, trimmed; null without one."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))

    def kept(line: Column) -> Column:
        out = line != ""
        for mark in COMMENTS:
            out = out & ~line.startswith(mark)
        return out

    return F.get(F.filter(lines, kept), 0)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, closed) of a text; empty for a null text."""
    lines = F.split(text, "\n")
    return F.coalesce(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n"), F.lit(""))


def line_starts(text: Column) -> Column:
    """The byte offset at which each line begins."""
    sizes = F.transform(F.split(text, "\n"), lambda x: F.octet_length(x) + 1)
    first = F.array(F.lit(0).cast("int"))
    return F.slice(F.aggregate(sizes, first, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(1), F.size(sizes))


def byte_offset(starts: Column, line: Column, column: Column) -> Column:
    """Offset of a line (from 1) and column; null beyond the text."""
    return F.get(starts, line - 1) + F.greatest(column, F.lit(0))


def digest(*parts: Column) -> Column:
    """md5 of the parts one after another: the input of a stage with the version of what makes it."""
    return F.md5(F.concat(*[p.cast("string") for p in parts]).cast("binary"))


def config_digest(**values: Column) -> Column:
    """md5 of the values by name, whatever order they are given in; nulls count."""
    return F.md5(F.concat_ws("|", *[F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in sorted(values.items())]).cast("binary"))


def named_exports(text: Column) -> Column:
    """Distinct names a script exports: declarations and names in export lists (as given outside)."""
    direct = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in EXPORTS])
    inside = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"export\s*\{([^}]+)\}"), F.lit(1)), lambda b: F.transform(F.split(b, ","), lambda x: F.trim(x))))
    outer = F.transform(F.filter(inside, lambda x: x != ""), lambda x: F.trim(F.element_at(F.split(x, r"(?i)\s+as\s+"), -1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(direct, outer), lambda x: x.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"))))


def search_pattern(symbol: Column, query: Column) -> Column:
    """An alternation of up to six terms: the symbol, then the longer words of the query."""
    words = F.filter(F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9_$]", "")), lambda w: F.length(w) >= 3)
    terms = F.slice(F.array_distinct(F.concat(F.array_compact(F.array(symbol)), words)), 1, 6)
    escaped = F.transform(terms, lambda t: F.regexp_replace(t, r"[.*+?^${}()|\[\]\\]", r"\\$0"))
    return F.array_join(escaped, "|")


def aliases_text(aliases: Column) -> Column:
    return F.array_join(aliases, ",")


def aliases_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def tagged_document(name: Column, kind: Column, symbol: Column, relation: Column, content: Column) -> Column:
    """What a cross encoder reads of a candidate: its tags, then its text."""
    tag = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{label}: "), c, F.lit("]")))
    return F.concat_ws(" ", tag("name", name), tag("kind", kind), tag("symbol", symbol), tag("relation", relation), F.when(content != "", content))


def repository_path(path: Column, root: str) -> Column:
    """A changed path as the index keeps it: relative to the root, with forward slashes and no ./; null outside the root."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    p = F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30)).otherwise(p)
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^(?:\\./)+", ""), "/+", "/"), "/$", "")
    return F.when(~p.startswith("/") & ~p.rlike(r"(?:^|/)\.\.(?:/|$)") & (p != ""), p)


def tolerance(place: Column, reranked: Column) -> Column:
    """By how much a score may drift between two runs (place from 0)."""
    return F.when(reranked, TOLERANCE_RERANKED).when(place < 3, TOLERANCE_TOP).otherwise(TOLERANCE_TAIL)


def spaceless_tokens(text: Column) -> Column:
    """Tokens of a text by its characters other than white space."""
    return F.ceil(F.length(F.regexp_replace(text, r"\s", "")) * 1.4 / 4).cast("bigint")


def hue(text: str) -> int:
    """A hue from a name: a polynomial hash (31) in signed 32 bits, modulo 360."""
    value = 0
    for c in text:
        value = (value * 31 + ord(c)) & 0xFFFFFFFF
    return abs(value - (1 << 32) if value >= 1 << 31 else value) % 360


def backoff_ms(attempt: int, base: int = 1000, jitter: int = 250, rng: random.Random | None = None) -> int:
    """Delay before an attempt: doubled each time, with a jitter to either side."""
    return max(0, base * 2 ** (attempt - 1) + (rng or random).randint(-jitter, jitter))


def embedding_budget(limit: int) -> int:
    """Tokens of one text once a reserve of an eighth, at least 128, is kept."""
    return max(1, limit - max(128, -int(-limit * 0.125 // 1)))


def ignore_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regular expression, negated, only directories) of a line of an ignore file; the path is relative to the file's folder."""
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*|\*|\?)", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^" if anchored else "^(?:.*/)?") + out, negated, folder


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a file is ignored by rules (folder of the ignore file, line), outer folders first and lines in order: the last that
    fits decides, as files of inner folders override outer ones."""
    out = F.lit(False)
    for base, line in rules:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        expression, negated, folder = ignore_regex(line)
        inner = path if not base else F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30))
        out = F.when(F.coalesce(inner.rlike(expression + ("/" if folder else "(?:/|$)")), F.lit(False)), F.lit(not negated)).otherwise(out)
    return out
