"""Source files that do not parse.

Each file is lexed into rows: its distinct pairs of adjacent token classes, its brackets and the shapes of
its bracket groups (lexing.shapes). Three DataFrame checks follow. An anti-join of the pairs against those the
grammar permits (derived from its productions by first, last and follow sets) finds tokens that never stand
together. A window over a file's brackets gives nesting depth, and a window over (file, depth) must find
openings and closings of the same kind in turn. The distinct shapes, far fewer than files, are matched against the statement
productions once each and joined back. A file flagged by any of the three is a candidate; for JSON, TOML,
Python (and YAML where a reader is installed) an exact reader then confirms it.

Defined cases: the extension names the language, unknown ones and Markdown are never flagged; null content is
never flagged; an empty file is valid except as JSON; of repeated rows of a file the one scanned last counts; a
byte-order mark is ignored and all line ends count as line feeds; other columns are dropped.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import grammars as g
from tessera.llm import lexing, scripts
from tessera.session import bounded, cut, parallelism

try:
    import tomllib
except ImportError:  # before Python 3.11
    tomllib = None
try:
    import yaml
except ImportError:
    yaml = None

# Extensions and the languages they stand for.
EXTENSIONS = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sh": "bash", "bash": "bash"}
LEXERS = {"typescript": g.script(True), "javascript": g.script(False), "go": g.GO, "rust": g.RUST, "java": g.JAVA, "json": g.JSON, "toml": g.TOML, "python": g.PYTHON}
CONTEXTS = {"typescript": g.script_context, "javascript": g.script_context, "go": g.go_context, "rust": g.rust_context, "java": g.java_context}
PAREN = {"(", "cond", "loop", "catch", "params", "resources"}
NESTS = {"(": ")", "[": "]", "{": "}", **dict(scripts.SHELL_ENDS.values())}
FLAGGED_BROADCAST = 1_000_000
SHAPES_A_TASK = 200_000
YAML_NEWS = {"\u0085", " ", " "}


@lru_cache(maxsize=1)
def productions() -> dict[str, dict[str, str]]:
    python = g.python_productions()
    return {
        "typescript": g.script_productions(True),
        "javascript": g.script_productions(False),
        "go": g.go_productions(),
        "rust": g.rust_productions(),
        "java": g.java_productions(),
        "json": g.JSON_PRODUCTIONS,
        "toml": g.TOML_PRODUCTIONS,
        "python": python,
        "bash": scripts.shell_productions(),
        "yaml": scripts.YAML_PRODUCTIONS,
    }


END = "\x03"


def adjacency(pattern: str) -> tuple[bool, set[str], set[str], set[tuple[str, str]]]:
    """(nullable, first, last, follow) of the words of a regular expression. Sets of classes are bit masks."""
    from re import _parser as parser

    alphabet = sum(1 << c for c in range(33, 127))
    end = 1 << ord(END)
    follow: set[tuple[int, int]] = set()  # products of last and first sets

    def members(items: list) -> int:
        out, negate = 0, False
        for op, value in items:
            name = str(op)
            if name == "NEGATE":
                negate = True
            elif name == "LITERAL":
                out |= 1 << value
            elif name == "RANGE":
                out |= sum(1 << c for c in range(value[0], value[1] + 1))
        return alphabet & ~out if negate else out

    def sequence(items) -> tuple[bool, int, int]:  # noqa: ANN001
        nullable, first, last = True, 0, 0
        final = len(items) - 1
        for k, item in enumerate(items):
            if k == final and str(item[0]) == "ASSERT" and item[1][0] == 1:
                n, f, l_ = False, sequence(item[1][1])[1], end  # says what follows, takes nothing
            else:
                n, f, l_ = node(item)
            if last and f:
                follow.add((last, f))
            first |= f if nullable else 0
            last = l_ | last if n else l_
            nullable = nullable and n
        return nullable, first, last

    def node(item) -> tuple[bool, int, int]:  # noqa: ANN001
        op, value = item
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            s = 1 << value if name == "LITERAL" else alphabet & ~(1 << value) if name == "NOT_LITERAL" else alphabet if name == "ANY" else members(value)
            return False, s, s
        if name == "SUBPATTERN":
            return sequence(value[3])
        if name == "ATOMIC_GROUP":
            return sequence(value)
        if name == "BRANCH":
            parts = [sequence(x) for x in value[1]]
            first = last = 0
            for _, f, l_ in parts:
                first, last = first | f, last | l_
            return any(p[0] for p in parts), first, last
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            n, f, l_ = sequence(inner)
            if high > 1 and f and l_:
                follow.add((l_, f))
            return n or low == 0, f, l_
        if name == "AT" and str(value) in ("AT_END", "AT_END_STRING"):
            return False, end, end
        return True, 0, 0

    spelled = lambda mask: [chr(c) for c in range(127) if mask >> c & 1]
    nullable, first, last = sequence(parser.parse(pattern))
    return nullable, set(spelled(first)), set(spelled(last)), {(a, b) for x, y in follow for a in spelled(x) for b in spelled(y)}


@lru_cache(maxsize=32)
def permitted(language: str) -> frozenset[tuple[str, str]]:
    """Token pairs that the productions of a language permit, brackets spelled out."""
    out: set[tuple[str, str]] = set()
    ends = scripts.SHELL_ENDS if language == "bash" else {} if language == "yaml" else {"P": ("(", ")"), "B": ("[", "]"), "C": ("{", "}")}
    left = lambda s: ends[s][1] if s in ends else s
    right = lambda s: ends[s][0] if s in ends else s
    for context, pattern in productions()[language].items():
        if (language, context) in (("python", "block"), ("yaml", "line")):
            continue  # heads of lines or lines, not tokens
        nullable, first, last, follow = adjacency(pattern)
        last = last | {a for a, b in follow if b == END}
        first, last, follow = first - {END}, last - {END}, {(a, b) for a, b in follow if END not in (a, b)}
        out |= {(left(a), right(b)) for a, b in follow}
        opening = ("^", "$") if context == "file" else ("{" + context, "}" + context) if language == "bash" else ("[", "]") if context == "[" else ("(", ")") if context in PAREN else ("{", "}")
        out |= {(opening[0], right(x)) for x in first} | {(left(x), opening[1]) for x in last}
        if nullable:
            out.add(opening)
    if language == "python":  # lines are matched one by one
        out |= {(a, b) for a in ";<>" for b in {y for x, y in out if x == "^"} | {"<", "$"}} | {(";", ">"), ("^", "<")}
    return frozenset(out)


def indented(text: str, tokens: list[tuple[str, int, bool]]) -> list[tuple[str, int]]:
    """Python's classes with ';' after logical lines, '>' and '<' for blocks."""
    out: list[tuple[str, int]] = []
    depth, levels = 0, [0]
    for kind, at, broke in tokens:
        if depth == 0 and (broke or not out):
            if out and out[-1][0] != ";":
                out.append((";", at))
            column = len(text[text.rfind("\n", 0, at) + 1 : at].replace("﻿", "").expandtabs(8))
            if column > levels[-1]:
                levels.append(column)
                out.append((">", at))
            while column < levels[-1]:
                levels.pop()
                out.append(("<", at))
            if column != levels[-1]:
                out.append((lexing.ERROR, at))
        if kind in lexing.OPEN:
            depth += 1
        elif kind in lexing.CLOSE:
            depth = max(0, depth - 1)
        out.append((kind, at))
    if out and out[-1][0] != ";":
        out.append((";", len(text)))
    out += [("<", len(text))] * (len(levels) - 1)
    return out


def lexed(language: str, text: str) -> tuple[set[tuple[str, str]], list[tuple[int, str]], set[tuple[str, str]]]:
    """(pairs, brackets, shapes) of one file."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language == "bash":
        tokens = scripts.shell_tokens(text)
        return lexing.pairs(tokens), [(at, k) for k, at in tokens if k in NESTS or k in NESTS.values()], scripts.shell_shapes(tokens)
    if language == "yaml":
        tokens = scripts.yaml_tokens(text)
        return lexing.pairs(tokens), [], scripts.yaml_shapes(tokens)
    lexer = LEXERS[language]
    if language in ("typescript", "javascript", "rust") and text.startswith("#!") and not text.startswith("#!["):
        text = "\n" + text.partition("\n")[2]
    raw = lexer.tokens(text)
    whole = lexing.brackets([(k, at) for k, at, _ in raw])
    raw = g.without_macros(text, raw) if language == "rust" else raw
    classes = indented(text, raw) if language == "python" else lexing.joined(raw, lexer)
    shapes = lexing.shapes(classes, CONTEXTS.get(language, lambda _outer, _before, b: b))
    if language == "python":
        lines = next((s for c, s in shapes if c == "file"), "")
        shapes = {(c, s) for c, s in shapes if c != "file"} | {("file", x) for x in python_lines(lines)} | {("block", x) for x in python_blocks(lines)}
    return lexing.pairs(classes), whole, shapes


def python_lines(lines: str) -> list[str]:
    """Logical lines; a block's opening belongs to the line before it."""
    return re.findall(r"<|[^;<>]*;>?|[^;<>]+|>", lines)


def python_blocks(lines: str) -> list[str]:
    """The heads of each block's lines: compound statements by their keyword, all else as s."""
    out, stack, fresh = [], [""], True
    for i, c in enumerate(lines):
        if c == ">":
            stack.append("")
        elif c == "<":
            out.append(stack.pop() if len(stack) > 1 else "<")
        elif c == ";":
            fresh = True
            continue
        elif fresh:
            head = lines[i + 1 : i + 2] if c == "y" else c
            stack[-1] += head if head in "thzLlIfw" else "s"
        fresh = c in "<>"
    return out + stack


def lex_rows(files: DataFrame) -> DataFrame:
    """(file_id, language, part, at, a, b): part is pair, bracket or shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file_id, language, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pairs, brackets, shapes = lexed(language, content)
                rows += [(file_id, language, "pair", 0, a, b) for a, b in pairs]
                rows += [(file_id, language, "bracket", at, k, "") for at, k in brackets]
                rows += [(file_id, language, "shape", 0, c, s) for c, s in shapes]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file_id", "language", "part", "at", "a", "b"])

    sent = files.where("content IS NOT NULL AND language IS NOT NULL").select(F.col("file_id").cast("bigint").alias("file_id"), "language", "content")
    return sent.mapInArrow(run, "file_id bigint, language string, part string, at bigint, a string, b string")


def permitted_pairs(spark: SparkSession) -> DataFrame:
    """The pair table: as large as the grammars, whatever the data."""
    rows = [(lang, a, b) for lang in [*LEXERS, "bash", "yaml"] for a, b in permitted(lang)]
    return F.broadcast(spark.createDataFrame(rows, "language string, a string, b string"))


def bad_pairs(rows: DataFrame) -> DataFrame:
    pairs = rows.where("part = 'pair'").select("file_id", "language", "a", "b")
    return pairs.join(permitted_pairs(rows.sparkSession), ["language", "a", "b"], "left_anti").select("file_id")


def bad_nesting(rows: DataFrame) -> DataFrame:
    """Files whose brackets don't close, or close another kind."""
    marks = rows.where("part = 'bracket'").select("file_id", "at", "a")
    up = F.col("a").isin(*NESTS)
    order = Window.partitionBy("file_id").orderBy("at")
    marks = marks.withColumn("step", F.when(up, 1).otherwise(-1)).withColumn("depth", F.sum("step").over(order) + F.when(up, 0).otherwise(1))
    level = Window.partitionBy("file_id", "depth").orderBy("at")
    marks = marks.withColumn("before", F.lag("a").over(level)).withColumn("after", F.lead("a").over(level))
    fits = F.lit(False)
    for o, c in NESTS.items():
        fits = fits | ((F.col("a") == o) & (F.col("after") == c)) | ((F.col("a") == c) & (F.col("before") == o))
    return marks.where(~F.coalesce(fits, F.lit(False))).select("file_id")


@lru_cache(maxsize=256)
def production(language: str, context: str) -> re.Pattern | None:
    pattern = productions()[language].get(context)
    return re.compile(pattern) if pattern is not None else None


def fits(language: str, context: str, shape: str) -> bool:
    rule = production(language, context)
    return lexing.ERROR not in shape and (rule is None or rule.fullmatch(shape) is not None)


def bad_shapes(rows: DataFrame) -> DataFrame:
    """Files with a group that no production yields; each distinct shape is matched once."""
    shapes = rows.where("part = 'shape'").select("file_id", "language", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not fits(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # shapes of a context go to the same few tasks, which then compile its productions only
    distinct = shapes.select("language", "a", "b").distinct()
    distinct = cut(distinct)
    spread = max(1, distinct.count() // SHAPES_A_TASK)
    distinct = distinct.repartition(parallelism(rows.sparkSession), "language", "a", F.pmod(F.xxhash64("b"), F.lit(spread)))
    bad = distinct.mapInArrow(run, "language string, a string, b string")
    return shapes.join(bad, ["language", "a", "b"], "left_semi").select("file_id")


def exact_failure(language: str, text: str) -> bool:
    """What an exact reader says of a flagged file; True where there is none."""
    text = text.removeprefix("﻿")
    try:
        if language == "json":

            def refuse(word: str) -> None:
                raise ValueError(word)

            json.loads(text, parse_constant=refuse)
        elif language == "toml" and tomllib:
            tomllib.loads(text)
        elif language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "yaml" and yaml:
            for _ in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
                pass
        else:
            return True
    except Exception:  # noqa: BLE001
        return True
    return False


def confirmed(files: DataFrame, flagged: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [exact_failure(lang, text) for lang, text in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield batch.select(["file_id"]).filter(pa.array(keep, pa.bool_()))

    sent = files.join(bounded(flagged, FLAGGED_BROADCAST), "file_id", "left_semi").select("file_id", "language", "content")
    return sent.mapInArrow(run, f"file_id {files.schema['file_id'].dataType.simpleString()}")


def current_files(source_files: DataFrame) -> DataFrame:
    """One row per file, the one scanned last, with the language of its extension (null if unchecked)."""
    pick = F.max(F.struct("scanned_at", "content", "repo", "file_path")).alias("_r")
    rows = source_files.where("file_id IS NOT NULL").groupBy("file_id").agg(pick).select("file_id", "_r.repo", "_r.file_path", "_r.content")
    extension = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return rows.withColumn("language", F.try_element_at(names, extension))


def failing(files: DataFrame) -> DataFrame:
    """Ids of the files that do not parse."""
    rows = cut(lex_rows(files))
    flagged = cut(bad_pairs(rows).unionByName(bad_nesting(rows)).unionByName(bad_shapes(rows)).distinct())
    return confirmed(files, flagged)


def failure_rates(files: DataFrame, bad: DataFrame, index_stats: DataFrame) -> DataFrame:
    """Per repository and language: files, failures, their rate, and what the index runs reported: distinct
    paths, and how many of these fail here too."""
    reported = index_stats.select("repo", F.explode("parse_failures").alias("file_path")).where("file_path IS NOT NULL").distinct().withColumn("reported", F.lit(1))
    rows = files.drop("content").join(bad.withColumn("failed", F.lit(1)), "file_id", "left").join(reported, ["repo", "file_path"], "left")
    language = F.coalesce("language", F.lit("other"))
    both = F.coalesce(F.col("failed") * F.col("reported"), F.lit(0))
    out = rows.groupBy("repo", language.alias("language")).agg(
        F.count("*").alias("n_files"), F.sum(F.coalesce("failed", F.lit(0))).alias("n_failed"), F.sum(F.coalesce("reported", F.lit(0))).alias("n_reported"), F.sum(both).alias("n_both")
    )
    return out.withColumn("failure_rate", F.round(F.col("n_failed") / F.col("n_files"), 6))
