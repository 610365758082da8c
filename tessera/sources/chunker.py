"""Source text to chunks, and the pluggable embedder: the table functions of the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Sizes in characters without white space.
MOST_SOLID, SMALL_GAP, SMALL_FILE = 2000, 400, 800
DIMENSIONS = 8


def solid(text: str) -> int:
    return sum(not c.isspace() for c in text)


def blocks(lines: list[str]) -> list[tuple[int, int]]:
    """Line ranges (end exclusive) that tile a file: a block ends before a line without indentation that follows a blank
    one or a closing line."""
    out, start = [], 0
    for i in range(1, len(lines)):
        opens = lines[i][:1].strip() != "" and lines[i][0] not in "})]"
        if opens and (not lines[i - 1].strip() or lines[i - 1][:1] in "})]") and i > start:
            out.append((start, i))
            start = i
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def chunk_lines(text: str) -> list[tuple[int, int]]:
    """Chunks of a file as 1-based closed line ranges: blocks, small neighbours merged, large ones cut; they
    tile the file without overlap."""
    lines = text.splitlines() or [""]
    merged: list[list[int]] = []
    for a, b in blocks(lines):
        size = solid("\n".join(lines[a:b]))
        if merged and size < SMALL_GAP and solid("\n".join(lines[merged[-1][0] : b])) <= SMALL_GAP:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out: list[tuple[int, int]] = []
    for a, b in merged:
        start, size = a, 0
        for i in range(a, b):
            n = solid(lines[i])
            if size + n > MOST_SOLID and i > start:
                out.append((start + 1, i))
                start, size = i, 0
            size += n
        out.append((start + 1, b))
    return out


def chunk_files(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_no, start_line, end_line, text, whole_file): a file of few characters also comes as a whole.
    Null texts give no chunks; an empty one gives one empty chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                lines = t.splitlines() or [""]
                spans = chunk_lines(t)
                rows += [(k, i, a, b, "\n".join(lines[a - 1 : b]), False) for i, (a, b) in enumerate(spans)]
                if len(spans) > 1 and solid(t) <= SMALL_FILE:
                    rows.append((k, len(spans), 1, len(lines), t, True))
            yield pd.DataFrame(rows, columns=["k", "chunk_no", "start_line", "end_line", "text", "whole_file"])

    kind = files.schema[key].dataType.simpleString()
    sent = files.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return sent.mapInPandas(run, f"k {kind}, chunk_no int, start_line int, end_line int, text string, whole_file boolean").withColumnRenamed("k", key)


def mock_vector(text: str) -> list[float]:
    """A deterministic vector of a text: a polynomial hash modulo 1000 seeds eight values below 1."""
    seed = 0
    for c in text:
        seed = (seed * 31 + ord(c)) % 1000
    return [((seed + 17 * i) % 997) / 997 for i in range(DIMENSIONS)]


def embedder(embed: Callable[[list[str]], list[list[float]]] | None = None) -> Callable[[Column], Column]:
    """A Column function over an embedding back end, called a batch at a time; the mock one by default."""
    back = embed or (lambda texts: [mock_vector(t) for t in texts])

    @pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        given = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if given.any():
            out[given] = pd.Series([np.asarray(v, np.float32) for v in back(texts[given].tolist())], index=texts[given].index)
        return out

    return vectors


def dynamic_batches(items: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy batches in order within each group: a batch closes before the item that would pass the budget; an item over
    the budget stands alone. The running sum resets, which no window can; a group goes to one task, so groups
    must be bounded (partitions of the work, not data keys)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch, used, out = 0, 0, []
        for n in pdf[size].fillna(0):
            if used and used + n > budget:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return pdf.assign(batch=np.array(out, np.int32))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.groupBy(group).applyInPandas(run, f"{schema}, batch int")
