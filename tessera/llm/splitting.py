"""Splitting oversized items at natural boundaries, all greedy cuts at once by pointer doubling.

Every code-point boundary of a text is a node. Its successor is the farthest legal next cut: a piece
that ends there starts overlap_bytes before the node and has at most max_bytes. Among the legal ends
the last line end counts (a blank line in the farther half of the reach is preferred), else the last
white space, else the last code point (never inside a CR LF pair, unless nothing else is legal).
The greedy cuts are the nodes reachable from 0; they are derived by squaring the successor table
(reach 1, 2, 4 ... cuts), log2(pieces) table look-ups instead of one step per piece.

A text is one row, so its tables are arrays beside it and no exchange is needed; only texts over
their limit enter Python.

Defined cases: a text within its limit, empty or null gives no pieces; limits below 4 bytes count as
4 (a code point must fit); an overlap is cut to max_bytes - 4, and widened by up to 3 bytes to begin at a code
point where that fits, else narrowed; of repeated rows of an id the greatest counts; unknown or null languages use
the row ``default``; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import bounded

#: Rows of a table of limits up to which it is broadcast.
LIMIT_ROWS = 10_000


def successors(data: np.ndarray, max_bytes: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nodes (byte offsets of all boundaries), the byte at which a piece that follows the node
    starts, and the index of each node's successor."""
    n = len(data)
    max_bytes = max(4, max_bytes)
    overlap = max(0, min(overlap, max_bytes - 4))
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)
    if starts[0] != 0:
        starts = np.insert(starts, 0, 0)
    is_lf, is_cr = data == 10, data == 13
    after = np.zeros(n + 1, bool)
    after[1:] = is_lf
    after[1:n] |= is_cr[:-1] & ~is_lf[1:]
    if n:
        after[n] |= is_cr[-1]
    lines = np.flatnonzero(after)
    bare = np.array([not data[a:b].tobytes().strip() for a, b in zip(np.insert(lines, 0, 0)[:-1], lines, strict=True)], bool) if len(lines) else np.zeros(0, bool)
    blanks = lines[bare]
    spaces = np.flatnonzero(np.isin(data, (9, 32))) + 1
    inside_crlf = np.zeros(n + 1, bool)
    inside_crlf[1:n] = is_cr[:-1] & is_lf[1:]
    whole = starts[~inside_crlf[starts]]
    begin = starts[np.maximum(np.searchsorted(starts, starts - overlap, "right") - 1, 0)]
    # four bytes stay for new text; where widening leaves less, the overlap is narrowed
    narrow = starts[np.minimum(np.searchsorted(starts, starts - overlap, "left"), len(starts) - 1)]
    begin = np.where(starts - begin > max_bytes - 4, np.minimum(narrow, starts), begin)
    begin[0] = 0
    reach = begin + max_bytes

    def last(bounds: np.ndarray) -> np.ndarray:
        if not len(bounds):
            return np.zeros(len(starts), np.int64)
        at = np.searchsorted(bounds, reach, "right") - 1
        return np.where(at >= 0, bounds[np.maximum(at, 0)], 0)

    best = last(starts)
    for bounds in (whole, spaces, lines):
        end = last(bounds)
        best = np.where(end > starts, end, best)
    end = last(blanks)
    best = np.where(end > (starts + reach) // 2, end, best)
    best = np.where(reach >= n, n, best)
    return starts, begin, np.searchsorted(starts, best)


def cuts(data: np.ndarray, max_bytes: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each piece."""
    nodes, begin, step = successors(data, max_bytes, overlap)
    reached = np.zeros(len(nodes), bool)
    reached[0] = True
    while True:
        reached[step[reached]] = True
        if step[0] == len(nodes) - 1:
            break
        step = step[step]
    ends = np.flatnonzero(reached)
    return begin[ends[:-1]], nodes[ends[1:]]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False):
            raw = row.text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, np.uint8)
            breaks = np.append(0, np.cumsum((data == 10) | ((data == 13) & (np.append(data[1:], 0) != 10))))
            for no, (a, b) in enumerate(zip(*cuts(data, int(row.max_bytes), int(row.overlap_bytes)), strict=True)):
                first = int(breaks[a])
                final = int(breaks[b]) - int(b > a and breaks[b] > breaks[b - 1])
                out.append((row.id, no, int(a), int(b), first, final, raw[a:b].decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["id", "piece_no", "byte_from", "byte_to", "line_from", "line_to", "text"])


def oversized(items: DataFrame, limits: DataFrame, item: str) -> DataFrame:
    """Items over the limit of their language, once each, with the limits that hold for them."""
    language = F.lower(F.btrim("language"))
    own = limits.select(language.alias("_l"), F.col("max_bytes").alias("_m"), F.col("overlap_bytes").alias("_o"))
    rest = limits.where(language == "default").select("max_bytes", "overlap_bytes").limit(1).collect()
    most, shared = (rest[0][0], rest[0][1]) if rest else (None, None)
    rows = items.select(item, "start_byte", "start_line", "text", language.alias("_l")).where(F.col(item).isNotNull())
    rows = rows.join(bounded(own, LIMIT_ROWS), "_l", "left")
    limit, overlap = F.coalesce("_m", F.lit(most).cast("int")), F.coalesce("_o", F.lit(shared).cast("int"))
    rows = rows.select(item, "start_byte", "start_line", "text", limit.alias("max_bytes"), overlap.alias("overlap_bytes"))
    over = rows.where(F.octet_length("text") > F.col("max_bytes"))
    pick = F.max(F.struct("text", "start_byte", "start_line", "max_bytes", "overlap_bytes")).alias("_r")
    return over.groupBy(item).agg(pick).select(item, "_r.*")


def split_items(items: DataFrame, limits: DataFrame, item: str) -> DataFrame:
    """The pieces of all oversized items: byte_from, byte_to and line_from, line_to count from 0 in the
    text and are always right; start_byte, end_byte, start_line and end_line are those of
    the file as far as the item's own start is right."""
    over = oversized(items, limits, item)
    sent = over.select(F.col(item).alias("id"), "text", "max_bytes", "overlap_bytes")
    kind = items.schema[item].dataType.simpleString()
    pieces = sent.mapInPandas(_pieces, f"id {kind}, piece_no int, byte_from bigint, byte_to bigint, line_from int, line_to int, text string")
    spans = over.select(F.col(item).alias("id"), "start_byte", "start_line")
    return pieces.join(spans, "id").select(
        F.col("id").alias(item),
        "piece_no",
        "byte_from",
        "byte_to",
        (F.col("start_byte") + F.col("byte_from")).alias("start_byte"),
        (F.col("start_byte") + F.col("byte_to")).alias("end_byte"),
        (F.col("start_line") + F.col("line_from")).alias("start_line"),
        (F.col("start_line") + F.col("line_to")).alias("end_line"),
        "text",
    )


def oversized_ids(items: DataFrame, limits: DataFrame, item: str) -> DataFrame:
    """Ids of the items that were split, from their pieces."""
    sent = oversized(items, limits, item).select(F.col(item).alias("id"), "text", "max_bytes", "overlap_bytes")
    kind = items.schema[item].dataType.simpleString()
    pieces = sent.mapInPandas(_pieces, f"id {kind}, piece_no int, byte_from bigint, byte_to bigint, line_from int, line_to int, text string")
    return pieces.where("piece_no = 1").select(F.col("id").alias(item))
