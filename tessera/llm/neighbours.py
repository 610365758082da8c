"""Most similar vectors of every vector: inverted lists, score-aware four-bit codes, exact reranking.

Vectors are scaled to unit length, so cosine is an inner product. A bounded sample (SAMPLE vectors a
model) fits, on the driver, spherical list centres and product-quantisation codebooks of 16 words.
The codebooks minimise the score-aware loss |r|^2 + (eta - 1) (r.x)^2 of the residual r, which weighs
the part parallel to the vector eta times as much: that part is what spoils the scores of near
vectors. Codes are assigned and words refitted by coordinate descent under that loss. Every row is
then indexed: it is stored in its nearest list with two four-bit codes a byte and asks its ``probes`` nearest
lists. A cell, one block of a list's members against one block of its askers, is scanned by table
look-ups (one 256-entry table for each byte of the codes); the best ``rerank`` of each asker are scored
exactly and the best k kept. Blocks have at most BLOCK vectors, so a list with a third of all rows is
many cells; all blocks of members meet all blocks of askers, so nothing is lost.

Exact copies share one class (the 64-bit hash of model and unit vector): the scan sees a vector once
however many rows carry it, and membership is joined back.

Cost: with lists of ``list_size`` vectors, N x probes x list_size look-ups, so linear in N. The first level has at most
LISTS lists; a model with more than LISTS x list_size vectors has its lists divided again, each by centres of its own,
which travel as rows to the blocks of their list (``refined``). What travels in task closures is bounded: models are indexed in
waves of at most WAVE_BYTES. Vectors without structure, for which the tenth neighbour is hardly nearer than the hundredth, need
``share`` = 1: all lists, quadratic work.

Defined cases: null, empty, all-zero and non-finite vectors have no neighbours and are nobody's;
null models or keys are ignored; vectors of another length than their model's most frequent
one form an index of their own; a table without vectors gives an empty result; a vector isn't its own neighbour, copies under another
key are, at 1.0; ties are settled by class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import bounded, cut

SAMPLE = 16_000
LISTS = 4096
BLOCK = 8192
WORD = 4  # dimensions a four-bit code stands for
THRESHOLD = 0.5  # score from which the loss shall be good: sets eta
WAVE_BYTES = 256 << 20  # samples and centres of the models indexed at once


@dataclass
class Index:
    centres: np.ndarray  # lists x d
    words: np.ndarray  # codes x 16 x WORD
    eta: float

    @property
    def padded(self) -> int:
        return len(self.words) * WORD


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_centres(x: np.ndarray, lists: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds if lists > 1 else 1):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=lists) == 0
        c = np.where(empty[:, None], c, _unit(sums)).astype(np.float32)
    return c


def _pad(x: np.ndarray, to: int) -> np.ndarray:
    return x if x.shape[1] == to else np.pad(x, ((0, 0), (0, to - x.shape[1])))


def assign(x: np.ndarray, words: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes of unit vectors under the score-aware loss, one coordinate after another."""
    m = len(words)
    parts = _pad(x, m * WORD).reshape(len(x), m, WORD)
    square = (words**2).sum(2)
    dots = np.einsum("nmd,mkd->nmk", parts, words)
    plain = square[None] - 2 * dots  # |x - c|^2 without |x|^2
    own = (parts**2).sum(2)
    codes = plain.argmin(2)
    at = np.arange(len(x))
    parallel = own - np.take_along_axis(dots, codes[:, :, None], 2)[:, :, 0]  # r_s . x_s
    total = parallel.sum(1)
    for _ in range(rounds):
        for s in range(m):
            rest = total - parallel[:, s]
            along = own[:, s, None] - dots[:, s]
            codes[:, s] = (plain[:, s] + (eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
            parallel[:, s] = along[at, codes[:, s]]
            total = rest + parallel[:, s]
    return codes.astype(np.uint8)


def fit_words(x: np.ndarray, eta: float, rounds: int = 4, seed: int = 11) -> np.ndarray:
    """Sixteen words a subspace: k-means start, then alternating assignment and weighted least squares."""
    rng = np.random.default_rng(seed)
    m = -(-x.shape[1] // WORD)
    parts = _pad(x, m * WORD).reshape(len(x), m, WORD)
    words = np.stack([parts[rng.choice(len(x), 16, replace=len(x) < 16), s] for s in range(m)]).astype(np.float32)
    for _ in range(5):
        for s in range(m):
            near = ((words[s] ** 2).sum(1)[None] - 2 * parts[:, s] @ words[s].T).argmin(1)
            for k in range(16):
                if (near == k).any():
                    words[s, k] = parts[near == k, s].mean(0)
    for _ in range(rounds):
        codes = assign(x, words, eta)
        for s in range(m):
            taken = words[np.arange(m)[None], codes]
            along = ((parts - taken) * parts).sum(2)
            rest = along.sum(1) - along[:, s]
            for k in range(16):
                mine = codes[:, s] == k
                if mine.sum() > WORD:
                    p = parts[mine, s].astype(np.float64)
                    a = len(p) * np.eye(WORD) + (eta - 1) * p.T @ p
                    b = p.sum(0) + (eta - 1) * (p * (rest[mine] + (p**2).sum(1))[:, None]).sum(0)
                    words[s, k] = np.linalg.solve(a + 1e-6 * np.eye(WORD), b)
    return words


def fit(sample: np.ndarray, n: int, list_size: int) -> Index:
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    return Index(fit_centres(sample, min(LISTS, -(-n // list_size))), fit_words(sample, eta), eta)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] * 16 + codes[:, 1::2]


def tables(q: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A 256-entry table of partial scores for each query and byte of the codes."""
    m = len(words)
    parts = _pad(q, m * WORD).reshape(len(q), m, WORD)
    t = np.einsum("nmd,mkd->nmk", parts, words)
    if m % 2:
        t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
    return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256)


def scan(q: np.ndarray, x: np.ndarray, packed: np.ndarray, words: np.ndarray, rerank: int, k: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score) of the k best members of each query; same[i] is the member that is
    query i itself, or -1."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, min(len(q), 4_000_000 // max(1, len(x))))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        t = tables(part, words)
        guess = np.zeros((len(part), len(x)), np.float32)
        for byte in range(packed.shape[1]):
            guess += np.take(t[:, byte], packed[:, byte], axis=1)
        own = same[a : a + step]
        has = np.flatnonzero(own >= 0)
        guess[has, own[has]] = -np.inf
        r = min(rerank, len(x))
        near = np.argpartition(-guess, r - 1, axis=1)[:, :r] if r < len(x) else np.broadcast_to(np.arange(len(x)), guess.shape)
        exact = np.einsum("nd,nrd->nr", part, x[near])
        exact = np.where(near == own[:, None], -np.inf, exact)
        kk = min(k, r)
        best = np.argpartition(-exact, kk - 1, axis=1)[:, :kk] if kk < r else np.broadcast_to(np.arange(r), exact.shape)
        score = np.take_along_axis(exact, best, 1)
        rows = np.repeat(np.arange(a, a + len(part)), kk)
        cols = np.take_along_axis(near, best, 1).ravel()
        keep = np.isfinite(score.ravel())
        out.append((rows[keep], cols[keep], score.ravel()[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def unit_vectors(rows: DataFrame, key: str, vector: str, model: str) -> DataFrame:
    """(key, model with length, unit) of the usable vectors; unit is float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, models, units = [], [], []
            vectors = batch.column(2)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = vectors.offsets.to_numpy()
            for i, (k, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                v = flat[offsets[i] : offsets[i + 1]]
                norm = float(np.sqrt(v @ v)) if len(v) else 0.0
                if norm > 0 and np.isfinite(norm):
                    keys.append(k)
                    models.append(f"{m}/{len(v)}")
                    units.append((v / norm).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(models, pa.string()), pa.array(units, pa.binary())], ["k", "model", "unit"])

    usable = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & F.col(model).isNotNull())
    sent = usable.select(F.col(key).cast("string").alias("k"), F.col(model).cast("string").alias("model"), F.col(vector).cast("array<float>").alias("v"))
    return sent.mapInArrow(run, "k string, model string, unit binary")


def waves(classes: DataFrame) -> list[dict[str, int]]:
    """The models with their sizes, in groups whose samples and centres fit in WAVE_BYTES."""
    out: list[dict[str, int]] = []
    room = 0
    for r in classes.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "model").collect():  # a row a model
        need = 2 * min(r["n"], SAMPLE) * int(r["model"].rpartition("/")[2]) * 4
        if not out or need > room:
            out.append({})
            room = WAVE_BYTES
        out[-1][r["model"]] = r["n"]
        room -= need
    return out


def fit_all(classes: DataFrame, sizes: dict[str, int], list_size: int) -> dict[str, Index]:
    """One index per model, each from at most SAMPLE vectors chosen by their hash, all in one job."""
    share = F.create_map(*[F.lit(x) for m, n in sizes.items() for x in (m, int(min(1.0, 1.2 * SAMPLE / n) * (1 << 20)))])
    spread = F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(1 << 20))
    order = Window.partitionBy("model").orderBy("class")
    chosen = classes.where(spread <= F.try_element_at(share, F.col("model"))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE)
    taken: dict[str, list[bytes]] = {name: [] for name in sizes}
    for r in chosen.select("model", "unit").collect():
        taken[r["model"]].append(r["unit"])
    return {name: fit(np.frombuffer(b"".join(units), np.float32).reshape(len(units), -1), sizes[name], list_size) for name, units in taken.items() if units}


def refined(placed: DataFrame, branches: dict[int, int], probes: int) -> DataFrame:
    """placed with the lists of the models in ``branches`` (by number) divided into so many each. Rows and the centres of a
    list meet in blocks; each row keeps the ``probes`` nearest of the parts of its lists, its own one first."""
    model = (F.col("list") / LISTS).cast("int")
    parts = F.try_element_at(F.create_map(*[F.lit(x) for kv in branches.items() for x in kv]), model)
    rows = placed.select("class", "unit", F.posexplode("lists").alias("pos", "list")).withColumn("parts", F.coalesce(parts, F.lit(1)))
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
    sizes = bounded(sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), LISTS * 256)
    limit = F.col("parts") * 32

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["unit"]), np.float32).reshape(len(pdf), -1)
        c = fit_centres(x, int(pdf["parts"].iloc[0]))
        return pd.DataFrame({"list": [int(pdf["list"].iloc[0])], "centres": [c.tobytes()]})

    order = Window.partitionBy("list").orderBy(F.xxhash64("class", F.lit(3)))
    sample = rows.where("pos = 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    found = sample.select("list", "unit", "parts").groupBy("list").applyInPandas(centres, "list int, centres binary").join(sizes, "list")
    found = found.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("bigint").alias("class"), F.lit(-1).alias("pos"), F.col("centres").alias("unit"))
    sent = rows.join(sizes, "list").select("list", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), "class", "pos", "unit")

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["pos"].to_numpy() >= 0
        none = pd.DataFrame({"class": np.array([], np.int64), "list": np.array([], np.int64), "pos": np.array([], np.int32), "score": np.array([], np.float64)})
        if not own.any():
            return none
        units = pdf["unit"].to_numpy()
        x = np.frombuffer(b"".join(units[own]), np.float32).reshape(int(own.sum()), -1)
        c = np.frombuffer(units[~own][0], np.float32).reshape(-1, x.shape[1]) if not own.all() else np.zeros((1, x.shape[1]), np.float32)
        near = x @ c.T
        p = min(probes, len(c))
        top = np.argsort(-near, axis=1, kind="stable")[:, :p]
        pos = np.repeat(pdf["pos"].to_numpy()[own], p) + (np.tile(np.arange(p), len(x)) > 0)  # 0: the part it is stored in
        return pd.DataFrame({"class": np.repeat(pdf["class"].to_numpy()[own].astype(np.int64), p), "list": (np.int64(pdf["list"].iloc[0]) * LISTS + top).ravel(), "pos": pos.astype(np.int32), "score": np.take_along_axis(near, top, 1).ravel().astype(np.float64)})

    fine = sent.unionByName(found).groupBy("list", "block").applyInPandas(part, "class bigint, list bigint, pos int, score double")
    best = Window.partitionBy("class").orderBy((F.col("pos") == 0).desc(), F.col("score").desc(), "list")
    kept = fine.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= probes)
    lists = kept.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "list"))), lambda x: x["list"]).alias("lists"))
    return cut(placed.drop("lists").join(lists, "class"))


def neighbours(rows: DataFrame, key: str, vector: str, model: str, k: int = 10, list_size: int = 512, probes: int = 4, share: float = 0.0, rerank: int = 48, floor: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) has for each class a its k most similar classes with at least
    ``floor``; members (class, key, model) says whose vectors a class is."""
    units = unit_vectors(rows, key, vector, model).withColumn("class", F.xxhash64("model", "unit"))
    members = units.select("class", F.col("k").alias(key), "model")
    classes = cut(units.groupBy("class").agg(F.first("model").alias("model"), F.first("unit").alias("unit")))
    found = rows.sparkSession.createDataFrame([], "a bigint, b bigint, similarity double")
    for sizes in waves(classes):
        part = classes.where(F.col("model").isin(list(sizes)))
        found = found.unionByName(searched(part, fit_all(part, sizes, list_size), sizes, k, list_size, probes, share, rerank, floor))
    best = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), members


def searched(classes: DataFrame, index: dict[str, Index], sizes: dict[str, int], k: int, list_size: int, probes: int, share: float, rerank: int, floor: float) -> DataFrame:
    """(a, b, similarity) of the classes of a wave, over the lists each one asks."""
    names = list(index)
    number = {name: i for i, name in enumerate(names)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column("model").to_pylist(), object)
            for name in dict.fromkeys(models):
                part = batch.filter(pa.array(models == name))
                own = index[name]
                x = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float32).reshape(len(part), -1)
                p = min(len(own.centres), max(probes, int(np.ceil(share * len(own.centres)))))
                near = x @ own.centres.T
                if p < len(own.centres):
                    top = np.argpartition(-near, p - 1, axis=1)[:, :p]
                    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                    top = np.take_along_axis(top, order, 1)
                else:
                    top = np.argsort(-near, axis=1, kind="stable")
                packed = pack(assign(x, own.words, own.eta))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("class"),
                        part.column("unit"),
                        pa.array([r.tobytes() for r in packed], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * p + 1, p, dtype=np.int32)), pa.array((number[name] * LISTS + top).ravel().astype(np.int32))),
                    ],
                    ["class", "unit", "codes", "lists"],
                )

    placed = cut(classes.mapInArrow(place, "class bigint, unit binary, codes binary, lists array<int>"))
    branches = {number[m]: -(-n // (LISTS * list_size)) for m, n in sizes.items() if n > LISTS * list_size}
    fine = bool(branches) and share < 1
    if fine:
        placed = refined(placed, branches, probes)
    each = LISTS * LISTS if fine else LISTS  # lists a model
    # one row per list
    sizes = placed.select(F.explode("lists").alias("list"), F.col("lists")[0].alias("home")).groupBy("list").agg(F.count("*").alias("askers"), F.sum((F.col("list") == F.col("home")).cast("int")).alias("stored"))
    blocks = bounded(sizes.select("list", F.ceil(F.col("askers") / BLOCK).cast("int").alias("qb"), F.greatest(F.lit(1), F.ceil(F.col("stored") / BLOCK)).cast("int").alias("mb")), 256 * LISTS)
    spread = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    stored = placed.select("class", "unit", "codes", F.col("lists")[0].alias("list")).join(blocks, "list")
    stored = stored.select("class", "unit", "codes", "list", spread("mb").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
    asking = placed.select("class", "unit", F.explode("lists").alias("list")).join(blocks, "list")
    asking = asking.select("class", "unit", F.lit(None).cast("binary").alias("codes"), "list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), spread("qb").alias("q"))
    both = stored.unionByName(asking)

    def cell(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = index[names[int(key_[0]) // each]]
        is_member = pdf["codes"].notna().to_numpy()
        ids = pdf["class"].to_numpy()
        none = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64), "similarity": np.array([], np.float64)})
        if not is_member.any() or is_member.all():
            return none
        units_ = pdf["unit"].to_numpy()
        stack = lambda mask: np.frombuffer(b"".join(units_[mask]), np.float32).reshape(int(mask.sum()), -1)
        x, q = stack(is_member), stack(~is_member)
        packed = np.frombuffer(b"".join(pdf["codes"].to_numpy()[is_member]), np.uint8).reshape(len(x), -1)
        mids, qids = ids[is_member], ids[~is_member]
        order = np.argsort(mids)
        at = np.minimum(np.searchsorted(mids[order], qids), len(mids) - 1)
        same = np.where(mids[order][at] == qids, order[at], -1)
        i, j, s = scan(q, x, packed, own.words, rerank, k, same)
        keep = s >= floor
        return pd.DataFrame({"a": qids[i[keep]], "b": mids[j[keep]], "similarity": s[keep].astype(np.float64)})

    return both.groupBy("list", "m", "q").applyInPandas(cell, "a bigint, b bigint, similarity double")


def brute_force(units: DataFrame, k: int) -> DataFrame:
    """(a, b, model, similarity): the exact k nearest of every class whose id is divisible by 20, against all rows; queries and
    rows meet in blocks."""
    classes = units.select(F.xxhash64("model", "unit").alias("class"), "model", "unit").dropDuplicates(["class"])
    asks = classes.where("class % 20 = 0")
    n, m = (max(1, -(-d.count() // size)) for d, size in ((classes, BLOCK), (asks, BLOCK)))
    spread = lambda n: F.pmod(F.xxhash64("class", F.lit(5)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = classes.select("class", "model", "unit", F.lit(False).alias("asks"), spread(n).alias("i"), every(m).alias("j"))
    asking = asks.select("class", "model", "unit", F.lit(True).alias("asks"), every(n).alias("i"), spread(m).alias("j"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["asks"].to_numpy(bool)
        ids, units_ = pdf["class"].to_numpy(), pdf["unit"].to_numpy()
        out = [pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64), "model": np.array([], object), "similarity": np.array([], np.float64)})]
        if mine.any() and not mine.all():
            x, q = (np.frombuffer(b"".join(units_[w]), np.float32).reshape(int(w.sum()), -1) for w in (~mine, mine))
            for at in range(0, len(q), 256):
                who = ids[mine][at : at + 256]
                s = q[at : at + 256] @ x.T
                s[who[:, None] == ids[~mine][None]] = -np.inf
                best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(s), 1))
                i, j = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
                keep = np.isfinite(s[i, j])
                out.append(pd.DataFrame({"a": who[i[keep]], "b": ids[~mine][j[keep]], "model": pdf["model"].iloc[0], "similarity": s[i, j][keep].astype(np.float64)}))
        return pd.concat(out)

    found = stored.unionByName(asking).groupBy("model", "i", "j").applyInPandas(cell, "a bigint, b bigint, model string, similarity double")
    best = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


#: Keys of a class up to which it is one block when pairs of classes are expanded to pairs of keys.
KEYS = 1000


def similar_keys(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of different keys, in either of which's list the other stands, and of keys
    that share a vector. The keys of a class come in blocks, and every block of one class meets every block of the other, so
    that no task holds all copies of a vector."""
    mine = members.select("class", F.col(key).alias("k")).distinct()
    blocks = mine.groupBy("class").agg(F.ceil(F.count("*") / KEYS).cast("int").alias("n"))
    rows = mine.join(blocks, "class").withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    links = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a class whose keys differ is linked with itself
    links = links.unionByName(mine.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
    sized = links.join(blocks.select(F.col("class").alias("a"), F.col("n").alias("na")), "a").join(blocks.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b")
    cells = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = rows.select(F.col("class").alias("a"), F.col("own").alias("i"), F.col("k").alias("ka"))
    right = rows.select(F.col("class").alias("b"), F.col("own").alias("j"), F.col("k").alias("kb"))
    out = cells.select("a", "b", "i", "j").join(left, ["a", "i"]).join(right, ["b", "j"]).where("ka <> kb")
    return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
