"""Problem 3: the most similar vectors of every vector, by additive quantisation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from tantu.session import materialise, shuffle_partitions

#: Codebooks after the first, of WORDS full-dimensional vectors each, fitted in ROUNDS rounds on a sample: SAMPLE vectors, or SAMPLE_A_CELL for each cell if that is more.
BOOKS, WORDS, SAMPLE, SAMPLE_A_CELL, ROUNDS = 4, 256, 60_000, 32, 8
#: The first codebook names a vector's cell: one word for CELL vectors, at most CELLS.
CELL, CELLS = 128, 16_384
#: Partial codes kept by the encoder.
BEAM = 8
#: Vectors on which cells and shortlist are measured, and the share of their true neighbours that each has to hold.
ASKED, RECALL = 256, 0.999
#: What is measured on a part of the vectors is multiplied by so much for all.
MORE_CELLS, MORE_CANDIDATES = 1.5, 2
#: Vectors compared in one task at most, and at least if there are tasks enough; questions put to them in one task.
BUCKET, SMALL_BUCKET, QUESTIONS = 16_384, 2048, 65_536
#: Rows encoded, and questions scored, at a time.
ROWS_AT_ONCE, AT_ONCE = 2048, 128
#: Up to so many groups of equal vectors are sent to all tasks (24 bytes each); beyond that they are shuffled.
MOST_SENT = 1_000_000


def fitted_codebooks(x: np.ndarray, cells: int, *, seed: int = 0) -> list[np.ndarray]:
    """(cells, dims), then BOOKS times (WORDS, dims): k-means on the vectors, then on what each book leaves over."""
    rng = np.random.default_rng(seed)
    left, books = x.astype(np.float32).copy(), []
    for size in (cells, *[WORDS] * BOOKS):
        words = left[rng.choice(len(left), size, replace=len(left) < size)].copy()
        for _ in range(ROUNDS):
            near = _nearest(left, words)
            order = np.argsort(near, kind="stable")
            counts = np.bincount(near, minlength=size)
            filled = counts > 0
            sums = np.add.reduceat(left[order], np.concatenate([[0], np.cumsum(counts[filled])[:-1]]), axis=0)
            words[filled] = sums / counts[filled, None]
            # an empty word takes the place of some vector
            if len(empty := np.flatnonzero(~filled)):
                words[empty] = left[rng.choice(len(left), len(empty))]
        books.append(words)
        left = left - words[_nearest(left, words)]
    return books


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words * words).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ words.T - half, axis=1) for i in range(0, len(x), 8192)])


def encoded(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, a word of each book; length of what they add up to): beam search over the sums of one word of each book, the BEAM cheapest kept at each."""
    n, dims = x.shape
    sums = np.zeros((n, 1, dims), np.float32)
    codes = np.zeros((n, 1, 0), np.int32)
    rows = np.arange(n)[:, None]
    for words in books:
        left = x[:, None, :] - sums
        # |left - word|^2 for every kept sum and word
        cost = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, dims) @ words.T).reshape(n, -1, len(words)) + (words * words).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1), 1)
        parent, word = best // len(words), best % len(words)
        codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
        sums = sums[rows, parent] + words[word]
    return codes[:, 0], np.linalg.norm(sums[:, 0], axis=1)


def table_scores(q: np.ndarray, books: list[np.ndarray], cell: np.ndarray, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(queries, rows): cosines of the queries with what the codes add up to, looked up in a table of each book."""
    named, at = np.unique(cell, return_inverse=True)
    score = (q @ books[0][named].T)[:, at]
    for m, words in enumerate(books[1:]):
        score += (q @ words.T)[:, codes[:, m]]
    return score / np.maximum(length, 1e-12)


def nearest_cells(q: np.ndarray, words: np.ndarray, probes: int) -> np.ndarray:
    """(queries, probes): the cells nearest to each query, in no order."""
    score = q @ words.T - (words * words).sum(1) / 2
    return np.argpartition(-score, probes - 1, axis=1)[:, :probes] if probes < len(words) else np.broadcast_to(np.arange(len(words)), score.shape)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows whose vector is neither null nor all zero, has only finite values and the usual length, and how many they are."""
    ok = vectors.filter(
        F.col(vector).isNotNull() & F.forall(
            vector,
            lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")),
        ) & F.exists(vector, lambda v: v != 0)
    )
    ok = ok.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL")
    most = ok.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return ok.filter(F.size("v") == (most["dims"] if most else 0)), most["count"] if most else 0


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    # scaled first: the square of a large value need not be finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(x.itemsize * x.shape[1]),
        len(x),
        [None, pa.py_buffer(x)],
    ).cast(pa.binary()) if len(x) else pa.array([], pa.binary())


def _unpacked(column: pa.Array, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


INDEX = "id long, cell int, codes binary, length float, vec binary"


def index(vectors: DataFrame, key: str, vector: str, *, seed: int = 0, sample: int = SAMPLE) -> tuple[DataFrame, list[np.ndarray], int]:
    """(id, cell, codes, length, vec) of every usable vector, written; the codebooks; the number of rows.

    The codebooks are fitted on about ``sample`` vectors (more for very many cells, bounded by CELLS), those whose
    hash falls below a bound, equal vectors once; every usable vector is encoded. vec is the unit vector.
    """
    spark = vectors.sparkSession
    ok, n = usable(vectors, key, vector)
    if not n:
        return spark.createDataFrame([], INDEX), [], 0
    cells = max(1, min(CELLS, n // CELL))
    share = min(1.0, max(sample, SAMPLE_A_CELL * cells) / n)
    hashed = ok.withColumn("h", F.xxhash64("v", F.lit(seed))).filter(F.pmod("h", F.lit(2**31)) < int(share * 2**31))
    chosen = hashed.groupBy("h").agg(F.first("v").alias("v")).select("v").toArrow()
    books = fitted_codebooks(_matrix(chosen["v"].combine_chunks()), min(cells, chosen.num_rows), seed=seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                x = _matrix(part.column(1))
                codes, length = encoded(x, books)
                columns = [part.column(0), pa.array(codes[:, 0], pa.int32()), _packed(codes[:, 1:].astype(np.uint8)), pa.array(length, pa.float32()), _packed(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cell", "codes", "length", "vec"])

    return materialise(ok.mapInArrow(encode, INDEX), "vector-index"), books, n


def _loaded(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, cell, codes, length, vec of a batch of the index."""
    return b["id"].to_numpy(), b["cell"].to_numpy(), _unpacked(b["codes"], np.uint8), b["length"].to_numpy(), _unpacked(b["vec"], np.float32)


@dataclass(frozen=True)
class Reach:
    """How many cells a vector is looked up in, and how many candidates by table score are compared exactly."""

    probes: int
    shortlist: int


def measured_reach(rows: DataFrame, books: list[np.ndarray], n: int, k: int, *, recall: float = RECALL, asked: int = ASKED, seed: int = 0) -> Reach:
    """The reach, with a margin, by which about ``asked`` vectors of the index find the share ``recall`` of their true neighbours, in each of the two steps.

    The true neighbours are found by comparing these vectors with every row, the ranks of their scores by counting over every row. Both
    passes are linear in the rows; k rows a vector reach the driver.
    """
    bound = int(min(1.0, 1.2 * asked / n) * 2**31)
    chosen = rows.filter(F.pmod(F.xxhash64("vec", F.lit(seed + 1)), F.lit(2**31)) < bound).select("id", "vec").toArrow()
    ids, q = chosen["id"].to_numpy(), _unpacked(chosen["vec"].combine_chunks(), np.float32) if chosen.num_rows else np.zeros((0, 1), np.float32)
    if not len(ids):
        return Reach(len(books[0]), n)

    def nearest_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for b in batches:
            for at in range(0, b.num_rows, 4 * ROWS_AT_ONCE):
                part = b.slice(at, 4 * ROWS_AT_ONCE)
                others = part["id"].to_numpy()
                s = q @ _unpacked(part["vec"], np.float32).T
                s[ids[:, None] == others[None, :]] = -2
                keep = min(k, s.shape[1])
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                flat = top.ravel()
                new = pa.table(
                    {
                        "q": np.repeat(np.arange(len(q)), keep),
                        "cosine": np.take_along_axis(s, top, 1).ravel(),
                        "id": others[flat],
                        "cell": part["cell"].to_numpy()[flat],
                        "codes": part["codes"].take(pa.array(flat)),
                        "length": part["length"].to_numpy()[flat],
                    }
                )
                best = new if best is None else pa.concat_tables([best, new])
                order = np.lexsort((-best["cosine"].to_numpy(), best["q"].to_numpy()))
                which = best["q"].to_numpy()[order]
                best = best.take(pa.array(order[np.arange(len(order)) - np.searchsorted(which, which) < k]))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    near = rows.mapInArrow(nearest_here, "q long, cosine float, id long, cell int, codes binary, length float").filter("cosine > -2")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "id"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= k).toArrow().combine_chunks()
    if not near.num_rows:
        return Reach(len(books[0]), n)
    at, cell, codes, length = near["q"].to_numpy(), near["cell"].to_numpy(), _unpacked(near["codes"].combine_chunks(), np.uint8), near["length"].to_numpy()

    def least(ranks: np.ndarray) -> int:
        return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

    words = books[0]
    score = q @ words.T - (words * words).sum(1) / 2
    probes = least((score[at] > score[at, cell][:, None]).sum(1))
    probed = np.zeros((len(q), len(words)), bool)
    np.put_along_axis(probed, nearest_cells(q, words, probes), True, 1)
    own = np.array([table_scores(q[i : i + 1], books, cell[j : j + 1], codes[j : j + 1], length[j : j + 1])[0, 0] for j, i in enumerate(at)])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(at), np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 4 * ROWS_AT_ONCE):
                _, c, code, ln, _ = _loaded(b.slice(start, 4 * ROWS_AT_ONCE))
                s = np.where(probed[:, c], table_scores(q, books, c, code, ln), -np.inf)
                s.sort(axis=1)
                counts += [s.shape[1] - np.searchsorted(s[i], t + 1e-6, "right") for i, t in zip(at, own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(counts)], names=["j", "n"])

    higher = rows.mapInArrow(above, "j long, n long").groupBy("j").agg(F.sum("n").alias("n")).toArrow()
    return Reach(min(len(words), math.ceil(MORE_CELLS * probes)), max(2 * k, MORE_CANDIDATES * least(higher["n"].to_numpy())))


def cell_buckets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, slices) of every cell: cells near each other share a bucket of about ``size`` rows, a larger cell has several buckets of its own.

    Cells are halved along the direction in which they lie farthest apart, by their rows.
    """
    first, slices = np.zeros(len(words), np.int64), np.maximum(1, -(-counts // size))
    todo, made = [np.arange(len(words))], 0
    while todo:
        g = todo.pop()
        if counts[g].sum() > size and len(g) > 1:
            x = words[g] - words[g].mean(0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            g = g[np.argsort(along, kind="stable")]
            upto = np.cumsum(counts[g])
            cut = int(np.clip(np.searchsorted(upto, upto[-1] / 2) + 1, 1, len(g) - 1))
            todo += [g[cut:], g[:cut]]
            continue
        first[g] = made
        made += int(slices[g].max())
    return first, slices


def _searched(rows: DataFrame, books: list[np.ndarray], n: int, k: int, reach: Reach) -> DataFrame:
    """(id, other, cosine): the k best of every bucket that a vector is looked up in."""
    spark = rows.sparkSession
    words, probes = books[0], min(reach.probes, len(books[0]))
    counts = np.zeros(len(words), np.int64)
    for r in rows.groupBy("cell").count().collect():  # a row for each cell, at most CELLS
        counts[r["cell"]] = r["count"]
    buckets = max(-(-n // BUCKET), min(shuffle_partitions(spark), n // SMALL_BUCKET), 1)
    first, slices = cell_buckets(words, counts, -(-n // buckets))

    def asked_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are looked up in which buckets."""
        cells = nearest_cells(x, words, probes)
        at = np.repeat(np.arange(len(x)), cells.shape[1])
        cells = cells.ravel()
        many = slices[cells]
        at, bucket = np.repeat(at, many), np.repeat(first[cells], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(at * (2**32) + bucket)
        return pairs >> 32, pairs & (2**32 - 1)

    def count_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int((first + slices).max()), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                total += np.bincount(asked_of(_unpacked(b["vec"].slice(at, ROWS_AT_ONCE), np.float32))[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    asks = np.ones(int((first + slices).max()), np.int64)
    for r in rows.select("vec").mapInArrow(count_asks, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        asks[r["bucket"]] = -(-r["n"] // QUESTIONS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row once for each part of the questions put to its bucket, and once as a question to each bucket asked."""
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                ids, cell = part["id"].to_numpy(), part["cell"].to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                home = first[cell] + (mixed % slices[cell].astype(np.uint64)).astype(np.int64)
                copies = asks[home]
                held = np.repeat(np.arange(len(ids)), copies)
                held_part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                who, bucket = asked_of(_unpacked(part["vec"], np.float32))
                ask_part = (mixed[who] % asks[bucket].astype(np.uint64)).astype(np.int64)
                both = np.concatenate([held, who])
                is_held = np.arange(len(both)) < len(held)
                taken = part.take(pa.array(both))
                none = lambda c: pa.compute.if_else(pa.array(is_held), c, pa.scalar(None, c.type))
                columns = [
                    pa.array(np.concatenate([home[held], bucket]).astype(np.int32)), pa.array(np.concatenate([held_part, ask_part]).astype(np.int32)), pa.array(~is_held),
                    taken["id"], taken["cell"], none(taken["codes"]), none(taken["length"]), taken["vec"],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "ask", "asks", "id", "cell", "codes", "length", "vec"])

    routed = rows.select("id", "cell", "codes", "length", "vec").mapInArrow(
        route,
        "bucket int, ask int, asks boolean, id long, cell int, codes binary, length float, vec binary",
    )
    routed = routed.repartition(max(shuffle_partitions(spark), int(asks.sum())), "bucket", "ask").sortWithinPartitions("bucket", "ask", "asks", "cell")

    def answer(own: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, cell, codes, length, x, starts = own
        q_ids, q = batch["id"].to_numpy(), _unpacked(batch["vec"], np.float32)
        # the rows of all cells that any of these questions, which lie near each other, looks in
        here = np.unique(nearest_cells(q, words, probes))
        spans = [np.arange(starts[c], starts[c + 1]) for c in here if starts[c] < starts[c + 1]]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if spans:
            columns = np.concatenate(spans)
            wanted, others = min(reach.shortlist, len(columns)), ids[columns]
            step = max(1, min(len(q), 4_000_000 // (wanted * x.shape[1])))
            whole = wanted == len(columns)
            score = None if whole else table_scores(q, books, cell[columns], codes[columns], length[columns])
            for at in range(0, len(q), step):
                qs, qi = q[at : at + step], q_ids[at : at + step]
                if whole:
                    short, exact = np.broadcast_to(np.arange(len(columns)), (len(qs), len(columns))), qs @ x[columns].T
                else:
                    short = np.argpartition(-score[at : at + step], wanted - 1, axis=1)[:, :wanted]
                    exact = np.matmul(x[columns[short]], qs[:, :, None])[:, :, 0]
                exact = np.where(others[short] == qi[:, None], -2, exact)
                keep = min(k, wanted)
                best = np.argpartition(-exact, keep - 1, axis=1)[:, :keep]
                # of equal cosines at the edge those of the smallest ids
                edge = np.take_along_axis(exact, best, 1).min(1, keepdims=True)
                for r in np.flatnonzero((exact >= edge).sum(1) > keep):
                    best[r] = np.lexsort((others[short[r]], -exact[r]))[:keep]
                a, b, c = np.repeat(qi, keep), others[np.take_along_axis(short, best, 1)].ravel(), np.take_along_axis(exact, best, 1).ravel()
                found.append((a[c > -2], b[c > -2], c[c > -2].astype(np.float32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], names=["id", "other", "cosine"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own: tuple | None = None
        last = None
        for b in batches:
            keys = np.stack([b["bucket"].to_numpy(), b["ask"].to_numpy(), b["asks"].to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                group = tuple(keys[start, :2])
                if group != last:
                    held, own, last = [], None, group
                part = b.slice(start, stop - start)
                if not keys[start, 2]:
                    held.append(part)
                    continue
                if own is None and held:
                    ids, cell, codes, length, x = (np.concatenate(c) for c in zip(*(_loaded(h) for h in held), strict=True))
                    own, held = (ids, cell, codes, length, x, np.searchsorted(cell, np.arange(len(words) + 1))), []
                if own is not None:
                    for at in range(0, part.num_rows, AT_ONCE):
                        yield answer(own, part.slice(at, AT_ONCE))

    return routed.mapInArrow(search, "id long, other long, cosine float")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "other", "cosine")


def nearest(vectors: DataFrame, key: str, vector: str, k: int, *, recall: float | None = RECALL, seed: int = 0, sample: int = SAMPLE, asked: int = ASKED) -> DataFrame:
    """(id, rank, other, cosine): for every usable vector the k others of the highest cosine, with a small loss.

    Vectors are looked up in the cells (words of the first book) nearest to them. There the stored codes are scored by table, and the best
    candidates compared exactly. How many cells and candidates that takes is measured, see measured_reach; recall None looks everywhere and
    compares everything. Cells near each other share a bucket, a task's work: a vector goes to each bucket once. A bucket of many questions is
    asked in parts.

    Equal vectors are searched for once; each of them then has the others of its group among its neighbours, and a group stands in
    another's answer with its smallest ids. Equal cosines rank by id. Null, all-zero and non-finite vectors and null keys take no
    part, rows repeated under one id count once; an id of several vectors has the best of each, of which some may name the same id.
    """
    rows, books, n = index(vectors, key, vector, seed=seed, sample=sample)
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "id long, rank int, other long, cosine float")
    rows = rows.withColumn("h", F.xxhash64("vec", F.lit(0))).withColumn("g", F.xxhash64("vec", F.lit(1)))
    groups = rows.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    n_groups = groups.count()
    single = rows
    if n_groups:
        groups = materialise(groups, "equal-vectors")
        if n_groups <= MOST_SENT:
            groups = F.broadcast(groups)
        firsts = rows.join(groups, ["h", "g"]).filter("id = rep").drop("rep").dropDuplicates(["h", "g"])
        single = materialise(rows.join(groups, ["h", "g"], "left_anti").unionByName(firsts), "vector-index")
        n = single.count()
    reach = Reach(len(books[0]), n) if recall is None else measured_reach(single, books, n, k, recall=recall, asked=asked, seed=seed)
    found = _searched(single, books, n, k, reach)
    # an id may hold several vectors; an id's answers meet in one shuffle, at most k from each bucket it asked
    found = found.repartition("id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    if not n_groups:
        return _best(found, k)
    found = materialise(_best(found, k), "nearest")
    members = materialise(rows.join(groups, ["h", "g"]).select("rep", "id").distinct(), "equal-vectors")
    order = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    few = members.withColumn("place", order).filter(F.col("place") <= k + 1).select("rep", F.col("id").alias("member"))
    # a group stands for its first members, and answers each of its own
    others = found.join(few, F.col("other") == F.col("rep"), "left").select("id", F.coalesce("member", "other").alias("other"), "cosine")
    equal = few.select(F.col("rep").alias("id"), F.col("member").alias("other"), F.lit(1.0).cast("float").alias("cosine"))
    answers = _best(others.unionByName(equal), k + 1).drop("rank").withColumnRenamed("id", "rep")
    alone = members.select("rep", "id").filter("rep <> id").unionByName(single.select(F.col("id").alias("rep"), "id").distinct())
    return _best(alone.join(answers, "rep").filter("id <> other").groupBy("id", "other").agg(F.max("cosine").alias("cosine")), k)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(idx_a, idx_b), idx_a < idx_b: pairs in which one is among the other's neighbours."""
    return found.select(F.least("id", "other").cast("int").alias("idx_a"), F.greatest("id", "other").cast("int").alias("idx_b")).distinct()
