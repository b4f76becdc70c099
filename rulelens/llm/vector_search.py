"""Approximate nearest neighbours by additive quantisation.

A vector's direction is coded as a sum of codewords, one from each of several full-dimensional codebooks, chosen by
beam search; its norm is stored. The codebooks are residual k-means codebooks, refitted together by least squares on
the codes of a bounded sample. A query turns the codebooks into lookup tables of inner products, so a vector scores
by adding one entry a codebook and multiplying by its norm; the best of each block are reranked exactly.

Vectors are coded once; a vector travels as its code (a byte a codebook), its norm and its components in the table's
own type. Vectors and queries are dealt into bounded blocks; each pair of a query block and a vector block is one
task, which returns its best few. Small tables are cut finer, so that all cores work. Equal vectors are one candidate
with the few least ids that may be needed; a large group of copies is cut to those before anything is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.plans.scratch import save

#: Vectors the codebooks are fitted on, at most; rows of a block of vectors and of queries.
FIT_ROWS, VECTOR_BLOCK, QUERY_BLOCK = 16_384, 16_384, 4_096
BOOKS, WORDS, BEAM = 16, 256, 8
#: Candidates that each block reranks for a query: the best by lookup tables. With ``rerank`` at the block's size or
#: above every vector is reranked, and the search is exact.
RERANK = 1000
#: Tasks wanted for each core, where the tables are small.
TASKS = 2


def _residual_means(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), words, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=words).astype(x.dtype)[:, None]
        centers = np.where(held > 0, sums / np.maximum(held, 1), x[rng.choice(len(x), words)])
    return centers


def beam_encode(books: np.ndarray, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books): at each book every beam is extended by every word and the nearest sums are kept."""
    m, words, dim = books.shape
    norms = (books**2).sum(axis=2)
    codes, rest = np.zeros((len(x), 1, 0), np.int64), x[:, None, :]
    for b in range(m):
        step = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, dim) @ books[b].T).reshape(len(x), -1, words) + norms[b]
        flat = step.reshape(len(x), -1)
        keep = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        codes = np.concatenate([np.take_along_axis(codes, (keep // words)[:, :, None], axis=1), (keep % words)[:, :, None]], axis=2)
        rest = np.take_along_axis(rest, (keep // words)[:, :, None], axis=1) - books[b][keep % words]
    return np.take_along_axis(codes, (rest**2).sum(axis=2).argmin(axis=1)[:, None, None], axis=1)[:, 0]


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 7) -> np.ndarray:
    """Residual codebooks, then rounds of beam encoding and a joint least-squares refit."""
    rng, rest, out = np.random.default_rng(seed), x.copy(), []
    words = min(words, len(x))
    for _ in range(books):
        c = _residual_means(rest, words, rng)
        rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)]
        out.append(c)
    found = np.stack(out)
    for _ in range(rounds):
        codes = np.concatenate([beam_encode(found, x[k : k + 512]) for k in range(0, len(x), 512)])
        at = codes + np.arange(books) * words
        gram, right = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(right, at[:, a], x)
            for b in range(books):
                np.add.at(gram, (at[:, a], at[:, b]), np.float32(1))
        flat = found.reshape(-1, x.shape[1])
        right -= gram @ flat
        gram[np.diag_indices_from(gram)] += 1
        found = (flat + np.linalg.solve(gram, right)).reshape(found.shape).astype(x.dtype)
    return found


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: of the commonest length, finite, not null, not zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count()
    common = lengths.agg(F.max(F.struct("count", -F.col("n")))).first()[0]
    return rows.where(F.size("v") == (-common[1] if common else 0))


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """Each vector once: its least id, its ``most`` least ids (that many may be asked for), and the vector."""
    in_order = Window.partitionBy("v").orderBy("vec_id")  # a rank limit, so copies go before they are dealt
    few = vectors.dropDuplicates().withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "ids", "v")


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms. Components are scaled first, so that neither tiny nor huge ones lose the norm."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    rest = np.sqrt((y**2).sum(axis=1))
    return (y / rest[:, None]).astype(np.float32), np.minimum(most, 1e300) * rest


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
    return column.values.to_numpy(zero_copy_only=False)[first:last].reshape(len(column), -1).astype(np.float64)


def _encode(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x, norms = directions(_matrix(part.column("v")))
                codes = pa.array([row.tobytes() for row in beam_encode(books, x).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "ids", "v")), codes, pa.array(norms)], ["vec_id", "ids", "v", "code", "norm"])

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_in_block(
    books: np.ndarray, asked: np.ndarray, queries: np.ndarray, ids: list[list[int]], codes: np.ndarray, norms: np.ndarray, y: np.ndarray, k: int, rerank: int
) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's best: lookup-table scores choose ``rerank`` candidates, exact ones rank them."""
    sizes, places, out = np.array([len(x) for x in ids]), np.arange(codes.shape[1]), []
    for q, vector in zip(asked.tolist(), queries, strict=True):
        table = books @ (vector / np.abs(vector).max()).astype(np.float32)  # books x words
        score = norms * table[places, codes].sum(axis=1)
        best = np.argpartition(-score, rerank - 1)[:rerank] if len(score) > rerank else np.arange(len(score))
        with np.errstate(all="ignore"):
            exact = (y[best] * vector).sum(axis=1)
        order = np.argsort(-exact, kind="stable")  # what overflows both ways is no number and comes last
        # Groups from the best on, until k + 1 members (the query itself may be one) and all ties of the last.
        held = np.cumsum(np.minimum(sizes[best[order]], k + 1))
        last = exact[order][min(int(np.searchsorted(held, k + 1)), len(order) - 1)]
        if not np.isnan(last):
            order = order[exact[order] >= last]
        got = [(s, i) for g, s in zip(best[order].tolist(), exact[order].tolist(), strict=True) for i in ids[g] if i != q]
        got.sort(key=lambda p: (p[0] != p[0], -p[0] if p[0] == p[0] else 0.0, p[1]))
        out += [(q, i, s) for s, i in got[:k]]
    return out


def _search(books: np.ndarray, k: int, rerank: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("vec_id")
            codes = np.stack([np.frombuffer(x, np.uint8) for x in vectors.column("code").to_pylist()]).astype(np.int64)
            ids, norms = vectors.column("ids").to_pylist(), vectors.column("norm").to_numpy()
            found = nearest_in_block(books, queries.column("vec_id").to_numpy(), _matrix(queries.column("v")), ids, codes, norms, _matrix(vectors.column("v")), k, rerank)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def search(
    table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK,
    vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``table`` to each row of ``queries`` by inner product.

    A row is no neighbour of the query with its id. Vectors that are null, zero, hold null or non-finite
    components, or are not of the commonest length take no part; nor do rows without an id. Ties go to the
    smaller id, and rows equal in id and vector count once; a score that is not a number (huge components that
    overflow both ways) comes last. An empty table gives no rows. Codebooks are fitted on ``FIT_ROWS`` vectors at
    most (those with the least hashes); every vector is indexed. Each block of about ``vector_block`` vectors
    reranks ``rerank`` of its own, so with ``rerank`` well above ``vector_block`` nothing is lost.
    """
    spark = table.sparkSession
    vectors = save(distinct_vectors(valid_vectors(table, id_col, vector_col), k + 1), "search-vectors")
    total = vectors.count()
    if not total:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    asked = valid_vectors(queries, id_col, vector_col).dropDuplicates()
    asked = save(asked.where(F.size("v") == F.lit(vectors.select(F.size("v")).first()[0])), "search-queries")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()  # bounded by FIT_ROWS
    books = fit_books(directions(_matrix(sample.column("v")))[0])
    kind = vectors.schema["v"].dataType.simpleString()
    coded = vectors.mapInArrow(_encode(books), f"vec_id long, ids array<long>, v {kind}, code binary, norm double")
    wanted = TASKS * spark.sparkContext.defaultParallelism
    n_vector = -(-total // vector_block)
    n_query = max(-(-asked.count() // query_block), -(-wanted // n_vector))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asked.select(spread(n_vector).alias("b"), own(n_query).alias("q"), "vec_id", "v")
    right = coded.select(own(n_vector).alias("b"), spread(n_query).alias("q"), "vec_id", "ids", "v", "code", "norm")
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q"))
    best = found.applyInArrow(_search(books, k, rerank), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.where("vec_id % 20 = 0"))


SQL = None
