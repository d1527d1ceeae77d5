"""Approximate nearest neighbours by additive quantisation.

A vector of length one is approximated by the sum of one codeword from each of several codebooks of full dimension. Codebooks
start as k-means of residuals and are then refitted together by least squares; codes are found by beam search, and the norm of
each approximation is stored. A search builds, for each query, the products with all codewords; a row's score is the sum
of its looked-up products over its stored norm. The best rows are ranked again by the exact cosine, and with them every row whose
stored distance from its approximation leaves room for a cosine as large: rows of one narrow cluster, which codes can't tell apart.

Only the codebooks are fitted on a sample (``sample`` vectors, the smallest hashes of vec_id); every row is indexed, and
every query of the stated set meets every row, block by block: a block of queries and a block of codes is one task.

Equal vectors are indexed once, under their smallest vec_id; a vector found stands for as many of its rows as could
be among the nearest. So a group of copies of any size takes one place, and none of it is lost.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors of another
length than the most frequent one. Rows that repeat a vec_id count once, with the smallest vector. Equal cosines go to the
smaller vec_id. Extra columns are ignored. Fewer candidates than asked for: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

BOOKS, WORDS, BEAM = 16, 256, 4
#: Rows of a block of codes (a byte for each book, two numbers and the vector), and queries of a block.
CODE_BLOCK, QUERY_BLOCK = 1 << 15, 1024
#: Rows that are scored exactly at once, and by how much a looked-up score in single precision may miss.
EXACT_ROWS, SLACK = 1 << 14, 1e-5


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        c[full] = np.add.reduceat(x[order], starts, axis=0) / n[full][:, None]
    return c


def beam_codes(x: np.ndarray, books: np.ndarray, beam: int = BEAM, block: int = 512) -> np.ndarray:
    """Codes (rows, books) whose summed codewords come close to each row; ``beam`` partial sums survive each book."""
    m, k, d = books.shape
    norms = (books**2).sum(2)
    out = np.zeros((len(x), m), np.uint8)
    for at in range(0, len(x), block):
        left = x[at : at + block][:, None, :]
        codes = np.zeros((left.shape[0], 1, 0), np.uint8)
        for b in range(m):
            n, w = left.shape[:2]
            cost = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, d) @ books[b].T).reshape(n, w, k) + norms[b]
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            who, word = best // k, best % k
            rows = np.arange(n)[:, None]
            left = left[rows, who] - books[b][word]
            codes = np.concatenate([codes[rows, who], word[:, :, None].astype(np.uint8)], axis=2)
        pick = np.argmin((left**2).sum(2), axis=1)
        out[at : at + block] = codes[np.arange(len(pick)), pick]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit_books(x: np.ndarray, m: int = BOOKS, k: int = WORDS, refits: int = 1, sweeps: int = 6, seed: int = 7) -> np.ndarray:
    """Codebooks (m, k, dimension): k-means of residuals, then beam codes and least squares by sweeps over the books."""
    rng, left, books = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(m):
        c = _kmeans(left, k, rng)
        near = np.argmin((c * c).sum(1)[None] - 2 * left @ c.T, axis=1)
        left = left - c[near]
        books.append(c)
    books = np.stack(books)
    for _ in range(refits):
        codes = beam_codes(x, books)
        left = x - decode(codes, books)
        for _ in range(sweeps):
            for b in range(m):  # the best book b, the others held: means of what they leave
                n = np.bincount(codes[:, b], minlength=k)
                order, full = np.argsort(codes[:, b], kind="stable"), n > 0
                step = np.zeros_like(books[b])
                step[full] = np.add.reduceat(left[order], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
                books[b] += step
                left -= step[codes[:, b]]
    return books


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part, one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = table.select("vec_id", F.when(fine, v).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (most["n"] if most else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def build_index(vectors: DataFrame, sample: int = 20_000) -> tuple[DataFrame, np.ndarray | None]:
    """Rows (vec_id, v, code binary, norm float, near float) for every vector, and the codebooks. near is the cosine of a vector and
    its approximation."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    books = fit_books(_unit(got["v"]), k=min(WORDS, len(got))) if len(got) else None
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _unit(f["v"])
                codes = beam_codes(x, shared.value)
                close = decode(codes, shared.value)
                norms = np.linalg.norm(close, axis=1)
                near = (x * close).sum(1) / np.maximum(norms, 1e-12)
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "code": [c.tobytes() for c in codes], "norm": norms.astype(np.float32), "near": near.astype(np.float32)})

    return vectors.mapInPandas(encode, "vec_id long, v array<double>, code binary, norm float, near float"), books


def _packed(rows: DataFrame, blocks: int, pack, schema: str) -> DataFrame:
    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            yield pd.DataFrame([pack(pd.concat(got, ignore_index=True))])

    return rows.repartition(blocks).mapInPandas(whole, schema)


def _doubles(rows) -> np.ndarray:
    """Vectors by their largest component: no overflow, and powers of ten cancel."""
    x = np.stack([np.asarray(r, float) for r in rows])
    return x / np.abs(x).max(axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two tables of ``_doubles``."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def best_possible(cosine: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The largest cosine that a query and a vector can have, by the query's cosine with the vector's approximation and ``near``, that
    of the vector with it: angles obey the triangle inequality. Raised by what single precision may lose."""
    c, n = np.clip(cosine.astype(float), -1, 1), np.clip(near.astype(float), -1, 1)
    return np.where(c >= n, 1.0, c * n + np.sqrt((1 - c * c) * (1 - n * n))) + SLACK


def search(index: DataFrame, books: np.ndarray, queries: DataFrame, n_codes: int, n_queries: int, k: int, shortlist: int) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` vectors of largest cosine for each query, and of others.

    In each block the ``shortlist`` rows with the best looked-up scores are scored exactly; the k-th of these scores is a floor, and
    every further row whose ``best_possible`` reaches it is scored too. So no row is lost, however close others lie to it.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(books)
    codes = _packed(
        index, max(1, -(-n_codes // CODE_BLOCK)),
        lambda f: {"ids": f["vec_id"].to_numpy("<i8").tobytes(), "codes": b"".join(f["code"]), "norms": f["norm"].to_numpy("<f4").tobytes(), "nears": f["near"].to_numpy("<f4").tobytes(), "rows": _doubles(f["v"]).tobytes()},
        "ids binary, codes binary, norms binary, nears binary, rows binary",
    )
    asked = _packed(
        queries, max(1, -(-n_queries // QUERY_BLOCK)),
        lambda f: {"qids": f["vec_id"].to_numpy("<i8").tobytes(), "vectors": _doubles(f["v"]).tobytes()},
        "qids binary, vectors binary",
    )

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        m, _, d = books.shape
        for f in frames:
            for r in f.itertuples(index=False):
                ids, norms, nears = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.norms, "<f4"), np.frombuffer(r.nears, "<f4")
                rows = np.frombuffer(r.rows, float).reshape(-1, d)
                code = np.ascontiguousarray(np.frombuffer(r.codes, np.uint8).reshape(-1, m).T).astype(np.int64)
                qids, asked = np.frombuffer(r.qids, "<i8"), np.frombuffer(r.vectors, float).reshape(-1, d)
                q = (asked / np.linalg.norm(asked, axis=1, keepdims=True)).astype(np.float32)
                out, keep, few = [], min(max(shortlist, k), len(ids)), min(k, len(ids))
                for i, qid in enumerate(qids.tolist()):
                    product = books @ q[i]
                    score = product[0][code[0]]
                    for b in range(1, m):
                        score = score + product[b][code[b]]
                    score = score / np.maximum(norms, 1e-12)
                    some = np.argpartition(-score, keep - 1)[:keep]
                    exact = _cosines(rows[some], asked[i][None])
                    floor = np.partition(exact, keep - few)[keep - few]
                    open_ = best_possible(score, nears) >= floor
                    open_[some] = False
                    for rest in np.array_split(np.flatnonzero(open_), max(1, np.count_nonzero(open_) // EXACT_ROWS)):
                        more = _cosines(rows[rest], asked[i][None])
                        some, exact = np.concatenate([some, rest[more >= floor]]), np.concatenate([exact, more[more >= floor]])
                    best = np.lexsort((ids[some], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[some[best]], "score": exact[best]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    return codes.crossJoin(asked).mapInPandas(look_up, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, is_query: Column, k: int = 5, shortlist: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``is_query`` (over vec_id) marks."""
    scratch = Scratch(table.sparkSession, "ann")
    vectors = scratch.keep(valid_vectors(table))
    distinct = scratch.keep(vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id")))
    index, books = build_index(distinct)
    queries = vectors.where(is_query)
    n_queries = queries.count()
    if books is None or not n_queries:
        return vectors.where(F.lit(False)).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index = scratch.keep(index)
    # k + 1 vectors: one of them may be the query's own
    scored = search(index, books, queries, index.count(), n_queries, k + 1, shortlist).withColumnRenamed("vec_id", "first")
    # the k + 1 smallest vec_ids of each vector: one of them may be the query itself
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    same = vectors.withColumn("_place", place).where(F.col("_place") <= k + 1)
    same = scratch.keep(same.join(distinct.withColumnRenamed("vec_id", "first"), "v").select("first", "vec_id"))
    ranked = scored.join(same, "first").where("vec_id != query_id").select("query_id", "vec_id", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = ranked.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
