"""Exact top-k search by distributed histogram selection.

Vectors become blocks of integers. Every (query block, candidate block) tile is scored whole, and
only counts of scores leave it: each round refines, per query, the interval that holds the k-th
best score, from the global histogram of scores in that interval. When few scores lie at or above
an interval's lower end, those are emitted and ranked, ties to the smaller id.

A tile reports no more than its own k best scores per query: what lies below them cannot change
the k-th best of all, and of equal scores the k smallest ids of a tile are enough.

Null vectors, and those with null or non-finite components, take no part, nor do vectors whose integers have squares that add up to
``SQUARES`` or more: below it every score fits 64 bits. Shorter vectors count as
padded with zeros. Rows that repeat an id are candidates of their own, but for the query with that
id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstat.session import checkpoint

#: Rows of a candidate block and of a query block; shares of the candidates a query block is sent to.
CANDIDATES, QUERIES, SHARES = 1024, 4096, 48
#: Bits of the score that one round of histograms settles.
STEP = 9
#: Products of two vectors with smaller sums of squares are smaller still.
SQUARES = 2.0**62


def _matrix(rows: list[bytes]) -> np.ndarray:
    width = max(map(len, rows), default=0) // 8
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row) // 8] = np.frombuffer(row, np.int64)
    return out


def _packed(frame: pd.DataFrame) -> dict:
    m = _matrix(list(frame["vec"]))
    most = int(np.abs(m).max()) if m.size else 0
    kind = np.int16 if most < 2**15 else np.int64
    return {"ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "wide": kind is np.int64, "n": len(m), "mat": m.astype(kind).tobytes()}


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(row.mat, np.int64 if row.wide else np.int16)
    return np.frombuffer(row.ids, np.int64), m.reshape(row.n, -1).astype(np.int64)


def _as_integers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors that take part, as little-endian 64-bit integers."""
    for frame in frames:
        ids, out = [], []
        for vec_id, v in zip(frame["vec_id"], frame["embedding"], strict=True):
            if v is None or vec_id is None or pd.isna(vec_id):
                continue
            x = np.asarray([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object or isinstance(v, list) else v, np.float64)
            x = np.floor(x * 1024.0)
            if np.isfinite(x).all() and float(x @ x) < SQUARES:
                ids.append(int(vec_id))
                out.append(x.astype(np.int64).tobytes())
        yield pd.DataFrame({"vec_id": np.array(ids, np.int64), "vec": out})


def _blocks(size: int, state: bool):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), size):
                part = frame.iloc[i: i + size]
                row = _packed(part)
                if state:
                    row |= {c: part[c].to_numpy(np.int64).tobytes() for c in ("lo", "above")}
                yield pd.DataFrame([row])
    return pack


_BLOCK = "ids binary, wide boolean, n int, mat binary"


def _tiles(queries: DataFrame, candidates: DataFrame, n_queries: int) -> DataFrame:
    """Every query block beside every candidate block, joined on (query block, share of the candidates)."""
    blocks = max(1, -(-n_queries // QUERIES))
    q = (queries.repartition(blocks, "vec_id").mapInPandas(_blocks(QUERIES, True), f"{_BLOCK}, lo binary, above binary")
         .withColumn("qb", F.monotonically_increasing_id()))
    q = checkpoint(q)
    names = q.select(F.collect_list("qb").alias("qbs"))  # one long for each 4096 queries
    q = q.select(F.col("qb"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), *(F.col(c).alias(f"q_{c}") for c in q.columns if c != "qb"))
    c = candidates.select("*", F.explode(names.scalar()).alias("qb"))
    return c.join(q, ["qb", "share"])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: by floating point while every sum stays below two to the 53rd."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, width)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


_LOW = -(2**62)


def _best(row, k: int) -> Iterator[tuple]:
    """For each query of a tile: its id, what is known of it, and the tile's k best (scores, ids)."""
    q_ids = np.frombuffer(row.q_ids, np.int64)
    q = np.frombuffer(row.q_mat, np.int64 if row.q_wide else np.int16).reshape(row.q_n, -1).astype(np.int64)
    lo, above = np.frombuffer(row.q_lo, np.int64), np.frombuffer(row.q_above, np.int64)
    ids, m = _unpacked(row)
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    for i in range(0, len(q), 512):
        s = _scores(q[i: i + 512], m)
        s[q_ids[i: i + 512, None] == ids[None, :]] = _LOW
        floor = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] if s.shape[1] else np.zeros(len(s), np.int64)
        for j in range(len(s)):
            at = np.flatnonzero(s[j] >= max(floor[j], lo[i + j], _LOW + 1))
            at = at[np.argsort(-s[j][at], kind="stable")][:k]  # ids ascend among equal scores
            yield q_ids[i + j], lo[i + j], above[i + j], s[j][at], ids[at]


def _histogram(k: int, shift: int, width: int | None):
    """Counts of scores by bin of two to the ``shift``, inside the interval a query has come to."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                out_q, out_b, out_n = [], [], []
                for q, lo, _, scores, _ in _best(row, k):
                    inside = scores if width is None else scores[scores - width < lo]
                    bins, n = np.unique(inside >> shift, return_counts=True)
                    out_q += [q] * len(bins)
                    out_b += bins.tolist()
                    out_n += n.tolist()
                yield pd.DataFrame({"vec_id": np.array(out_q, np.int64), "bin": np.array(out_b, np.int64), "n": np.array(out_n, np.int64)})
    return count


def _emit(k: int):
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                parts = [(np.full(len(s), q), s, v) for q, _, _, s, v in _best(row, k)]
                q, s, v = (np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(3))
                yield pd.DataFrame({"query_id": q, "score": s, "vec_id": v})
    return emit


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows."""
    rows = checkpoint(vectors.select("vec_id", "embedding").mapInPandas(_as_integers, "vec_id long, vec binary"))
    queries = rows.filter(is_query).dropDuplicates(["vec_id"]).withColumns({"lo": F.lit(_LOW), "above": F.lit(0).cast("long")})
    n_queries = queries.count()
    blocks = checkpoint(rows.mapInPandas(_blocks(CANDIDATES, False), _BLOCK).withColumn("share", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33) * 7, F.lit(SHARES)).cast("int")))
    largest = rows.select(F.max(F.octet_length("vec"))).first()[0] or 8
    bound = blocks.select(F.max(F.when(F.col("wide"), 62).otherwise(30))).first()[0] or 30
    shift = max(0, min(62, bound + int(largest // 8).bit_length()) - STEP)
    width, state = None, queries
    while n_queries and shift >= 0:
        counts = _tiles(state, blocks, n_queries).mapInPandas(_histogram(k, shift, width), "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        counts = counts.join(state.select("vec_id", "above"), "vec_id")
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin"))
        upto = counts.withColumn("upto", F.sum("n").over(down) + F.col("above"))
        # the first bin, from above, at which k scores are reached; none: all scores are fewer than k
        found = (upto.filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
                 .select("vec_id", (F.col("bin") * F.lit(1 << shift)).alias("to"), (F.col("upto") - F.col("n")).alias("over"), "upto"))
        state = checkpoint(state.select("vec_id", "vec", "lo", "above").join(found, "vec_id", "left").select(
            "vec_id", "vec", F.coalesce("to", "lo").alias("lo"), F.coalesce("over", "above").alias("above"), F.coalesce("upto", F.lit(0)).alias("upto")))
        done = (state.select(F.max("upto")).first()[0] or 0) <= 4 * k
        if done or shift == 0:
            break
        width, shift = 1 << shift, max(0, shift - STEP)
    found = _tiles(state, blocks, n_queries).mapInPandas(_emit(k), "query_id long, score long, vec_id long") if n_queries else \
        queries.select(F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("score"), "vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
