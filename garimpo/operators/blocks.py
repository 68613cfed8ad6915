"""Many queries against all chunks, in blocks of both: exact scores of every match, the first k kept for each block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.workdir import materialize

QUERIES, CHUNKS = 4096, 8192  # queries and chunks of a block
AT_ONCE = 256  # queries scored together: their scores are one array of AT_ONCE x CHUNKS at most


def best_of_block(asked: pa.Table, postings: pa.Table, k: int, unit: float) -> pa.Table:
    """(s, id_chunk, score) of the first ``k`` chunks of each query of (s, term), among (term, id_chunk, part).

    Parts are whole numbers whose sums a double holds exactly. A score is its sum over ``unit``, rounded to four places
    (``unit`` 0: the sum itself); ties go by id.
    """
    terms = pc.unique(postings["term"])
    ids = pc.unique(postings["id_chunk"])
    ids = ids.take(pc.sort_indices(ids))  # so that ties of the score are in the order of their ids
    of = np.asarray(pc.index_in(postings["term"], terms)).astype(np.int64)
    chunk = np.asarray(pc.index_in(postings["id_chunk"], ids)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    chunk, part = chunk[order], np.asarray(postings["part"]).astype(np.float64)[order]
    first = np.searchsorted(of[order], np.arange(len(terms) + 1))
    queries = pc.unique(asked["s"])
    query = np.asarray(pc.index_in(asked["s"], queries)).astype(np.int64)
    term = np.asarray(pc.fill_null(pc.index_in(asked["term"], terms), -1)).astype(np.int64)
    order = np.argsort(query, kind="stable")
    query, term = query[order][term[order] >= 0], term[order][term[order] >= 0]
    width, found = len(ids), []
    for begin in range(0, len(queries), AT_ONCE):
        some = slice(*np.searchsorted(query, (begin, begin + AT_ONCE)))
        start, size = first[term[some]], first[term[some] + 1] - first[term[some]]
        total = int(size.sum())
        if total == 0:
            continue
        at = np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
        cell = np.repeat(query[some] - begin, size) * width + chunk[at]
        rows = min(AT_ONCE, len(queries) - begin)
        sums = np.bincount(cell, part[at], rows * width).reshape(rows, width)
        score = np.round(sums / unit, 4) if unit else sums
        if width > k:  # all that reach the k-th score of their query, ties too
            least = np.maximum(np.partition(score, width - k, axis=1)[:, width - k], np.finfo(float).tiny)
            q, c = np.nonzero(score >= least[:, None])
        else:
            q, c = np.nonzero(score > 0)
        order = np.lexsort((c, -score[q, c], q))
        q, c = q[order], c[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, c = q[place < k], c[place < k]
        found.append((q + begin, c, score[q, c]))
    q, c, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"s": queries.take(pa.array(q)), "id_chunk": ids.take(pa.array(c)), "score": pa.array(score, pa.float64())})


def best_in_blocks(asked: DataFrame, postings: DataFrame, k: int, unit: float) -> DataFrame:
    """(s, posicao, id_chunk, score) of the first ``k`` chunks of every query of (s bigint, term), among (term, id_chunk, part).

    A block of queries meets every block of chunks, each pair in a task of bounded size; a posting goes only to the blocks of
    queries that ask for its term. What comes back is at most ``k`` rows a query and block of chunks.
    """
    asked, postings = materialize(asked, "perguntas"), materialize(postings, "pesos")
    across = max(1, -(-asked.select("s").distinct().count() // QUERIES))
    down = max(1, -(-postings.select("id_chunk").distinct().count() // CHUNKS))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("s"), F.lit(across)).cast("int"))
    wanted = asked.select(F.col("qb").alias("rq"), F.col("term").alias("rt")).distinct()
    right = postings.join(wanted, F.col("term") == F.col("rt")).select("rq", F.pmod(F.xxhash64("id_chunk"), F.lit(down)).cast("int").alias("rc"), "term", "id_chunk", "part")
    left = asked.select("qb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("cb"), "s", "term")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_of_block(a, b, k, unit)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("rq", "rc")).applyInArrow(score, "s bigint, id_chunk string, score double")
    order = Window.partitionBy("s").orderBy(F.col("score").desc(), F.col("id_chunk"))
    ranked = found.withColumn("posicao", F.row_number().over(order))
    return ranked.where(F.col("posicao") <= k).select("s", "posicao", "id_chunk", "score")
