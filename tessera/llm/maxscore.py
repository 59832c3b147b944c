"""Exact top-k inner products by MaxScore.

A term is a dimension, a sign and a layer of magnitudes (powers of two); its posting list holds the rows of a shard whose component falls
there, and its score bound is the query's component times the layer's largest. A row lies in one layer of a dimension at most, so terms
taken from the smallest bound up stay non-essential while the sum over dimensions of their largest bounds is below the k-th best score
known; rows that no essential list holds can't enter. Essential lists are traversed, the other components probed, largest bound first,
only for rows that still can. Shards' lists of k are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

LONG = (1 << 63) - 1
EXACT = float(1 << 53)
LIMIT = float(1 << 63) * (1 - 1e-9)  # scores beyond it may be clipped to equal ones, so none is skipped for another
INDEX = "shard long, size int, small boolean, ids binary, x binary, dims binary, signs binary, low binary, high binary, starts binary, postings binary, values binary"


def _padded(lists: list[list[float]], scale: float) -> np.ndarray:
    """Rows of floored components; shorter ones end in zeros."""
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _index(x: np.ndarray) -> dict[str, np.ndarray]:
    """The posting lists of a shard, by dimension, sign and layer, magnitudes ascending."""
    layer = np.frexp(np.abs(x))[1]  # exponent: 0 for zero, so zeros are in no list
    rows, dims = np.nonzero(x)
    signs = np.sign(x[rows, dims]).astype(np.int64)
    order = np.lexsort((rows, layer[rows, dims], signs, dims))
    rows, dims, signs = rows[order], dims[order], signs[order]
    key = np.stack([dims, signs, layer[rows, dims]])
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if len(rows) else np.zeros(0, np.int64)
    magnitude = np.abs(x[rows, dims])
    edge = lambda f: f.reduceat(magnitude, starts) if len(starts) else np.zeros(0)
    return {
        "dims": dims[starts].astype(np.int32), "signs": signs[starts].astype(np.int32), "low": edge(np.minimum), "high": edge(np.maximum),
        "starts": np.r_[starts, len(rows)].astype(np.int64), "postings": rows.astype(np.int32), "values": x[rows, dims],
    }


class Shard:
    """Rows of one shard, in order of id, with their posting lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dims, signs, low, high, starts, postings, values):
        self.ids, self.x, self.dims, self.signs, self.low, self.high, self.starts, self.postings, self.values = ids, x, dims, signs, low, high, starts, postings, values
        self.columns = np.ascontiguousarray(x.T)
        self.widest = np.abs(x).max(0, initial=0)
        last = np.r_[(dims[1:] != dims[:-1]) | (signs[1:] != signs[:-1]), True] if len(dims) else np.zeros(0, bool)
        self.end = starts[1:][last][np.cumsum(np.r_[0, last[:-1]])] if len(dims) else starts  # where the lists of a term's dimension and sign end
        first = np.r_[True, (dims[1:] != dims[:-1]) | (signs[1:] != signs[:-1])] if len(dims) else np.zeros(0, bool)
        self.below = np.where(first, 0.0, np.r_[0.0, high[:-1]]) if len(dims) else high  # the next lower layer's largest
        self.visited = self.skipped = 0

    @classmethod
    def of_row(cls, r: dict) -> Shard:
        read = lambda name, kind: np.frombuffer(r[name], kind)
        x = read("x", np.float32 if r["small"] else np.float64).astype(np.float64).reshape(r["size"], -1)
        values = read("values", np.float32 if r["small"] else np.float64).astype(np.float64)
        return cls(read("ids", np.int64), x, read("dims", np.int32), read("signs", np.int32), read("low", np.float64), read("high", np.float64), read("starts", np.int64), read("postings", np.int32).astype(np.int64), values)

    def top(self, name: int, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (as doubles) of the rows that may be among the k best of query ``q``, all of them with ``least`` or more; not row ``name`` itself."""
        q = np.r_[q, np.zeros(max(0, self.x.shape[1] - len(q)))][: self.x.shape[1]]
        weight = q[self.dims] * self.signs
        active = np.flatnonzero(weight > 0)
        exact = self.exact(q)
        slack = 0.0 if exact else 1e-9 * float(np.abs(q) @ self.widest)
        floor = min(least, LIMIT) - slack
        bound, step = weight[active] * self.high[active], weight[active] * (self.high[active] - self.below[active])
        order = np.argsort(bound, kind="stable")
        cut = int(np.searchsorted(np.cumsum(step[order]), floor, "left"))  # so many terms are non-essential: their bounds sum to less than the floor
        essential, others = np.sort(active[order[cut:]]), active[order[:cut]]
        if floor <= 0:  # rows without any positive term may enter
            rows, score = np.arange(len(self.ids)), self.x @ q
        else:
            rows, score = self._probe(q, k, floor, essential, others, name, 0.0 if exact else 1e-9)
        self.visited += len(rows)
        self.skipped += len(self.ids) - len(rows)
        keep = (score >= floor) & (self.ids[rows] != name)
        return self.ids[rows[keep]], score[keep]

    def exact(self, q: np.ndarray) -> bool:
        """Whether sums of products are exact in doubles."""
        return float(np.abs(q[: len(self.widest)]) @ self.widest[: len(q)]) < EXACT

    def _probe(self, q, k, floor, essential, others, name, error):
        """Rows and whole scores of those that can reach the floor; the best k by their essential part raise it first."""
        part = np.zeros(len(self.ids))
        dims = self.dims[essential]
        # a dimension's essential layers lie side by side: from its lowest essential one to its end
        for t in essential[np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]])] if len(dims) else ():
            d, at = self.dims[t], slice(self.starts[t], self.end[t])
            np.add.at(part, self.postings[at], self.values[at] * q[d])
        reach = np.zeros(len(q))  # the largest magnitude of a dimension that no essential list holds
        np.maximum.at(reach, self.dims[others], self.high[others])
        least = np.full(len(q), np.inf)  # the smallest magnitude that one holds
        np.minimum.at(least, dims, self.low[essential])
        open_ = reach * np.abs(q)
        rest = float(open_.sum())
        rows = np.flatnonzero((part > 0) & (part + rest >= floor))  # essential parts are positive sums
        part = part[rows]
        if len(rows) > 4 * k:
            best = rows[np.argpartition(-part, k)[: k + 1]]
            best = best[self.ids[best] != name][:k]
            if len(best) == k:
                floor = max(floor, min(LIMIT, float((self.x[best] @ q).min())) - error * abs(floor))
        every = np.flatnonzero(q)
        few = max(4 * k, len(self.ids) // 8)  # so few are scored whole at once
        # the largest components first: they settle most, of the bound or by what they take away
        for group in np.array_split(every[np.argsort(-np.abs(q[every]), kind="stable")], max(1, len(every) // 4)):
            alive = part + rest >= floor
            if not alive.all():
                rows, part = rows[alive], part[alive]
            if len(rows) <= few:
                break
            for d in group:
                v = self.columns[d][rows] * np.sign(q[d])
                part += np.where(v >= least[d], 0.0, v) * abs(q[d])  # what an essential list held is counted
            rest -= float(open_[group].sum())
        return rows, self.x[rows] @ q


def _exact_scores(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer scores, clipped to a long's range."""
    w = [int(v) for v in q]
    return [max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, w, strict=False)))) for row in x]


def _indexed(rows: DataFrame, scale: float, cells: int, widest: int, count: int) -> DataFrame:
    shards = max(1, math.ceil(count * max(1, widest) / cells))

    def build(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        order = np.argsort(ids)
        x = _padded(t["v"].take(pa.array(order)).to_pylist(), scale)
        small = bool(np.abs(x).max(initial=0) <= 1 << 24)  # whole numbers of that size are exact in four bytes
        made = {k: [(v.astype(np.float32) if small and k == "values" else v).tobytes()] for k, v in _index(x).items()}
        own = {"shard": pa.array([t["shard"][0].as_py()], pa.int64()), "size": pa.array([len(ids)], pa.int32()), "small": [small]}
        return pa.table({**own, "ids": [ids[order].tobytes()], "x": [(x.astype(np.float32) if small else x).tobytes()], **made})

    dealt = rows.select((F.pmod(F.xxhash64("vec_id"), F.lit(shards))).alias("shard"), "vec_id", "v")
    return stored(dealt.groupBy("shard").applyInArrow(build, INDEX), "shards")


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, cells: int = 1 << 20, slice_cells: int = 1 << 22, seeds: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` whose id ``every`` divides, the ``k`` other rows with the largest
    inner product of ``floor(scale * component)``; ties go to the smaller vec_id, and there are fewer where the table has fewer.

    Vectors that are null or hold null or non-finite components (also after scaling) and rows without an id take no part. Shorter vectors end in zeros, so
    an empty one scores 0. Of rows with equal vec_id the smallest vector counts. Scores are exact and clipped to a long's range. An empty
    table gives no rows; other columns are ignored. A shard holds ``cells`` components, a broadcast slice of queries ``slice_cells``; one
    slice after another meets all shards. ``seeds`` rows give each query a score to beat; they steer skipping, not results.
    """
    good = F.expr(f"vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double) * {scale}) < double('infinity'))")
    held = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = stored(held.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    count, widest, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    widest = max(1, widest or 1)
    index = _indexed(rows, scale, cells, widest, count)
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(max(k + 1, min(seeds, cells // widest))).toArrow()
    known, known_ids = _padded(sample["v"].to_pylist(), scale), sample["vec_id"].to_numpy()
    slices = max(1, math.ceil(asked * widest / slice_cells))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("_slice", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)))
    out = None
    for s in range(slices):
        part = queries.where(F.col("_slice") == s).select("vec_id", "v").toArrow()
        if not part.num_rows:
            continue
        found = _searched(index, part["vec_id"].to_numpy(), _padded(part["v"].to_pylist(), scale), k, known_ids, known)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.select(F.col("shard").alias("query_id"), F.col("size").alias("rank"), F.col("shard").alias("vec_id"), F.col("shard").alias("score")).where(F.lit(False))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, names: np.ndarray, q: np.ndarray, k: int, known_ids: np.ndarray, known: np.ndarray) -> DataFrame:
    """``query_id, vec_id, score``: each task's k best for each query of a slice, written out."""
    width = max(q.shape[1], known.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    q, known = wide(q), wide(known)
    least = np.full(len(names), -np.inf)
    for i in range(0, len(names), 1024):
        score = q[i : i + 1024] @ known.T
        score[names[i : i + 1024, None] == known_ids[None, :]] = -np.inf
        if len(known_ids) > k:
            rough = np.abs(q[i : i + 1024]) @ np.abs(known).max(0, initial=0) * 1e-9
            least[i : i + 1024] = np.partition(score, -k, axis=1)[:, -k] - np.where(rough < EXACT * 1e-9, 0, rough)
    sent = index.sparkSession.sparkContext.broadcast((names, q, least))

    def search(batches):
        names, q, least = sent.value
        floor = least.copy()
        best: list[list[tuple[int, int]]] = [[] for _ in names]  # (-score, id)
        for batch in batches:
            for j in range(batch.num_rows):
                shard = Shard.of_row(batch.slice(j, 1).to_pylist()[0])
                for i, name in enumerate(names.tolist()):
                    found, score = shard.top(name, q[i], k, float(floor[i]))
                    if not len(found):
                        continue
                    if shard.exact(q[i]):
                        first = np.argsort(-score, kind="stable")[:k]  # ids ascend, so the smaller of equals comes first
                        found, whole = found[first], score[first].astype(np.int64).tolist()
                    else:
                        whole = _exact_scores(shard.x[np.searchsorted(shard.ids, found)], q[i])
                    best[i] = sorted([*best[i], *((-s, v) for s, v in zip(whole, found.tolist(), strict=True))])[:k]
                    if len(best[i]) == k:
                        floor[i] = max(floor[i], np.nextafter(float(-best[i][-1][0]), -np.inf))
        rows = [(name, v, -s) for name, b in zip(names.tolist(), best, strict=True) for s, v in b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    found = stored(index.mapInArrow(search, "query_id long, vec_id long, score long"), "found")
    sent.destroy()
    return found


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5"""
