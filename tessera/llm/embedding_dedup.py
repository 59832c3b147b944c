"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine >= c lie within epsilon = sqrt(2 - 2c) of each other. Vectors of one label are sorted by the cells of
an epsilon grid on their leading principal dimensions and cut into blocks. Blocks whose boxes (those dimensions, and the
length of the rest of the vector) are farther apart than epsilon cannot meet; the others are joined by halving both
sequences again and again, dropping halves that are provably distant, down to small dense products. A pair of blocks
returns each vector's sum of links and one edge towards its local component, so large groups of copies cost no more rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, stored
from .graph import connected_components

BLOCK, LEAF = 512, 128


def principal_axes(vectors: DataFrame, leading: int, sample: int) -> dict[int, np.ndarray]:
    """Leading principal axes of the commonest vector length, from the ``sample`` vectors of the smallest hashes.

    The axes only steer which blocks are skipped; any orthonormal ones give the same links. Other lengths take their first coordinates.
    """
    common = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return {}
    rows = vectors.where(F.col("size") == common["size"]).orderBy(F.xxhash64("v"), "nid").select("v").limit(sample).collect()
    x = np.array([r["v"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return {common["size"]: axes[:leading].T.copy()}


def _scaled(lists: list[list[float]]) -> np.ndarray:
    """Vectors multiplied by powers of two so that no square overflows or vanishes."""
    x = np.array(lists, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _projected(x: np.ndarray, axes: dict[int, np.ndarray], leading: int) -> np.ndarray:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = axes.get(x.shape[1])
    p = u[:, :leading] if a is None else u @ a
    p = np.pad(p, ((0, 0), (0, leading - p.shape[1])))
    return np.c_[p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))]


def _blocks(vectors: DataFrame, epsilon: float, axes: dict[int, np.ndarray], leading: int) -> DataFrame:
    """Blocks of at most ``BLOCK`` vectors in epsilon grid order, each of one label and length."""

    def place(batches):
        for batch in batches:
            lists = batch["v"].to_pylist()
            p = np.empty((len(lists), leading + 1))
            by: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by.setdefault(len(v), []).append(i)
            for at in by.values():
                p[at] = _projected(_scaled([lists[i] for i in at]), axes, leading)
            cells = np.floor(p / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "cells", "p"])

    placed = vectors.select("nid", "label", "size", "m", "v").mapInArrow(place, "nid long, label long, size int, m long, v array<double>, cells array<int>, p array<double>")
    order = ["label", "size", *[F.col("cells")[i] for i in range(leading)], "nid"]
    dealt = placed.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches):
        waiting: list[tuple] = []

        def block():
            nids, labels, sizes, ms, vs, cells, ps = zip(*waiting, strict=True)
            p = np.array(ps)
            waiting.clear()
            return {
                "bid": nids[0], "label": labels[0], "size": sizes[0], "first": min(c[0] for c in cells), "last": max(c[0] for c in cells), "low": p.min(0).tolist(), "high": p.max(0).tolist(),
                "n": len(nids), "nids": np.array(nids, np.int64).tobytes(), "ms": np.array(ms, np.int64).tobytes(), "vs": _scaled(vs).tobytes(), "ps": p.tobytes(),
            }

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (len(waiting) == BLOCK or waiting[0][1:3] != row[1:3]):
                    out.append(block())
                waiting.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if waiting:
            yield pa.RecordBatch.from_pylist([block()], schema)

    schema = pa.schema([("bid", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("n", pa.int32()), ("nids", pa.binary()), ("ms", pa.binary()), ("vs", pa.binary()), ("ps", pa.binary())])
    return stored(dealt.mapInArrow(cut, "bid long, label long, size int, first int, last int, low array<double>, high array<double>, n int, nids binary, ms binary, vs binary, ps binary"), "blocks")


class _Sequence:
    """An interval of one block's vectors, with the box around it."""

    def __init__(self, v: np.ndarray, norm: np.ndarray, p: np.ndarray, at: int):
        self.v, self.norm, self.p, self.at, self.low, self.high = v, norm, p, at, p.min(0), p.max(0)

    def __len__(self) -> int:
        return len(self.v)

    def halves(self) -> tuple[_Sequence, _Sequence]:
        h = len(self) // 2
        return _Sequence(self.v[:h], self.norm[:h], self.p[:h], self.at), _Sequence(self.v[h:], self.norm[h:], self.p[h:], self.at + h)

    def distant(self, other: _Sequence, epsilon: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float(gap @ gap) > epsilon * epsilon


def _join(a: _Sequence, b: _Sequence, epsilon: float, least: float, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    if a.distant(b, epsilon):
        return
    if len(a) <= LEAF and len(b) <= LEAF:
        i, j = np.nonzero((a.v @ b.v.T) / (a.norm[:, None] * b.norm[None, :]) >= least)
        found.append((i + a.at, j + b.at))
    elif len(a) >= len(b):
        for part in a.halves():
            _join(part, b, epsilon, least, found)
    else:
        for part in b.halves():
            _join(a, part, epsilon, least, found)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name that links reach, for each of n vectors."""
    root = names.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def _linked(pairs: DataFrame, epsilon: float, least: float) -> DataFrame:
    """``nid, links, root`` for the vectors with links in each pair of blocks."""

    def sequence(row, side: str) -> tuple[np.ndarray, np.ndarray, _Sequence]:
        n = row["n" + side]
        v, p = np.frombuffer(row["vs" + side]).reshape(n, -1), np.frombuffer(row["ps" + side]).reshape(n, -1)
        return np.frombuffer(row["nids" + side], np.int64), np.frombuffer(row["ms" + side], np.int64), _Sequence(v, np.linalg.norm(v, axis=1), p, 0)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found: list[tuple[np.ndarray, np.ndarray]] = []
                names, many, a = sequence(row, "1")
                if row["bid1"] == row["bid2"]:
                    _join(a, a, epsilon, least, found)
                    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                    i, j = i[i < j], j[i < j]
                else:
                    others, more, b = sequence(row, "2")
                    _join(a, b, epsilon, least, found)
                    if not found:
                        continue
                    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                    j = j + len(names)
                    names, many = np.r_[names, others], np.r_[many, more]
                if not len(i):
                    continue
                links = np.bincount(i, many[j], len(names)) + np.bincount(j, many[i], len(names))
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"nid": names[at], "links": links[at].astype(np.int64), "root": _local_roots(len(names), i, j, names)[at]})

    return pairs.mapInArrow(run, "nid long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, leading: int = 6, sample: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows of one label and vector length link at cosine >= ``least`` in double precision; equal vectors link too. Null
    labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Repeated
    rows are vectors of their own, joined as one. Null vec_id: kept as rows, last in a component's smallest id, ``kept`` false.
    Empty table: no rows. Other columns are ignored. Equal vectors are told by a 64-bit hash.
    """
    epsilon = float(np.sqrt(2 - 2 * least)) + 1e-6
    good = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = source.withColumn("v", F.when(F.coalesce(F.expr(good), F.lit(False)), F.transform("embedding", lambda x: x + F.lit(0.0)))).withColumn("nid", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    keyed = rows.where("nid is not null").groupBy("nid").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    nodes = stored(keyed.withColumn("size", F.size("v")), "vectors")

    blocks = _blocks(nodes, epsilon, principal_axes(nodes, leading, sample), leading)
    box = blocks.select("bid", "label", "size", "first", "last", "low", "high")
    one = box.select(*[F.col(c).alias(c if c in ("label", "size") else c + "1") for c in box.columns], F.explode(F.expr("sequence(first - 1, last + 1)")).alias("cell"))
    two = box.select(*[F.col(c).alias(c if c in ("label", "size") else c + "2") for c in box.columns], F.explode(F.expr("sequence(first, last)")).alias("cell"))
    gap = f"aggregate(zip_with(zip_with(low1, high2, (a, b) -> a - b), zip_with(low2, high1, (a, b) -> a - b), (a, b) -> greatest(0D, a, b)), 0D, (s, x) -> s + x * x) <= {epsilon * epsilon!r}D"
    near = one.join(two, ["label", "size", "cell"]).where("bid1 <= bid2").where(gap).select("bid1", "bid2").distinct()
    load = lambda side: blocks.select(*[F.col(c).alias(c + side) for c in ("bid", "n", "nids", "ms", "vs", "ps")])
    pairs = near.join(load("1"), "bid1").join(load("2"), "bid2").select("bid1", "bid2", *[c + s for s in "12" for c in ("n", "nids", "ms", "vs", "ps")])
    found = stored(_linked(pairs, epsilon, least), "links")

    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    components = connected_components(found, "nid", "root").withColumnRenamed("node", "nid")
    named = nodes.select("nid", "m", "least").join(components, "nid", "left").join(links, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("nid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.coalesce("nid", F.xxhash64(F.lit("alone"), "vec_id")).alias("nid"), F.col("nid").isNotNull().alias("known")).join(named, "nid", "left")
    out = out.select("vec_id", F.when(F.col("known"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)))


ORACLE_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
  select a as node, b as other from links
  union
  select r.node, l.b from reach r join links l on r.other = l.a
), counted as (
  select a as vec_id, count(*) as n_links from links group by a
), lowest as (
  select node as vec_id, min(other) as least from reach group by node
)
select e.vec_id, coalesce(c.n_links, 0)::bigint as n_links, least(e.vec_id, coalesce(l.least, e.vec_id)) as component_id,
  least(e.vec_id, coalesce(l.least, e.vec_id)) = e.vec_id as kept
from embeddings e left join counted c on e.vec_id = c.vec_id left join lowest l on e.vec_id = l.vec_id"""
