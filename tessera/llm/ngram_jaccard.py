"""N-gram Jaccard join by a token-group matrix.

Documents become sets of hashed word shingles. Equal sets are one node. Similar nodes are put into groups: nodes that
share a minimum hash are compared with one of them only, another for each of several hashes, and what links is one group, dealt to parts
of some dozens of members. The stored matrix has a row for each rare token, part of a group and size of its members; a node meets
the parts that share a token with it which is rare enough in both for their sizes, and every link lies among these meetings. A node that doesn't link with
its group's smallest member is held against the parts' token unions: it may be linked with a member only if at least the
threshold's share of its own tokens is in the union, and only parts that reach this bound are opened. Copies and near copies meet
their group's smallest node, never each other, so a group's size costs in proportion.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bloom_of, bounded_batches, ceil_share, partitions, salted_join, stored, texts, unused
from .graph import connected_components

#: Minimum hashes of a set, and how many two sets must share to be compared while groups are made.
HASHES, ALIKE = 12, 6
#: Odd multipliers of the minimum hashes, and of the word and shingle hashes.
SEEDS = tuple(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(HASHES))
#: Rare tokens that a node and a group must share before they are compared; more of them lengthen what is shuffled.
SHARED = 1
STEP, MIX = np.uint64(0x200000101B3), np.uint64(0xFF51AFD7ED558CCD)
BASE, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
SKETCH_BITS, BLOCK = 24, 1 << 18
SEGMENT = 1 << 20
#: Members of a group whose union is one entry of the matrix, about.
UNION_MEMBERS = 48


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same for A-Z as for a-z."""
    x = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64) + np.uint64(1)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m) + np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


_VALUES = _byte_values()
_IN_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)], np.int8)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """BASE ** i and INVERSE ** i for i < n at least."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            x = _POWERS[k]
            _POWERS[k] = np.concatenate([x, x * np.uint64(pow(base, len(x), 1 << 64))])
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words split at ASCII white space, A-Z as a-z: differences of a prefix sum, moved to power 0."""
    out, at = [], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        end = at + SEGMENT
        while end < len(data) and _IN_WORD[data[end]]:
            end += 1
        part = data[at:end]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
        edges = np.flatnonzero(np.diff(_IN_WORD[part], prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        out.append((sums[ends] - sums[starts]) * down[starts])
        at = end
    h = np.concatenate(out) if out else np.empty(0, np.uint64)
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; with fewer words, of the whole sequence."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * STEP + h[i : len(h) - width + 1 + i]
        out ^= out >> np.uint64(29)
    out *= MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_id(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _long(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _summaries(k: int):
    """A row for each document (kind 0), and the task's token counts by cell (kind 1, dense; 2, sparse)."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("keys", pa.list_(pa.int32())), ("block", pa.int32()), ("blob", pa.binary())])

    def run(batches):
        cells, docs = np.zeros(1 << SKETCH_BITS, np.uint16), 0
        for batch in batches:
            n, sid, keys = [], [], []
            for t in texts(batch["text"]):
                s = shingle_set(t, k)
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                keys.append([int((s * np.uint64(m)).min() >> np.uint64(33)) for m in SEEDS] if len(s) else None)
                np.add.at(cells, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint16(1))
                if (docs := docs + 1) % 30_000 == 0:
                    np.minimum(cells, 255, out=cells)
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int8()), batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int32())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        for b in range((1 << SKETCH_BITS) // BLOCK) if docs else ():
            part = np.minimum(cells[b * BLOCK : (b + 1) * BLOCK], 255).astype(np.uint8)
            at = np.flatnonzero(part)
            if len(at):
                sparse = len(at) < BLOCK // 8
                blob = at.astype(np.uint32).tobytes() + part[at].tobytes() if sparse else part.tobytes()
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([2 if sparse else 1], pa.int8()), none, none, none, none, pa.nulls(1, pa.list_(pa.int32())), pa.array([b], pa.int32()), pa.array([zlib.compress(blob, 1)], pa.binary())], schema=schema)

    return run, "kind tinyint, doc_id long, text_key long, n long, sid long, keys array<int>, block int, blob binary"


def _levels(counted: DataFrame) -> np.ndarray:
    """log2 of each cell's count over all documents. Fixed in size; it only orders tokens, so cells that collide cost time, never links."""

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for kind, b, blob in zip(x["kind"].to_pylist(), x["block"].to_pylist(), x["blob"].to_pylist(), strict=True):
                raw, into = zlib.decompress(blob), sums.setdefault(b, np.zeros(BLOCK, np.uint64))
                if kind == 1:
                    into += np.frombuffer(raw, np.uint8)
                else:
                    n = len(raw) // 5
                    into[np.frombuffer(raw[: 4 * n], np.uint32)] += np.frombuffer(raw[4 * n :], np.uint8)
        for b, x in sums.items():
            level = np.floor(np.log2(np.maximum(x, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "blob": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in counted.select("kind", "block", "blob").repartition(partitions(counted.sparkSession), "block").mapInArrow(merged, "block int, blob binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.blob, np.uint8)
    return out


def _rarest(k: int, levels, percent: int, wanted=None):
    """``sid, n, places, tokens``: each set's size and rarest tokens, rarest first with their places in that order, enough to meet every
    similar set; with ``wanted``, only those that this Bloom filter may hold. Once for each set and task."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int32()), ("places", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows, held = [], 0
            for t in texts(batch["text"]):
                s = shingle_set(t, k)
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                rank = levels.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rare = _long(s[np.argsort(rank, kind="stable")[: len(s) - ceil_share(len(s), percent) + SHARED]])
                places = np.arange(len(rare)) if wanted is None else np.flatnonzero(wanted.value.has(rare))
                if len(places):
                    rows.append((i, len(s), places.astype(np.int32), rare[places]))
                    held += len(places)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "sid long, n int, places array<int>, tokens array<long>"


def _packed_texts(wanted):
    """The texts that the Bloom filter may hold, compressed: a fraction of the size of their tokens. Once for each text and task."""

    def run(batches):
        seen: set[int] = set()
        zipper = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hit = np.flatnonzero(wanted.value.has(batch["text_key"].to_numpy(zero_copy_only=False)))
            part = batch.take(pa.array(hit))
            keys, blobs = [], []
            for key, t in zip(part["text_key"].to_pylist(), texts(part["text"]), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    blobs.append(zipper.compress(t))
            if keys:
                yield pa.RecordBatch.from_pydict({"text_key": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run, "text_key long, blob binary"


def _token_rows(source: DataFrame, groups: DataFrame, k: int, levels, percent: int) -> DataFrame:
    """``token, sid, gid, part, n, reach``: the rarest tokens that sets of two groups hold at least, of every set that has them.

    Sets of sizes n >= m link with at least a = percent * (n + m) / (100 + percent) tokens in common, so SHARED of them are
    among the n - a + SHARED rarest of the one and the m - a + SHARED rarest of the other. ``reach``: the largest size of another set for which
    the token is rare enough in this one. Most tokens are a single group's: which are not is found by a combining
    aggregate over tokens alone, and only those, as a Bloom filter tells, are dealt out with their sets.
    """
    spark = source.sparkSession
    gid = F.coalesce("gid", "sid").alias("gid")
    run, schema = _rarest(k, levels, percent)
    held = source.select("text").mapInArrow(run, schema).join(groups.select("sid", "gid"), "sid", "left").select(F.explode("tokens").alias("token"), gid)
    common = held.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low <> high").select("token")
    wanted = spark.sparkContext.broadcast(bloom_of(stored(common, "tokens")))
    run, schema = _rarest(k, levels, percent, wanted)
    rows = source.select("text").mapInArrow(run, schema).join(groups, "sid", "left")
    rows = rows.select("sid", gid, F.coalesce("part", F.lit(0)).alias("part"), "n", F.explode(F.arrays_zip("places", "tokens")).alias("x"))
    reach = F.expr(f"cast((n - x.places + {SHARED - 1}) * {100 + percent} div {percent} - n as int)")
    out = stored(rows.select(F.col("x.tokens").alias("token"), "sid", "gid", "part", "n", reach.alias("reach")).distinct(), "token-rows")
    wanted.destroy()
    return out


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """``sid, gid, part``: sets, and the parts of other groups that have a member of their size or smaller with which they may link.

    The token-group matrix has a row for each rare token, part of a group and size of its members. A token that one group's many
    members share is one row a part and size; one that many sets ask for is salted.
    """
    matrix = rows.where("reach >= n").groupBy("token", "gid", "part", F.col("n").alias("m")).agg(F.max("reach").alias("reached"))
    matrix = stored(matrix.select("token", F.col("gid").alias("g"), F.col("part").alias("p"), "m", "reached"), "matrix")
    asked = salted_join(rows.select("token", "sid", "gid", "n", "reach"), matrix, ["token"], by="sid")
    fits = f"g <> gid and m <= n and 100 * m >= {percent} * n and m <= reach and reached >= n and (m < n or g < gid)"
    return stored(asked.where(fits).select("sid", F.col("g").alias("gid"), F.col("p").alias("part")).distinct(), "met")


class _Sets:
    """The sets of compressed texts, the last few kept."""

    def __init__(self, k: int):
        self.k, self.unzip, self.kept = k, zstandard.ZstdDecompressor(), {}

    def get(self, key: int, blob: bytes) -> np.ndarray:
        if key not in self.kept:
            if len(self.kept) >= 64:
                self.kept.clear()
            self.kept[key] = shingle_set(self.unzip.decompress(blob), self.k)
        return self.kept[key]


def _verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have at least this Jaccard similarity."""

    def compare(batches):
        kept = _Sets(k)
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            good = [similar(kept.get(x, s), kept.get(y, t), percent) for x, y, s, t in zip(a, b, batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"]}).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("sid").alias("a"), F.col("blob").alias("sa"))
    two = sets.select(F.col("sid").alias("b"), F.col("blob").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _by_part(rows: DataFrame, spark) -> DataFrame:
    """``gid, part, kind, sid, blob`` dealt by part, what is of kind 0 first."""
    return rows.repartition(partitions(spark), "gid", "part").sortWithinPartitions("gid", "part", "kind").select("gid", "part", "kind", "sid", "blob")


def _unions(members: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """``gid, part, blob``: the union of the tokens of each part's ``members(gid, part, sid)``, sorted and compressed."""
    rows = members.select("gid", "part", F.lit(0).alias("kind"), "sid").join(sets.select("sid", "blob"), "sid")

    def run(batches):
        unzip, zipper = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, union = None, np.empty(0, np.uint64)
        made = lambda: pa.RecordBatch.from_pydict({"gid": pa.array([now[0]], pa.int64()), "part": pa.array([now[1]], pa.int32()), "blob": pa.array([zipper.compress(np.diff(union, prepend=np.uint64(0)).tobytes())], pa.binary())})
        for batch in batches:
            for gid, part, blob in zip(*(batch[c].to_pylist() for c in ("gid", "part", "blob")), strict=True):
                if (gid, part) != now:
                    if now is not None:
                        yield made()
                    now, union = (gid, part), np.empty(0, np.uint64)
                union = np.union1d(union, shingle_set(unzip.decompress(blob), k))
        if now is not None:
            yield made()

    return stored(_by_part(rows, members.sparkSession).mapInArrow(run, "gid long, part int, blob binary"), "unions")


def _qualifying(asked: DataFrame, unions: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``asked(sid, gid, part)`` whose set has enough tokens in the part's union to be similar to a member."""
    own = unions.select("gid", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("sid"), "blob")
    rows = own.unionByName(asked.select("gid", "part", F.lit(1).alias("kind"), "sid").join(sets.select("sid", "blob"), "sid"))

    def run(batches):
        unzip, union, now = zstandard.ZstdDecompressor(), np.empty(0, np.uint64), None
        for batch in batches:
            found = []
            for gid, part, kind, sid, blob in zip(*(batch[c].to_pylist() for c in ("gid", "part", "kind", "sid", "blob")), strict=True):
                if kind == 0:
                    union, now = np.cumsum(np.frombuffer(unzip.decompress(blob), np.uint64), dtype=np.uint64), (gid, part)
                elif now == (gid, part):
                    s = shingle_set(unzip.decompress(blob), k)
                    if 100 * len(np.intersect1d(s, union, assume_unique=True)) >= percent * len(s):
                        found.append((sid, gid, part))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["sid", "gid", "part"])

    return stored(_by_part(rows, asked.sparkSession).mapInArrow(run, "sid long, gid long, part int"), "qualifying")


def _opened(members: DataFrame, asked: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` of ``asked(sid, gid, part)`` with the parts' ``members(gid, part, sid)``, the first of each, which is all that components need."""
    open_ = members.join(asked.select("gid", "part").distinct(), ["gid", "part"], "left_semi")
    rows = open_.select("gid", "part", F.lit(0).alias("kind"), "sid").unionByName(asked.select("gid", "part", F.lit(1).alias("kind"), "sid")).join(sets.select("sid", "blob"), "sid")

    def run(batches):
        unzip, now, inside = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            a, b = [], []
            for gid, part, kind, sid, blob in zip(*(batch[c].to_pylist() for c in ("gid", "part", "kind", "sid", "blob")), strict=True):
                if (gid, part) != now:
                    now, inside = (gid, part), []
                s = shingle_set(unzip.decompress(blob), k)
                if kind == 0:
                    inside.append((sid, s))
                    continue
                for other, x in inside:
                    if 100 * min(len(s), len(x)) >= percent * max(len(s), len(x)) and similar(s, x, percent):
                        a.append(sid)
                        b.append(other)
                        break
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(_by_part(rows, members.sparkSession).mapInArrow(run, "a long, b long"), "links")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n, sid, component`` of every row; component names a group of nodes, or a row without words."""
    spark = docs.sparkSession
    source = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    run, schema = _summaries(k)
    all_rows = stored(source.mapInArrow(run, schema), "shingles")
    rows = all_rows.where("kind = 0")
    nodes = stored(rows.where("n > 0").groupBy("sid").agg(F.min("text_key").alias("text_key"), F.first("keys").alias("keys")), "nodes")

    def sets_of(ids: DataFrame) -> DataFrame:
        """``sid, blob`` of the nodes ``ids(sid)``."""
        keys = stored(nodes.select("sid", "text_key").join(ids, "sid", "left_semi"), "keys")
        wanted = spark.sparkContext.broadcast(bloom_of(keys.select("text_key")))
        fetch, out = _packed_texts(wanted)
        found = source.select("text_key", "text").mapInArrow(fetch, out).groupBy("text_key").agg(F.first("blob").alias("blob"))
        sets = stored(found.join(keys, "text_key").select("sid", "blob"), "sets")
        wanted.destroy()
        return sets

    keyed = nodes.select("sid", F.posexplode("keys").alias("r", "key"))
    buckets = keyed.groupBy("r", "key").agg(F.count("*").alias("m")).where("m > 1")
    alikes = stored(salted_join(keyed, buckets, ["r", "key"], by="sid"), "buckets")
    # every other hash compares with the node that most others share keys with, the rest with any one
    popular = alikes.groupBy("sid").agg(F.sum("m").alias("popular"))
    order = F.struct(F.when(F.col("r") % 2 == 0, F.col("popular")).otherwise(0), F.xxhash64("sid", "r"))
    centres = alikes.join(popular, "sid").groupBy("r", "key").agg(F.max_by("sid", order).alias("centre"))
    near = salted_join(alikes, centres, ["r", "key"], by="sid").where("sid <> centre").select(F.col("sid").alias("a"), F.col("centre").alias("b")).distinct()
    keys_of = lambda side: nodes.select(F.col("sid").alias(side), F.col("keys").alias("keys_" + side))
    alike = f"size(filter(zip_with(keys_a, keys_b, (x, y) -> x = y), x -> x)) >= {ALIKE}"
    pairs = stored(salted_join(near.join(keys_of("a"), "a"), keys_of("b"), ["b"], by="a").where(alike).select("a", "b"), "pairs")
    links = stored(_verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()), k, percent), "links")
    label = stored(connected_components(links), "groups").select(F.col("node").alias("sid"), F.col("component").alias("gid"))
    parts = label.groupBy("gid").agg(F.expr(f"cast(ceil(count(*) / {UNION_MEMBERS}) as int)").alias("parts"))
    groups = stored(salted_join(label, parts, ["gid"], by="sid").select("sid", "gid", F.expr("cast(pmod(xxhash64(sid), parts) as int)").alias("part")), "members")

    levels = spark.sparkContext.broadcast(_levels(all_rows.where("kind > 0")))
    token_rows = _token_rows(source, groups, k, levels, percent)
    levels.destroy()
    met = _met(token_rows, percent)
    ends = met.select("sid").union(met.select("gid")).distinct()
    sets = sets_of(ends)
    first = stored(_verified(met.select(F.col("sid").alias("a"), F.col("gid").alias("b")).distinct(), sets, k, percent), "links")
    rest = stored(met.join(first.select(F.col("a").alias("sid"), F.col("b").alias("gid")), ["sid", "gid"], "left_anti").join(groups.select("gid").distinct(), "gid", "left_semi"), "rest")
    members = stored(groups.join(rest.select("gid", "part").distinct(), ["gid", "part"], "left_semi"), "members")
    inner = sets_of(members.select("sid").distinct())
    asked = _qualifying(rest, _unions(members, inner, k), sets, k, percent)
    more = _opened(members, asked, sets.unionByName(inner).dropDuplicates(["sid"]), k, percent)

    linked = stored(connected_components(links.unionByName(first).unionByName(more)), "components")
    found = salted_join(rows.select("doc_id", "text_key", "n", "sid"), linked.select(F.col("node").alias("sid"), "component"), ["sid"], by="doc_id", how="left")
    return found.withColumn("component", F.coalesce("component", "sid", F.xxhash64("doc_id")))


def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``; rows link at Jaccard >= percent / 100.

    Null and blank texts: no shingles, a component of their own. Fewer words than k: the whole sequence is one shingle.
    Rows repeated or with equal sets: in one component. Null doc_id: kept, counts last as a component's smallest id, so
    the component's id is null only if all its ids are. Empty table: no rows. Other columns are ignored. Texts, sets and
    shingles are told apart by 64-bit hashes.
    """
    rows = stored(_components(docs, k, percent), "named")
    least = rows.where("sid is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return salted_join(rows, least, ["component"], by="doc_id", how="left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component the row with the smallest doc_id stays.

    Null ids count last, equal ids by the text's hash; of rows equal in both, one stays. Rows without words all stay.
    """
    rows = stored(_components(docs, k, percent).where("sid is not null"), "components")
    key = unused(docs, "row_key")
    pick = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row"))
    pick = pick.select(F.xxhash64("row.doc_id", "row.text_key").alias(key)).distinct()
    blank = F.coalesce(~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(True))
    keyed = docs.where(~blank).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return docs.where(blank).unionByName(keyed.join(pick, key, "left_semi").dropDuplicates([key]).select(*docs.columns))


#: ``ngram_jaccard_components`` in DuckDB's SQL: all pairs that share a shingle are counted.
ORACLE_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingles as (
  select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [hash(array_to_string(w, ' '))] else [] end)) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as m from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * m >= 75 * (x.n + y.n - m)),
ways as (select a, b from links union all select b, a from links),
reach as (select a as node, b as other from ways union select r.node, l.b from reach r join ways l on r.other = l.a),
lowest as (select node, min(other) as c from reach group by node)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) as component_id
from documents d left join sizes s on d.doc_id = s.doc_id left join lowest l on d.doc_id = l.node"""
