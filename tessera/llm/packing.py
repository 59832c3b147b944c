"""Best-fit packing of token pieces into sequences by bin completion over the histogram of lengths.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the search runs on their counts: best-fit
decreasing gives the first incumbent, fillings without a gap another; unless one meets the lower bound, branch and bound takes the largest remaining
length, enumerates the undominated fillings of the room beside it, and drops branches whose waste can no longer beat
the incumbent. The plan tells how many sequences take which lengths; pieces, ranked within their length by Spark, look up their place in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, partitions, stored, unused
from .tokenizing import encoder, forget

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), and so on
Plan = list[tuple[Pattern, int]]  # a pattern, and how many sequences have it
#: Word pieces that a worker remembers.
REMEMBER = 800_000


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Each piece, longest first, into the fullest sequence that still has room; equal sequences are handled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: Plan = []

    def put(pattern: Pattern, room: int, times: int) -> None:
        if times and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, times))
        elif times:
            done.append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put(((length, each),), capacity - each * length, left // each)
                put(((length, left % each),), capacity - left % each * length, int(left % each > 0))
                break
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = room // length
            full = min(times, left // each)
            put((*pattern, (length, each)), room - each * length, full)
            left, times = left - full * each, times - full
            if times and left:
                put((*pattern, (length, left)), room - left * length, 1)
                left, times = 0, times - 1
            put(pattern, room, times)
    return done + [x for room in rooms for x in open_[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """At least so many sequences: Martello and Toth's bound over all thresholds."""
    n = np.zeros(capacity + 1, np.int64)
    for x, m in counts.items():
        n[x] = m
    size = np.arange(capacity + 1)
    above, mass = np.r_[np.cumsum(n[::-1])[::-1], 0], np.cumsum(n * size)  # pieces of x or longer; tokens in pieces up to x
    large = capacity // 2 + 1  # the shortest of which no two fit together
    k = np.r_[0, size[1:large]]
    alone, half = above[capacity - k + 1], above[large] - above[capacity - k + 1]
    room = half * capacity - (mass[capacity - k] - mass[large - 1])
    rest = mass[large - 1] - np.where(k > 0, mass[np.maximum(k, 1) - 1], 0)
    return int((alone + half + np.maximum(0, -((room - rest) // capacity))).max())


def _fits_inside(small: list[int], large: list[int]) -> bool:
    """Whether the pieces of ``small`` can be laid into those of ``large``."""
    if not small:
        return True
    return any(x >= small[0] and (i == 0 or large[i - 1] != x) and _fits_inside(small[1:], sorted([*large[:i], x - small[0], *large[i + 1 :]], reverse=True)) for i, x in enumerate(large))


def undominated_fillings(room: int, counts: dict[int, int], width: int, items: int) -> list[tuple[int, ...]]:
    """Sets of lengths for this room, fullest first, the ``width`` fullest; none can be laid into the pieces of another.

    Beside n pieces chosen the ``width`` / 2 ** n longest that fit are tried, at least one; from ``items`` pieces on, the longest as often
    as it fits, and so on, so that nothing more fits beside a set. The same for few lengths as for many.
    """
    lengths = sorted(x for x in counts if counts[x] and x <= room)
    found: set[tuple[int, ...]] = set()

    def extend(chosen: tuple[int, ...], left: int, highest: int) -> None:
        fits = lengths[: bisect_right(lengths, min(left, highest))]
        fits = [x for x in fits if chosen.count(x) < counts[x]]
        while fits and len(chosen) >= items:
            x = fits[-1]
            times = min(counts[x] - chosen.count(x), left // x)
            chosen, left = (*chosen, *[x] * times), left - x * times
            fits = [y for y in fits[:-1] if y <= left and chosen.count(y) < counts[y]]
        if not fits:
            found.add(chosen)
            return
        # the longest first: they leave the least room
        for x in fits[-max(1, width >> len(chosen)) :]:
            extend((*chosen, x), left - x, x)

    extend((), room, room)
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-sum(f), len(f), f)):
        if not any(len(g) <= 6 and len(f) <= 6 and _fits_inside(list(f), list(g)) for g in kept):
            kept.append(f)
            if len(kept) == width:
                break
    return kept


def _fill(free: np.ndarray, room: int) -> list[int]:
    """One free piece, or else the most even two, that fill the room to the last token; empty if there are none."""
    if free[room]:
        return [room]
    half = room // 2
    both = (free[1 : half + 1] > 0) & (free[room - half : room][::-1] > 0)
    if room % 2 == 0 and free[half] < 2:
        both[half - 1 :] = False
    at = np.flatnonzero(both)
    return [room - int(at[-1]) - 1, int(at[-1]) + 1] if len(at) else []


def _completion(n: np.ndarray, top: int, capacity: int, tries: int = 32) -> list[int]:
    """``top`` and pieces beside it, with as small a gap as is found."""
    free, chosen, room, states = n.copy(), [top], capacity - top, []
    free[top] -= 1
    while room:
        if found := _fill(free, room):
            return chosen + found
        fits = np.flatnonzero(free[1 : room + 1])
        if not len(fits):
            break
        states.append((len(chosen), room))
        chosen.append(int(fits[-1]) + 1)
        free[chosen[-1]] -= 1
        room -= chosen[-1]
    if room:  # another piece than the longest may leave what two others fill
        for size, left in states[: -4 : -1]:
            free = n.copy()
            np.subtract.at(free, chosen[:size], 1)
            for x in (np.flatnonzero(free[1:left])[: -tries - 1 : -1] + 1).tolist():
                free[x] -= 1
                if found := _fill(free, left - x):
                    return [*chosen[:size], x, *found]
                free[x] += 1
    return chosen


def exact_fills(counts: dict[int, int], capacity: int) -> Plan:
    """Longest piece first, beside it pieces that leave no gap, the most even ones: short pieces fit anywhere and are kept for the last sequences.

    A filling is used until one of its lengths runs out, so there are about as many as lengths.
    """
    n = np.zeros(capacity + 1, np.int64)
    for x, m in counts.items():
        n[x] = m
    plan: Plan = []
    for top in sorted(counts, reverse=True):
        while n[top]:
            need: dict[int, int] = {}
            for x in _completion(n, top, capacity):
                need[x] = need.get(x, 0) + 1
            times = min(int(n[x]) // k for x, k in need.items())
            for x, k in need.items():
                n[x] -= k * times
            plan.append((tuple(need.items()), times))
    return plan


def bin_completion(counts: dict[int, int], capacity: int, effort: int = 3000, width: int = 64, items: int = 6) -> Plan:
    """The best plan found within ``effort`` search nodes; never more sequences than best-fit decreasing or ``exact_fills`` gives.

    The width of the fillings tried is doubled from 2 to ``width``, each with an equal share of the effort, until a plan meets the lower bound.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    used, least = sum(n for _, n in best), lower_bound(counts, capacity)
    if used > least:
        other = exact_fills(counts, capacity)
        if (n := sum(t for _, t in other)) < used:
            best, used = other, n
    shares = [w for w in (2, 4, 8, 16, 32, 64) if w <= width]
    for w in shares:
        if used > least:
            best, used = _search(counts, capacity, effort // len(shares), w, items, best, used, least)
    return best


def _search(counts: dict[int, int], capacity: int, effort: int, width: int, items: int, best: Plan, used: int, least: int) -> tuple[Plan, int]:
    """Branch and bound, depth first, from the incumbent ``best`` of ``used`` sequences."""
    total = sum(x * n for x, n in counts.items())
    # a frame: what was left and the patterns before its own, its pattern and how often, sequences and waste with it; siblings share the first two
    stack: list[tuple[dict[int, int], Plan, dict[int, int], int, int, int]] = [(counts, [], {}, 0, 0, 0)]
    while stack and effort > 0 and used > least:
        before, past, need, times, n, waste = stack.pop()
        effort -= 1
        left = {x: m for x, m in ((x, m - times * need.get(x, 0)) for x, m in before.items()) if m}
        plan = [*past, (tuple(need.items()), times)] if times else past
        if not left:
            if n < used:
                best, used = plan, n
            continue
        rest = best_fit_decreasing(left, capacity)
        if n + sum(t for _, t in rest) < used:
            best, used = plan + rest, n + sum(t for _, t in rest)
        allowed = (used - 1) * capacity - total
        top = max(left)
        beside = {**left, top: left[top] - 1}
        branches = []
        for filling in undominated_fillings(capacity - top, beside, width, items):
            need = {top: 1}
            for x in filling:
                need[x] = need.get(x, 0) + 1
            spill = capacity - top - sum(filling)
            most = min(left[x] // k for x, k in need.items())
            for times in dict.fromkeys((1, most)):
                if waste + times * spill <= allowed:
                    branches.append((left, plan, need, times, n + times, waste + times * spill))
        stack += reversed(branches)
    return best, used


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row of ``pieces(length, ...)``, 1 <= length <= capacity.

    Places leave no gaps: a sequence's pieces follow one another from 0. Rows that are alike are places apart. Rows with a null or other
    length are refused. Empty: no rows. A length may hold most rows: ranks come from sorted ranges and their counts, not
    from a window over the length. What the driver sees is one count a length and the plan over them.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    checked = pieces.select(*names).withColumn("length", F.expr(f"if(length between 1 and {capacity}, length, raise_error('a piece is empty, null or longer than a sequence'))"))
    # stored first: dealing by ranges reads its input twice
    part, at, rank, shelf, plan_row = (unused(pieces, c) for c in ("part", "at", "rank", "shelf", "plan"))
    ranged = stored(checked, "unpacked").repartitionByRange(partitions(spark), "length", F.xxhash64(*names)).sortWithinPartitions("length", *[c for c in names if c != "length"])
    rows = stored(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "pieces")
    runs = rows.groupBy(part, "length").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy(part)) - F.col("n") - F.col("first")
    runs = runs.select(part, "length", before.alias(rank))
    counts = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}

    # a length's places, filed under stretches of ranks, as many as it has places
    places: dict[int, list[tuple]] = {x: [] for x in counts}
    sequence, filled = 0, dict.fromkeys(counts, 0)
    for pattern, times in bin_completion(counts, capacity):
        offset = 0
        for length, each in pattern:
            places[length].append((filled[length], filled[length] + each * times, sequence, each, offset))
            filled[length] += each * times
            offset += each * length
        sequence += times
    widths = {x: -(-counts[x] // len(found)) for x, found in places.items()}
    filed = [(x, i, widths[x], p) for x, found in places.items() for p in found for i in range(p[0] // widths[x], (p[1] - 1) // widths[x] + 1)]
    kind = pieces.schema["length"].dataType
    plan = spark.createDataFrame(filed, f"length int, {shelf} long, width long, {plan_row} struct<since long, until long, sequence long, each long, offset long>").withColumn("length", F.col("length").cast(kind))
    runs = runs.join(F.broadcast(plan.select("length", F.col("width").alias(shelf)).distinct()), "length")
    ranked = rows.join(runs, [part, "length"]).withColumn(rank, F.col(at) + F.col(rank)).withColumn(shelf, F.expr(f"{rank} div {shelf}"))
    found = ranked.join(F.broadcast(plan.drop("width")), ["length", shelf]).where(f"{rank} >= {plan_row}.since and {rank} < {plan_row}.until")
    return found.select(*names, F.expr(f"{plan_row}.sequence + ({rank} - {plan_row}.since) div {plan_row}.each").alias("sequence_id"), F.expr(f"{plan_row}.offset + ({rank} - {plan_row}.since) % {plan_row}.each * length").alias("offset"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, ids: bool = False, remember: int = REMEMBER, keep: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each document's ids and the end id, cut only where longer than ``capacity``.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Null and empty texts are the end id alone. Rows stay where they are; repeated rows and null ids are kept.
    ``remember``: word pieces whose ids a worker remembers, some 200 bytes each; ``keep``: from task to task. Neither changes an id.
    """
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: len(fields)]

    def run(batches):
        enc = encoder(tokenizer, remember, added=True)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), enc.encode_many(batch["text"].to_pylist()), strict=True):
                x = np.frombuffer(found + end, enc.dtype).astype("<u4")
                for i, at in enumerate(range(0, len(x), capacity)):
                    part = x[at : at + capacity]
                    rows.append((doc_id, i, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int64))[: len(fields)])
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
        if not keep:
            forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, ids: bool = False, remember: int = REMEMBER, keep: bool = True) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with their sequence and place; with ``ids``, the pieces' tokens too."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, ids, remember, keep), capacity)
