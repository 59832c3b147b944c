import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm.spelling import ALPHABET, bucket_of, near_words, passes_of, spelling_variants

SCHEMA = "doc_id long, text string, word string, n int, other string"


def words(rows):
    count = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    v = words(rows)
    near = {w: [x for x in v if is_near(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 10 * v[w] else None
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], len(near[w]), v.get(form[w])))
    return sorted(out, key=str)


def run(spark, rows, **more):
    got = spelling_variants(spark.createDataFrame([(*r, "word", 7, "other") for r in rows], SCHEMA), **more)
    return sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def corpus():
    rng = np.random.default_rng(8)
    stems = ["abcdefgh", "abcdefg", "straßenbahn", "ÉCOLESÀÉ", "aaaaaaaaa", "aaaaaaaa", "aaaaaaa", "÷÷××÷÷××", "Mississippi", "x" * 64, "y" * 63, "q" * 130]
    rows = []
    for i in range(400):
        picked = [stems[int(j)] for j in rng.zipf(1.5, 6) % len(stems)]
        for j, w in enumerate(picked):
            if rng.random() < 0.3:
                k = int(rng.integers(len(w)))
                picked[j] = w[:k] + str(rng.choice(["", chr(int(rng.choice(ALPHABET))), "ab", "A"])) + w[k + 1 :]
        rows.append((int(i % 300), " ".join(picked) + (".ā" if i % 3 else "1")))
    rows += [(1, "common words common-sense tipping ") for _ in range(5)] + [(None, None), (None, "nothing nothing"), (5, ""), (None, "nothing"), (9, "z" * 60_000 + " " + "z" * 60_000), (10, "z" * 60_001), (11, "z" * 60_001)]
    # counts that grow tenfold twice: a chain of forms
    return rows + [(1000 + i, "alphabetic " * 150 + "alphabetik " * 12 + ("alphabetike " if i < 2 else "")) for i in range(2)]


def test_against_brute_force(spark):
    rows = corpus()
    wanted = brute(rows)
    assert sum(r[1] is not None for r in wanted) > 20 and any(r[2] not in (r[0], r[1]) for r in wanted)
    assert run(spark, rows) == wanted
    assert run(spark, rows, blocks=3) == wanted  # several passes, buckets cut


def test_every_pair_once(spark):
    v = spark.createDataFrame([(w, 1) for w in ("aabbccd", "aabbcc", "abbccd", "aabbce", "aabbccdd", "aabxccd", "àabbccd")], "word string, n long")
    got = [tuple(sorted(r)) for r in near_words(v).select("word", "other").collect()]
    names = [r[0] for r in v.collect()]
    assert sorted(got) == sorted(tuple(sorted((a, b))) for i, a in enumerate(names) for b in names[:i] if is_near(a, b))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short words only")]) == []


def test_passes_hold_every_block_once():
    passes = passes_of({7: 1000, 8: 10, 9: 5000, 70: 3}, 20)
    held = Counter()
    for p in passes:
        assert sum(x.high - x.low for x in p.values()) <= 20
        held.update((x.bucket, b) for x in p.values() for b in range(x.low, x.high))
    assert set(held.values()) == {1} and {b for b, _ in held} == {7, 8, 9, 70}
    assert [bucket_of(n) for n in (7, 63, 64, 127, 128)] == [7, 63, 65, 65, 66]
