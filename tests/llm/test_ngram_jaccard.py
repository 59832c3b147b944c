import random

from tessera.llm.ngram_jaccard import ngram_jaccard_components, one_of_each_group


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, sid string")
    return sorted((tuple(r) for r in ngram_jaccard_components(df).collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 5, 8, 30, 120)))]
        for _ in range(rnd.choice((1, 2, 20))):
            words = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 5))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if family % 3 == 0:
                words = passage + words
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (None, "one two"), (None, None), (5, rows[5][1])]
    assert run(spark, rows) == brute(rows)


def test_chain_links_across_groups(spark):
    words = [f"v{i}" for i in range(200)]
    rows, w = [], list(words)
    for i in range(12):
        rows.append((i, " ".join(w)))
        for j in range(5):
            w[(i * 37 + j * 41) % 200] = f"z{i}_{j}"
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_text(spark):
    text = " ".join(f"a{i}" for i in range(60_000))
    assert run(spark, [(1, text), (2, text + " b")]) == [(1, 59_996, 1), (2, 59_997, 1)]


def test_one_of_each_group_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(7, words, "a"), (3, words + " more", "b"), (3, words + " more", "c"), (None, words, "d"), (9, "other text", "e"), (1, None, "f"), (1, None, "g"), (2, " ", "h"), (None, "alone", "i")]
    got = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = sorted((r.source for r in got))
    assert kept in (["b", "e", "f", "g", "h", "i"], ["c", "e", "f", "g", "h", "i"])
