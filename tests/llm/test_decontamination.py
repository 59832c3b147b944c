import random

from tessera.llm.decontamination import ItemIndex, contaminated_passages, is_contaminated, question_and_answer, runs, words_of


def brute(rows, index):
    """Every passage against every item."""
    out = set()
    for d, t, *_ in rows:
        words = words_of((t or "").encode())
        for shelf in index.shelves:
            for at in range(0, max(1, len(words)), shelf.step):
                part = words[at : at + 2 * shelf.step]
                have = {shelf.terms[w] for w in part if w in shelf.terms}
                for i, name in enumerate(shelf.names):
                    score = sum(v for x, v in shelf.impacts[i].items() if x in have)
                    if score >= shelf.threshold and all(len(x & runs(part)) / len(x) >= shelf.overlap for x in shelf.parts[i]):
                        out.add((d, name))
    return out


def case():
    rnd = random.Random(9)
    vocabulary = ["the", "of", "and", "a", "in"] * 30 + [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, f"{text(rnd.randrange(8, 30))}. {text(rnd.randrange(2, 9))}?", "x") for i in range(40)]
    items += [(100, None, "x"), (101, " .", "x"), (None, text(12), "x"), (3, items[3][1], "x"), (102, "One", "x")]
    rows = []
    for i in range(200):
        body = text(rnd.choice((0, 5, 50, 400)))
        if i % 4 == 0:
            leak = rnd.choice(items[:40])[1].split()
            for _ in range(rnd.choice((0, 0, 1, 3, 12))):
                leak[rnd.randrange(len(leak))] = rnd.choice(vocabulary)
            cut = rnd.randrange(len(body) + 1)
            body = body[:cut] + " " + " ".join(leak).upper() + " " + body[cut:]
        rows.append((i, body, 1.0))
    return items, rows + [(None, items[0][1], 1.0), (None, None, 1.0), (0, rows[0][1], 1.0), (900, "the " * 300_000 + items[5][1], 1.0)]


def test_against_brute_force(spark):
    items, rows = case()
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string, score string")
    index = ItemIndex([(i, t.encode()) for i, t, _ in items if t is not None])
    expected = brute(rows, index)
    got = contaminated_passages(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(expected) > 30
    assert all(r.score >= 0.6 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in got)
    whole = {(i, n) for i, t, _ in rows for n, x, _ in items[:40] if x.lower() in (t or "").lower()}
    assert whole <= expected
    sliced = contaminated_passages(docs, tests, slice_items=10).collect()
    assert whole <= {(r.doc_id, r.item_id) for r in sliced}
    flagged = docs.where(is_contaminated(docs.text, tests)).collect()
    assert {r.doc_id for r in flagged} == {d for d, _ in expected} and flagged[0].asDict().keys() == {"doc_id", "text", "score"}


def test_a_long_item_changes_no_other(spark):
    item = (1, "which river flows through the old town of nine bridges. the green alder")
    filler = " ".join(f"f{i}" for i in range(200))
    docs = spark.createDataFrame([(1, f"which river flows through the old town of nine bridges {filler} the green alder"), (2, f"{filler} {item[1]} {filler}")], "doc_id long, text string")
    long_item = (2, " ".join(f"w{i}" for i in range(100_000)))
    for items in ([item], [item, long_item]):
        got = contaminated_passages(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(2, 1)]
        assert got[0].passage_start in range(200 - 16, 201)


def test_empty_tables(spark):
    docs, tests = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert contaminated_passages(docs, some).collect() == [] == contaminated_passages(some.withColumnRenamed("item_id", "doc_id"), tests).collect()
    assert some.where(is_contaminated(some.text, tests)).collect() == []


def test_question_and_answer():
    assert question_and_answer(b"What is the capital of the land by the sea? The town.") == (b"what is the capital of the land by".split(), b"the sea the town".split())
    assert question_and_answer(b"one") == ([b"one"], [b"one"])


def test_slices_change_nothing(spark):
    items, rows = case()
    items.append((500, " ".join(f"long{i}" for i in range(200)), "x"))  # one slice's passages must not be wider than another's
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string, score string")
    key = lambda x: sorted(map(str, x.collect()))
    whole = key(contaminated_passages(docs, tests))
    assert key(contaminated_passages(docs, tests, slice_items=9)) == whole and len(whole) > 30
    flagged = key(docs.where(is_contaminated(docs.text, tests)))
    assert key(docs.where(is_contaminated(docs.text, tests, slice_items=20))) == flagged
