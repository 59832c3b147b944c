import random

import corpus_pipeline
from tessera.llm.decontamination import ItemIndex
from tessera.llm.toxicity import _Ratios, train_toxicity, training_labels

from .test_decontamination import brute as leaks
from .test_ngram_jaccard import brute as components
from .test_toxicity import corpus


def test_every_stage_against_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    rows, labels = corpus(600, 5)
    items = [(i, " ".join(rows[i][1].split()[:20]) + f" item{i} item{i}b item{i}c.") for i in range(5)]
    rows = [(i, t) for i, t, _ in rows]
    rows += [(1000 + i, t + " more words") for i, t in rnd.sample(rows, 40)] + [(2000 + i, x) for i, x in items] + [(None, None), (3000, ""), (5, rows[5][1])]
    spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = train_toxicity(docs, training_labels(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    ratios = _Ratios(model.pair)
    left = [r for r in rows if model.scores([(r[1] or "").encode()], ratios)[0] < 0.5]
    assert 300 < len(left) < len(rows)
    first = {}
    for d, _, c in components(left):
        first.setdefault(c, d)
    keep = {c for _, n, c in components(left) if n}
    stay, seen = [], set()
    for r in left:
        if not (r[1] or "").split():
            stay.append(r)
        elif r[0] in keep and r[0] not in seen:
            seen.add(r[0])
            stay.append(r)
    bad = {d for d, _ in leaks(stay, ItemIndex([(i, t.encode()) for i, t in items]))}
    stay = [r for r in stay if r[0] not in bad]
    assert len(bad) >= 4

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got if r.piece == 0), key=str) == sorted((r[0] for r in stay), key=str)
    total = {}
    for r in got:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 4096 and len(total) == -(-sum(total.values()) // 4096)


def test_middle_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
