"""Uploads to shared lakes: answers, bounds, isolation and repeats; marks by key."""

import pytest

from tessera.functions.storage import shared_path
from tessera.streaming.lakes import Lakes, Marks

UPLOAD = "upload long, code string, what string, cx long, cy long, id long, t_ms long, seq long, planing boolean, status string, reviewed_t long"


def cell(upload, code, cx, t=1, planing=False):
    return (upload, code, "cell", cx, 0, None, t, upload, planing, None, None)


def flag(upload, code, name, status="pending", reviewed=None):
    return (upload, code, "flag", None, None, name, 1, upload, None, status, reviewed)


def test_answers_bounds_and_isolation(spark):
    lakes = Lakes(spark, shared_path(spark, "lakes"), max_cells=3, max_flags=1)
    send = lambda n, *rows: lakes.merge(spark.createDataFrame(rows, UPLOAD), n)
    assert lakes.rows().collect() == [] and lakes.answers().collect() == []
    send(0, cell(1, "aaaa", 1, planing=True), cell(1, "aaaa", 2), cell(2, "bbbb", 1), flag(1, "AAAA", 7), cell(3, "no", 1), cell(4, None, 1))
    first = {f.rsplit("/", 1)[1] for f in lakes.rows().where("lake = 'BBBB'").inputFiles() if "lake=BBBB" in f}
    send(1, cell(5, "AAAA", 1, t=0), flag(5, "AAAA", 7, "confirmed", 5), flag(6, "AAAA", 7, "rejected", 3))
    send(2, *[cell(7, "AAAA", i) for i in range(2, 5)], *[cell(8, "CCCC", i) for i in range(4)], flag(9, "CCCC", 1), flag(9, "CCCC", 2))
    got = {(r.lake, r.what, r.cx, r.id): (r.upload, r.status) for r in lakes.rows().collect()}
    assert got == {("AAAA", "cell", 1, None): (5, None), ("AAAA", "cell", 2, None): (1, None), ("AAAA", "flag", None, 7): (5, "confirmed"), ("BBBB", "cell", 1, None): (2, None)}
    assert {(r.upload, r.answer, r.merged) for r in lakes.answers().collect()} == {(1, 200, 2), (2, 200, 1), (3, 400, None), (4, 400, None), (5, 200, 2), (6, 200, 2), (7, 507, None), (8, 413, None), (9, 413, None)}
    assert first and first <= {f.rsplit("/", 1)[1] for f in lakes.rows().inputFiles()}  # BBBB's files are the same


def test_a_repeated_batch_and_old_versions(spark):
    lakes = Lakes(spark, shared_path(spark, "lakes"))
    for n in (0, 1, 1, 2, 2):
        lakes.merge(spark.createDataFrame([cell(n, "AAAA", n), cell(n, "AAAA", 100, t=n)], UPLOAD), n)
    assert sorted(r.cx for r in lakes.rows().collect()) == [0, 1, 2, 100]
    assert lakes.table.versions() == [1, 2] and lakes.table._numbers("data") == [1, 2]
    assert Lakes(spark, lakes.base).rows().count() == 4  # a new start reads the latest version


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_marks_in_any_order(spark, order):
    marks = Marks(spark, shared_path(spark, "marks"))
    changes = [[("L", 1, 1, 1, False, "a"), ("L", 2, 1, 1, False, "a"), ("M", 1, 9, 9, False, "m")], [("L", 1, 2, 1, True, None), ("L", 3, 1, 1, True, None)], [("L", 2, 1, 2, False, "b"), ("L", 1, 1, 9, False, "c"), ("L", 3, 2, 0, False, "d")]]
    for n, k in enumerate(order):
        marks.apply(spark.createDataFrame(changes[k], "lake string, id long, t long, seq long, gone boolean, status string"), n)
    assert {(r.lake, r.id): r.status for r in marks.rows().collect()} == {("L", 2): "b", ("M", 1): "m", ("L", 3): "d"}


def test_of_equal_flags_the_first_stands_in_any_order(spark):
    rows = [(7, "AAAA", "flag", None, None, i, t, seq, None, "pending", None) for i in range(40) for t, seq in ((5, 3), (6, 2), (4, 4))]
    for n, order in enumerate((rows, rows[::-1])):
        lakes = Lakes(spark, shared_path(spark, "lakes"))
        lakes.merge(spark.createDataFrame(order, UPLOAD).coalesce(1), n)
        assert {(r.t_ms, r.seq) for r in lakes.rows().collect()} == {(6, 2)}
