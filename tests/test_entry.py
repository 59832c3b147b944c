"""The driver's contract."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_nothing_outside_names_the_training_data_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tessera"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
