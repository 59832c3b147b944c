import random

import regex

from tessera.llm.license_scan import BASE, NOTICES, evaluate, parse_expression, scan_licenses


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark):
    rnd = random.Random(3)
    bits = ["MIT", "license", "License,", "apache", "Apache-License", "general", "public", "GENERAL public", "é", "x\ny", "mit\u00a0license", "0", "--", "gnu", "lesser", "version 2"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(30))), "labels") for i in range(300)]
    rows += [(None, None, None), (None, None, None), (7, "", "x"), (8, "mit license " * 50_000, "y")]
    got = sorted((tuple(r)[:6] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_expressions():
    assert parse_expression("mit or apache-2.0 and gpl-2.0-only with classpath-exception-2.0 */") == ["mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or"]
    assert parse_expression("(mit or gpl-3.0) and bsd-3-clause") == ["mit", "gpl-3.0", "or", "bsd-3-clause", "and"]
    for bad in ("", "or mit", "mit and", "(mit", "mit with (a or b)", "and"):
        assert parse_expression(bad) is None
    assert evaluate(["mit", "gpl-3.0", "or"]) == (True, {"mit", "gpl-3.0"})
    assert evaluate(["mit", "gpl-3.0", "and"]) == (False, {"mit", "gpl-3.0"})
    assert evaluate(["gpl-2.0", "classpath", "with"]) == (False, {"gpl-2.0"})


def test_tags_and_notices(spark):
    rows = [(1, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode"), (2, "Licensed under CC BY-NC 4.0."), (3, "nothing"), (4, "SPDX-License-Identifier: and")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].permissive, got[1].expressions) == ("gpl-2.0-only,mit", True, "mit gpl-2.0-only or")
    assert (got[2].labels, got[2].base_labels, got[3].labels, got[3].score, got[4].labels) == ("cc-by-nc-4.0", "", "", 0.0, "")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_identifiers_are_labels(spark):
    assert parse_expression("mit and then some prose") == ["mit"]
    assert parse_expression("mit or gpl-2.0+ and nothing else") == ["mit", "gpl-2.0+", "or"]
    assert parse_expression("unknown words here") is None
    assert parse_expression("licenseref-own or (mit and prose") is None
    assert parse_expression("licenseref-own or lgpl-2.1-or-later") == ["licenseref-own", "lgpl-2.1-or-later", "or"]
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: acme or mit\nacme notice")], "doc_id long, text string")
    assert scan_licenses(docs).first().labels == ""
    assert scan_licenses(docs, {"acme notice": "acme"}, frozenset({"acme", "mit"})).first().labels == "acme,mit"


def brute_all(text):
    """All of a text's columns, phrase by phrase, for texts without tags."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    count = lambda phrase: sum(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))
    found = [(p, x, count(p)) for p, x in [*BASE.items(), *NOTICES.items()]]
    return ",".join(sorted({x for _, x, n in found if n})), 1 - 0.5 ** sum(n for *_, n in found)


def test_labels_and_scores_against_brute_force(spark):
    rnd = random.Random(4)
    bits = [*BASE, *NOTICES, "gnu", "version", "2", "cc by", "4.0", "Public-Domain", "word"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))) for i in range(300)]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_all(t) for i, t in rows}


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
