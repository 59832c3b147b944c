import hashlib
import re

import numpy as np

from tessera.llm.fill_in_middle import BoundarySet, _Array, _Bitmap, _Runs, digests, fill_in_middle, token_boundaries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, form string, output int, _cut string, n string"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "\t\n", "a", " a", "a ", "a  b c\u0085 d", "émigré 𝒳𝒴 中文 é", "x<P>y z", "<S", "<S>", "<<M", "a\x1cb\x0bc", "word " * 70_000, "a" * 200_000, "ab cd\n" * 9]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_against_brute_force(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(12 * len(TEXTS))] + [(None, "one two three four"), (None, None), (5, "a b c d e f g"), (5, "a b c d e f g")]
    made = fill_in_middle(spark.createDataFrame([(*r, "spm", 1, "x", "y") for r in rows], SCHEMA))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    wanted = [brute(*r) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert {r[2] for r in wanted} == {"plain", "psm", "spm"}
    back = digests(made).select("doc_id", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r[0], sha(w[5]), sha(r[1] or "")) for r, w in zip(rows, wanted, strict=True)), key=str)


def test_empty_table(spark):
    assert digests(fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []


def test_select_in_every_kind_of_container():
    rng = np.random.default_rng(2)
    parts = [np.arange(0, 60_000), (1 << 16) + np.sort(rng.choice(1 << 16, 20_000, replace=False)), (4 << 16) + np.sort(rng.choice(1 << 16, 300, replace=False)), np.array([9 << 16])]
    offsets = np.concatenate(parts).astype(np.int64)
    held = BoundarySet(offsets)
    assert [type(c) for c in held.containers] == [_Runs, _Bitmap, _Array, _Array]
    assert [held.select(k) for k in range(0, len(offsets), 7)] == offsets[::7].tolist()
    assert held.select(len(offsets) - 1) == 9 << 16


def test_boundaries_are_token_ends():
    for text in TEXTS[1:]:
        ends = [0, *(m.end() for m in TOKEN.finditer(text))]
        held = token_boundaries(text)
        assert held.size == len(ends)
        assert [held.select(k) for k in range(min(50, len(ends)))] == ends[:50]
