import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.queries import op5_token_id_output, op6_best_fit_packing
from tessera.llm.token_files import TokenFile, read_token_files, write_token_files
from tessera.llm.tokenizing import Encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {p: Encoder(p, 10_000) for p in (BYTE, WORD)}


def plain(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


LIBRARY = {}
for _p in (BYTE, WORD):
    LIBRARY[_p] = Tokenizer.from_file(_p)
    LIBRARY[_p].encode_special_tokens = True

UNTOUCHED = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ADDED = {p: Encoder(p, 10_000, added=True) for p in (BYTE, WORD)}


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("aB'sdt  \n\t.,!é́ßΣσ ​᠎漢1९<|>endoftx\x1c\u0085")), max_size=40) | st.text(max_size=30).filter(lambda t: t.isprintable()))
def test_pieces_give_the_ids_of_the_text(path, text):
    e = ENCODERS[path]
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(i * 7 % 50, f"Text {i} " * (i % 9) + "<|endoftext|>\n  x", "n") for i in range(50)]
    rows += [(3, rows[0][1], "a"), (None, "none", "b"), (None, None, "c"), (99, "", "d"), (100, "long " * 200_000, "e"), (100, "long " * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    files, dictionary = write_token_files(docs, BYTE, file_bytes=500)
    got = [r.asDict() for r in read_token_files(spark, files, dictionary).orderBy("start").collect()]
    expected = sorted(((d is not None, d or 0, t or "", plain(BYTE, t or "") + [2]) for d, t, _ in rows), key=lambda x: x[:3])
    assert [r["doc_id"] for r in got] == [d if known else None for known, d, _, _ in expected]
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(str(x[3]) for x in expected)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    some = files.where("docs > 0").first()
    one = TokenFile(some.uri, dictionary)
    assert len(one) == some.docs and len(one.document(0)) == one.counts[0]
    with pytest.raises(ValueError, match="another dictionary"):
        TokenFile(some.uri, dictionary + b"x")


def test_empty_table(spark):
    files, dictionary = write_token_files(spark.createDataFrame([], "doc_id long, text string"), BYTE)
    assert read_token_files(spark, files, dictionary).collect() == []


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=100, deadline=None)
@given(text=st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a", "word", " ", "  ", "\n", "é", "<|", "endoftext|>"]), max_size=12).map("".join))
def test_added_tokens_as_the_untouched_library_gives_them(path, text):
    e = ADDED[path]
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == UNTOUCHED[path].encode(text, add_special_tokens=False).ids


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "one <|startoftext|> two"), (3, "plain text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for query, path, end in ((op5_token_id_output, BYTE, 2), (op6_best_fit_packing, WORD, 1)):
        got = {r.doc_id: r.ids_crc32 for r in query(spark, str(tmp_path)).collect()}
        assert got == {d: zlib.crc32(np.array([*UNTOUCHED[path].encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in rows}
