import pytest

from tessera.llm.warc import Archive, payload_digest, read_warc, response, write_warc


def brute(rows, least=0):
    out, head = [], {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        head.setdefault(rows[i][2] or "", i)
    for i, (d, _, h) in enumerate(r[:3] for r in rows):
        p = (h or "").encode()
        first = len(p) < least or head[h or ""] == i
        out.append((d, len(p), payload_digest(p), "response" if first else "revisit", None if first else rows[head[h or ""]][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, compress, least):
    fake = response(77, 0, "http://nested/", b"inner " * 40, compress=False).decode()
    rows = [(i, f"http://a/{i}\r\nx", f"<p>{i % 40}</p>" * (i % 7), "record") for i in range(150)]
    rows += [(200, None, fake), (201, "u", fake * 3 + "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"), (202, "u", "\x1f\x8b\x08" * 50), (None, "u", "null id"), (None, None, None), (203, "u", ""), (204, "u", "x" * 300_000), (150, "z", fake)]
    rows = [(*r[:3], "extra") for r in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    archives = write_warc(pages, least, compress, file_bytes=20_000)
    got = read_warc(archives, range_bytes=700, payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, least)
    by_digest = {payload_digest((r[2] or "").encode()): (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in got if r.record_type == "response")


def test_magic_in_payloads_is_a_candidate_but_no_record(spark):
    fake = response(77, 0, "http://nested/", b"inner", compress=False).decode()
    archives = write_warc(spark.createDataFrame([(1, "u", "before " + fake + " after")], "page_id long, url string, html string"), compress=False)
    a = archives.first()
    f = Archive(a.uri)
    assert len([at for at in f.candidates(0, a.bytes) if f.record(at)]) == 3
    assert [r.page_id for r in read_warc(archives).collect()] == [1]


def test_truncated_archives_are_refused(spark):
    archives = write_warc(spark.createDataFrame([(1, "u", "text"), (2, "u", "more")], "page_id long, url string, html string").coalesce(1))
    a = archives.first()
    path = a.uri.removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:-9])
    with pytest.raises(ValueError, match="lead to its end"):
        read_warc(spark.createDataFrame([(a.uri, a.bytes - 9)], "uri string, bytes long"))


def test_repeated_rows_and_empty_table(spark):
    schema = "page_id long, url string, html string"
    got = read_warc(write_warc(spark.createDataFrame([(1, "u", "a")] * 3, schema))).collect()
    assert sorted((r.record_type, r.refers_to) for r in got if r.record_type == "revisit") == [("revisit", 1)] * 2 and len(got) == 3
    assert read_warc(write_warc(spark.createDataFrame([], schema))).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_headers_of_any_length(spark, compress):
    urls = {1: "http://a/" + "x" * 200_000, 2: "u", 3: "http://b/" + " " * 200_000, 4: "http://c/" + "é" * 1_500_000}
    pages = spark.createDataFrame([(i, u, f"text {i}" if i < 4 else "text 1") for i, u in urls.items()] + [(5, "v", "WARC/1.1\r\n" * 30_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in read_warc(write_warc(pages, compress=compress), range_bytes=50_000).collect()}
    assert {i: r.url for i, r in got.items()} == {i: u.replace(" ", "%20") for i, u in urls.items()} | {5: "v"}
    assert (got[4].record_type, got[4].refers_to) == ("revisit", 1)
