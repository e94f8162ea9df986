import gzip
import random

from gleaner.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n"
SCHEMA = "page_id long, url string, html string, start string, path2 string"


def pages(spark, rows):
    return spark.createDataFrame([r + ("x", None) for r in rows], SCHEMA)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    r = random.Random(0)
    rows = []
    for i in range(300):
        parts = [FAKE * r.randrange(3), "é" * r.randrange(400), "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n" * r.randrange(2), "WARC/1.", FAKE[: r.randrange(70)]]
        r.shuffle(parts)
        rows.append((i, f"http://h/{i}", "".join(parts)))
    rows += [(None, "http://h/n", "x"), (400, None, "x"), (401, "http://h/e", ""), (402, "http://h/0", None), (403, " odd\r\n%0D%25 ", "x"), (404, "http://h/%0D", "y"), (405, "http://h/l", "z" * 500_000), (405, "http://h/l", "z" * 500_000)]
    folder = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, rows).repartition(3), folder)
    key = lambda x: tuple(str(v) for v in x)
    for block in (700, 100_000, warc.BLOCK):
        got = [(x.page_id, x.url, x.html) for x in warc.read_warc(spark, folder, block, "*.txt").collect()]
        assert sorted(got, key=key) == sorted(rows, key=key)


def test_header_over_a_block_edge_and_broken_ends():
    record = b"WARC/1.0\r\nX: " + b"h" * 200_000 + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = record * 2 + b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort"
    read = lambda _, at, size: data[at : at + size]
    found = [c for at in range(0, len(data), 150_000) for c in warc.candidates(read, "", at, 150_000, len(data))]
    assert [(a, c) for a, _, c in found] == [(0, len(record)), (len(record), 2 * len(record))]


def test_chain_stops_at_a_break(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 1\r\n\r\na\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + b"??" + one)
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"no record\r\n" + one)
    assert [r.html for r in warc.read_warc(spark, f"file://{tmp_path}", glob="*.warc").collect()] == ["a"]


def test_gzip_members(spark, tmp_path):
    r = random.Random(3)
    wants, data = [], b""
    for i in range(60):
        inner = gzip.compress(FAKE.encode())
        body = b"".join(r.choice([inner, FAKE.encode(), bytes([r.randrange(97, 123)]) * 3000]) for _ in range(r.randrange(4)))
        head = f"WARC/1.0\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        data += gzip.compress(head + body + warc.END, r.randrange(10))
        wants.append((i, body.decode("utf-8", "replace")))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(data[: len(data) // 2])
    for block in (500, 10_000, warc.BLOCK):
        got = warc.read_warc(spark, f"file://{tmp_path}", block, "*.gz").collect()
        assert sorted((x.page_id, x.html) for x in got if x.path.endswith("a.warc.gz")) == wants
        half = sorted((x.page_id, x.html) for x in got if x.path.endswith("b.warc.gz"))
        assert half == wants[: len(half)] and half


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, []), folder)
    assert warc.read_warc(spark, folder, glob="*.txt").count() == 0
