import gzip
import hashlib

from trackspark.llm import arc as A


def convert(spark, pages, tmp_path):
    a, w = str(tmp_path / "arc"), str(tmp_path / "warc")
    A.write_arc(pages, a)
    A.convert(spark, a, w)
    return w


def test_equals_brute_force(spark, tmp_path):
    long, multi = "<p>" + "x" * 200, "ü" * 50
    htmls = [None, "", "short", "short", long, long, long, multi, multi, "a\r\n\r\nb\r\n\r\n" * 20, "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 9,
             "HTTP/1.1 200 OK\r\n\r\n" * 8, "\n" * 150, "\x00" * 100, "\n" * 150]
    rows = [(100 - i, None if i == 2 else f"http://h/{i} a?\tq", h, i) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long").repartition(3)
    got = {r.page_id: r for r in A.read_warc(spark, convert(spark, pages, tmp_path)).collect()}
    firsts = {}
    for i, _, h, _ in rows:
        firsts[h or ""] = min(i, firsts.get(h or "", i))
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and firsts[h or ""] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) == (
            len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
            firsts[h or ""] if again else None, True)


def test_null_and_repeated_ids(spark, tmp_path):
    body = "y" * 120
    pages = spark.createDataFrame([(None, "u", body), (7, "u", body), (7, "u", body)], "page_id long, url string, html string")
    got = A.read_warc(spark, convert(spark, pages, tmp_path)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [
        ("7", "response", None), ("7", "revisit", 7), ("None", "revisit", 7)]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert A.read_warc(spark, convert(spark, pages, tmp_path)).count() == 0


HEAD = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n%s\n"
V1 = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"2 0 org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def test_versions_and_faults():
    one = HEAD % (len(V1), V1) + b"http://a/ b 1.2.3.4 19990102 text/html 5\nhello\n\ndns:a 1.2.3.4 19990102030405 text/dns 2\nok\n"
    rows = list(A.parse_arc(one))
    assert [(r[0], r[2], r[3], r[5], r[8], r[10]) for r in rows] == [
        ("http://a/ b", "1999-01-02T00:00:00Z", "text/html", b"hello", None, None),
        ("dns:a", "1999-01-02T03:04:05Z", "text/dns", b"ok", None, None)]
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: 12\r\n\r\nbody"
    two = HEAD % (len(V2), V2) + b"http://a/ 1.2.3.4 20000101000000 text/html 200 - - 0 x %d\n" % len(http) + http + b"\n"
    assert [(r[4], r[5], r[8]) for r in A.parse_arc(gzip.compress(two))] == [(http[:-4], b"body", 12)]
    assert [r[10] for r in A.parse_arc(one[:-4])][-1] == "truncated"
    assert [r[10] for r in A.parse_arc(one + b"not a header\n")][-1] == "malformed"
    assert list(A.parse_arc(b"")) == []
    # several gzip members, as archives store them
    parts = gzip.compress(HEAD % (len(V1), V1)) + gzip.compress(b"http://b/ - 2000 text/html 1\nz\n")
    assert [(r[0], r[5]) for r in A.parse_arc(parts)] == [("http://b/", b"z")]
