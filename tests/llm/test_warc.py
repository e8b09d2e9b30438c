import glob
import gzip
import hashlib
import random
from collections import Counter

import pytest

from boxframe.llm import common, warc

from .helpers import table

SCHEMA = "key long, uri string, payload binary, type string, digest string, record_id string, http string, at int"


def pages(seed=3):
    """Payloads with separators and records inside, equal ones, short ones, nulls, empty ones, bytes that are no text, very long ones, repeated rows."""
    r = random.Random(seed)
    same = b"<html>" + b"same page \r\n\r\n" * 30
    out = [(i, f"http://a.example/{i}", bytes(r.randrange(256) for _ in range(r.randint(0, 400)))) for i in range(40)]
    out += [(100 - i, f"http://b.example/ {i}\r\nX: y", same) for i in range(30)]
    out += [(200, "u", b"\r\n\r\n" * 40), (201, "u", b"\r\n\r\n" * 40), (202, "u", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 9), (203, None, None), (204, "", b"")]
    out += [(205, "u", b"x" * 99), (206, "u", b"x" * 99), (207, "u", b"y" * 100), (208, "u", b"y" * 100), (None, "u", b"y" * 100), (209, "u", bytes(range(256)) * 2_000), (210, "u", b"tail\r\n\r"), (211, "u", b"\r\n"), *[(212 + n, "u", (b"\r\n" * 9)[:n]) for n in range(12)], *[(230 + n, "u", b"x\r" + (b"\n\r" * 9)[:n]) for n in range(9)]]
    out += [out[3], (300, "v", b"z" * 150), (300, "v", b"z" * 150), (None, "n", b"n" * 120), (None, "n", b"n" * 120)]
    return [(*x, "t", "d", "r", "h", 7) for x in out]


def expected(rows):
    groups = {}
    for key, _, payload, *_ in rows:
        groups.setdefault(payload or b"", []).append(key)
    out = Counter()
    for payload, keys in groups.items():
        keys.sort(key=lambda k: (k is None, k))
        d = hashlib.sha256(payload).hexdigest()
        for i, k in enumerate(keys):
            again = i > 0 and len(payload) >= 100
            out[(k, len(payload), d, "revisit" if again else "response", keys[0] if again else None)] += 1
    return out


@pytest.mark.parametrize("bound", [200_000, 1])
def test_round_trip(spark, monkeypatch, bound):
    monkeypatch.setattr(common.join_split, "__defaults__", (bound, 10))
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert table(got, "key", "size", "digest", "type", "origin") == expected(rows)


def test_files_are_archives(spark, tmp_path):
    """The files are what the format asks for: read here by a parser of their own."""
    rows = pages()
    warc.write(warc.captures(spark.createDataFrame(rows, SCHEMA)), f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    ids, refs, payloads = set(), [], Counter()
    for name in glob.glob(f"{tmp_path}/b/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            assert first == "WARC/1.1"
            f = dict(x.split(": ", 1) for x in lines)
            n = int(f["Content-Length"])
            block, end, data = rest[:n], rest[n : n + 4], rest[n + 4 :]
            assert end == b"\r\n\r\n" and f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK")
            assert f["WARC-Record-ID"] not in ids
            ids.add(f["WARC-Record-ID"])
            if f["WARC-Type"] == "revisit":
                assert payload == b"" and f["WARC-Profile"] == warc.PROFILE
                refs.append(f["WARC-Refers-To"])
            else:
                assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
                payloads[payload] += 1
    assert set(refs) <= ids and len(ids) == len(rows)
    assert all(n == 1 for p, n in payloads.items() if len(p) >= 100) and set(payloads) == {x[2] or b"" for x in rows}


def record(kind, fields, block, version="1.0"):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members per record, an info record, earlier revisits (one whose original is here, one whose original is not), requests, a cut file."""
    body = b"<p>" + b"q" * 200
    sha = hashlib.sha256(body).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    web = "Content-Type: application/http; msgtype=response"
    each = [
        record("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
        record("response", ["WARC-Record-ID: <urn:a>", "warc-target-uri:  http://x/ ", web], http + body),
        record("request", ["Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        record("revisit", ["WARC-Record-ID: <urn:b>", web, f"WARC-Payload-Digest: sha256:{sha}", "WARC-Refers-To: <urn:gone>"], http),
        record("revisit", ["WARC-Record-ID: <urn:c>", web, "WARC-Payload-Digest: sha256:00", "WARC-Refers-To: <urn:elsewhere>"], http),
        record("response", ["WARC-Record-ID: <urn:d>", web], http + body),
        record("response", ["WARC-Record-ID: <urn:e>", "Content-Type: text/dns"], b"dns:x" * 40),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in each))
    (tmp_path / "a/two.warc.gz").write_bytes(gzip.compress(record("response", [web], http + b"whole") + record("response", [web], http + body)[:-90]))
    found = warc.read(spark, f"{tmp_path}/a")
    assert found.where("not complete").count() == 1 and found.where("type = 'response'").count() == 5
    assert found.where("record_id = '<urn:a>'").first().uri == "http://x/"
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    new = warc.read(spark, f"{tmp_path}/b")
    assert table(new, "type") == Counter({("response",): 4, ("revisit",): 3, ("warcinfo",): 1, ("request",): 1})
    first = new.where("uri = 'http://x/'").first()
    assert bytes(first.payload) == body and bytes(first.http) == http[:-4]
    got = table(warc.resolved(new).where("type = 'revisit'"), "size", "digest")
    assert got == Counter({(len(body), sha): 2, (None, "00"): 1})
    assert new.where("refers_to = '<urn:elsewhere>'").count() == 1
    assert bytes(new.where("type = 'request'").first().payload) == b"GET / HTTP/1.1\r\n\r\n"


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
