"""Archives that other writers made: all record types, header names in any case, digests in hex, large payloads."""

import base64
import gzip
import hashlib
import random

import pytest

from tessera.llm import warc


def record(kind, headers, block, length=True):
    lines = ["WARC/1.0", f"warc-TYPE:{kind}", f"WARC-record-id: <urn:{kind}>", *headers] + ([f"content-length:   {len(block)}"] if length else [])
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def http(body, head="HTTP/1.1 200 OK\r\ncontent-type: text/html"):
    return head.encode() + b"\r\n\r\n" + body


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("warc") / "foreign.warc.gz"
    big = random.Random(1).randbytes(9 << 20) * 8  # 72 MB that do not deflate at once
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    http_type = "CONTENT-TYPE: application/http; msgtype=response"
    members = [
        record("warcinfo", ["Content-Type: application/warc-fields"], b"software: other\r\n"),
        record("request", ["Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        record("response", [http_type, "WARC-Target-URI: http://a/", f"WARC-payload-DIGEST: sha1:{hashlib.sha1(b'<p>').hexdigest().upper()}"], http(b"<p>")),
        record("metadata", ["Content-Type: text/plain"], b"", length=False),
        record("response", ["Content-Type: text/dns", "WARC-Target-URI: dns:a"], b"a 1.2.3.4"),
        record("response", [http_type, "X-Page-Id: not a number", "WARC-Payload-Digest: md5:00"], http(b"")),
        record("revisit", [http_type, f"WARC-Payload-Digest: SHA1:{digest(b'<p>').lower()}", "WARC-Refers-To: <urn:response>"], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        record("revisit", ["WARC-Refers-To: <urn:response>"], b""),
        gzip.compress(b"not a record"),
        record("response", [http_type, f"WARC-Payload-Digest: sha1:{digest(big)}", "WARC-Target-URI: http://big/"], http(big)),
        record("conversion", [f"WARC-Payload-Digest: sha1:{digest(b'other')}"], b"plain \x1f\x8b\x08 text"),
    ]
    path.write_bytes(b"".join(members))
    return spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long"), big


@pytest.mark.parametrize("split", [1 << 20, 1 << 30])
def test_responses_and_revisits(archive, split):
    manifest, big = archive
    rows = warc.read_warc(manifest, split).drop("payload").collect()
    sha = lambda b: hashlib.sha1(b).hexdigest()
    told = {(r["record_type"], r["url"], r["payload_bytes"], r["payload_digest"], r["digest_agrees"], r["refers_to_record"], r["page_id"]) for r in rows}
    assert len(rows) == 6 and told == {
        ("response", "http://a/", 3, sha(b"<p>"), True, None, None),
        ("response", "dns:a", 9, sha(b"a 1.2.3.4"), None, None, None),
        ("response", None, 0, sha(b""), None, None, None),
        ("revisit", None, None, sha(b"<p>"), None, "<urn:response>", None),
        ("revisit", None, None, None, None, "<urn:response>", None),
        ("response", "http://big/", len(big), sha(big), True, None, None),
    }


def test_all_types_and_digests_that_do_not_agree(archive):
    manifest, _ = archive
    rows = warc.read_warc(manifest, types=None, verify=False).where("payload_bytes < 1000").collect()
    payloads = {r["record_type"]: bytes(r["payload"]) for r in rows if r["record_type"] not in ("response", "revisit")}
    assert payloads == {"warcinfo": b"software: other\r\n", "request": b"", "metadata": b"", "conversion": b"plain \x1f\x8b\x08 text"}
    assert [r["digest_agrees"] for r in rows if r["record_type"] == "conversion"] == [False]
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(manifest, types=("conversion",)).collect()
