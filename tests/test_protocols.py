"""DNS messages and frames, TLS records, handshakes and certificates, by messages put together here."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import blake3, protocols
from tracewright.operators import reassembly


def label(text):
    return bytes([len(text)]) + text.encode()


def message(answers=b"", count=0, question=None, flags=0x8180):
    name = label("Example") + label("test") + b"\0" if question is None else question
    return (7).to_bytes(2) + flags.to_bytes(2) + (1).to_bytes(2) + count.to_bytes(2) + bytes(4) + name + b"\0\x01\0\x01" + answers


def answer(kind, data, name=b"\xc0\x0c", ttl=60):
    return name + kind.to_bytes(2) + b"\0\x01" + ttl.to_bytes(4) + len(data).to_bytes(2) + data


def test_answers_by_value():
    raw = answer(1, bytes([10, 0, 0, 1])) + answer(28, bytes(15) + b"\x01") + answer(5, b"\xc0\x14") + answer(16, b"text") + answer(1, b"abc")
    got = protocols.dns_message(message(raw, 5))
    assert (got["id"], got["response"], got["rcode"], got["qname"], got["qtype"], got.get("issue")) == (7, True, 0, "Example.test", 1, None)
    assert [a["value"] for a in got["answers"]] == ["10.0.0.1", "::1", "test", None, None] and got["answers"][0] | {"rdata_hash": 0} == {"name": "Example.test", "type": 1, "class": 1, "ttl": 60, "value": "10.0.0.1", "rdata_hash": 0}
    assert got["answers"][3]["rdata_hash"] == blake3.digests([b"text"])[0] and got["answers"][4]["rdata_hash"] is None


@pytest.mark.parametrize(
    ("data", "kind"),
    [
        (message(question=b"\xc0\x0c"), "CompressionLoop"),
        (message(question=b"\xc0\xff"), "CompressionPointerOutOfBounds"),
        (message(answers=b"".join((0xC000 + 18 + 2 * (k + 1)).to_bytes(2) for k in range(40)) + b"\0", question=b"\xc0\x12"), "CompressionJumpLimitExceeded"),
        (message()[:20], "TruncatedName"),
        (message(question=b"\x41abc\0"), "InvalidLabelType"),
        (message(question=label("x" * 63) * 4 + b"\0"), "ExpandedNameTooLong"),
        (message(answer(1, bytes(4))[:-1], 1), "TruncatedRecord"),
        (message()[:11], "TruncatedRecord"),
        (bytes(65_536), "MessageTooLarge"),
        (message(question=label("a") + b"\x02\xff\xfe\0"), "TruncatedName"),
    ],
)
def test_issues_of_messages(data, kind):
    assert protocols.dns_message(data)["issue"] == kind


def test_frames_and_their_issues():
    one, two = message(), message(answer(1, bytes(4)), 1)
    framed = lambda m: len(m).to_bytes(2) + m
    kinds = lambda data: [m.get("issue") for m in protocols.dns_stream(data)]
    assert kinds(framed(one) + framed(two)) == [None, None] and kinds(b"") == []
    assert kinds(framed(one) + b"\0") == kinds(framed(one) + b"\0\x05hello") == [None, "InvalidTcpFrameLength"]
    assert kinds(framed(one) + framed(two)[:-1]) == [None, "IncompleteTcpFrame"]
    # what is odd in a message doesn't hide those behind it
    assert kinds(framed(message(question=b"\xc0\x0c")) + framed(two)) == ["CompressionLoop", None]


def test_any_segments_give_the_same_messages(spark):
    frames = b"".join(len(m).to_bytes(2) + m for m in (message(answer(1, bytes([10, 0, 0, k])) * (k % 3), k % 3) for k in range(20)))
    want, rng = list(protocols.dns_stream(frames)), random.Random(4)
    schema = "file string, packet_index long, ts_us long, captured long, original long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags string, tcp_sequence long, payload binary, issue string"
    rows = []
    for stream in range(5):
        at, parts = 0, []
        while at < len(frames):
            size = rng.randrange(1, 80)
            parts.append((at, frames[at : at + size]))
            at += size
        rng.shuffle(parts)
        rows += [(f"f{stream}", k, 0, len(d), len(d), "a", "b", 1, 53, "TCP", "ACK", (2**32 - 100 + s) % 2**32, d, None) for k, (s, d) in enumerate(parts)]
    streams = reassembly.streams_of(reassembly.reassembled(spark.createDataFrame(rows, schema)))
    found = streams.select(protocols.dns_frames("bytes").alias("m")).collect()
    assert len(found) == 5
    for r in found:
        assert [(m["qname"], [a["value"] for a in m["answers"]], m["issue"]) for m in r["m"]] == [(m["qname"], [a["value"] for a in m["answers"]], None) for m in want]


# --- certificates


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def oid(text):
    a, b, *rest = map(int, text.split("."))
    out = [40 * a + b]
    for n in rest:
        part = [n & 127]
        while n := n >> 7:
            part.insert(0, n & 127 | 128)
        out += part
    return der(6, bytes(out))


def name(*parts):
    return der(0x30, *(der(0x31, *(der(0x30, oid(o), der(12, v.encode())) for o, v in together)) for together in parts))


def made_certificate(names=("a.test", "*.b.test"), serial=b"\x00\xfe\x01", early=(23, b"240115120000Z"), late=(24, b"20500101000000Z"), version=True):
    issuer = name([("2.5.4.6", "US")], [("2.5.4.10", "Some Org")], [("2.5.4.3", "CA Ä")])
    subject = name([("2.5.4.3", "host.test"), ("1.2.840.113549.1.9.1", "x@y.test")], [("1.2.3.4", "odd")])
    general = der(0x30, *(der(0x82, n.encode()) for n in names), der(0x87, bytes(4)))
    more = der(0xA3, der(0x30, der(0x30, oid("2.5.29.19"), der(4, der(0x30))), der(0x30, oid("2.5.29.17"), der(1, b"\xff"), der(4, general))))
    own = der(0x30, *([der(0xA0, der(2, b"\x02"))] if version else []), der(2, serial), der(0x30, oid("1.2.840.113549.1.1.11")), issuer, der(0x30, der(*early), der(*late)), subject, der(0x30, b""), more)
    return der(0x30, own, der(0x30, oid("1.2.840.113549.1.1.11")), der(3, b"\0sig"))


def test_certificates_by_value():
    raw = made_certificate()
    assert protocols.certificate(raw) == {
        "subject": "CN=host.test + Email=x@y.test, 1.2.3.4=odd", "issuer": "C=US, O=Some Org, CN=CA Ä", "names": ["a.test", "*.b.test"], "serial": "00fe01", "not_before": "Mon, 15 Jan 2024 12:00:00 +0000",
        "not_after": "Sat, 01 Jan 2050 00:00:00 +0000", "sha256": hashlib.sha256(raw).hexdigest(),
    }
    assert protocols.certificate(made_certificate(early=(23, b"991231235959Z"), version=False))["not_before"] == "Fri, 31 Dec 1999 23:59:59 +0000"
    for cut in range(0, len(raw) - 12, 5):
        with pytest.raises(ValueError):
            protocols.certificate(raw[:cut])


def sized(data, width):
    return len(data).to_bytes(width) + data


def client(sni=b"Host.test"):
    more = b"\0\0" + sized(sized(b"\0" + sized(sni, 2), 2), 2) + b"\0\x10" + sized(sized(sized(b"h2", 1) + sized(b"http/1.1", 1), 2), 2) + b"\0\x2b" + sized(sized(b"\x03\x04\x03\x03", 1), 2)
    return b"\x01" + sized(b"\x03\x03" + bytes(32) + b"\0" + sized(b"\x13\x01\x13\x02", 2) + sized(b"\0", 1) + sized(more, 2), 3)


def server(version=b"\x03\x04", cipher=b"\x13\x01", alpn=b"h2"):
    more = b"\0\x2b" + sized(version, 2) + b"\0\x10" + sized(sized(sized(alpn, 1), 2), 2)
    return b"\x02" + sized(b"\x03\x03" + bytes(32) + b"\0" + cipher + b"\0" + sized(more, 2), 3)


def chain(*certificates, extension=b""):
    return b"\x0b" + sized(sized(b"".join(sized(c, 3) + sized(extension, 2) for c in certificates), 3), 3)


def record(data, kind=22, step=50):
    return b"".join(bytes([kind]) + b"\x03\x03" + sized(data[k : k + step], 2) for k in range(0, len(data), step))


def test_handshakes_by_value():
    got = protocols.tls_handshake(record(client()) + record(b"secret", 23))
    assert (got["kind"], got["version"], got["sni"], got["alpn"], got["ciphers"], got["offered"], got["visibility"], got.get("issue")) == ("ClientHello", 0x0303, "Host.test", ["h2", "http/1.1"], [0x1301, 0x1302], [0x0304, 0x0303], "NotPresentInCapture", None)
    got = protocols.tls_handshake(record(server(b"\x03\x03", b"\xc0\x2f") + chain(made_certificate(), made_certificate(("c.test",)))))
    assert (got["selected_version"], got["selected_cipher"], got["selected_alpn"], got["visibility"], [c["names"] for c in got["certificates"]]) == (0x0303, 0xC02F, "h2", "Observed", [["a.test", "*.b.test"], ["c.test"]])
    assert protocols.tls_handshake(record(server()))["visibility"] == "NotObservableEncryptedHandshake"


BIG = b"\x0b" + sized((4 << 20).to_bytes(3) + bytes(10), 3)


@pytest.mark.parametrize(
    ("data", "kind", "visibility"),
    [
        (record(client())[:-1], "TruncatedRecord", "Truncated"),
        (b"\x16\x03", "TruncatedRecord", "Truncated"),
        (b"\x16\x03\x03" + (18_433).to_bytes(2), "RecordLengthLimitExceeded", "ParseError"),
        (record(client()[:-1]), "TruncatedHandshake", "Truncated"),
        (record(client() + BIG), "TruncatedHandshake", "Truncated"),
        (record(b"\x01" + sized(bytes(20), 3)), "InvalidHandshake", "ParseError"),
        (record(b"x", 23), "InvalidHandshake", "ParseError"),
        (record(b"\x01" + ((16 << 20) - 1).to_bytes(3)), "TruncatedHandshake", "Truncated"),
        (record(b"x" * ((16 << 20) + 1), step=18_000), "HandshakeLengthLimitExceeded", "Truncated"),
        (record(server() + chain(*[made_certificate()] * 33), step=18_000), "CertificateChainLimitExceeded", "ParseError"),
        (record(server() + b"\x0b" + sized(sized(((4 << 20) + 1).to_bytes(3) + b"ab", 3), 3)), "CertificateBytesLimitExceeded", "ParseError"),
        (record(server() + chain(b"no certificate")), "MalformedCertificate", "ParseError"),
        (record(server() + chain()), "MalformedCertificate", "ParseError"),
        (record(server(cipher=b"\xc0\x2f")), "InconsistentNegotiation", "ParseError"),
    ],
)
def test_issues_of_handshakes(data, kind, visibility):
    got = protocols.tls_handshake(data)
    assert (got["issue"], got["visibility"]) == (kind, visibility)


def test_columns(spark):
    rows = spark.createDataFrame([(1, record(server(b"\x03\x03", b"\xc0\x2f") + chain(made_certificate()))), (2, None), (3, b"")], "k int, d binary")
    got = {r["k"]: r["m"] for r in rows.select("k", protocols.tls("d").alias("m")).collect()}
    assert got[1]["certificates"][0]["subject"].startswith("CN=host.test") and got[2] is None and got[3]["issue"] == "InvalidHandshake"
    kinds = rows.select(protocols.quality(F.lit("TruncatedName")).alias("a"), protocols.quality(F.lit("CompressionLoop")).alias("b"), protocols.quality(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(kinds) == ("Partial", "Degraded", "Complete")
    assert rows.select(protocols.dns("d").alias("m")).where("m.issue = 'TruncatedRecord'").count() >= 1
