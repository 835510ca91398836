"""Heads of HTTP messages, DNS messages, TLS handshakes and certificates in the bytes of packets and streams.

HTTP is read by built-in functions; DNS and TLS, whose parts lie where the parts before them say, by small parsers over Arrow batches. What is
malformed is null from there on and names its issue and the byte where it was met; frames and records before it stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import format_datetime
from ipaddress import IPv6Address
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from . import blake3

HTTP = "(?is)^(?:(GET|HEAD|POST|PUT|DELETE|OPTIONS|PATCH|CONNECT|TRACE) (\\S+) HTTP/1\\.[01]|HTTP/1\\.[01] (\\d{3})[^\\r\\n]*)\\r?\\n"
HEADERS = ("host", "user-agent", "content-type", "server", "content-length")


def http(data: Column) -> Column:
    """method, uri, status and five headers of a message's head; null if it isn't one. The body is left out."""
    head = F.split_part(F.decode(data, "ISO-8859-1"), F.lit("\r\n\r\n"), F.lit(1))
    some = lambda c: F.when(c != "", c)
    header = lambda name: some(F.trim(F.regexp_extract(head, f"(?is)\\n{name}:([^\\r\\n]*)", 1)))
    line = lambda k: some(F.regexp_extract(F.concat(head, F.lit("\r\n")), HTTP, k))
    fields = [F.upper(line(1)).alias("method"), line(2).alias("uri"), line(3).cast("int").alias("status"), *(header(h).alias(h.replace("-", "_")) for h in HEADERS)]
    return F.when(F.concat(head, F.lit("\r\n")).rlike(HTTP), F.struct(*fields))



class Odd(Exception):
    """An issue, by its kind, at a byte."""

    def __init__(self, kind: str, at: int) -> None:
        super().__init__(kind)
        self.kind, self.at = kind, at


#: Bounds of DNS messages and names, and issues after which a capture has only a part of a message, by protocol; others degrade it.
JUMPS, LONGEST_NAME, LONGEST_MESSAGE = 32, 255, 65_535
PARTIAL = ("IncompleteTcpFrame", "TruncatedName", "TruncatedRecord", "TruncatedHandshake", "HandshakeLengthLimitExceeded")
NAMES, NUMBERS = ArrayType(StringType()), ArrayType(IntegerType())
ANSWER_TYPE = StructType().add("name", "string").add("type", "integer").add("class", "integer").add("ttl", "long").add("value", "string").add("rdata_hash", "string")
DNS_TYPE = StructType().add("id", "integer").add("response", "boolean").add("rcode", "integer").add("qname", "string").add("qtype", "integer").add("answers", ArrayType(ANSWER_TYPE)).add("issue", "string").add("issue_at", "integer")
ADDRESS, ALIASES, ADDRESS6 = 1, (5, 12), 28


def quality(issue: Column) -> Column:
    """How much of a message there is, by its issue."""
    return F.when(issue.isNull(), "Complete").when(issue.isin(*PARTIAL), "Partial").otherwise("Degraded")


def number(data: bytes, at: int, width: int = 2) -> int:
    return int.from_bytes(data[at : at + width])


def name_at(data: bytes, start: int) -> tuple[str, int]:
    """A name and the place behind it. Pointers may lead anywhere, but to no place twice."""
    at, behind, labels, seen = start, None, [], set()
    while True:
        if at >= len(data):
            raise Odd("TruncatedName", at)
        n = data[at]
        if n == 0:
            return ".".join(labels), at + 1 if behind is None else behind
        if n >= 0xC0:
            if at + 1 >= len(data):
                raise Odd("TruncatedName", at)
            target = (n & 0x3F) << 8 | data[at + 1]
            if len(seen) == JUMPS:
                raise Odd("CompressionJumpLimitExceeded", at)
            if target >= len(data):
                raise Odd("CompressionPointerOutOfBounds", at)
            if target in seen:
                raise Odd("CompressionLoop", target)
            seen.add(target)
            behind = at + 2 if behind is None else behind
            at = target
            continue
        if n > 63:
            raise Odd("InvalidLabelType", at)
        at += 1
        raw = data[at : at + n]
        try:
            if len(raw) < n:
                raise Odd("TruncatedName", at)
            labels.append(raw.decode())
        except UnicodeDecodeError:
            raise Odd("TruncatedName", at) from None
        at += n
        # points count twice
        if sum(len(x.encode()) for x in labels) + 2 * (len(labels) - 1) > LONGEST_NAME:
            raise Odd("ExpandedNameTooLong", start)


def _answer(data: bytes, at: int) -> tuple[dict, int]:
    name, at = name_at(data, at)
    if at + 10 > len(data):
        raise Odd("TruncatedRecord", at)
    kind, own, ttl, size = number(data, at), number(data, at + 2), number(data, at + 4, 4), number(data, at + 8)
    at += 10
    if at + size > len(data):
        raise Odd("TruncatedRecord", at)
    raw, value, known = data[at : at + size], None, True
    if kind in (ADDRESS, ADDRESS6):
        known = size == (4 if kind == ADDRESS else 16)
        value = (".".join(map(str, raw)) if kind == ADDRESS else str(IPv6Address(raw))) if known else None
    elif kind in ALIASES:
        value = name_at(data, at)[0]
    return {"name": name, "type": kind, "class": own, "ttl": ttl, "value": value, "rdata_hash": raw if known else None}, at + size


def _message(data: bytes) -> dict:
    """A message, with the data of its answers in place of their digests."""
    row: dict = {"answers": []}
    try:
        if len(data) > LONGEST_MESSAGE:
            raise Odd("MessageTooLarge", LONGEST_MESSAGE)
        if len(data) < 12:
            raise Odd("TruncatedRecord", len(data))
        flags = number(data, 2)
        row |= {"id": number(data, 0), "response": flags >> 15 == 1, "rcode": flags & 15}
        name, at = name_at(data, 12)
        if at + 4 > len(data):
            raise Odd("TruncatedRecord", at)
        row |= {"qname": name, "qtype": number(data, at)}
        at += 4
        for _ in range(number(data, 6)):
            answer, at = _answer(data, at)
            row["answers"].append(answer)
    except Odd as e:
        row |= {"issue": e.kind, "issue_at": e.at}
    return row


def _stream(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        left = len(data) - at
        size = number(data, at) if left > 1 else 0
        if size < 12 or left < size + 2:
            yield {"answers": [], "issue": "InvalidTcpFrameLength" if size < 12 else "IncompleteTcpFrame", "issue_at": left}
            return
        yield _message(data[at + 2 : at + 2 + size])
        at += 2 + size


def _digested(messages: list[dict]) -> list[dict]:
    """Messages with the digests of their answers' data. These are taken of all at once, each of equal ones once, since one alone takes most of a millisecond."""
    answers = [a for m in messages for a in m["answers"] if a["rdata_hash"] is not None]
    data = list({a["rdata_hash"] for a in answers})
    digests = dict(zip(data, blake3.digests(data), strict=True))
    for a in answers:
        a["rdata_hash"] = digests[a["rdata_hash"]]
    return messages


def dns_message(data: bytes) -> dict:
    return _digested([_message(data)])[0]


def dns_stream(data: bytes) -> Iterator[dict]:
    """The messages of a stream, each behind its length. A length that can't be ends it, as does a message that the stream ends in."""
    yield from _digested(list(_stream(data)))


def dns_batches(data: bytes, size: int) -> Iterator[list[dict]]:
    """As dns_stream, so many messages at once."""
    found = _stream(data)
    while some := list(islice(found, size)):
        yield _digested(some)


def dns_messages(data: list[bytes | None]) -> list[dict | None]:
    found = [None if d is None else _message(d) for d in data]
    _digested([m for m in found if m is not None])
    return found


def _over_all(work: Callable[[list[bytes | None]], list], made: DataType) -> Callable[[Column], Column]:
    """work over a batch of a column of bytes, as a column of this type."""
    arrow = to_arrow_type(made)

    def run(data: pa.Array) -> pa.Array:
        return pa.array(work(data.to_pylist()), arrow)

    run.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, made)


def _over(work: Callable[[bytes], object], made: DataType) -> Callable[[Column], Column]:
    """work over a column of bytes, as a column of this type; null for null."""
    return _over_all(lambda data: [None if d is None else work(d) for d in data], made)


#: What a DNS message asks and answers, and the first issue in it.
dns = _over_all(dns_messages, DNS_TYPE)
#: The messages of a TCP stream, as an array.
dns_frames = _over(lambda d: list(dns_stream(d)), ArrayType(DNS_TYPE))

#: Bounds of TLS records, handshakes and certificates, kinds of messages, extensions and ciphers of TLS 1.3, and names of parts of a certificate's names.
LONGEST_RECORD, LONGEST_HANDSHAKE, MOST_CERTIFICATES, LONGEST_CERTIFICATE = 18_432, 16 << 20, 32, 4 << 20
HANDSHAKE, CLIENT, SERVER, CERTIFICATE = 22, 1, 2, 11
SNI, ALPN, VERSIONS, TLS13, CIPHERS13 = 0, 16, 43, 0x0304, (0x1301, 0x1302, 0x1303)
PARTS = {
    "2.5.4.3": "CN", "2.5.4.4": "SN", "2.5.4.5": "serialNumber", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.9": "street", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.12": "title", "2.5.4.42": "GN",
    "1.2.840.113549.1.9.1": "Email", "0.9.2342.19200300.100.1.1": "UID", "0.9.2342.19200300.100.1.25": "DC",
}
SUBJECT_NAMES = "2.5.29.17"
CERTIFICATE_TYPE = StructType().add("subject", "string").add("issuer", "string").add("names", NAMES).add("serial", "string").add("not_before", "string").add("not_after", "string").add("sha256", "string")
TLS_TYPE = (
    StructType().add("kind", "string").add("version", "integer").add("offered", NUMBERS).add("selected_version", "integer").add("selected_cipher", "integer").add("sni", "string").add("alpn", NAMES).add("ciphers", NUMBERS)
    .add("selected_alpn", "string").add("certificates", ArrayType(CERTIFICATE_TYPE)).add("visibility", "string").add("issue", "string").add("issue_at", "integer")
)


def der(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """The tag of an element, and where its content begins and ends."""
    if at + 2 > end:
        raise ValueError
    size, start = data[at + 1], at + 2
    if size > 127:
        n = size & 127
        if not 0 < n < 5 or start + n > end:
            raise ValueError
        size, start = number(data, start, n), start + n
    if start + size > end:
        raise ValueError
    return data[at], start, start + size


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        one = der(data, at, end)
        yield one
        at = one[2]


def object_name(raw: bytes) -> str:
    numbers, n = [], 0
    for b in raw:
        n = n << 7 | b & 127
        if b < 128:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, (first, numbers[0] - 40 * first, *numbers[1:])))


def text_of(tag: int, raw: bytes) -> str:
    return raw.decode({30: "utf-16-be", 28: "utf-32-be", 12: "utf-8"}.get(tag, "latin-1"), "replace")


def distinguished(data: bytes, at: int, end: int) -> str:
    """A name as its parts in order: comma and blank between them, a plus between parts that stand together."""
    out = []
    for _, a, b in elements(data, at, end):
        together = []
        for _, c, d in elements(data, a, b):
            (_, oid, oid_end), (tag, value, value_end) = list(elements(data, c, d))[:2]
            name = object_name(data[oid:oid_end])
            together.append(f"{PARTS.get(name, name)}={text_of(tag, data[value:value_end])}")
        out.append(" + ".join(together))
    return ", ".join(out)


def moment(tag: int, raw: bytes) -> str:
    text = raw.decode("ascii")
    if tag == 23:
        text = ("20" if text[:2] < "50" else "19") + text
    return format_datetime(datetime.strptime(text.removesuffix("Z"), "%Y%m%d%H%M%S").replace(tzinfo=UTC))


def certificate(data: bytes) -> dict:
    """Names, number and validity of a certificate. ValueError where it isn't one."""
    try:
        _, at, end = der(data, 0, len(data))
        _, at, end = der(data, at, end)
        own = list(elements(data, at, end))
        own = own[1:] if own[0][0] == 0xA0 else own
        (tag, a, b), _, issuer, (_, c, d), subject = own[:5]
        if tag != 2:
            raise ValueError
        validity = list(elements(data, c, d))
        names = []
        for tag, x, y in own[6:]:
            if tag == 0xA3:
                _, x, y = der(data, x, y)
                for _, e, f in elements(data, x, y):
                    parts = list(elements(data, e, f))
                    if object_name(data[parts[0][1] : parts[0][2]]) == SUBJECT_NAMES:
                        _, g, h = der(data, parts[-1][1], parts[-1][2])
                        names += [data[i:j].decode("ascii", "replace") for t, i, j in elements(data, g, h) if t == 0x82]
        return {
            "subject": distinguished(data, subject[1], subject[2]), "issuer": distinguished(data, issuer[1], issuer[2]), "names": names, "serial": data[a:b].hex(),
            "not_before": moment(validity[0][0], data[validity[0][1] : validity[0][2]]), "not_after": moment(validity[1][0], data[validity[1][1] : validity[1][2]]), "sha256": hashlib.sha256(data).hexdigest(),
        }
    except (IndexError, UnicodeDecodeError) as e:
        raise ValueError from e


def _certificates(body: bytes, offset: int) -> list[dict]:
    """The chain of a message of TLS 1.3, each with its extensions."""
    short = lambda at: Odd("TruncatedHandshake", offset + at)
    if len(body) < 3 or 3 + number(body, 0, 3) > len(body):
        raise short(0)
    at, end, out = 3, 3 + number(body, 0, 3), []
    while at < end:
        if len(out) == MOST_CERTIFICATES:
            raise Odd("CertificateChainLimitExceeded", offset + at)
        if at + 3 > end:
            raise short(at)
        size, at = number(body, at, 3), at + 3
        if size > LONGEST_CERTIFICATE:
            raise Odd("CertificateBytesLimitExceeded", offset + at)
        if at + size + 2 > end:
            raise short(at)
        try:
            out.append(certificate(body[at : at + size]))
        except ValueError:
            raise Odd("MalformedCertificate", 0) from None
        at += size
        more, at = number(body, at), at + 2
        if at + more > end:
            raise short(at)
        at += more
    if not out:
        raise Odd("MalformedCertificate", offset + at)
    return out


def _pairs(raw: bytes) -> list[int]:
    return [number(raw, k) for k in range(0, len(raw) - 1, 2)]


def hello(kind: int, body: bytes) -> dict | None:
    """What a hello offers or selects; None where it is too short to be one. An extension that runs over the end ends them."""
    if len(body) < 35:
        return None
    client, at = kind == CLIENT, 35 + body[34]
    out: dict = {"kind": "ClientHello" if client else "ServerHello", "version": number(body, 0), "offered": [], "selected_version": None, "selected_cipher": None, "sni": None, "alpn": [], "ciphers": []}
    if client:
        if at + 2 + number(body, at) > len(body) or at + 2 > len(body):
            return None
        out["ciphers"], at = _pairs(body[at + 2 : at + 2 + number(body, at)]), at + 2 + number(body, at)
        if at >= len(body):
            return out
        at += 1 + body[at]
    elif at + 2 <= len(body):
        out["ciphers"], at = [number(body, at)], min(at + 3, max(at + 2, len(body)))
    if at + 2 > len(body):
        return out
    end, at = min(at + 2 + number(body, at), len(body)), at + 2
    if not client:
        out |= {"selected_version": out["version"], "selected_cipher": next(iter(out["ciphers"]), None)}
    while at + 4 <= end:
        kind, size = number(body, at), number(body, at + 2)
        own, at = body[at + 4 : at + 4 + size], at + 4 + size
        if at > end:
            break
        if kind == SNI and len(own) >= 5 and 5 + number(own, 3) <= len(own):
            out["sni"] = _utf8(own[5 : 5 + number(own, 3)])
        elif kind == ALPN:
            k = 2
            while k < len(own) and k + 1 + own[k] <= len(own):
                if (name := _utf8(own[k + 1 : k + 1 + own[k]])) is not None:
                    out["alpn"].append(name)
                k += 1 + own[k]
        elif kind == VERSIONS and client and own and own[0] < len(own):
            out["offered"] = _pairs(own[1 : 1 + own[0]])
        elif kind == VERSIONS and not client and size == 2:
            out["selected_version"] = number(own, 0)
    return out


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Kinds and contents of TLS records."""
    at = 0
    while at < len(data):
        size = number(data, at + 3)
        if len(data) - at < 5:
            raise Odd("TruncatedRecord", at)
        if size > LONGEST_RECORD:
            raise Odd("RecordLengthLimitExceeded", at)
        if at + 5 + size > len(data):
            raise Odd("TruncatedRecord", at)
        yield data[at], data[at + 5 : at + 5 + size]
        at += 5 + size


def tls_handshake(data: bytes) -> dict:
    """The first hello of the records of a stream, its certificates, and what can be seen of these."""
    row: dict = {"certificates": []}
    try:
        whole = b""
        for kind, body in records(data):
            if kind == HANDSHAKE:
                whole += body
            if len(whole) > LONGEST_HANDSHAKE:
                raise Odd("HandshakeLengthLimitExceeded", len(whole))
        at, own = 0, None
        while at < len(whole):
            size = number(whole, at + 1, 3)
            if len(whole) - at < 4:
                raise Odd("TruncatedHandshake", at)
            if size > LONGEST_HANDSHAKE:
                raise Odd("HandshakeLengthLimitExceeded", at)
            if at + 4 + size > len(whole):
                raise Odd("TruncatedHandshake", at)
            kind, body = whole[at], whole[at + 4 : at + 4 + size]
            if kind in (CLIENT, SERVER) and own is None:
                own = hello(kind, body)
                if own is None:
                    raise Odd("InvalidHandshake", at)
                row |= own
            elif kind == CERTIFICATE:
                row["certificates"] += _certificates(body, at + 4)
            at += 4 + size
        if own is None:
            raise Odd("InvalidHandshake", 0)
        if own["selected_version"] == TLS13 and own["selected_cipher"] not in CIPHERS13:
            raise Odd("InconsistentNegotiation", 0)
        server = own["kind"] == "ServerHello"
        row["selected_alpn"] = next(iter(own["alpn"]), None) if server else None
        row["visibility"] = "Observed" if row["certificates"] else "NotObservableEncryptedHandshake" if server and own["selected_version"] == TLS13 else "NotPresentInCapture"
    except Odd as e:
        row |= {"issue": e.kind, "issue_at": e.at}
        row["visibility"] = "Truncated" if e.kind in PARTIAL else "ParseError"
    return row


#: A stream's first TLS hello, names and ciphers, with the certificates that follow it and the first issue.
tls = _over(tls_handshake, TLS_TYPE)
