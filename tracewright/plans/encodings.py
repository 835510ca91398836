"""Queries of functions of text and bytes, of recipes, protocols and chains of digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blake3
from ..functions import octets as B
from ..functions import protocols as P
from ..functions import recipes as R
from ..functions import scalar as S
from ..functions import shell as X
from ..functions import text as T
from ..operators import observations, reassembly, windows
from .catalog import query

def text_of(column):
    return column.cast("string")


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\\s+', ' ', 'g'))) AS key FROM part")
def product_keys(t):
    return t("part").select("p_partkey", T.product_key(F.concat(F.lit("  "), "p_name", F.lit("\t  "), "p_type", F.lit(" "))).alias("key"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CVE-2024-' || (10000 + p_partkey) WHEN 1 THEN 'CVE-2023-' || (10000 + p_partkey) END AS cve FROM part")
def cve_identifiers(t):
    n = text_of(F.col("p_partkey") + 10000)
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("CVE-2024-"), n)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("UBUNTU-CVE-2023-"), n)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("XCVE-2023-"), n)).otherwise(F.concat(F.lit("CVE-2023-"), n, F.lit("-x")))
    return t("part").select("p_partkey", T.cve_of(text).alias("cve"))


HEADS = ("Critical: ", "Important : ", "MODERATE: ", "low ", "Low:", "High: ")


@query(f"SELECT p_partkey, CASE WHEN contains(h || p_name, ':') AND trim(split_part(h, ':', 1)) IN ('Critical', 'Important', 'Moderate', 'Low') THEN trim(split_part(h, ':', 1)) END AS severity FROM (SELECT *, [{', '.join(repr(h) for h in HEADS)}][p_size % 6 + 1] AS h FROM part)")
def summary_severities(t):
    heads = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_size") % 6).cast("int") + 1)
    return t("part").select("p_partkey", T.severity_prefix(F.concat(heads, "p_name")).alias("severity"))


RELEASES = ("Windows  10 Version 22H2", "windows 11,version 24H2", "Windows Server 2022 (Server Core installation)", "Windows Server Update Services", "Microsoft .NET on Windows 10", "Windows 8", "Windows 8.1 for x64", "Windows RT on Surface", "Windowsill 10", "Windows Vista", "Windows XP")


@query("SELECT p_partkey, p_size % 11 IN (0, 1, 2, 6, 9) AS windows FROM part")
def windows_products(t):
    name = F.element_at(F.array(*map(F.lit, RELEASES)), (F.col("p_size") % 11).cast("int") + 1)
    return t("part").select("p_partkey", T.is_windows(name).alias("windows"))


@query("SELECT p_partkey, p_partkey % 4 = 1 AS named, p_partkey % 4 = 0 AS top, p_partkey % 4 IN (2, 3) AS under, p_partkey % 4 = 3 AS one FROM part")
def path_globs(t):
    n = text_of(F.col("p_partkey"))
    paths = (F.concat(F.lit("f"), n, F.lit(".js")), F.concat(F.lit("x/node_modules/f"), n), F.concat(F.lit("src/a/b/f"), n, F.lit(".js")), F.concat(F.lit("src/f"), n, F.lit(".js")))
    path = F.element_at(F.array(*paths), (F.col("p_partkey") % 4).cast("int") + 1)
    return t("part").select("p_partkey", T.glob(path, "node_modules/").alias("named"), T.glob(path, "/*.js").alias("top"), T.glob(path, "src/**/*.j?").alias("under"), T.glob(path, "src/*.js").alias("one"))


@query("SELECT p_partkey, 'a ' || CASE p_partkey % 3 WHEN 0 THEN 'password = ***' WHEN 1 THEN 'API_KEY: ***' ELSE 'passage = ' || p_brand END AS line FROM part")
def masked_lines(t):
    head = F.element_at(F.array(*map(F.lit, ("a password = ", "a API_KEY: ", "a passage = "))), (F.col("p_partkey") % 3).cast("int") + 1)
    return t("part").select("p_partkey", T.masked(F.concat(head, F.regexp_replace("p_brand", " ", ""))).alias("line"))


ENDS = ("", " 2.1", " 12.4.1 (x64)", " 64-bit Edition", " 7", " v3.0")


@query(f"""WITH p AS (SELECT *, p_type || ' ' || p_name || [{', '.join(repr(e) for e in ENDS)}][p_size % 6 + 1] AS raw, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'unknown' ELSE p_brand || ' Inc.' END AS publisher, CASE WHEN p_size % 3 = 0 THEN '' ELSE '1.' || p_size || '/b' END AS v FROM part),
n AS (SELECT *, p_type || ' ' || p_name || [ '', '', '', '', ' 7', ' v3.0'][p_size % 6 + 1] AS product FROM p),
i AS (SELECT *, replace(lower(product), ' ', '_') AS own, CASE WHEN p_size % 4 < 2 THEN replace(lower(product), ' ', '_') ELSE replace(replace(lower(publisher), ' ', '_'), '#', '') END AS vendor, CASE WHEN v = '' THEN '*' ELSE replace(v, '/', '') END AS number FROM n)
SELECT p_partkey, product, 'cpe:2.3:a:' || vendor || ':' || own || ':' || number || ':*:*:*:*:*:*:*' AS cpe, 'pkg:generic/' || vendor || '/' || own || '@' || number AS purl FROM i""")
def product_identifiers(t):
    size = F.col("p_size")
    raw = F.concat("p_type", F.lit(" "), "p_name", F.element_at(F.array(*map(F.lit, ENDS)), (size % 6).cast("int") + 1))
    publisher = F.when(size % 4 == 0, "").when(size % 4 == 1, "unknown").otherwise(F.concat("p_brand", F.lit(" Inc.")))
    version = F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("1."), text_of(size), F.lit("/b")))
    return t("part").select("p_partkey", T.software_identifiers(raw, publisher, version).alias("i")).select("p_partkey", "i.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '10,0,' || p_partkey || ',' || p_size END AS build FROM part")
def build_numbers(t):
    tail = F.concat(text_of(F.col("p_partkey")), F.lit("​."), text_of(F.col("p_size")))
    build = T.build(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10."), tail)).otherwise(F.concat(F.lit("10.0."), tail)))
    return t("part").select("p_partkey", F.when(build.isNotNull(), F.array_join(F.transform(build, text_of), ",")).alias("build"))


@query("SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first FROM orders ORDER BY 1 DESC LIMIT 12")
def newest_months(t):
    months = t("orders").select(F.date_format("o_orderdate", "yyyy-MMM").alias("m")).distinct()
    return months.select(T.month(F.col("m")).alias("d")).orderBy(F.desc("d")).limit(12).select(F.date_format("d", "yyyy-MM-dd").alias("first"))


TARGETS = ("/30", "", "/29", "/31", "/32", "-10.1.{}.15", "-10.1.{}.3", "/12", "/33", ".test")


def target_texts():
    n = text_of(F.col("s_suppkey") % 200)
    ends = [F.concat(F.lit(e.split("{}")[0]), n, F.lit(e.split("{}")[1])) if "{}" in e else F.lit(e) for e in TARGETS]
    return F.concat(F.lit("10.1."), n, F.lit(".13"), F.element_at(F.array(*ends), (F.col("s_suppkey") % 10).cast("int") + 1))


@query("""SELECT s_suppkey, '10.1.' || s_suppkey % 200 || '.' || unnest(CASE s_suppkey % 10 WHEN 0 THEN [13, 14] WHEN 1 THEN [13] WHEN 2 THEN [9, 10, 11, 12, 13, 14] WHEN 4 THEN [13] WHEN 5 THEN [13, 14, 15] ELSE [] END) AS ip FROM supplier""")
def expanded_blocks(t):
    return t("supplier").select("s_suppkey", F.explode(T.addresses(T.target(target_texts()))).alias("ip"))


@query("""SELECT s_suppkey, CASE s_suppkey % 10 WHEN 1 THEN 'Address' WHEN 5 THEN 'Range' WHEN 6 THEN 'Invalid' WHEN 7 THEN 'Invalid' WHEN 8 THEN 'Invalid' WHEN 9 THEN 'Hostname' ELSE 'Cidr' END AS kind,
  CASE s_suppkey % 10 WHEN 6 THEN 'end before start' WHEN 7 THEN 'block too large' WHEN 8 THEN 'block' END AS why FROM supplier""")
def target_kinds(t):
    return t("supplier").select("s_suppkey", T.target(target_texts()).alias("x")).select("s_suppkey", "x.kind", "x.why")


@query("SELECT event_id, '{\"a\":{\"x\":1,\"y\":[2,' || event_id || ']},\"k\":' || json_extract_string(props, '$.k') || ',\"z\":\"' || event_type || '\"}' AS canonical FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def canonical_documents(t):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "z": "'), "event_type", F.lit('", "k": '), k, F.lit(', "a": {"y": [2, '), text_of(F.col("event_id")), F.lit('], "x": 1}}'))
    return t("events").where(k.isNotNull()).select("event_id", T.canonical_json(text).alias("canonical"))


@query("SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY 1")
def manifest_digests(t):
    own = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return own.select("o_custkey", F.sha2(F.array_join(F.transform("k", text_of), ","), 256).alias("digest"), F.size("k").cast("long").alias("n"))


@query("SELECT doc_id, left(sha256(text), 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS place FROM documents WHERE text IS NOT NULL")
def content_places(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", T.locator(F.col("text").cast("binary")).alias("place"))


@query("""SELECT doc_id, hex(encode(text)) AS hexadecimal, base64(encode(text)) AS base64, sha256(url_encode(text)) AS url, sha256(text) AS zlib, sha256(text) AS several, CASE doc_id % 4 WHEN 0 THEN 'JK' WHEN 1 THEN 'fl' END AS odd FROM documents WHERE text IS NOT NULL""")
def recipe_round_trips(t):
    raw, digest, way = F.col("text").cast("binary"), lambda c: F.sha2(c, 256), F.col("doc_id") % 4
    # a blank in hexadecimal numbers; both alphabets of base64; a padding that lacks; half a byte
    odd = F.when(way == 0, R.hex_decode(F.lit(" 0x4A 4b\n").cast("binary"))).when(way == 1, R.base64_decode(F.lit("Zm w=").cast("binary"))).when(way == 2, R.base64_decode(F.lit("Zmw").cast("binary"))).otherwise(R.hex_decode(F.lit("4a4").cast("binary")))
    # the zlib step runs in Python and has a projection of its own
    docs = t("documents").where("text IS NOT NULL").select("doc_id", "text", R.cook(raw, ["zlib_compress", "zlib_decompress"]).alias("again"))
    return docs.select(
        "doc_id", F.upper(R.cook(raw, ["hex_encode"]).cast("string")).alias("hexadecimal"), R.cook(raw, ["base64_encode", "base64_decode", "base64_encode"]).cast("string").alias("base64"),
        digest(R.cook(raw, ["url_encode", "url_decode", "url_encode"])).alias("url"), digest(F.col("again")).alias("zlib"),
        digest(R.cook(raw, ["rot13", "base64_encode", "hex_encode", "hex_decode", "base64_decode", "rot13"])).alias("several"), odd.cast("string").alias("odd"),
    )


@query("""SELECT doc_id, CASE WHEN strlen(text) > 64 THEN NULL ELSE regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', '.', 'g') END AS input_short, left(lower(hex(encode(text))), 64) || CASE WHEN strlen(text) > 32 THEN '...' ELSE '' END AS output_sample, strlen(text) AS input_len, 2 * strlen(text) AS output_len, '' AS flags FROM documents WHERE text IS NOT NULL""")
def recipe_previews(t):
    own = R.preview(t("documents").where("text IS NOT NULL").select("doc_id", "text"), F.col("text").cast("binary"), [("xor", b"K"), ("xor", b"K"), "hex_encode"])
    return own.select(
        "doc_id", F.when(F.col("input_len") <= 64, F.col("input_sample")).alias("input_short"), "output_sample", F.col("input_len").cast("long").alias("input_len"), F.col("output_len").cast("long").alias("output_len"),
        F.array_join("flags", "|").alias("flags"),
    )


@query("SELECT p_partkey, CASE WHEN p_size >= 100 OR p_size < 10 THEN '' ELSE 'flag{' || p_size || '!}|' END || 'CTF{' || replace(p_brand, '#', '_') || '}|sec{abc}' AS flags FROM part")
def default_flags(t):
    size = F.concat(text_of(F.col("p_size")), F.lit("!"))
    text = F.concat(F.lit("see flag{"), size, F.lit("}, CTF{"), F.translate("p_brand", "#", "_"), F.lit("} and flag{"), size, F.lit("} x{abcd} flag{a b c} Vuln{ab} sec{abc}"))
    return t("part").select("p_partkey", F.array_join(R.flags(text), "|").alias("flags"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' END AS method, CASE WHEN page_id % 2 = 0 THEN '/p' || page_id END AS uri, CASE WHEN page_id % 2 = 1 AND page_id % 3 > 0 THEN '404' END AS status, CASE WHEN page_id % 2 = 0 THEN 'h.test' END AS host, CASE WHEN page_id % 2 = 1 AND page_id % 3 > 0 THEN 'text/html' END AS content_type FROM pages""")
def http_heads(t):
    page = text_of(F.col("page_id"))
    asked = F.concat(F.lit("get /p"), page, F.lit(" HTTP/1.1\r\nHost:  h.test \r\nX: y\r\n\r\nHost: no"))
    given = F.lit("HTTP/1.1 404 Not Found\r\ncontent-type: text/html\r\n\r\n<p>")
    data = F.when(F.col("page_id") % 2 == 0, asked).when(F.col("page_id") % 3 == 0, "no head at all").otherwise(given)
    return t("pages").select("page_id", P.http(data.cast("binary")).alias("h")).select("page_id", "h.method", "h.uri", text_of(F.col("h.status")).alias("status"), "h.host", "h.content_type")


def _hex(n, digits):
    return F.lpad(F.hex(n), digits, "0")


def _label(text):
    return F.concat(_hex(F.length(text), 2), F.hex(text.cast("binary")))


@query("""SELECT c_custkey, 'C' || c_custkey || '.' || lower(c_mktsegment) AS qname, '1' AS qtype, CASE WHEN c_custkey % 3 <> 2 THEN '10.0.0.' || c_nationkey || '|C' || c_custkey || '.' || lower(c_mktsegment) ELSE '' END AS answers,
  CASE WHEN c_custkey % 3 = 2 THEN 'CompressionPointerOutOfBounds' END AS issue, CASE WHEN c_custkey % 3 = 2 THEN 'Degraded' ELSE 'Complete' END AS quality FROM customer""")
def dns_messages(t):
    key = F.col("c_custkey")
    # an address and an alias, whose names point to the question; in every third message the pointer leads out of it
    message = dns_answer(_label(F.concat(F.lit("C"), text_of(key))), _label(F.lower("c_mktsegment")), F.when(key % 3 == 2, "C0FF").otherwise("C00C"), F.col("c_nationkey").cast("long"))
    own = t("customer").select("c_custkey", P.dns(F.unhex(message)).alias("m"))
    return own.select("c_custkey", "m.qname", text_of(F.col("m.qtype")).alias("qtype"), F.array_join(F.transform("m.answers", lambda a: a["value"]), "|").alias("answers"), "m.issue", P.quality(F.col("m.issue")).alias("quality"))


def dns_answer(first, second, pointer, last):
    """A message in hexadecimal numbers that asks for a name of two labels and answers with an address and an alias."""
    answer = F.concat(pointer, F.lit("00010001000000000004"), F.lit("0A0000"), _hex(last, 2), pointer, F.lit("00050001000000000002C00C"))
    return F.concat(F.lit("12348180000100020000"), F.lit("0000"), first, second, F.lit("00"), F.lit("00010001"), answer)


@query("""SELECT c_nationkey, count(*) AS messages, CAST(sum(c_custkey) AS BIGINT) AS keys, max(lower(c_mktsegment)) AS segment FROM customer GROUP BY 1""")
def dns_over_streams(t):
    """Messages of a nation's customers as one stream of frames, cut into segments without regard to them, put together and read again."""
    key = F.col("c_custkey")
    message = F.unhex(dns_answer(_label(F.concat(F.lit("C"), text_of(key))), _label(F.lower("c_mktsegment")), F.lit("C00C"), F.col("c_nationkey").cast("long")))
    frame = F.concat(F.unhex(_hex(F.octet_length(message).cast("long"), 4)), message)
    streams = t("customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.hex(frame).alias("f")))), lambda x: x["f"]), "").alias("all"))
    # a nation's stream grows with its customers, and all of their messages count
    whole = reassembly.streams_of(reassembly.reassembled(segments(streams, "c_nationkey", F.unhex("all")), reassembly.WHOLE, issues=False))
    own = reassembly.dns_messages_of(whole, ["left"])
    own = own.select(F.split_part("left", F.lit(":"), F.lit(1)).cast("int").alias("c_nationkey"), F.regexp_extract("m.qname", r"^C(\d+)\.", 1).cast("long").alias("k"), F.split_part("m.qname", F.lit("."), F.lit(2)).alias("s"))
    return own.groupBy("c_nationkey").agg(F.count("*").alias("messages"), F.sum("k").alias("keys"), F.max("s").alias("segment"))


def segments(rows, key, data, size=97, step=61):
    """Packets of one stream a row from its key: segments of size bytes, step apart, so that they overlap, each as a packet of a capture."""
    own = rows.select(F.col(key).cast("string").alias("src_ip"), data.alias("d")).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("d") - 1, F.lit(0)), F.lit(step))))
    payload = F.substring(F.col("d"), F.col("at") + 1, F.lit(size))
    return own.select(
        F.lit("f").alias("file"), F.col("at").cast("long").alias("packet_index"), F.col("at").cast("long").alias("ts_us"), F.octet_length(payload).cast("long").alias("captured"), F.octet_length(payload).cast("long").alias("original"), "src_ip",
        F.lit("~").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit("TCP").alias("protocol"), F.lit("ACK").alias("tcp_flags"), (F.col("at") + 7).cast("long").alias("tcp_sequence"), payload.alias("payload"),
        F.lit(None).cast("string").alias("issue"),
    )


@query("""SELECT doc_id, sha256(text) AS digest, 'Complete' AS status, strlen(text) AS size, (strlen(text) + 60) // 61 - 1 AS overlaps FROM documents WHERE strlen(text) > 97""")
def stream_bytes(t):
    found = reassembly.reassembled(segments(t("documents").where("octet_length(text) > 97"), "doc_id", F.col("text").cast("binary")), reassembly.WHOLE, issues=False)
    key = F.split_part("left", F.lit(":"), F.lit(1)).cast("long").alias("doc_id")
    overlaps = F.try_element_at("issue_packets", F.lit("OverlapIdentical")).alias("overlaps")
    return reassembly.streams_of(found).select(key, F.sha2("bytes", 256).alias("digest"), "status", F.octet_length("bytes").cast("long").alias("size"), overlaps)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'ClientHello' END AS kind, CASE WHEN c_custkey % 4 > 0 THEN 'H' || c_custkey || '.' || lower(c_mktsegment) END AS sni, CASE WHEN c_custkey % 4 > 0 THEN 'h2|http/1.1' END AS alpn, CASE WHEN c_custkey % 4 > 0 THEN '4867|4865' END AS ciphers,
  CASE WHEN c_custkey % 4 = 0 THEN 'InvalidHandshake' END AS issue, CASE WHEN c_custkey % 4 = 0 THEN 'ParseError' ELSE 'NotPresentInCapture' END AS visibility FROM customer""")
def tls_hellos(t):
    host = F.hex(F.concat(F.lit("H"), text_of(F.col("c_custkey")), F.lit("."), F.lower("c_mktsegment")).cast("binary"))
    size = lambda h, digits: _hex((F.length(h) / 2).cast("long"), digits)
    framed = lambda h, digits: F.concat(size(h, digits), h)
    sni = F.concat(F.lit("0000"), framed(framed(F.concat(F.lit("00"), framed(host, 4)), 4), 4))
    more = framed(F.concat(F.lit("FF010001FF"), sni, F.lit("0010000E000C02683208687474702F312E31")), 4)
    hello = F.concat(F.lit("0303" + "AB" * 32 + "00" + "000413031301" + "0100"), more)
    record = F.concat(F.when(F.col("c_custkey") % 4 == 0, "17").otherwise("16"), F.lit("0301"), framed(F.concat(F.lit("01"), framed(hello, 6)), 4))
    own = t("customer").select("c_custkey", P.tls(F.unhex(record)).alias("m"))
    return own.select("c_custkey", "m.kind", "m.sni", F.array_join("m.alpn", "|").alias("alpn"), F.array_join(F.transform("m.ciphers", text_of), "|").alias("ciphers"), "m.issue", "m.visibility")


@query("""SELECT c_custkey AS session_id, CAST(CASE c_custkey % 6 WHEN 1 THEN 3 WHEN 5 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS BIGINT) AS sequence_no, CASE c_custkey % 6 WHEN 1 THEN 'sequence' WHEN 2 THEN 'digest' WHEN 3 THEN 'previous' WHEN 4 THEN 'genesis' ELSE 'digest' END AS issue FROM customer WHERE c_custkey % 6 > 0""")
def broken_custody(t):
    key, way = F.col("c_custkey"), F.col("c_custkey") % 6
    given = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")

    def event(n, previous, number=None):
        """The fields of a session's n-th event, and what its digest is taken of."""
        fields = {
            "event_id": F.concat_ws("-", text_of(key), F.lit(str(n))), "session_id": text_of(key), "artifact_id": F.when(key % 2 == 0, F.col("c_name")), "case_id": F.col("c_mktsegment"), "action": F.lit("INGEST"),
            "actor_id": F.lit("é"), "timestamp_utc": F.lit(f"2024-01-0{n}T00:00:00+00:00"), "sha256": F.sha2("c_name", 256), "blake3": blake3.digest(F.col("c_name").cast("binary")), "details_hash": text_of(F.col("c_acctbal")),
        }
        return fields, windows.custody_bytes(previous, F.lit(n) if number is None else number, fields)

    # digests of one event after the other, each in a projection of its own
    rows = given.withColumn("h0", F.when(way == 4, "OTHER").otherwise(windows.GENESIS))
    for n in (1, 2, 3):
        rows = rows.withColumn(f"h{n}", blake3.digest(event(n, F.col(f"h{n - 1}"), F.when((way == 1) & F.lit(n == 3), 4).otherwise(n))[1]))
    # of each six sessions five have been tampered with: a number left out, an action, a previous digest, the first link, a digest
    out = None
    for n in (1, 2, 3):
        fields, _ = event(n, F.col(f"h{n - 1}"))
        action = F.when((way == 2) & F.lit(n == 2), "EXPORT").otherwise(fields.pop("action")).alias("action")
        own = rows.select(
            *(c.alias(name) for name, c in fields.items() if name != "session_id"), action, key.alias("session_id"), F.when((way == 1) & F.lit(n == 3), 4).otherwise(n).cast("long").alias("sequence_no"),
            F.when((way == 3) & F.lit(n == 3), F.col("h1")).otherwise(F.col(f"h{n - 1}")).alias("previous_event_hash"), F.when((way == 5) & F.lit(n == 1), "0").otherwise(F.col(f"h{n}")).alias("event_hash"),
        )
        out = own if out is None else out.unionByName(own)
    return windows.broken_custody(out).withColumn("sequence_no", F.when(F.col("issue") == "sequence", F.col("sequence_no") - 1).otherwise(F.col("sequence_no")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'gone' ELSE 'changed' END AS issue FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0")
def append_only_issues(t):
    s = t("supplier")
    now = s.where("s_suppkey % 7 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit("x"))).otherwise(F.col("s_name")))
    return windows.only_appended(s, now.union(s.withColumn("s_suppkey", F.col("s_suppkey") + 10_000_000)), ["s_suppkey"])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS total FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
b AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 3 THEN 'offset' WHEN e + size > least(150, total) THEN 'size' END AS bad FROM c), s AS (SELECT *, max(CAST(bad IS NOT NULL AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS stopped FROM b)
SELECT l_orderkey AS upload_id, CAST(sum(CASE WHEN stopped = 0 THEN size ELSE 0 END) AS BIGINT) AS bytes, CASE WHEN count(bad) > 0 THEN 'refused: ' || arg_min(bad, l_linenumber) FILTER (bad IS NOT NULL) WHEN sum(CASE WHEN stopped = 0 THEN size ELSE 0 END) = max(total) THEN 'complete' ELSE 'open' END AS state FROM s GROUP BY 1""")
def upload_states(t):
    from pyspark.sql.window import Window

    by = Window.partitionBy("l_orderkey")
    size = F.col("l_quantity").cast("long")
    ends = F.coalesce(F.sum(size).over(by.orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    start = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 3), ends + 1).otherwise(ends)
    total = F.sum(size).over(by) + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    return windows.uploads(lines.select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("arrival"), size.alias("size"), start.alias("start"), total.alias("total")), 150)


@query("SELECT s_suppkey, s_suppkey % 5 NOT IN (0, 4) AS outside FROM supplier")
def external_addresses(t):
    n = text_of(F.col("s_suppkey") % 250)
    texts = (F.concat(F.lit("127.0.0."), n), F.concat(F.lit("9.9.9."), n), F.concat(F.lit("::ffff:9.9.9."), n), F.concat(F.lit("2001:db8::"), n), F.concat(F.lit("host"), n))
    return t("supplier").select("s_suppkey", X.is_external(F.element_at(F.array(*texts), (F.col("s_suppkey") % 5).cast("int") + 1)).alias("outside"))


@query("SELECT s_suppkey, '/opt/s' || s_suppkey || '|tail' AS programs FROM supplier")
def executed_programs(t):
    line = F.concat(F.lit("LANG=C nohup /opt/s"), text_of(F.col("s_suppkey")), F.lit(" -q; sudo sh -c 'tail -f x'"))
    return t("supplier").select("s_suppkey", F.array_join(X.executed(line), "|").alias("programs"))


@query("SELECT s_suppkey, 'm' || s_suppkey AS md5, 'b=c' AS sha256 FROM supplier")
def hash_lists(t):
    got = B.hash_list(F.concat(F.lit("MD5=a,SHA256=b=c,x, MD5=m"), text_of(F.col("s_suppkey"))))
    return t("supplier").select("s_suppkey", got["MD5"].alias("md5"), got["SHA256"].alias("sha256"))


@query("SELECT p_partkey, lower(p_brand) AS nuget, regexp_replace(lower(p_brand), '[-_.]+', '-', 'g') AS pypi, p_brand AS npm FROM part")
def package_names_by_ecosystem(t):
    return t("part").select("p_partkey", *(S.package_name(F.col("p_brand"), e).alias(a) for e, a in (("NuGet", "nuget"), ("PyPI", "pypi"), ("npm", "npm"))))


@query("""WITH p AS (SELECT c_nationkey AS host, c_custkey AS pid, c_custkey // 2 AS ppid, lower(c_mktsegment) AS name FROM customer)
SELECT p.host, p.pid AS id, 'process' AS event, p.name, coalesce(q.name, '') AS more, lower(n_name) AS platform FROM p JOIN nation ON n_nationkey = p.host LEFT JOIN p q ON q.host = p.host AND q.pid = p.ppid
UNION ALL SELECT s_nationkey, s_suppkey, 'scheduled_task', s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'run' || CASE WHEN s_suppkey % 2 = 0 THEN ' -x' ELSE '' END END, lower(n_name) FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def host_observations(t):
    hosts = t("nation").select(F.col("n_nationkey").alias("host"), F.lit("10.0.0.1").alias("host_ip"), F.lower("n_name").alias("platform"))
    processes = t("customer").select(F.col("c_nationkey").alias("host"), F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 2).alias("ppid"), F.lower("c_mktsegment").alias("name"))
    key = F.col("s_suppkey")
    tasks = t("supplier").select(F.col("s_nationkey").alias("host"), F.col("s_name").alias("task_name"), F.when(key % 3 > 0, "run").alias("action"), F.when(key % 2 == 0, "-x").otherwise(" ").alias("arguments"), key.alias("state"))
    data = lambda name: F.get_json_object("data", f"$.{name}")
    process = F.col("raw_event_type") == "process"
    own = observations.of_hosts(hosts, processes=processes, tasks=tasks)
    return own.select(
        "host", F.when(process, data("pid")).otherwise(data("state")).cast("long").alias("id"), F.col("raw_event_type").alias("event"), F.coalesce(data("process_name"), data("task_name")).alias("name"),
        F.when(process, data("parent_name")).otherwise(data("action")).alias("more"), data("platform").alias("platform"),
    )


@query("""WITH p AS (SELECT page_id, '/' || split_part(url, '/', 4) AS uri, split_part(url, '/', 3) AS host, len(html) AS n, strlen(html) + strlen(split_part(url, '/', 3)) + strlen('/' || split_part(url, '/', 4)) + 25 AS size FROM pages)
SELECT page_id, uri, host, (size + 60) // 61 AS packets, 'Partial' AS flow_quality, 'Complete' AS protocol_quality FROM p""")
def capture_observations(t):
    """Requests whose bodies are pages, cut into segments of a capture: their sockets, and the head that the flow's bytes begin with."""
    host, uri = F.split_part("url", F.lit("/"), F.lit(3)), F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4)))
    message = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"), F.col("html"))
    packets = segments(t("pages"), "page_id", message.cast("binary")).withColumn("dst_port", F.lit(8080)).withColumn("packet_locator", F.lit("x"))
    found = observations.of_capture(packets)
    data = lambda name: F.get_json_object("data", f"$.{name}")
    sent = found.where("raw_event_type = 'network_socket'").groupBy(data("source_ip").cast("long").alias("page_id")).agg(F.count("*").alias("packets"))
    flows = found.where("raw_event_type = 'network_flow'").select(F.split_part(data("flow.left"), F.lit(":"), F.lit(1)).cast("long").alias("page_id"))
    heads = found.where("raw_event_type = 'http_message'").select(data("uri").alias("uri"), data("host").alias("host"), "flow_quality", "protocol_quality").distinct()
    pages = t("pages").select("page_id", uri.alias("uri"), host.alias("host"))
    return pages.join(sent, "page_id").join(flows, "page_id", "left_semi").join(heads, ["uri", "host"])
