"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns, and against plain versions."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers
from tracewright.llm import additive, bpe, media, packing, pii, quality, secrets, shingle_join, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, g long, label int, words string, row long"
LONG = " ".join(f"word{i}" for i in range(40_000))
TEXTS = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "x y z"), (None, None), (4, LONG), (5, LONG + " more"), (6, "A  b\tC\nd e"), (7, "mail x@y.org, password = hunter2222 é 🙂")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", 1, 2, 3, "w", 4) for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


NONE = hashlib.sha256(b"").hexdigest()
WORDS3 = {1: 3, 4: 39_998, 5: 39_999, 6: 3}


def by_row(df, *columns):
    """Rows of df without doc_id, by doc_id and in the order of their text."""
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.select("doc_id", *columns).collect()), key=str)


def want(f):
    return sorted(((i, *f(i, t or "")) for i, t in TEXTS), key=str)


def test_secrets_on_odd_rows(spark):
    out = secrets.scan(docs(spark), secrets.new_path(spark, "ledger"))
    span = "assign:14:35"
    assert by_row(out, "n_assign", "spans", "base_sha256") == want(lambda i, t: (1, span, hashlib.sha256(span.encode()).hexdigest()) if i == 7 else (None, None, None))
    assert secrets.scan(docs(spark, []), secrets.new_path(spark, "ledger")).count() == 0


def test_pii_on_odd_rows(spark):
    assert by_row(pii.find(docs(spark)), "n_email", "n_phone", "spans") == want(lambda i, t: (1, 0, "email:5:12") if i == 7 else (0, 0, ""))
    assert pii.find(docs(spark, [])).count() == pii.mask(docs(spark, [])).count() == 0


def test_media_on_odd_rows(spark):
    def plain(i, t):
        raw = t.encode()
        kept = raw + bytes(-len(raw) % 64 if raw else 64)
        return len(raw), len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-64:])

    out = media.features(media.store(docs(spark)))
    assert by_row(out, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want(plain)
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store(docs(spark)).collect()}
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["media_sha256"] == hashlib.sha256(m).hexdigest() and got[i]["media_bytes"] == len(m) for i, m in stored.items() if i not in (1, None))
    assert media.features(media.store(docs(spark, []))).count() == 0


def test_bpe_on_odd_rows(spark):
    own = bpe.codec(bpe.MULTI)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})

    def plain(i, t):
        ids = np.array(other.encode_ordinary(t), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    assert by_row(bpe.digests(docs(spark)), "n_tokens", "ids_sha256", "decoded_sha256") == want(plain)
    coded = bpe.encode(docs(spark), offsets=True)
    assert by_row(coded, "ids") == want(lambda i, t: (other.encode_ordinary(t),))
    assert by_row(coded, "starts") == want(lambda i, t: (other.decode_with_offsets(other.encode_ordinary(t))[1],))
    assert sorted(((r["doc_id"], bytes(r["raw"]).decode()) for r in bpe.decode(coded).collect()), key=str) == want(lambda i, t: (t,))
    assert bpe.digests(docs(spark, [])).count() == bpe.encode(docs(spark, [])).count() == bpe.decode(coded.limit(0)).count() == 0


def test_join_on_odd_rows(spark):
    def plain(i, t):
        n = len(t.split())
        # the long ones differ in one shingle of 39,999; 6 has the words of 1
        return (0 if not n else max(1, n - 2) if n < 1000 else n - 2), {5: 4, 6: 1}.get(i, i)

    assert by_row(shingle_join.linked_components(docs(spark), 3, 90, 100), "n_shingles", "component_id") == want(plain)
    assert shingle_join.linked_components(docs(spark, []), 3, 90, 100).count() == 0


def test_models_on_odd_rows(spark):
    fit = lambda rows: quality.fit(docs(spark), labels(spark, rows))
    assert by_row(quality.score(docs(spark), fit([])), "score", "predicted") == want(lambda i, t: (1.0, 1))
    model = fit([(1, 1, 0), (3, 0, 1), (4, 1, 0), (4, None, 0), (None, 1, 1)])
    scores = by_row(quality.score(docs(spark), model), "held_out", "score", "predicted")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert scores == want(lambda i, t: (held(i), s := float(model.score(quality.features([t]))[0]), int(s >= 0.3)))
    assert by_row(toxicity.score(docs(spark), toxicity.fit(docs(spark), labels(spark, []))), "grade", "toxic") == want(lambda i, t: (0, 0))
    one = toxicity.fit(docs(spark), labels(spark, [(1, 1, 0), (3, 0, 1), (None, 1, 1)]))
    assert by_row(toxicity.score(docs(spark), one), "held_out", "toxic") == want(lambda i, t: (held(i), 0))
    assert quality.score(docs(spark, []), model).count() == toxicity.score(docs(spark, []), one).count() == 0


def test_quality_against_plain_pairs():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, len(quality.NAMES)))
    x[:, 3] += 2.5 * y
    model = quality.Ranking(x, y)
    right = (model.score(x) >= quality.CUT) == (y == 1)
    assert right.mean() > 0.85 and np.abs(model.weights).argmax() == 3
    # the order of all pairs, one by one
    s = model.score(x)
    wins = np.mean([(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    assert wins > 0.93
    # the gradient of the logistic loss of the pairs is 0 at the weights
    z = model.standard(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(quality.PAIRS, len(bad))
    d = z[np.random.default_rng(7).permutation(np.resize(good, n))] - z[np.resize(bad, n)]
    slope = np.array([sum(v / (1 + np.exp(r @ model.weights)) for v, r in zip(d[:2000, k], d[:2000], strict=True)) / 2000 for k in (0, 3)])
    whole = d.T @ (1 / (1 + np.exp(d @ model.weights))) / n - quality.RIDGE * model.weights
    assert np.abs(whole).max() < 1e-5 and np.isfinite(slope).all()


def test_grades_of_labels_are_learned(spark):
    rng = np.random.default_rng(8)
    plain, marked = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)], {1: "mild", 2: "harsh", 3: "vile"}
    rows, graded = [], []
    for i in range(1500):
        grade = int(rng.integers(0, 4)) if i % 3 == 0 else 0
        words = [plain[k] for k in rng.integers(0, len(plain), 40)] + [marked.get(grade, "")] * (grade > 0)
        rows.append((i, " ".join(rng.permutation(words))))
        graded.append((i, 0, grade))
    model = toxicity.fit(docs(spark, rows), labels(spark, graded))
    out = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), model).collect()}
    held = [r for r in out.values() if r["held_out"]]
    truth = {i: g for i, _, g in graded}
    assert np.mean([r["grade"] == truth[r["doc_id"]] for r in held]) > 0.95
    means = [np.mean([r["expected_severity"] for r in held if truth[r["doc_id"]] == g]) for g in range(4)]
    assert means == sorted(means) and all((r["toxic"] == 1) == (truth[r["doc_id"]] > 0) for r in held)
    # thresholds are ordered, and one vector of weights serves them all
    assert (np.diff(model.thresholds) >= 0).all()


def test_each_severity_is_the_sum_over_the_thresholds():
    model = toxicity.Severity(["bad", "wors*"])
    model.weights, model.thresholds = {"bad": 2.0, "wors*": 3.0}, np.array([1.0, 2.5, 6.0])
    for text, total in (("a bad thing", 2.0), ("Bad, BAD worst", 5.0), ("nothing", 0.0), ("", 0.0)):
        assert np.allclose(model.above([text])[0], [1 / (1 + np.exp(t - total)) for t in model.thresholds])


def test_packing_odd_rows(spark):
    out = packing.pack_documents(docs(spark)).toPandas()
    whole = Tokenizer.from_file(packing.WORDS)
    want = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert out.length.sum() == want and (out[out.doc_id.isin([2, 3])].length == 1).all()
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 2048 and (own.offset.to_numpy() == np.concatenate(([0], own.length.cumsum()[:-1]))).all()
    assert packing.pack_documents(docs(spark, [])).count() == 0
    # each piece against the ids that tokenizers gives
    for (i, t), rows in [((i, t), out[out.doc_id == i].sort_values("piece")) for i, t in TEXTS if i in (3, 4, 5, 6, 7)]:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert rows.piece.tolist() == list(range(-(-len(ids) // 2048))) and rows.start.tolist() == list(range(0, len(ids), 2048))
        assert rows.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]


def test_packing_exchanges_until_the_bound_of_all(spark):
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 2049, 1200)
    found = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    least = packing.lower_bound(lengths, 2048)
    for in_task, more in ((100, 6), (50_000, 4)):
        out = packing.pack(found, in_task=in_task).toPandas()
        assert sorted(out.doc_id) == list(range(1200)) and (out.sort_values("doc_id").length.to_numpy() == lengths).all()
        for _, own in out.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert own.length.sum() <= 2048 and (own.offset.to_numpy() == np.concatenate(([0], own.length.cumsum()[:-1]))).all()
        assert least <= out.sequence_id.nunique() <= least + more, (in_task, least, out.sequence_id.nunique())


def test_bounds_against_the_best_packing():
    def fewest(lengths, room):
        best = len(lengths)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(lengths):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[k] <= room:
                    place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
            place(k + 1, [*bins, lengths[k]])

        place(0, [])
        return best

    rng = np.random.default_rng(10)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, 8))[::-1]
        least, exact, own = packing.lower_bound(lengths, 20), fewest(lengths.tolist(), 20), packing.best_fit(lengths, 20)[0].max() + 1
        assert least <= exact <= own


def test_ledger_scans_unseen_blobs_only(spark, monkeypatch):
    ledger = secrets.new_path(spark, "ledger")
    secrets.scan(docs(spark), ledger).count()
    first = spark.read.parquet(ledger).count()
    again = secrets.scan(docs(spark, [*TEXTS, (9, "token: abcdef123")]), ledger)
    assert spark.read.parquet(ledger).count() == first + 1 and again.where("n_assign = 1").count() == 2
    # what two scans at a time have both added counts once, and what a later version of the rules sees is scanned again
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-copy")
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-copy")
    assert secrets.scan(docs(spark), ledger + "-copy").count() == len(TEXTS)
    assert spark.read.parquet(ledger + "-copy").count() == 2 * (first + 1)
    monkeypatch.setattr(secrets, "RULES", "next")
    assert secrets.scan(docs(spark), ledger).count() == len(TEXTS) and spark.read.parquet(ledger).count() == 2 * first + 1


def test_lasting_ledger(spark, tmp_path):
    spark.conf.set(secrets.LASTING, str(tmp_path / "ledger"))
    try:
        runs = [sorted(map(str, secrets.op1_secret_ledger(spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
        n = spark.read.parquet(str(tmp_path / "ledger")).count()
        assert runs[0] == runs[1] and n == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("coalesce(text, '')").distinct().count()
    finally:
        spark.conf.unset(secrets.LASTING)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_anchors_find_what_patterns_find():
    rng = np.random.default_rng(1)
    pieces = ["@", ".", "+", "-", " ", "a", "b.c", "1", "12", "255", "256", "4111111111111111", "1.2.3.4", "+1 (555) 123-4567", "x@y.de", "(", ")", "ssn: 123-45-6789", "é"]
    for _ in range(20_000):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(1, 14)))
        assert [x for x in pii.pii_spans(text) if x[0] in pii.BASE] == plain_pii(text), text


def test_jpeg_round_trip():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7, 130, 8128, 8200)] + [b"\0" * 64, b"\xff" * 640]
    for got, want in zip(media.read(media.write(payloads)), payloads, strict=True):
        assert got[2].tobytes() == want


def test_pictures_with_chroma_and_ac_coefficients():
    """A picture of two by two luminance blocks a unit, two chroma blocks and AC coefficients in all, coded bit by bit."""
    rng = np.random.default_rng(11)
    dc_table, ac_table = ((0, 0, 0, 12) + (0,) * 12, tuple(range(12))), ((0, 0, 0, 4, 0, 0, 0, 8) + (0,) * 8, (0x00, 0x01, 0x12, 0xF0, 0x02, 0x03, 0x11, 0x21, 0x31, 0x41, 0x22, 0x13))
    spelled = [{s: (c, n) for s, c, n in media.codes(*t)} for t in (dc_table, ac_table)]
    across, down, bits, want, last = 3, 2, "", np.zeros((4, 6), int), [0, 0, 0]

    def put(table, symbol):
        code, n = spelled[table][symbol]
        return f"{code:0{n}b}"

    def value(x, size):
        return f"{x if x >= 0 else x + (1 << size) - 1:0{size}b}" if size else ""

    for unit in range(across * down):
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for block in range(blocks):
                dc = int(rng.integers(-60, 60))
                if c == 0:
                    want[unit // across * 2 + block // 2, unit % across * 2 + block % 2] = dc
                diff, last[c] = dc - last[c], dc
                size = abs(diff).bit_length()
                bits += put(0, size) + value(diff, size)
                k = 1
                while k < 64 and rng.random() < 0.7:
                    symbol = int(rng.choice([0x01, 0x12, 0xF0, 0x03, 0x11, 0x22]))
                    if k + (symbol >> 4) > 62:
                        break
                    k += (symbol >> 4) + 1
                    size = symbol & 15
                    bits += put(1, symbol) + (value(int(rng.integers(1 << size - 1, 1 << size)), size) if size else "")
                if k < 64:
                    bits += put(1, 0)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    table = lambda kind, t: media._segment(0xC4, bytes([kind]) + bytes(t[0]) + bytes(t[1]))
    frame = bytes([8, 0, 30, 0, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, b"\0" + bytes([4] * 64)) + media._segment(0xC0, frame) + table(0, dc_table) + table(16, ac_table) + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (width, height, thumb), (_, _, again) = media.read([data, data])
    assert (width, height) == (45, 30) and (thumb == np.clip(np.rint(want * 4 / 8 + 128), 0, 255)[:4, :6]).all() and (again == thumb).all()


def test_long_payloads_take_memory_by_parts():
    raw = bytes(range(256)) * 4096 * 4
    tracemalloc.start()
    (stream,) = media.write([raw])
    width, height, thumb = media.read([stream])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert thumb.tobytes() == raw and most < 250 << 20, most


def test_byte_bpe_equals_tiktoken():
    own = bpe.codec(bpe.MULTI)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ["", "a  b", " \n lead", "nb\xa0sp  q", "日本 語　b", "don't I'LL", "<|endoftext|> x", "🙂🙂 é", "a\r\n\r\nb", "!\n\n!? ...\n x", LONG]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text) and own.decode(ids) == text.encode()
    assert own.offsets(own.encode("é🙂 b")).tolist()[0] == 0


def test_packing_meets_its_bound():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 2048, 300)
        bins, places = packing.best_fit(lengths, 2048)
        assert np.bincount(bins, lengths).max() <= 2048
        assert packing.lower_bound(lengths, 2048) <= bins.max() + 1
    assert packing.lower_bound(np.full(10, 1025), 2048) == 10
    assert packing.lower_bound(np.full(10, 700), 2048) == 5


def test_join_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        own = [words[i] for i in rng.integers(0, 300, 80 + 10 * base)]
        for copy in range(12):
            text = list(own)
            for i in rng.integers(0, len(text), copy % 4):
                text[i] = words[rng.integers(0, 300)]
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.linked_components(docs(spark, rows), 3, 90, 100).collect()}
    assert got == dict(enumerate(root))


def test_join_where_all_entries_are_crowded(spark, monkeypatch):
    """With blocks and crowds of two, few centres and one round of stars, the pairs that stars leave are all made in blocks."""
    monkeypatch.setattr(shingle_join, "CROWDED", 2)
    monkeypatch.setattr(shingle_join, "BLOCK", 3)
    monkeypatch.setattr(shingle_join, "CENTRES", (1,))
    test_join_against_all_pairs(spark)


def test_repeated_numbers_in_a_search(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = [tuple(r) for r in additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("query_id", "rank").collect()]
    # the smaller vector of number 0 asks; the other one is a candidate
    near = 0.9 / np.sqrt(0.82)
    assert [g[:3] for g in got] == [(0, 1, 0), (0, 2, 1), (0, 3, 3)] and np.allclose([g[3] for g in got], near)


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2101, [1.0]), (None, x[0].tolist())]
    out = additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 2000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(got[q]))
    assert set(got) == set(range(0, 2000, 50)) and hits >= 0.9 * 200
    assert additive.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_with_any_magnitude_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    size = np.array([1e-200, 1e200, 5e-324 * 2**40, 1.0] * 15)[:, None]
    rows = [(i, v.tolist(), 7, "v", 3, 1.5) for i, v in enumerate(x * size)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long, v string, block int, score double")
    got = {}
    for r in additive.search(given, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = np.array([r[1] for r in rows])
    y = y / np.abs(y).max(1, keepdims=True)
    u = y / np.sqrt((y**2).sum(1, keepdims=True))
    assert set(got) == {0, 50}
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.argsort(-s)[:5]
        found = sorted(found)
        assert [v for _, v, _ in found] == best.tolist() and np.allclose([z for _, _, z in found], s[best], atol=1e-9)


def test_paths_of_a_hot_blob_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HOT", 3)
    rows = [(i, "password = hunter2222" if i % 2 else f"clean {i}") for i in range(40)] + [(None, "password = hunter2222")] * 5
    out = secrets.scan(docs(spark, rows), secrets.new_path(spark, "ledger"))
    assert by_row(out, "n_assign") == sorted(((i, 1 if "password" in t else None) for i, t in rows), key=str)


def test_models_on_held_out_labels(spark):
    d, la = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    s = quality.score(d, quality.fit(d, la)).join(la, "doc_id").where("held_out").toPandas()
    assert (s.predicted == s.quality).mean() >= 0.95
    s = toxicity.score(d, toxicity.fit(d, la)).withColumnRenamed("toxic", "found").join(la, "doc_id").where("held_out").toPandas()
    assert (s.found == s.toxic).mean() >= 0.95
