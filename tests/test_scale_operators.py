"""Joins, aggregates and stores against plain versions: heads and tails, scopes, needles, components that follow changes, bundled libraries, contents by digest."""

import hashlib
import ipaddress
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import blake3
from tracewright.operators import buffers, graph, needles, scopes, windows
from tracewright.sources import content_store, logs, projects, scripts


def plain_buffer(data, head, tail):
    behind = data[head:]
    kept = behind[max(0, len(behind) - tail) :]
    return data[:head], kept, len(behind) - len(kept), len(data)


@pytest.mark.parametrize(("head", "tail"), [(10, 10), (5, 5), (0, 3), (7, 0), (100, 100)])
def test_heads_and_tails_of_chunks(spark, head, tail):
    rng = random.Random(head)
    jobs = {f"job{k}": [bytes(rng.randrange(256) for _ in range(rng.randrange(9))) for _ in range(rng.choice((1, 3, 60)))] for k in range(12)}
    rows = [(job, k, c or None) for job, chunks in jobs.items() for k, c in enumerate(chunks)]
    rng.shuffle(rows)
    want = {job: plain_buffer(b"".join(chunks), head, tail) for job, chunks in jobs.items()}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = buffers.bounded(spark.createDataFrame(rows, "job string, n int, chunk binary").repartition(3), "job", "n", "chunk", head, tail).collect()
        assert {r["job"]: (bytes(r["head"]), bytes(r["tail"]), r["dropped_bytes"], r["total_bytes"]) for r in got} == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for chunks in jobs.values():
        # any grouping of neighbours
        parts = [buffers.stretch(c, head, tail) for c in chunks]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], head, tail)]
        assert parts[0].row(head, tail) == plain_buffer(b"".join(chunks), head, tail)


def test_heads_and_tails_of_a_stream(spark, tmp_path):
    chunks = [b"hello_", b"world", b"", b"of_chunks", b"!"]
    for k, group in enumerate((chunks[:1], chunks[1:4], chunks[4:])):
        spark.createDataFrame([("a", 10 * k + j, c) for j, c in enumerate(group)] + [("b", 10 * k, b"x")], "job string, n int, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("job string, n int, chunk binary, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    query = buffers.followed(stream, "job", "n", "chunk", 5, 5).writeStream.format("memory").queryName("tails").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r["job"]: r for r in spark.table("tails").orderBy("total_bytes").collect()}
    assert (bytes(last["a"]["head"]), bytes(last["a"]["tail"]), last["a"]["dropped_bytes"], last["a"]["total_bytes"]) == plain_buffer(b"".join(chunks), 5, 5)
    assert (bytes(last["b"]["head"]), last["b"]["total_bytes"]) == (b"xxx", 3)


def test_scopes_equal_all_blocks(spark):
    rng = random.Random(2)
    v4 = lambda: f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}"
    v6 = lambda: f"2001:db8:{rng.randrange(4):x}::{rng.randrange(1 << 16):x}"
    blocks = [(k, f"{v4()}/{rng.choice((8, 12, 16, 20, 24, 28, 30, 32))}" if k % 2 else f"{v6()}/{rng.choice((32, 48, 64, 112, 120, 128))}") for k in range(10_000)]
    blocks += [(20_000, "host.test"), (20_001, "10.9.9.9"), (20_002, "bad/24"), (20_003, None), (20_004, "10.0.0.0/33"), (20_005, "10.200.0.0/0x8"), (20_006, "::1")]
    targets = [v4() for _ in range(60)] + [v6() for _ in range(60)] + ["host.test", "other.test", "10.9.9.9", "bad/24", None, "172.16.0.1", "::1", "::ffff:10.0.0.1"]
    nets = {}
    for k, b in blocks:
        try:
            nets[k] = ipaddress.ip_network(b, strict=False)
        except ValueError:
            pass

    def best(t):
        try:
            own = ipaddress.ip_address(t)
        except ValueError:
            return sorted(k for k, b in blocks if b == t and "/" not in b) if t else []
        there = [(n.prefixlen, k) for k, n in nets.items() if n.version == own.version and own in n]
        return sorted(k for size, k in there if size == max(there)[0])

    given, table = spark.createDataFrame([(t,) for t in targets], "t string"), spark.createDataFrame(blocks, "k int, b string")
    got = {}
    for r in scopes.matches(given.distinct(), "t", table, "b").collect():
        got.setdefault(r["t"], []).append(r["k"])
    want = {t: best(t) for t in set(targets)}
    assert {t: sorted(k) for t, k in got.items()} == {t: k for t, k in want.items() if k}
    inside = {r["t"]: r["in_scope"] for r in scopes.in_scope(given, "t", table, "b").collect()}
    assert inside == {t: bool(k) for t, k in want.items()}
    plan = scopes.matches(given, "t", table, "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    local = {r["t"]: r["in_scope"] for r in scopes.in_scope(spark.createDataFrame([("127.0.0.9",), ("localhost",), ("::1",), ("10.0.0.1",)], "t string"), "t", table.limit(0), "b").collect()}
    assert local == {"127.0.0.9": True, "localhost": True, "::1": True, "10.0.0.1": False}


def test_needles_equal_all_pairs(spark):
    rng = random.Random(7)
    word = lambda n, letters="abcde É": "".join(rng.choice(letters) for _ in range(n))
    texts = [(k, word(rng.choice((0, 3, 20, 200)))) for k in range(150)] + [(900, None), (901, "The needle in it")]
    hay = [t for _, t in texts if t and len(t) > 30]
    asked = [(k, word(rng.choice((1, 2, 3, 4, 5, 7)))) for k in range(60)]
    asked += [(100 + k, t[5 : 5 + rng.randrange(1, 20)].swapcase()) for k, t in enumerate(rng.choices(hay, k=60))] + [(500, ""), (501, None), (502, "NEEDLE"), (503, "nowhere at all")]
    given = spark.createDataFrame(asked, "n int, needle string"), spark.createDataFrame(texts, "t int, text string")
    for case in (False, True):
        got = sorted((r["n"], r["t"]) for r in needles.found(given[0], "n", "needle", given[1], "t", "text", case).collect())
        low = (lambda x: x) if case else str.lower
        assert got == sorted((n, t) for n, a in asked for t, b in texts if a and b and low(a) in low(b)) and got
    plan = needles.found(given[0], "n", "needle", given[1], "t", "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def labels_of(edges, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components_follow_changes(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(40)}
    frame = lambda rows, names="src int, dst int": spark.createDataFrame(sorted(rows), names)
    ids = {i for e in edges for i in e}
    labels = graph.components(frame(edges)).select("id", "component")
    for _ in range(3):
        added = {(rng.randrange(70), rng.randrange(70)) for _ in range(6)}
        labels = graph.kept(graph.with_edges(labels, frame(added)))
        edges |= added
        ids |= {i for e in added for i in e}
        assert {r["id"]: r["component"] for r in labels.collect()} == labels_of(edges, ids)
        removed = set(rng.sample(sorted(edges), 8))
        labels = graph.kept(graph.without_edges(labels, frame(edges), frame({(b, a) for a, b in removed})))
        edges = {(a, b) for a, b in edges if (a, b) not in removed and (b, a) not in removed}
        assert {r["id"]: r["component"] for r in labels.collect()} == labels_of(edges, ids)


SCRIPTS = {
    "static/js/jquery.min.js": "/*! jQuery v3.4.1 | (c) JS Foundation and other contributors | jquery.org/license */\n!function(e,t){}", "static/js/bootstrap-4.1.3.js": "/* no banner */",
    "static/js/lodash.min.js": '/**\n * @license\n * Lodash lodash.com/license | Underscore.js 1.8.3 underscorejs.org/LICENSE\n */\n;(function(){var u,i="4.17.15",o=200,f="Unsupported core-js use.";})', "static/js/app.js": "// requires jQuery v1.7 or later\nconsole.log(1)",
    "a\\tinymce.min.js": "// 5.10.2 (2021-11-17)\n!function(){}", "other.js": "// 5.10.2 (2021-11-17)\n * TinyMCE version 4.9.11", "x/vue.js": "/*\n * Vue.js v2.6.14\n */ /** @license React v17.0.2\n * react-dom.production.min.js */", "y/jquery-3.1.0.slim.min.js": "",
    "m.js": "//! moment.js\n//! version : 2.29.1\n * DataTables 1.10.2\n * marked v4.0.0 - a markdown parser\n// Backbone.js 1.4.0", "purify.js": "/*! @license DOMPurify 2.3.4 | (c) */ x.version='2.3.3', y.removed = []",
}
PAGE = '<script src="https://code.jquery.com/jquery-1.12.4.min.js"></script>\n<link href="https://stackpath.bootstrapcdn.com/bootstrap/4.1.3/css/bootstrap.min.css">\n<script src="https://cdnjs.cloudflare.com/ajax/libs/lodash.js/4.17.11/lodash.min.js"></script>\n<script src="https://cdn.jsdelivr.net/npm/vue@2.5.16/dist/vue.js"></script>\n<script src="https://unpkg.com/@popperjs/core@2.11.8/dist/umd/popper.min.js"></script>\n<script src="https://cdn.jsdelivr.net/npm/bootstrap@5/dist/js/bootstrap.js"></script>\n<script src="//ajax.googleapis.com/ajax/libs/angularjs/1.6.9/angular.min.js"></script>\n<i>https://code.jquery.com/ui/1.12.1/jquery-ui.js https://ajax.aspnetcdn.com/ajax/jquery/jquery-2.0.0.js</i>'


def one_by_one(path, text):
    """Every pattern by itself, without the automaton."""
    import re

    found, out = set(), []
    for name, _, own, only_in in scripts.LIBRARIES:
        if name in found or (only_in and not any(x in re.split(r"[/\\]", path)[-1].lower() for x in only_in)):
            continue
        for _, pattern in own:
            if m := re.search(pattern.replace("{V}", scripts.V), text):
                found.add(name)
                out.append((name, m[1], text[: m.start(1)].count("\n") + 1))
                break
    return out


def test_bundled_libraries(spark):
    got = {(r["name"], r["version"], r["file"], r["line"]) for r in scripts.libraries(spark.createDataFrame(list(SCRIPTS.items()), "path string, text string")).collect()}
    assert {("jquery", "3.4.1", "static/js/jquery.min.js", 1), ("bootstrap", "4.1.3", "static/js/bootstrap-4.1.3.js", 1), ("lodash", "4.17.15", "static/js/lodash.min.js", 5), ("tinymce", "5.10.2", "a\\tinymce.min.js", 1), ("tinymce", "4.9.11", "other.js", 2), ("jquery", "3.1.0", "y/jquery-3.1.0.slim.min.js", 1)} <= got
    assert not any(f == "static/js/app.js" for _, _, f, _ in got)
    for path, text in [*SCRIPTS.items(), *((p, "\n".join(random.Random(k).sample(list(SCRIPTS.values()), 4))) for k, p in enumerate(SCRIPTS))]:
        by_name = [(x["name"], x["version"], x["line"]) for x in scripts.bundled(path, text)]
        assert by_name[: len(one_by_one(path, text))] == one_by_one(path, text) and len(by_name) <= len(one_by_one(path, text)) + 1


def test_links_to_libraries(spark):
    rows = scripts.libraries(spark.createDataFrame([("a.html", PAGE), ("b.html", None), ("c.html", PAGE * 2)], "path string, text string"))
    got = [(r["name"], r["version"], r["line"]) for r in rows.where("file = 'a.html'").collect()]
    assert got == [("jquery", "1.12.4", 1), ("bootstrap", "4.1.3", 2), ("lodash", "4.17.11", 3), ("vue", "2.5.16", 4), ("@popperjs/core", "2.11.8", 5), ("angular", "1.6.9", 7), ("jquery-ui", "1.12.1", 8), ("jquery", "2.0.0", 8)]
    assert rows.where("file = 'c.html'").count() == 16 and rows.where("file = 'b.html'").count() == 0


def test_contents_by_digest(spark, tmp_path):
    root = str(tmp_path / "store")
    data = {"a": b"", "b": b"text", "c": bytes(range(256)) * 9000, "d": b"text", "e": None}
    kept = content_store.store_rows(spark.createDataFrame(list(data.items()), "n string, d binary"), "n", "d", root).collect()
    assert {r["name"]: (r["blake3"], r["sha256"], r["size"]) for r in kept} == {n: (blake3.digests([d])[0], hashlib.sha256(d).hexdigest(), len(d)) for n, d in data.items() if d is not None}
    assert all(r["path"] == f"{root}/{r['blake3'][:2]}/{r['blake3'][2:4]}/{r['blake3']}" and open(r["path"], "rb").read() == data[r["name"]] for r in kept)
    assert sum(r["new"] for r in kept) in (3, 4) and not content_store.store_rows(spark.createDataFrame([("z", b"text")], "n string, d binary"), "n", "d", root).first()["new"] and os.listdir(f"{root}/tmp") == []
    for piece in (1024, 1 << 16, content_store.PIECE):
        assert {r["size"]: r["whole"] for r in content_store.verified(spark, root, piece).collect()} == {0: True, 4: True, 2304000: True}
    large = next(r["path"] for r in kept if r["name"] == "c")
    os.chmod(large, 0o644)
    with open(large, "r+b") as f:
        f.seek(1_500_000)
        f.write(b"!")
    assert {r["size"]: r["whole"] for r in content_store.verified(spark, root, 1 << 16).collect()} == {0: True, 4: True, 2304000: False}
    digest = blake3.digests([b"text"])[0]
    assert content_store.read_slice(root, digest, 1, 100) == b"ext"
    for bad in ((digest, 0, 1 << 20), (digest, -1, 2)):
        with pytest.raises(ValueError):
            content_store.read_slice(root, *bad)
    with pytest.raises(FileNotFoundError):
        content_store.read_slice(root, "0" * 64, 0, 1)


def test_files_are_stored_in_one_pass_of_pieces(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for size in (0, 1, 40_000, 3 * content_store.PIECE + 5):
        (folder / f"f{size}").write_bytes((b"0123456789abcde" * (size // 15 + 1))[:size])
    kept = content_store.store_files(spark, str(folder), root).collect()
    for r in kept:
        raw = open(r["name"], "rb").read()
        assert (r["blake3"], r["sha256"], r["size"]) == (blake3.digests([raw])[0], hashlib.sha256(raw).hexdigest(), len(raw))
    assert content_store.verified(spark, root).where("whole").count() == 4 == len(kept) and F is not None


def test_numbers_by_ranges_equal_those_by_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "a", "a", "b", None)), rng.randrange(5), k) for k in range(500)]
    given = spark.createDataFrame(rows, "k string, v int, id int")
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["k"], r["id"]): r["place"] for r in windows.numbered(given, ["k"], [F.desc("v"), F.asc("id")], "place").collect()}
        want = {(k, i): n + 1 for key in ("a", "b", None) for n, (k, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])))}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_lines_that_are_no_records_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"EventID": 1}\n\nno json\n[1]\n  {"x": 2}\n')
    (tmp_path / "b.json").write_text('{"EventID": 1}\n')
    assert {r["file"].rpartition("/")[2]: (r["records"], r["bad"]) for r in logs.line_counts(spark, str(tmp_path)).collect()} == {"a.json": (2, 2), "b.json": (1, 0)}


def test_imports_without_a_given_standard_library(spark):
    files = spark.createDataFrame([("a.py", "import os\nimport torch\nx = '\u0001'\nimport numpy")], "file string, value string")
    assert {r["module"] for r in projects.python_imports(files, standard=("torch",)).collect()} == {"os", "numpy"}
    assert {r["module"] for r in projects.python_imports(files).collect()} == {"torch", "numpy"}
