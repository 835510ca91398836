import hashlib
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewright.sources import archives


def packed(*members, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name), content, more.get("how", zipfile.ZIP_STORED))
    return out.getvalue()


@pytest.mark.parametrize("name, want", [("a/b.txt", "a/b.txt"), ("/a//./b", "a/b"), ("a\\b", "a/b"), ("../a", None), ("a/../../b", None), ("C:/a", None), ("", None), ("/", None), ("a..b/c", "a..b/c")])
def test_clean_paths(name, want):
    assert archives.clean_path(name) == want


def test_members(spark, tmp_path, monkeypatch):
    (tmp_path / "a.zip").write_bytes(packed(("d/", b""), ("d/x", b"one"), ("../y", b"two"), ("e", b"")))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.zip").write_bytes(packed(("bomb", b"0" * 100_000), how=zipfile.ZIP_DEFLATED))
    (tmp_path / "d.zip").write_bytes(packed(("long", b"12345")))
    false = bytearray(packed(("z", b"12345")))
    at = false.rindex(b"PK\x01\x02")
    false[at + 24 : at + 28] = struct.pack("<I", 3)
    (tmp_path / "e.zip").write_bytes(bytes(false))
    got = {(r.file.rpartition("/")[2], r.member): (r.size, r.content and bytes(r.content), r.problem) for r in archives.members(spark, str(tmp_path), most=4).collect()}
    assert got.pop(("e.zip", "z"))[2] in ("unreadable", "too large")
    assert got == {
        ("a.zip", "d/x"): (3, b"one", None), ("a.zip", "../y"): (3, None, "unsafe path"), ("a.zip", "e"): (0, b"", None),
        ("b.zip", None): (None, None, "no archive"), ("c.zip", "bomb"): (100_000, None, "too large"), ("d.zip", "long"): (5, None, "too large"),
    }
    bomb = archives.members(spark, str(tmp_path), "c.zip").collect()
    assert [(r.member, r.problem) for r in bomb] == [("bomb", "grows too much")]
    monkeypatch.setattr(archives, "MAX_MEMBERS", 1)
    assert [r[3] for r in archives._rows(packed(("a", b""), ("b", b"")), 9)] == ["too many members"]


def test_advisories_of_archives(spark, tmp_path):
    record = {"id": "G-1", "affected": [{"package": {"ecosystem": "PyPI", "name": "n"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}
    (tmp_path / "a.zip").write_bytes(packed(("G-1.json", json.dumps(record)), ("bad.json", "{"), ("none.json", "{}"), ("readme.txt", "x")))
    (tmp_path / "b.zip").write_bytes(b"x")
    (tmp_path / "empty.zip").write_bytes(b"")
    got = archives.advisories(spark, str(tmp_path)).select("id", "name", "step", "introduced", "fixed").collect()
    assert sorted(map(tuple, got)) == [("G-1", "n", 0, "0", None), ("G-1", "n", 1, None, "2")]
    assert {(r.file.rpartition("/")[2], r.records, r.unreadable) for r in archives.record_counts(spark, str(tmp_path)).collect()} == {("a.zip", 1, 2), ("b.zip", 0, 1)}


def test_ranged(spark):
    one = lambda *a: spark.range(1).select(archives.ranged(F.lit(b"abcdef"), *a)).first()[0]
    assert [one(0, 2), one(4, 9), one(6, 1), one(1, 5, 2), one(-1, 2), one(0, 0)] == [b"ab", b"ef", b"", b"bc", None, b""]


def test_bundles(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x")
    (tmp_path / "b.csv").write_bytes(b"y")
    feeds = [{"feed_name": "one", "filename": "a.csv", "sha256": hashlib.sha256(b"x").hexdigest().upper()}]

    def listed(more):
        (tmp_path / "manifest.json").write_text(json.dumps({"feeds": feeds + more}))
        return str(tmp_path)

    assert archives.checked_bundle(spark, listed([])) == {"one": f"{tmp_path}/a.csv"}
    more = [{"feed_name": "two", "filename": "b.csv", "sha256": "0"}, {"feed_name": "three", "filename": "c.csv", "sha256": "0"}, {"feed_name": "four", "filename": "b.csv"}]
    got = archives.bundle_files(spark, listed(more)).collect()
    assert {(r.feed_name, r.state) for r in got} == {("one", "ok"), ("two", "mismatch"), ("three", "missing"), ("four", "mismatch")}
    with pytest.raises(ValueError, match="c.csv: missing"):
        archives.checked_bundle(spark, str(tmp_path))
