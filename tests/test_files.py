"""Files hashed where they lie."""

import gzip
import hashlib

import pytest

from tracewell.operators import runs
from tracewell.sources import tables as io


def told(df):
    return {r["path"].rsplit("/", 1)[-1]: (r["sha256"], r["bytes"], r["error"]) for r in df.collect()}


def test_hash_files(spark, tmp_path):
    held = {"empty": b"", "a b%20c.txt": b"x\ny", "packed.gz": gzip.compress(b"text"), "large": bytes(range(256)) * 60_000, "_hidden": b"h"}
    (tmp_path / "deep").mkdir()
    for name, data in held.items():
        (tmp_path / "deep" / name).write_bytes(data)
    want = {n: (hashlib.sha256(d).hexdigest(), len(d), None) for n, d in held.items() if n not in ("_hidden", "empty")}
    assert told(io.hash_files(spark, str(tmp_path))) == want
    assert told(io.hash_files(spark, str(tmp_path), piece=1000)) == want
    assert set(told(io.hash_files(spark, str(tmp_path), "*.gz"))) == {"packed.gz"}
    assert told(io.hash_files(spark, str(tmp_path), "*.gz", contents=True)) == {"packed.gz": (hashlib.sha256(b"text").hexdigest(), 4, None)}
    plan = io.hash_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # listed without contents


def test_hash_files_gone_or_elsewhere(spark, tmp_path):
    (tmp_path / "kept").write_bytes(b"k")
    (tmp_path / "gone").write_bytes(b"g")
    df = io.hash_files(spark, str(tmp_path))
    df.count()
    (tmp_path / "gone").unlink()
    got = told(df)
    assert got == {"kept": (hashlib.sha256(b"k").hexdigest(), 1, None)}

    def broken(path, contents):
        raise PermissionError(path)

    assert {x[2] for x in told(io.hash_files(spark, str(tmp_path), "kept", opener=broken)).values()} == {"PermissionError"}
    with pytest.raises(Exception, match="nosuch"):
        io.open_stream("nosuch://host/file")


def test_audit_of_files(spark, tmp_path):
    for name in ("same", "changed", "grown", "new"):
        (tmp_path / name).write_bytes(name.encode())
    files = io.hash_files(spark, str(tmp_path)).selectExpr("substring_index(path, '/', -1) as path", "sha256", "bytes")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    claims = [("same", sha(b"same"), 4), ("changed", sha(b"CHANGED"), 7), ("grown", sha(b"gro"), 3), ("gone", sha(b""), 0)]
    claimed = spark.createDataFrame(claims, "path string, sha256 string, bytes long")
    got = {r["path"]: r["reasons"] for r in runs.checksum_audit(files, claimed, claimed.select("path", "sha256")).collect()}
    assert got == {"changed": ["hash differs"], "grown": ["hash differs", "size differs"], "gone": ["missing file"]}
