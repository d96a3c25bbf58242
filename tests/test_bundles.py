import io
import json
import tarfile

from pyspark.sql import functions as F

from logbrook.functions.patterns import PATTERNS, Registry
from logbrook.operators import manifest, verify
from logbrook.plans import capture
from logbrook.sources import archives

FEW = Registry(tuple(p for p in PATTERNS if p.name in ("aws_access_key", "email")))
FACTS = f"bundle_id string, created_at string, source struct<{manifest.OBJECTS['source']}>, redaction struct<{manifest.OBJECTS['redaction']}>, reproduction struct<{manifest.OBJECTS['reproduction']}>"


def bundle(spark, folder, zstd=True):
    payload = spark.createDataFrame(
        [("bnd_a", "session.jsonl", "session", "{}\n"), ("bnd_a", "REPRODUCE.md", "reproduce", "# x"), ("bnd_a", "schemas/bundle-manifest-1.json", "schema", "{}"), ("bnd_a", "schemas/agent-incident-1.json", "schema", "{}"), ("bnd_b", "notes.txt", "evidence", "sk-" + "a" * 30)],
        "bundle_id string, path string, role string, content string",
    )
    facts = spark.createDataFrame([("bnd_a", "2024-01-01T00:00:00Z", None, None, None), ("bnd_b", "2024-01-01T00:00:00Z", None, None, None)], FACTS)
    return capture.write(payload, facts, f"file://{folder}", zstd).collect()


def codes(issues, name):
    return {(r.code, r.severity) for r in issues.collect() if name in r.bundle}


def test_write_verify_inspect(spark, tmp_path):
    assert len(bundle(spark, tmp_path)) == 2
    issues, verdict = capture.verify(spark, f"file://{tmp_path}/*.tar.zst")
    good = codes(issues, "bnd_a")
    assert {c for c, s in good if s == "error"} == set(), good
    assert {("MANIFEST_EXISTS", "info"), ("MANIFEST_SCHEMA", "info"), ("OFFLINE", "info")} <= good
    other = codes(issues, "bnd_b")
    assert ("RESIDUAL_SECRET", "warning") in other and ("REQUIRED_MISSING", "warning") in other
    assert {r.exit_code for r in verdict.collect()} == {0}
    assert {r.exit_code for r in capture.verify(spark, f"file://{tmp_path}/bnd_b*", strict=True)[1].collect()} == {8}
    summary, files = capture.inspect(spark, f"file://{tmp_path}/bnd_a*")
    assert summary.first().file_count == 4 and files.count() == 4
    ready = capture.may_prepare(verdict.withColumnRenamed("bundle", "bundle"), verify.manifests_of(archives.read_members(spark, f"file://{tmp_path}/*.tar.zst")))
    assert not any(r.ready for r in ready.collect())


def test_equal_files_make_equal_bytes():
    assert archives.pack({"b": b"2", "a": b"1"}) == archives.pack({"a": b"1", "b": b"2"})


def test_tampering_and_bad_headers(spark, tmp_path):
    bundle(spark, tmp_path / "ok", zstd=False)
    files = {m[0]: m[5] for m in archives.members_of((tmp_path / "ok/bnd_a.tar").read_bytes())}
    (tmp_path / "t").mkdir()
    changed = files | {"session.jsonl": b"other", "extra.txt": b"x"}
    (tmp_path / "t/tampered.tar").write_bytes(archives.pack(changed, zstd=False))
    (tmp_path / "t/nomanifest.tar").write_bytes(archives.pack({k: v for k, v in files.items() if k != "manifest.json"}, zstd=False))
    (tmp_path / "t/broken.tar").write_bytes(b"\x28\xb5\x2f\xfdnonsense")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, kind, mode in (("../up", tarfile.REGTYPE, 0o644), ("/abs", tarfile.REGTYPE, 0o644), ("link", tarfile.SYMTYPE, 0o644), ("same", tarfile.REGTYPE, 0o644), ("same", tarfile.REGTYPE, 0o4755)):
            info = tarfile.TarInfo(name)
            info.type, info.mode = kind, mode
            tar.addfile(info, io.BytesIO())
    (tmp_path / "t/evil.tar").write_bytes(out.getvalue())
    issues, verdict = capture.verify(spark, f"file://{tmp_path}/t/*.tar")
    issues = issues.cache()
    assert {("CHECKSUM_CONTENT", "error"), ("FILE_UNKNOWN", "warning")} <= codes(issues, "tampered")
    assert ("REQUIRED_MISSING", "error") in codes(issues, "nomanifest") and "MANIFEST_EXISTS" not in {c for c, _ in codes(issues, "nomanifest")}
    assert {c for c, _ in codes(issues, "evil")} == {"ARCHIVE_TRAVERSAL", "ARCHIVE_ABSOLUTE_PATH", "ARCHIVE_NON_REGULAR", "ARCHIVE_DUPLICATE", "ARCHIVE_UNSAFE_MODE"}
    assert {c for c, _ in codes(issues, "broken")} == {"ARCHIVE_READ"}
    exits = {r.bundle.rsplit("/", 1)[1]: r.exit_code for r in verdict.collect()}
    assert exits == {"tampered.tar": 8, "nomanifest.tar": 8, "evil.tar": 7, "broken.tar": 7}


def test_capture_end_to_end(spark, tmp_path):
    file = tmp_path / "home/.hermes/sessions/run.jsonl"
    file.parent.mkdir(parents=True)
    file.write_text("\n".join(json.dumps(x) for x in ({"role": "user", "content": "mail me@example.org"}, {"role": "assistant", "content": "done"})))
    made = capture.capture(spark, "hermes", f"file://{tmp_path}/home", "last", f"file://{tmp_path}/out", salt="s", registry=FEW).collect()
    assert len(made) == 1
    members = {r.name: bytes(r.content).decode() for r in archives.read_members(spark, f"file://{tmp_path}/out/*").collect()}
    assert "me@example.org" not in "".join(members.values())
    assert json.loads(members["redaction-report.json"])["total_redactions"] >= 1
    _, verdict = capture.verify(spark, f"file://{tmp_path}/out/*")
    assert verdict.first().valid


def test_streamed_redaction(spark, tmp_path):
    from logbrook.streaming import redaction

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("me@example.org\nplain\n")
    out = redaction.redacted(redaction.lines(spark, f"file://{tmp_path}/in"), "s", FEW)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.redacted[:15] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("redacted")).collect()} == {"<REDACTED_email", "plain"}
