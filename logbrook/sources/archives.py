"""Tar bundles (plain, gzip, zstd): members as rows, and rows as bundles."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import MAX_NAME_BYTES

MEMBERS = "bundle string, place long, name string, size long, mtime long, type string, mode long, content binary, problem string"


def unpack(raw: bytes) -> bytes:
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def members_of(raw: bytes) -> list[tuple]:
    """(name, size, mtime, type, mode, content) in archive order."""
    with tarfile.open(fileobj=io.BytesIO(unpack(raw)), mode="r:") as tar:
        return [(m.name, m.size, int(m.mtime), m.type.decode("latin-1"), m.mode, tar.extractfile(m).read() if m.isreg() else None) for m in tar.getmembers()]


def _explode(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            try:
                rows = [(path, i, *m, None) for i, m in enumerate(members_of(bytes(content)))]
            except Exception as problem:  # noqa: BLE001  any damage is one finding of that bundle
                rows = [(path, None, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")], dtype=object)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """One row per member; an archive that can't be read is one row with its problem."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_explode, MEMBERS)


def pack(files: dict[str, bytes], zstd: bool = True) -> bytes:
    """Equal files make equal bytes: members are sorted and carry no time and no owner."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w|") as tar:
        for name in sorted(files):
            if not name or name.startswith("/") or ".." in name.split("/") or len(name.encode()) > MAX_NAME_BYTES:
                raise ValueError(f"unsafe member name: {name!r}")
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(files[name]), 0o644
            tar.addfile(info, io.BytesIO(files[name]))
    if not zstd:
        return out.getvalue()
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def disagreement(bundle: str, files: dict[str, bytes]) -> str | None:
    """What a bundle's manifest and checksums say that its members don't bear out."""
    manifest = json.loads(files["manifest.json"])
    if manifest["bundle_id"] != bundle:
        return "the manifest names another bundle"
    found = {n: hashlib.sha256(c).hexdigest() for n, c in files.items() if n not in ("manifest.json", "checksums.txt")}
    if {f["path"]: f["sha256"] for f in manifest["files"]} != found:
        return "the manifest's files are not the members"
    lines = files["checksums.txt"].decode().splitlines()
    return None if dict(reversed(x.split("  ", 1)) for x in lines) == found else "the checksums are not those of the members"


def write_bundles(members: DataFrame, folder: str, zstd: bool = True) -> DataFrame:
    """Writes one archive per bundle_id from rows (bundle_id, path, content); rows (bundle_id, path, bytes, sha256).

    A bundle is bounded by the payload limit, so it is one group.  Archives appear by rename after
    they have been read back and compared, and where manifest and checksums fit the members.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import os

        from pyarrow import fs

        bundle = frame["bundle_id"].iloc[0]
        files = {p: bytes(c) for p, c in zip(frame["path"], frame["content"])}
        raw = pack(files, zstd)
        if {m[0]: m[5] for m in members_of(raw)} != files:
            raise ValueError(f"{bundle}: the archive does not read back as it was written")
        if told := disagreement(bundle, files):
            raise ValueError(f"{bundle}: {told}")
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{bundle}.tar.zst" if zstd else f"{base}/{bundle}.tar"
        with store.open_output_stream(tmp := f"{name}.{os.urandom(6).hex()}.tmp", compression=None) as out:
            out.write(raw)
        store.move(tmp, name)
        return pd.DataFrame({"bundle_id": [bundle], "path": [name], "bytes": [len(raw)], "sha256": [hashlib.sha256(raw).hexdigest()]})

    return members.select("bundle_id", "path", F.col("content").cast("binary").alias("content")).groupBy("bundle_id").applyInPandas(run, "bundle_id string, path string, bytes long, sha256 string")
