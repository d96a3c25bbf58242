"""Git on the driver's machine: the state that a capture notes, and working trees made from bundles.

None of this is data; it runs once, on the driver, with fixed arguments and without a shell.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import PrepareError


def _git(folder: str | Path, *args: str, seconds: int = 5) -> str | None:
    """What git prints, or None where it fails."""
    try:
        done = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip()


def git_state(folder: str | Path | None) -> dict | None:
    """commit, dirty and branch of a repository; None without one, or without a commit."""
    if folder is None or not (commit := _git(folder, "rev-parse", "HEAD")):
        return None
    status = _git(folder, "status", "--porcelain")
    state = {"commit": commit, "dirty": status is None or status != ""}
    if branch := _git(folder, "rev-parse", "--abbrev-ref", "HEAD"):
        state["branch"] = branch
    return state


def prepare(spark: SparkSession, bundle: str, repo: str, target: str) -> str:
    """A detached working tree of the bundle's baseline in an empty folder; the commit.  The repository's HEAD stays."""
    from ..sources import archives
    from . import capture

    issues, verdict = capture.verify(spark, bundle, strict=True)
    if (row := verdict.first()) is None or not row.valid:
        told = [r.message for r in issues.where("severity = 'error'").limit(5).collect()]
        raise PrepareError(f"the bundle is not valid: {'; '.join(told) or 'nothing to read'}")
    if not Path(repo).is_dir() or _git(repo, "rev-parse", "--git-dir", seconds=10) is None:
        raise PrepareError(f"not a repository: {repo}")
    place = Path(target)
    if place.exists() and (not place.is_dir() or any(place.iterdir())):
        raise PrepareError(f"not an empty folder: {target}")
    state = archives.read_members(spark, bundle).where("name = 'git-state.json'").select(F.get_json_object(F.col("content").cast("string"), "$.commit").alias("commit")).first()
    if state is None:
        raise PrepareError("the bundle has no git-state.json")
    head = _git(repo, "rev-parse", "HEAD", seconds=10)
    commit = state.commit or "HEAD"
    if commit.startswith("-") or _git(repo, "cat-file", "-e", commit, seconds=10) is None:
        raise PrepareError(f"the baseline is not in the repository: {commit}")
    made = not place.exists()
    place.mkdir(parents=True, exist_ok=True)
    if _git(repo, "worktree", "add", "--detach", str(place.resolve()), commit, seconds=30) is None:
        if made and not any(place.iterdir()):
            place.rmdir()
        raise PrepareError(f"no working tree could be made at {target}")
    if _git(repo, "rev-parse", "HEAD", seconds=10) != head:
        raise PrepareError("the repository's HEAD has moved")
    return commit
