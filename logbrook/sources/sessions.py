"""Discovering and reading sessions of the supported agents.

A connector lists sessions (session_id, agent, started_at, cwd_hint, agent_version, source_format,
event_count, path) and reads the events of those selected.  Files are pruned by glob before they are
opened; a selector is `last` or part of an id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.text import iso_from_millis, stem
from ..operators import events as ev


class Connector(Protocol):
    def discover(self, selector: str = "") -> DataFrame: ...

    def resolve(self, ref: str) -> DataFrame: ...

    def read(self, sessions: DataFrame) -> DataFrame: ...


def select(sessions: DataFrame, selector: str, fold_case: bool, order: str = "started_at") -> DataFrame:
    """`last`: the newest; else those whose id holds the selector.  Null times come last."""
    if selector == "last":
        return sessions.orderBy(F.col(order).desc_nulls_last(), "session_id").limit(1)
    own = F.col("session_id")
    return sessions.where(F.lower(own).contains(selector.lower()) if fold_case else own.contains(selector))


#: Files that are read by name; where more are asked for, all of the home are read and the others dropped.
NAMED = 10_000


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    try:
        found = spark.read.format("binaryFile").load(path)
    except Exception as problem:  # noqa: BLE001  no file fits the glob
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return found


class _Lines:
    """Connectors with one JSON Lines file per session."""

    agent = source_format = glob = ""
    fold_case = False
    order = "started_at"

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def session(self) -> Column:
        return stem(F.col("path"))

    def files(self, named: list[str] | None = None) -> DataFrame:
        return _files(self.spark, named or f"{self.home}/{self.glob}")

    def lines(self, named: list[str] | None = None) -> DataFrame:
        return ev.lines(self.files(named), self.session(), F.col("content"))

    def resolve(self, ref: str) -> DataFrame:
        return self.discover(ref).orderBy(F.col(self.order).desc_nulls_last(), "session_id").limit(1)

    def _listed(self, peeked: DataFrame) -> DataFrame:
        files = self.files().select(self.session().alias("session_id"), "path", F.col("modificationTime").alias("modified"))
        out = files.join(peeked, "session_id", "left")
        have = set(out.columns)
        missing = {"started_at": "string", "cwd_hint": "string", "agent_version": "string"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in have})
        count = F.coalesce("event_count", F.lit(0)) if "event_count" in have else F.lit(0)
        return out.select("session_id", F.lit(self.agent).alias("agent"), "started_at", "cwd_hint", "agent_version", F.lit(self.source_format).alias("source_format"), count.cast("long").alias("event_count"), "path", "modified")

    def selected(self, sessions: DataFrame) -> DataFrame:
        named = [r.path for r in sessions.select("path").limit(NAMED + 1).collect()] if "path" in sessions.columns else []
        escaped = [re.sub(r"([*?\[\]{}\\\\])", r"\\\1", p) for p in named]
        return self.lines(escaped if 0 < len(named) <= NAMED else None).join(sessions.select("session_id"), "session_id", "left_semi")


class BlockLog(_Lines):
    agent, source_format, glob = "claude-code", "claude-project-jsonl", ".claude/projects/*/*.jsonl"

    def discover(self, selector: str = "") -> DataFrame:
        rows = ev.parsed(self.lines())
        field = lambda p: F.try_variant_get("v", p, "string")
        peeked = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("line_no"))).alias("v"))
        peeked = peeked.select("session_id", "event_count", field("$.cwd").alias("cwd_hint"), field("$.version").alias("agent_version"), field("$.timestamp").alias("started_at"))
        return select(self._listed(peeked), selector, self.fold_case)

    def read(self, sessions: DataFrame) -> DataFrame:
        return ev.from_block_lines(self.selected(sessions))


class RolloutLog(_Lines):
    agent, source_format, glob = "codex-cli", "codex-rollout-jsonl", ".codex/sessions/[0-9]*/[0-9]*/[0-9]*/rollout-*.jsonl"

    def session(self) -> Column:
        return F.regexp_replace(stem(F.col("path")), "^rollout-", "")

    def files(self, named: list[str] | None = None) -> DataFrame:
        return super().files(named).where(F.col("path").rlike(r"/\d+/\d+/\d+/[^/]*$"))

    def discover(self, selector: str = "") -> DataFrame:
        meta = (F.try_variant_get("v", "$.type", "string") == "session_meta") | F.try_variant_get("v", "$.session_meta", "variant").isNotNull() | F.try_variant_get("v", "$.payload", "variant").isNotNull()
        field = lambda p: F.try_variant_get("v", p, "string")
        first = ev.parsed(self.lines()).where(meta).groupBy("session_id").agg(F.min_by("v", "line_no").alias("v"))
        peeked = first.select("session_id", field("$.payload.cwd").alias("cwd_hint"), field("$.payload.cli_version").alias("agent_version"), field("$.timestamp").alias("started_at"))
        listed = self._listed(peeked)
        return select(listed.withColumn("started_at", F.coalesce("started_at", (F.unix_micros("modified") / 1e6).cast("string"))), selector, self.fold_case)

    def read(self, sessions: DataFrame) -> DataFrame:
        return ev.from_rollout_lines(self.selected(sessions), self.agent, sessions)


class RoleLog(_Lines):
    agent, source_format, glob, fold_case, order = "hermes", "hermes-jsonl", ".hermes/sessions/*.jsonl", True, "modified"

    def files(self, named: list[str] | None = None) -> DataFrame:
        return super().files(named).where(~F.col("path").rlike(r"/\.[^/]*$"))

    def discover(self, selector: str = "") -> DataFrame:
        rows = ev.parsed(self.lines())
        meta = F.when(F.try_variant_get("v", "$.role", "string") == "session_meta", F.col("line_no"))
        peeked = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"), F.min_by("v", meta).alias("v"))
        provider, model = (F.try_variant_get("v", p, "string") for p in ("$.provider", "$.model"))
        version = F.when(provider.isNotNull() | model.isNotNull(), F.concat_ws("/", F.coalesce(provider, F.lit("unknown")), F.coalesce(model, F.lit("unknown"))))
        listed = self._listed(peeked.select("session_id", "event_count", version.alias("agent_version")))
        return select(listed.withColumn("started_at", iso_from_millis(F.unix_millis("modified"))), selector, self.fold_case, "modified")

    def read(self, sessions: DataFrame) -> DataFrame:
        return ev.from_role_lines(self.selected(sessions), self.agent, sessions)


class DocumentLog:
    """Sessions, messages and parts as single JSON files; keys come from the folders."""

    agent, source_format = "opencode-cli", "opencode-json"

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.root = spark, f"{home.rstrip('/')}/.local/share/opencode/storage"

    def _objects(self, path: str, **keys: Column) -> DataFrame:
        text = F.make_valid_utf8(F.col("content").cast("string"))
        rows = _files(self.spark, f"{self.root}/{path}").select(*[c.alias(k) for k, c in keys.items()], F.col("path").alias("file"), F.try_parse_json(text).alias("v"))
        return rows.where("v is not null")

    def sessions(self) -> DataFrame:
        rows = self._objects("session/*/*.json", stem=stem(F.col("path")))
        return rows.select(F.coalesce(F.try_variant_get("v", "$.id", "string"), F.col("stem")).alias("session_id"), "file", "v")

    def _folder(self) -> Column:
        return F.element_at(F.split("path", "/"), -2)

    def messages(self) -> DataFrame:
        return self._objects("message/*/*.json", session_id=self._folder())

    def parts(self) -> DataFrame:
        return self._objects("part/*/*.json", message_id=self._folder())

    def discover(self, selector: str = "") -> DataFrame:
        counts = _files(self.spark, f"{self.root}/message/*/*.json").select(self._folder().alias("session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))
        field = lambda p, t="string": F.try_variant_get("v", p, t)
        created = F.nullif(field("$.time.created", "bigint"), F.lit(0).cast("long"))
        rows = self.sessions().join(counts, "session_id", "left").select(
            "session_id", F.lit(self.agent).alias("agent"), iso_from_millis(created).alias("started_at"), field("$.directory").alias("cwd_hint"), field("$.version").alias("agent_version"),
            F.lit(self.source_format).alias("source_format"), F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"), F.col("file").alias("path"),
        )
        return select(rows, selector, True)

    def resolve(self, ref: str) -> DataFrame:
        return self.discover(ref).orderBy(F.col("started_at").desc_nulls_last(), "session_id").limit(1)

    def read(self, sessions: DataFrame) -> DataFrame:
        wanted = sessions.select("session_id")
        return ev.from_documents(self.sessions().join(wanted, "session_id", "left_semi"), self.messages().join(wanted, "session_id", "left_semi"), self.parts())


# Names under which connectors are asked for.
CONNECTORS: dict[str, Callable[[SparkSession, str], Connector]] = {
    "claude": BlockLog,
    "claude-code": BlockLog,
    "codex": RolloutLog,
    "codex-cli": RolloutLog,
    "hermes": RoleLog,
    "hermes-cli": RoleLog,
    "opencode": DocumentLog,
    "opencode-cli": DocumentLog,
}
#: The names that a manifest knows, by connector name.
MANIFEST_AGENT = {"claude": "claude-code", "claude-code": "claude-code", "codex": "codex-cli", "codex-cli": "codex-cli", "hermes": "unknown", "hermes-cli": "unknown", "opencode": "opencode", "opencode-cli": "opencode"}


def register(name: str, connector: Callable[[SparkSession, str], Connector]) -> None:
    CONNECTORS[name.lower()] = connector


def connector(spark: SparkSession, agent: str, home: str) -> Connector:
    made = CONNECTORS.get(agent.lower())
    if made is None:
        raise SourceError(f"Unknown agent: {agent}. Supported: {sorted(CONNECTORS)}", "E_SOURCE_ADAPTER")
    return made(spark, home)
