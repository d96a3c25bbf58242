"""Four session-log formats normalised into one event model.

Each reader turns a line (or a part) into an array of emissions by variant expressions, explodes it,
and numbers the events with a window over the session: a line's first event comes after all that the
lines before it count for.  Sessions are independent, so one pass serves any number of them.

Events: session_id, seq, kind, ts, agent, agent_version, tool, input (variant), output, exit_code,
duration_ms, code, message, owner, orphaned.  Polymorphic content that is no text is kept as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.policy import MAX_FIELD_CHARS
from ..functions.text import iso_from_millis, strip

KINDS = ("session_start", "user_message", "assistant_message", "tool_call", "tool_result", "error", "session_end")
COLUMNS = ("session_id", "seq", "kind", "ts", "agent", "agent_version", "tool", "input", "output", "exit_code", "duration_ms", "code", "message", "owner", "orphaned")
# Argument keys that may leave with their value, and what stands for the others.
SCALAR_KEYS = ("cmd", "path", "query", "arguments")
OMITTED = '{"omitted":"non_scalar_tool_input"}'
RAW_ARGUMENT_CHARS, REASONING_CHARS = 1024, 2048

_FIELDS = {"ts": "string", "tool": "string", "input": "variant", "output": "string", "exit_code": "bigint", "message": "string", "owner": "string", "call_id": "string"}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A string as it is, anything else as JSON, null as null."""
    return F.when(_is(v, "STRING"), v.cast("string")).when(v.isNull() | _is(v, "VOID"), F.lit(None)).otherwise(F.to_json(v))


def _event(kind, idx: Column | int = 0, **fields: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    idx = F.lit(idx) if isinstance(idx, int) else idx
    values = [(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) if not (n == "input" and n in fields) else fields[n].alias(n) for n, t in _FIELDS.items()]
    return F.struct(idx.cast("bigint").alias("idx"), kind.alias("kind"), *values)




def lines(files: DataFrame, session: Column, content: Column) -> DataFrame:
    """session_id, line_no, value: universal newlines, blank lines left out, invalid UTF-8 replaced."""
    text = F.make_valid_utf8(content.cast("string"))
    rows = files.select(session.alias("session_id"), F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "raw"))
    return rows.select("session_id", F.col("line_no").cast("long").alias("line_no"), strip(F.col("raw")).alias("value")).where("value <> ''")


def parsed(rows: DataFrame) -> DataFrame:
    """rows with v: the line as a variant; null for malformed lines and for JSON that is no object."""
    v = F.try_parse_json("value")
    return rows.withColumn("v", F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), v))


def tool_input(raw: Column) -> Column:
    """An object, or a string that holds one; other strings under `raw`, anything else an empty object."""
    inner = F.try_parse_json(raw.cast("string"))
    kept = F.parse_json(F.to_json(F.struct(F.substring(raw.cast("string"), 1, RAW_ARGUMENT_CHARS).alias("raw"))))
    nothing = F.parse_json(F.lit("{}"))
    return (
        F.when(_is(raw, "OBJECT"), raw)
        .when(_is(raw, "STRING") & inner.isNull(), kept)
        .when(_is(raw, "STRING") & _is(inner, "OBJECT"), inner)
        .otherwise(nothing)
    )


def safe_input(v: Column) -> Column:
    """Allowlisted scalars pass; every other key keeps a constant in place of its value."""
    keep = lambda k, x: k.isin(*SCALAR_KEYS) & ~(_is(x, "OBJECT") | _is(x, "ARRAY") | _is(x, "VOID"))
    return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.when(keep(k, x), x).otherwise(F.parse_json(F.lit(OMITTED))))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (session_id, line_no, events, counts): events with seq; counts is what the line adds to the sequence."""
    before = W.partitionBy("session_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    base = rows.withColumn("base", F.coalesce(F.sum("counts").over(before), F.lit(0)) + 1)
    return base.select("session_id", "line_no", "base", F.explode("events").alias("e")).select("session_id", "line_no", (F.col("base") + F.col("e.idx")).alias("seq"), "e.*")


def contiguous(events: DataFrame, *order: str) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy(*order)).cast("long"))


def canonical(events: DataFrame) -> DataFrame:
    """The event model's columns, with texts cut to their limit."""
    blank = {"agent": "string", "agent_version": "string", "duration_ms": "bigint", "code": "string", "input": "variant"}
    have = set(events.columns)
    cut = {"message", "output"}
    out = []
    for c in COLUMNS:
        if c == "orphaned":
            out.append((F.col(c) if c in have else F.lit(False)).alias(c))
        elif c in have:
            out.append(F.substring(c, 1, MAX_FIELD_CHARS).alias(c) if c in cut else F.col(c))
        else:
            out.append(F.lit(None).cast(blank.get(c, "string")).alias(c))
    return events.select(*out)


def to_jsonl(events: DataFrame) -> DataFrame:
    """session_id, seq, line: fixed key order, nulls left out, tool input reduced to what is safe."""
    row = F.struct("seq", "kind", "ts", "agent", "agent_version", "tool", safe_input(F.col("input")).alias("input"), "output", "exit_code", "duration_ms", "code", "message", "owner", F.when(F.col("orphaned"), True).alias("orphaned"))
    return events.select("session_id", "seq", F.to_json(row).alias("line"))


def unknown(rows: DataFrame, flag: Column) -> DataFrame:
    """Per session: lines (or entries) that no rule knows."""
    return rows.groupBy("session_id").agg(F.count_if(flag).cast("long").alias("unknown_event_types"))


# ---- block lines: user and assistant lines whose content is text or a list of blocks ---------------

def _block_events(v: Column) -> tuple[Column, Column]:
    """(events, counts) of a line; a list advances the sequence by one more than its blocks."""
    kind, ts, content = F.coalesce(_get(v, "$.type"), F.lit("")), _get(v, "$.timestamp"), _get(v, "$.message.content", "variant")
    blocks, listed = _get(v, "$.message.content", "array<variant>"), _is(_get(v, "$.message.content", "variant"), "ARRAY")
    whole = F.coalesce(_text(content), F.lit(""))

    def result_text(b: Column) -> Column:
        inner = _get(b, "$.content", "variant")
        part = lambda c: F.when(_is(c, "OBJECT"), F.coalesce(_get(c, "$.text"), F.lit(""))).otherwise(F.coalesce(_text(c), F.lit("")))
        joined = F.array_join(F.transform(_get(b, "$.content", "array<variant>"), part), " ")
        return F.when(_is(inner, "ARRAY"), joined).when(_is(inner, "STRING"), inner.cast("string")).otherwise(F.lit(""))

    def user(b: Column, i: Column) -> Column:
        shape = _get(b, "$.type")
        result = _event("tool_result", i, ts=ts, tool=F.coalesce(_get(b, "$.name"), F.lit("unknown")), output=result_text(b))
        return F.when(shape == "tool_result", result).when(shape == "text", _event("user_message", i, ts=ts, owner=F.lit("user"), message=F.coalesce(_get(b, "$.text"), F.lit(""))))

    def assistant(b: Column, i: Column) -> Column:
        shape, given = _get(b, "$.type"), _get(b, "$.input", "variant")
        call = _event("tool_call", i, ts=ts, tool=F.coalesce(_get(b, "$.name"), F.lit("unknown")), input=F.when(_is(given, "OBJECT"), given).otherwise(F.parse_json(F.lit("{}"))))
        return F.when(shape == "tool_use", call).when(shape == "text", _event("assistant_message", i, ts=ts, owner=F.lit("assistant"), message=F.coalesce(_get(b, "$.text"), F.lit(""))))

    def of(role: str, make) -> Column:
        single = F.array(_event(f"{role}_message", ts=ts, owner=F.lit(role), message=whole))
        return F.when(listed, F.filter(F.transform(blocks, make), lambda e: e.isNotNull())).otherwise(single)

    error = F.array(_event("error", ts=ts, message=F.coalesce(_text(content), _text(_get(v, "$.error", "variant")), F.lit(""))))
    spoken = kind.isin("user", "assistant")
    counts = F.when(spoken & listed, F.size(blocks) + 1).when(spoken | (kind == "error"), 1).otherwise(0).cast("long")
    return F.when(kind == "user", of("user", user)).when(kind == "assistant", of("assistant", assistant)).when(kind == "error", error), counts


def from_block_lines(rows: DataFrame) -> DataFrame:
    """Events of lines whose blocks carry tool use and results."""
    events, counts = _block_events(F.col("v"))
    known = parsed(rows).where("v is not null")
    return canonical(numbered(known.select("session_id", "line_no", events.alias("events"), counts.alias("counts"))))


def block_unknown(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(_get(F.col("v"), "$.type"), F.lit(""))
    return unknown(parsed(rows), F.col("v").isNull() | ~kind.isin("system", "user", "assistant", "error"))


def block_metadata(rows: DataFrame) -> DataFrame:
    """Per session: what its first system line says."""
    v = F.when(_get(F.col("v"), "$.type") == "system", F.col("v"))
    first = parsed(rows).withColumn("s", v).where("s is not null").groupBy("session_id").agg(*[F.min_by(_get(F.col("s"), p), "line_no").alias(a) for p, a in (("$.sessionId", "own_id"), ("$.cwd", "cwd"), ("$.version", "agent_version"))])
    return rows.select("session_id").distinct().join(first, "session_id", "left").select(F.coalesce("own_id", "session_id").alias("own_id"), "session_id", "cwd", "agent_version")


# ---- rollout lines: items with a payload ----------------------------------------------------------


def _rollout(v: Column) -> tuple[Column, Column]:
    """(event or null, whether the line is unknown)."""
    kind, ts, payload = F.coalesce(_get(v, "$.type"), F.lit("")), _get(v, "$.timestamp"), F.coalesce(_get(v, "$.payload.type"), F.lit(""))
    meta = (kind == "session_meta") | _get(v, "$.session_meta", "variant").isNotNull()
    role = F.coalesce(_get(v, "$.payload.role"), F.lit(""))
    given = _get(v, "$.payload.arguments", "variant")
    output = F.coalesce(_get(v, "$.payload.output", "variant"), _get(v, "$.payload.content", "variant"))
    code = F.coalesce(*[F.when(_get(v, p, "bigint") != 0, _get(v, p, "bigint")) for p in ("$.payload.exit_code", "$.exit_code")])
    said = _text(_get(v, "$.user_message", "variant"))
    item = (
        F.when(payload == "message", _event(F.when(role == "assistant", "assistant_message").otherwise("user_message"), ts=ts, owner=role, message=F.coalesce(_text(_get(v, "$.payload.content", "variant")), F.lit(""))))
        .when(payload == "function_call", _event("tool_call", ts=ts, tool=F.coalesce(_get(v, "$.payload.name"), _get(v, "$.payload.function"), F.lit("unknown")), input=tool_input(given)))
        .when(payload == "function_call_output", _event("tool_result", ts=ts, tool=F.coalesce(_get(v, "$.payload.name"), F.lit("unknown")), output=F.coalesce(_text(output), F.lit("")), exit_code=code))
    )
    event = F.when(meta, _event("session_start")).when(kind == "response_item", item).when((kind == "event_msg") & (F.coalesce(said, F.lit("")) != ""), _event("user_message", ts=ts, owner=F.lit("user"), message=said))
    silent = (kind == "turn_context") | ((kind == "response_item") & (payload == "reasoning"))
    return event, ~meta & ~silent & event.isNull()


def from_rollout_lines(rows: DataFrame, agent: str = "codex-cli", sessions: DataFrame | None = None) -> DataFrame:
    """Events without gaps; session starts take their time and version from `sessions` (session_id, started_at, agent_version)."""
    event, _ = _rollout(F.col("v"))
    found = parsed(rows).where("v is not null").select("session_id", "line_no", event.alias("e")).where("e is not null").select("session_id", "line_no", "e.*")
    return canonical(_with_session(contiguous(found, "line_no"), agent, sessions))


def rollout_unknown(rows: DataFrame) -> DataFrame:
    return unknown(parsed(rows), F.col("v").isNull() | _rollout(F.col("v"))[1])


def rollout_metadata(rows: DataFrame) -> DataFrame:
    """Per session: what its last meta line says."""
    meta = F.coalesce(_get(F.col("v"), "$.payload", "variant"), _get(F.col("v"), "$.session_meta", "variant"))
    is_meta = (_get(F.col("v"), "$.type") == "session_meta") | _get(F.col("v"), "$.session_meta", "variant").isNotNull()
    found = parsed(rows).where(is_meta).withColumn("m", meta)
    return found.groupBy("session_id").agg(*[F.max_by(_get(F.col("m"), f"$.{n}"), "line_no").alias(n) for n in ("id", "cwd", "cli_version", "originator", "model_provider")])


def _with_session(events: DataFrame, agent: str, sessions: DataFrame | None) -> DataFrame:
    start = F.col("kind") == "session_start"
    if sessions is not None:
        own = sessions.select("session_id", F.col("started_at").alias("_at"), F.col("agent_version").alias("_v"))
        events = events.join(own, "session_id", "left")
    else:
        events = events.withColumns({"_at": F.lit(None).cast("string"), "_v": F.lit(None).cast("string")})
    at_end = F.col("kind").isin("session_start", "session_end")
    return events.withColumns({"ts": F.when(at_end, F.coalesce("ts", "_at")).otherwise(F.col("ts")), "agent": F.when(start, F.lit(agent)), "agent_version": F.when(start, F.col("_v"))}).drop("_at", "_v")


# ---- role lines: chat messages with tool calls and correlated results -------------------------------


def _role(v: Column) -> tuple[Column, Column, Column]:
    """(events, counts, unknown entries) of a line."""
    role, ts = F.coalesce(_get(v, "$.role"), F.lit("")), _get(v, "$.timestamp")
    text = F.coalesce(_text(_get(v, "$.content", "variant")), F.lit(""))
    reasoning = F.coalesce(_text(_get(v, "$.reasoning", "variant")), F.lit(""))
    entries = F.coalesce(_get(v, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    calls = F.filter(entries, lambda c: _is(c, "OBJECT"))
    spoke = (text != "") | (reasoning != "")
    said = F.when(text != "", text).otherwise(F.concat(F.lit("[reasoning: "), F.substring(reasoning, 1, REASONING_CHARS), F.lit("]")))

    def call(c: Column, i: Column) -> Column:
        given = F.coalesce(_get(c, "$.function.arguments", "variant"), F.parse_json(F.lit('"{}"')))
        own = F.coalesce(F.nullif(_get(c, "$.id"), F.lit("")), _get(c, "$.call_id"), F.lit(""))
        return _event("tool_call", i + spoke.cast("int"), ts=ts, tool=F.coalesce(_get(c, "$.function.name"), F.lit("unknown")), input=tool_input(given), call_id=own)

    message = F.array(_event("assistant_message", ts=ts, owner=F.lit("assistant"), message=said))
    assistant = F.concat(F.when(spoke, message).otherwise(F.filter(message, lambda e: F.lit(False))), F.transform(calls, call))
    output = _get(v, "$.content", "variant")
    inner = F.when(_is(output, "STRING"), F.try_parse_json(output.cast("string")))
    code = F.coalesce(*[F.when(_get(inner, p, "double") != 0, _get(inner, p, "double")) for p in ("$.exit_code", "$.status_code")]).cast("bigint")
    tool = F.array(_event("tool_result", ts=ts, output=F.nullif(text, F.lit("")), exit_code=code, call_id=F.coalesce(_get(v, "$.tool_call_id"), F.lit(""))))
    events = (
        F.when(role == "session_meta", F.array(_event("session_start", ts=ts)))
        .when(role == "user", F.array(_event("user_message", ts=ts, owner=F.lit("user"), message=text)))
        .when(role == "assistant", assistant)
        .when(role == "tool", tool)
    )
    burnt = F.lit(1) + spoke.cast("int") + F.size(calls) - (~spoke & (F.size(entries) > 0)).cast("int")
    counts = F.when(role == "assistant", burnt).when(role.isin("session_meta", "user", "tool"), 1).otherwise(0).cast("long")
    odd = F.when(role == "assistant", F.size(entries) - F.size(calls)).when(role.isin("session_meta", "user", "tool"), 0).otherwise(1)
    return events, counts, odd


def correlated(events: DataFrame) -> DataFrame:
    """Each result takes the tool of the latest earlier call with its id, else `unknown`."""
    before = W.partitionBy("session_id", "call_id").orderBy("line_no", "seq").rowsBetween(W.unboundedPreceding, -1)
    latest = F.last(F.when((F.col("kind") == "tool_call") & (F.col("call_id") != ""), F.col("tool")), ignorenulls=True).over(before)
    return events.withColumn("tool", F.when(F.col("kind") == "tool_result", F.coalesce(latest, F.lit("unknown"))).otherwise(F.col("tool")))


def from_role_lines(rows: DataFrame, agent: str = "hermes", sessions: DataFrame | None = None) -> DataFrame:
    """Events with a start and an end in every session; without a start line one is put first and all are renumbered."""
    made, counts, _ = _role(F.col("v"))
    found = correlated(numbered(parsed(rows).where("v is not null").select("session_id", "line_no", made.alias("events"), counts.alias("counts"))))
    found = found.select("session_id", "line_no", "seq", "kind", *_FIELDS)
    every = rows.select("session_id").distinct()
    has = found.groupBy("session_id").agg(F.bool_or(F.col("kind") == "session_start").alias("started"), F.count(F.lit(1)).alias("n"))
    has = every.join(has, "session_id", "left").select("session_id", F.coalesce("started", F.lit(False)).alias("started"), F.coalesce("n", F.lit(0)).alias("n"))
    empty = [F.lit(None).cast(t).alias(n) for n, t in _FIELDS.items()]
    first = has.where("not started").select("session_id", F.lit(-1).cast("long").alias("line_no"), F.lit(0).cast("long").alias("seq"), F.lit("session_start").alias("kind"), *empty)
    whole = found.unionByName(first).join(has.select("session_id", "started"), "session_id")
    place = F.row_number().over(W.partitionBy("session_id").orderBy("line_no", "seq")).cast("long")
    whole = whole.withColumn("seq", F.when(F.col("started"), F.col("seq")).otherwise(place)).drop("started")
    total = F.col("n") + (~F.col("started")).cast("int")
    last = has.select("session_id", F.lit(1 << 62).alias("line_no"), (total + 1).cast("long").alias("seq"), F.lit("session_end").alias("kind"), *empty)
    return canonical(_with_session(whole.unionByName(last), agent, sessions))


def role_unknown(rows: DataFrame) -> DataFrame:
    odd = F.when(F.col("v").isNull(), 1).otherwise(_role(F.col("v"))[2])
    return parsed(rows).groupBy("session_id").agg(F.sum(odd).cast("long").alias("unknown_event_types"))


# ---- documents: sessions, messages and parts in files of their own ----------------------------------

PART_SILENT = ("reasoning", "step-start", "step-finish", "patch", "Unknown")


def from_documents(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """sessions (session_id, v), messages (session_id, file, v), parts (message_id, file, v)."""
    created = _get(F.col("m"), "$.time.created", "bigint")
    m = messages.select("session_id", F.col("file").alias("m_file"), F.col("v").alias("m")).withColumns({"message_id": F.coalesce(_get(F.col("m"), "$.id"), F.lit("")), "role": F.coalesce(_get(F.col("m"), "$.role"), F.lit("")), "created": F.coalesce(created, F.lit(0)), "ts": F.when(created != 0, iso_from_millis(created))})
    p = parts.select(F.col("message_id"), F.col("file").alias("p_file"), F.col("v").alias("p")).withColumn("p_id", F.coalesce(_get(F.col("p"), "$.id"), F.lit("")))
    joined = m.join(p, "message_id", "left")
    kind, text = F.coalesce(_get(F.col("p"), "$.type"), F.lit("")), F.coalesce(_get(F.col("p"), "$.text"), F.lit(""))
    tool = F.coalesce(_get(F.col("p"), "$.tool"), F.lit("unknown"))
    output = F.nullif(F.coalesce(_text(_get(F.col("p"), "$.state.output", "variant")), F.lit("")), F.lit(""))
    failed = F.coalesce(_text(_get(F.col("p"), "$.state.error", "variant")), F.lit("")) != ""
    role, ts = F.col("role"), F.col("ts")
    said = (kind == "text") & (text != "")
    event = (
        F.when((role == "user") & said, _event("user_message", ts=ts, owner=F.lit("user"), message=text))
        .when((role == "user") & (kind == "tool"), _event("tool_result", ts=ts, tool=tool, output=output, exit_code=F.when(failed, 1)))
        .when((role == "assistant") & said, _event("assistant_message", ts=ts, owner=F.lit("assistant"), message=text))
        .when((role == "assistant") & (kind == "tool"), _event("tool_call", ts=ts, tool=tool, input=tool_input(_get(F.col("p"), "$.state.input", "variant"))))
        .when((role == "tool") & (kind == "tool"), _event("tool_result", ts=ts, tool=tool, output=output))
    )
    order = ["created", "m_file", "late", "p_id", "p_file"]
    emitted = joined.withColumn("e", event).withColumn("late", F.lit(0))
    found = emitted.where("e is not null").select("session_id", *order, "e.*")
    spoke = emitted.groupBy("session_id", "message_id", "m_file", "role", "created", "ts").agg(F.count("e").alias("n"))
    empty = spoke.where("role = 'user' and n = 0").select("session_id", "created", "m_file", F.lit(1).alias("late"), F.lit("").alias("p_id"), F.lit("").alias("p_file"), _event("user_message", ts=ts, owner=F.lit("user"), message=F.lit("")).alias("e"))
    found = found.unionByName(empty.select("session_id", *order, "e.*"))
    started = sessions.select("session_id", iso_from_millis(_get(F.col("v"), "$.time.created", "bigint")).alias("ts"))
    ends = found.select("session_id").distinct().join(started, "session_id", "left")
    end = ends.select("session_id", F.lit(1 << 62).alias("created"), F.lit("").alias("m_file"), F.lit(2).alias("late"), F.lit("").alias("p_id"), F.lit("").alias("p_file"), _event("session_end", ts=F.col("ts")).alias("e"))
    return canonical(contiguous(found.unionByName(end.select("session_id", *order, "e.*")), *order))


def documents_unknown(messages: DataFrame, parts: DataFrame) -> DataFrame:
    role = F.coalesce(_get(F.col("v"), "$.role"), F.lit(""))
    m = messages.select("session_id", F.coalesce(_get(F.col("v"), "$.id"), F.lit("")).alias("message_id"), role.alias("role"))
    kind = F.coalesce(_get(F.col("v"), "$.type"), F.lit(""))
    odd = parts.join(m, "message_id").where(F.col("role").isin("user", "assistant") & ~kind.isin("text", "tool", *PART_SILENT)).select("session_id")
    odd = odd.unionByName(m.where(~F.col("role").isin("user", "assistant", "tool")).select("session_id"))
    counts = odd.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return m.select("session_id").distinct().join(counts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("unknown_event_types"))
