"""Incident records: version gate, projection to known fields, schema check, session lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The fields that are copied.
KNOWN = ("$schema", "schema_version", "incident_id", "source", "detector", "timestamps", "evidence_refs", "severity", "status")
KNOWN_INSIDE = {
    "source": ("producer", "producer_version", "agent", "agent_version", "session_ref"),
    "detector": ("rule", "threshold", "observed", "details"),
    "timestamps": ("detected_at", "session_started_at", "session_ended_at"),
}
REQUIRED = {"": ("schema_version", "incident_id", "source", "detector", "timestamps"), "source": ("producer", "producer_version", "agent"), "detector": ("rule", "threshold", "observed"), "timestamps": ("detected_at",)}
SEVERITIES = ("info", "warning", "error", "critical")
STATUSES = ("open", "resolved", "false_positive")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def major(version: Column) -> Column:
    return F.split_part(version, F.lit("."), F.lit(1))


def gate(value: Column) -> Column:
    """The error code of a file's text, else null."""
    v = F.try_parse_json(value)
    version = F.coalesce(_get(v, "$.schema_version"), F.lit("0.0"))
    return F.when(value.isNull(), "E_INCIDENT_NOT_FOUND").when(v.isNull() | ~_kind(v).startswith("OBJECT"), "E_INCIDENT_MALFORMED").when(major(version) != "1", "E_SCHEMA_VERSION")


def _only(v: Column, names) -> Column:
    """An object's known fields; what is no object passes whole."""
    kept = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k.isin(*names))
    return F.when(_kind(v).startswith("OBJECT"), F.parse_json(F.to_json(kept))).otherwise(v)


def _evidence(v: Column) -> Column:
    refs = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda r: _kind(r).startswith("OBJECT"))
    safe = F.transform(refs, lambda r: F.struct(F.coalesce(_get(r, "$.type"), F.lit("unknown")).alias("type"), F.coalesce(_get(r, "$.description"), F.lit("")).alias("description")))
    return F.when(_kind(v).startswith("ARRAY"), F.parse_json(F.to_json(safe))).otherwise(v)


def project(v: Column) -> Column:
    """A map of the known fields, pruned inside, with what the import has to say."""

    def value(k: Column, x: Column) -> Column:
        out = F.when(k == "evidence_refs", _evidence(x))
        for name, inner in KNOWN_INSIDE.items():
            out = out.when(k == name, _only(x, inner))
        return out.otherwise(x)

    fields = F.try_variant_get(v, "$", "map<string,variant>")
    known = F.transform_values(F.map_filter(fields, lambda k, _: k.isin(*KNOWN)), value)
    told = F.parse_json(F.to_json(F.struct(unknown_fields(v).alias("unknown_optional_fields_ignored"), F.lit("not_provided").alias("session_ref_resolution"))))
    return F.map_concat(known, F.create_map(F.lit("import"), told))


def unknown_fields(v: Column) -> Column:
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.size(F.array_except(names, F.array(*[F.lit(k) for k in KNOWN]))).cast("long")


def getters(v: Column) -> dict[str, Column]:
    return {
        "incident_id": _get(v, "$.incident_id"), "producer": _get(v, "$.source.producer"), "agent": F.coalesce(_get(v, "$.source.agent"), F.lit("unknown")),
        "agent_version": _get(v, "$.source.agent_version"), "session_ref": _get(v, "$.source.session_ref"),
    }


def problems(v: Column) -> Column:
    """What the incident schema forbids, as an array of messages."""
    text = lambda p: _get(v, p, "variant")
    is_text = lambda p: _kind(text(p)) == "STRING"
    found = []
    for where, names in REQUIRED.items():
        for n in names:
            path = f"$.{where}.{n}" if where else f"$.{n}"
            outer = F.lit(True) if not where else text(f"$.{where}").isNotNull()
            found.append(F.when(outer & text(path).isNull(), F.lit(f"'{n}' is a required property")))
    for where in ("source", "detector", "timestamps"):
        found.append(F.when(text(f"$.{where}").isNotNull() & ~_kind(text(f"$.{where}")).startswith("OBJECT"), F.lit(f"'{where}' is not an object")))
    strings = ["$.incident_id", "$.schema_version", *[f"$.source.{n}" for n in KNOWN_INSIDE["source"]], "$.detector.rule", "$.detector.details", *[f"$.timestamps.{n}" for n in KNOWN_INSIDE["timestamps"]]]
    found += [F.when(text(p).isNotNull() & ~is_text(p), F.lit(f"'{p[2:]}' is not a string")) for p in strings]
    found.append(F.when(is_text("$.schema_version") & ~_get(v, "$.schema_version").rlike(r"^1\.[0-9]+$"), F.lit("'schema_version' does not match 1.N")))
    whole = _get(v, "$.detector.threshold", "double")
    found.append(F.when(text("$.detector.threshold").isNotNull() & (_kind(text("$.detector.threshold")).isin("STRING", "BOOLEAN", "VOID") | whole.isNull() | (whole != F.floor(whole))), F.lit("'detector.threshold' is not an integer")))
    found.append(F.when(text("$.detector.observed").isNotNull() & _kind(text("$.detector.observed")).isin("STRING", "BOOLEAN", "VOID"), F.lit("'detector.observed' is not a number")))
    found.append(F.when(text("$.severity").isNotNull() & ~F.coalesce(_get(v, "$.severity").isin(*SEVERITIES), F.lit(False)), F.lit("'severity' is not one of the known values")))
    found.append(F.when(text("$.status").isNotNull() & ~F.coalesce(_get(v, "$.status").isin(*STATUSES), F.lit(False)), F.lit("'status' is not one of the known values")))
    refs = F.coalesce(F.try_variant_get(v, "$.evidence_refs", "array<variant>"), F.array().cast("array<variant>"))
    found.append(F.when(F.exists(refs, lambda r: _get(r, "$.type").isNull()), F.lit("an evidence reference has no type")))
    return F.array_compact(F.array(*found))


def sessions_of(incidents: DataFrame, sessions: DataFrame) -> DataFrame:
    """incidents with the newest session whose id holds session_ref, and whether it was found.

    The lookup is by part of an id.  The parts of all ids that are as long as some reference meet the references
    in a hash join; a reference longer than every id finds nothing, so the lengths are as few as an id is long.
    """
    asked = incidents.where("session_ref is not null and session_ref <> ''")
    longest = sessions.agg(F.max(F.length("session_id"))).first()[0] or 0
    lengths = [r.n for r in asked.select(F.length("session_ref").alias("n")).where(F.col("n") <= longest).distinct().collect()]
    size = F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))
    cut = sessions.select("session_id", F.col("started_at").alias("_at"), size.alias("_n")).where(F.length("session_id") >= F.col("_n"))
    place = F.sequence(F.lit(1), F.length("session_id") - F.col("_n") + 1)
    parts = cut.select("session_id", "_at", F.explode(F.array_distinct(F.transform(place, lambda k: F.substr("session_id", k, F.col("_n"))))).alias("_ref"))
    first = W.partitionBy("_ref").orderBy(F.col("_at").desc_nulls_last(), "session_id")
    newest = parts.join(asked.select(F.col("session_ref").alias("_ref")).distinct(), "_ref", "left_semi").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    found = incidents.join(newest.select("_ref", "session_id"), F.col("session_ref") == F.col("_ref"), "left").drop("_ref")
    status = F.when(F.col("session_ref").isNull() | (F.col("session_ref") == ""), "not_provided").when(F.col("session_id").isNull(), "unresolved").otherwise("resolved")
    return found.withColumn("session_ref_status", status)
