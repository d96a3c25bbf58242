"""JSON Schemas of manifests and incidents, made from the field tables, and a check against any schema's text.

The check knows type, enum, const, required, properties, additionalProperties, items, pattern, minLength,
minimum, maximum, and references into `$defs`; what it doesn't know it passes.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import SchemaError
from .operators import incidents, manifest

NAMES = ("bundle-manifest-1.json", "agent-incident-1.json")
_KINDS = {"string": "string", "boolean": "boolean", "bigint": "integer", "array<string>": "array"}
_HEX = "^[0-9a-f]{64}$"


def _object(fields: str, required=(), nullable: bool = True) -> dict:
    kinds = dict(f.split(":") for f in fields.split(","))
    made = {n: {"type": [_KINDS[k], "null"] if nullable and n not in required else _KINDS[k]} for n, k in kinds.items()}
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": made}


def bundle_manifest() -> dict:
    parts = {name: _object(fields) for name, fields in manifest.OBJECTS.items()}
    parts["source"]["properties"] |= {"agent": {"enum": list(manifest.AGENTS)}, "session_ref_status": {"enum": list(manifest.REF_STATUSES)}}
    parts["reproduction"]["properties"]["classification"] = {"enum": list(manifest.CLASSIFICATIONS)}
    file = _object("path:string,role:string,media_type:string,bytes:bigint,sha256:string", ("path", "role", "bytes", "sha256"))
    file["properties"] |= {"role": {"enum": list(manifest.ROLES)}, "sha256": {"type": "string", "pattern": _HEX}, "bytes": {"type": "integer", "minimum": 0}}
    head = {"$schema": {"type": "string"}, "manifest_version": {"type": "string", "pattern": r"^1\.[0-9]+$"}, "bundle_id": {"type": "string", "pattern": "^bnd_"}, "created_at": {"type": "string", "minLength": 1}}
    need = ["manifest_version", "bundle_id", "created_at", *parts, "files"]
    return {"title": "Bundle manifest", "type": "object", "additionalProperties": False, "required": need, "properties": head | parts | {"files": {"type": "array", "items": file}}}


def agent_incident() -> dict:
    inside = {}
    for name, fields in incidents.KNOWN_INSIDE.items():
        made = {f: {"type": "string"} for f in fields}
        inside[name] = {"type": "object", "required": list(incidents.REQUIRED[name]), "properties": made}
    inside["detector"]["properties"] |= {"threshold": {"type": "integer"}, "observed": {"type": "number"}}
    rest = {
        "schema_version": {"type": "string", "pattern": r"^1\.[0-9]+$"}, "incident_id": {"type": "string"}, "severity": {"enum": list(incidents.SEVERITIES)}, "status": {"enum": list(incidents.STATUSES)},
        "evidence_refs": {"type": "array", "items": {"type": "object", "required": ["type"]}},
    }
    return {"title": "Agent incident", "type": "object", "required": list(incidents.REQUIRED[""]), "properties": rest | inside}


def load(name: str, folder: str | None = None) -> dict:
    """A schema by name: from a folder where one is given and holds it, else the engine's own."""
    if folder and (file := Path(folder, name)).is_file():
        try:
            return json.loads(file.read_text(encoding="utf-8"))
        except ValueError as problem:
            raise SchemaError(f"{name} is not JSON: {problem}") from problem
    made = dict(zip(NAMES, (bundle_manifest, agent_incident))).get(name)
    if made is None:
        raise SchemaError(f"no schema named {name}", "E_SCHEMA_NOT_FOUND")
    return made()


def add(bundles: DataFrame, folder: str | None = None) -> DataFrame:
    """Payload rows (bundle_id, path, role, content) that put both schemas into every bundle."""
    listed = [F.struct(F.lit(f"schemas/{n}").alias("path"), F.lit("schema").alias("role"), F.lit(json.dumps(load(n, folder), indent=2)).cast("binary").alias("content")) for n in NAMES]
    return bundles.select("bundle_id", F.explode(F.array(*listed)).alias("x")).select("bundle_id", "x.*")


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def check(schema, value, at: str = "$", root: dict | None = None) -> list[str]:
    """What the schema forbids in a value."""
    if schema is True or not isinstance(schema, dict):
        return [f"{at} is not allowed"] if schema is False else []
    root = schema if root is None else root
    if str(ref := schema.get("$ref", "")).startswith("#/"):
        inner = root
        for part in ref[2:].split("/"):
            inner = inner.get(part, {})
        return check(inner, value, at, root)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at} is not of type {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at} is not one of {schema['enum']}")
    if "const" in schema and value != schema["const"]:
        found.append(f"{at} is not {schema['const']!r}")
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at} does not match {schema['pattern']}")
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at} is too short")
    elif _is(value, "number"):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            found.append(f"{at} is out of range")
    elif isinstance(value, dict):
        found += [f"{at}.{n} is required" for n in schema.get("required", []) if n not in value]
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        for n, x in value.items():
            found += check(known[n] if n in known else rest, x, f"{at}.{n}", root)
    elif isinstance(value, list) and "items" in schema:
        for n, x in enumerate(value):
            found += check(schema["items"], x, f"{at}[{n}]", root)
    return found


def against_files(members: DataFrame) -> DataFrame:
    """(bundle, name, message) of what the schemas inside bundles forbid in their manifest and incident; a bundle is bounded by its payload limit."""
    pairs = {"manifest.json": f"schemas/{NAMES[0]}", "incident.json": f"schemas/{NAMES[1]}"}
    other = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    told = members.where(F.col("name").isin(*pairs)).select("bundle", "name", F.element_at(other, F.col("name")).alias("schema"), F.col("content").cast("string").alias("text"))
    rules = members.where(F.col("name").isin(*pairs.values())).select("bundle", F.col("name").alias("schema"), F.col("content").cast("string").alias("rules"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for bundle, name, text, schema in zip(frame["bundle"], frame["name"], frame["text"], frame["rules"]):
                try:
                    value, rule = json.loads(text), json.loads(schema)
                except (TypeError, ValueError, RecursionError):
                    continue  # what can't be parsed is told elsewhere
                out += [(bundle, name, m) for m in check(rule, value)]
            yield pd.DataFrame(out, columns=["bundle", "name", "message"], dtype=object)

    return told.join(rules, ["bundle", "schema"]).select("bundle", "name", "text", "rules").mapInPandas(run, "bundle string, name string, message string")
