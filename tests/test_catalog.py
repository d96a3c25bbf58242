import pytest

from logbrook.plans import catalog

DATA = "/root/testdata/sf0.001"

QUICK = [
    "pattern_match_counts", "match_positions", "redact_stable_placeholder", "redact_custom_pattern", "placeholder_locations", "residual_scan", "normalize_block_seq", "session_stats", "discover_last", "discover_substring", "session_message_part_join",
    "safe_tool_input", "malformed_json", "incident_projection", "incident_version_gate", "incident_schema_check", "incident_session_theta", "hard_deny_paths", "path_policy_codes", "binary_sniff", "evidence_index", "manifest_files", "checksums_text",
    "capabilities_flags", "manifest_build", "manifest_validate", "header_safety", "inventory_anti_joins", "checksum_verify", "verify_rollup", "required_members", "payload_overlay", "human_size", "reproduction_class",
    "json_leaf_redaction", "change_snippets", "rollout_events", "checksum_file_lines", "report_member_issues", "deny_member_issues", "residual_member_issues", "stream_window_counts",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, DATA), catalog.ORACLE[name])


def test_every_query_but_the_json_sink_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"jsonl_sink"}


def test_jsonl_sink_equals_plain_json(spark, duck):
    import json

    found = {}
    for r in catalog.jsonl_sink(spark, DATA).collect():
        found.setdefault(r.session_id, {})[r.seq] = json.loads(r.line)
    turns = {}
    for conv, turn, role, text in duck.execute("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        turns.setdefault(f"conv-{conv}", []).append((role, text))
    assert set(found) == set(turns)
    for session, said in turns.items():
        said = [(f"{r}_message", r, t[:16384]) for r, t in said if r != "system"]
        rows = [found[session][k] for k in sorted(found[session])]
        assert [x["seq"] for x in rows] == list(range(1, len(said) + 3)) and (rows[0]["kind"], rows[-1]["kind"]) == ("session_start", "session_end")
        assert [(x["kind"], x["owner"], x["message"]) for x in rows[1:-1]] == said and all(v is not None for x in rows for v in x.values())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
