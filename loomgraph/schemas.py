"""Schemas of the event envelope, of its payloads, of the graph's tables and of entities."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"array<string>": T.ArrayType(T.StringType()), "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def _struct(spec: str) -> T.StructType:
    """`name type, name type`, without needing a session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in spec.split(", "))])


ENVELOPE = _struct("id string, type string, timestamp bigint, source string, pid bigint, session_id string, payload string, uid bigint, project_id string")

#: Payload columns by event type; other types keep their payload as text.
PAYLOADS = {
    "file.opened": _struct("path string, app_id string, flags bigint"),
    "window.focused": _struct("app_id string, window_title string, prev_app_id string"),
    "window.minimized": _struct("window_id string, app_id string, window_title string, workspace_id string"),
    "window.unminimized": _struct("window_id string, app_id string"),
    **dict.fromkeys(("clipboard.copy", "clipboard.paste"), _struct("source_app_id string, dest_app_id string, mime_type string, operation string")),
    "app.action": _struct("category string, action string, subject string, metadata map<string,string>"),
    **dict.fromkeys(("process.started", "process.exited"), _struct("event_type string, pid bigint, ppid bigint, comm string, exit_code bigint")),
    **dict.fromkeys(("network.connect", "network.accept"), _struct("app_id string, remote_addr string, protocol string, direction string")),
    "project.created": _struct("project_id string, name string, root_path string, inferred boolean, confidence bigint"),
    "project.updated": _struct("project_id string, name string, description string, accent_color string, icon string, status string"),
    "project.archived": _struct("project_id string, name string, root_path string"),
    "focus.activated": _struct("project_id string, project_name string, root_path string, accent_color string, suppress_notifications_from array<string>"),
    "focus.deactivated": _struct("project_id string, duration_seconds bigint"),
    "app.presence.set": _struct("app_id string, activity string, subject string, project string, auto_clear string, metadata map<string,string>"),
    "app.presence.clear": _struct("app_id string"),
    "app.timeline.record": _struct("app_id string, label string, subject string, type string, started_at bigint, ended_at bigint, metadata map<string,string>"),
    "app.annotation.set": _struct("app_id string, namespace string, target_type string, target_id string, data_json string"),
    "app.annotation.cleared": _struct("app_id string, namespace string, target_type string, target_id string"),
}

NODES = {
    "File": _struct("id string, path string, app_id string, last_accessed bigint"),
    "App": _struct("id string, name string"),
    "Session": _struct("id string, started_at bigint"),
    "Event": _struct("id string, type string, timestamp bigint, source string, title string"),
    "UserAction": _struct("id string, category string, action string, subject string, timestamp bigint"),
    "Project": _struct("id string, name string, description string, root_path string, accent_color string, icon string, status string, created_at bigint, last_accessed bigint, inferred boolean, confidence bigint, promoted boolean, archived_at bigint"),
    "Directory": _struct("id string, path string, name string, project_id string, created_at bigint"),
    "Annotation": _struct("id string, namespace string, target_type string, target_id string, data string, created_at bigint, last_modified bigint"),
    "Summary": _struct("id string, type string, app_id string, access_count bigint, primary_application string, active_period_start bigint, active_period_end bigint"),
    "PinnedMarker": _struct("id string, node_id string, node_type string, pinned_at bigint"),
}
EDGE = _struct("src_id string, dst_id string")
EDGES = {"ACCESSED_BY": ("File", "App"), "ACTIVE_IN": ("App", "Session"), "EMITTED_BY": ("Event", "App"), "DERIVED_FROM": ("UserAction", "Event"), "FILE_PART_OF": ("File", "Project"), "DIR_PART_OF": ("Directory", "Project"), "SUMMARIZES": ("Summary", "App")}

ENTITY = _struct("id string, _type string, _owner string, _version bigint, _created_at timestamp, _modified_at timestamp, _deleted boolean, _deleted_at timestamp, _pending_delete boolean, _pending_delete_at timestamp")

#: Types that several apps share.
SHARED = {
    "Person": _struct("name string, email string, phone string, organization string, notes string"),
    "Organization": _struct("name string, domain string, description string"),
    "Event": _struct("title string, start timestamp, end timestamp, location string, description string"),
    "Location": _struct("name string, address string, latitude double, longitude double, place_id string"),
    "Tag": _struct("name string, color string"),
}

#: Spark type of each declared field type; what travels as text stays text.
FIELD_TYPES = {
    **dict.fromkeys("string text datetime date duration url email path markdown color bytes uuid".split(), "string"),
    "int": "bigint", "float": "double", "bool": "boolean", "json": "variant",
    "string[]": "array<string>", "int[]": "array<bigint>", "float[]": "array<double>", "bool[]": "array<boolean>",
}
