"""Table schemas and the ordered enumerations they use."""

from pyspark.sql import types as T

# The enumerations, in canonical order. The order is semantic
# (reports sort by it and "highest severity" is decided by it).
CATEGORIES = (
    "root",
    "play_integrity",
    "mtd_rasp",
    "app_hardening",
    "anti_tamper",
    "anti_hooking",
    "anti_emulator",
    "clone_repackage",
    "app_defense",
)
SEVERITIES = ("info", "low", "medium", "high", "critical")
BEHAVIORS = ("process_kill", "hard_block", "soft_block", "log_only", "unknown")
BLOCKING_BEHAVIORS = ("process_kill", "hard_block", "soft_block")
KINDS = ("dex_string", "manifest", "native_lib_name", "native_symbol", "zip_entry")
VERDICTS = ("triggered", "not_triggered", "unknown")
DIFF_STATUSES = ("added", "removed", "unchanged")
# Categories that describe the artifact itself, not the environment it runs in.
ARTIFACT_SIDE_CATEGORIES = ("app_hardening", "anti_tamper")

DEFAULT_BEHAVIOR = "unknown"
EVIDENCE_CAP = 3
MAX_TOTAL_BYTES = 256 * 1024 * 1024
MAX_CONTAINERS = 10
PREVIEW_CHARS = 200


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

RULE = _struct(
    ("id", _S),
    ("name", _S),
    ("category", _S),
    ("severity", _S),
    ("behavior", _S),
    ("evidence_location", _S),
    ("patterns", T.ArrayType(_S)),
    ("is_regex", _B),
    ("description", _S),
    ("guidance_key", _S),
)
EVIDENCE = _struct(
    ("artifact_id", _S),
    ("kind", _S),
    ("container", _S),
    ("container_ord", _L),
    ("ordinal", _I),
    ("value", _S),
)
ENTRIES = _struct(
    ("artifact_id", _S),
    ("entry_ord", _L),
    ("name", _S),
    ("compressed_size", _L),
    ("uncompressed_size", _L),
    ("is_compressed", _B),
)
MANIFEST_ELEMENTS = _struct(
    ("artifact_id", _S),
    ("elem_ord", _L),
    ("tag", _S),
    ("attrs", T.ArrayType(_struct(("k", _S), ("v", _S)))),
)
FINDING = _struct(
    ("artifact_id", _S),
    ("rule_id", _S),
    ("rule_name", _S),
    ("category", _S),
    ("severity", _S),
    ("behavior", _S),
    ("evidence", _S),
    ("guidance_key", _S),
)
CONDITION = _struct(
    ("rule_id", _S),
    ("row_no", _I),
    ("fields", T.MapType(_S, _B)),
    ("verdict", _S),
    ("detail", _S),
)
HISTORY = _struct(("label", _S), ("path", _S), ("report", _S), ("created_at", _L))
