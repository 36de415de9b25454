"""Table schemas, the fact vocabulary and the JSON Schema mapping."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import small_table

# --- fixed values: they must equal what users of the data model already store -----------------

ENTITY_TYPES = ("person", "company", "project", "event")

FACT_TYPES = {
    "AFFILIATED": [
        "employee", "contractor", "advisor", "board_member", "founder", "investor",
        "legal_counsel", "consultant", "owner", "contributor", "reviewer", "stakeholder",
        "subsidiary", "sub_project", "other",
    ],
    "ASSERTED": [
        "commitment", "promise", "decision", "evaluation", "opinion", "concern", "blocker",
        "request", "update", "risk", "goal", "reference", "other",
    ],
    "TRANSITIONED": [
        "status_change", "stage_change", "role_change", "ownership_change", "resolution",
        "completion", "cancellation", "other",
    ],
}
ALIAS_LABEL = "IDENTIFIED_AS"
SUPERSEDING_LABELS = ("AFFILIATED", "ASSERTED")
EXPIRING_TYPES = ("commitment", "promise")
OP_AREAS = ("reality", "intention")
CONFIDENCES = ("inferred", "stated", "verified", "retracted")
CLASSIFICATIONS = ("relevant", "noise", "pending_triage", "triaging", "uncertain")
DEFAULT_TIMEZONE = "America/Los_Angeles"

# --- end of fixed values ----------------------------------------------------------------------

ENTITIES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Sources of a fact are rows of their own, not an array on the fact: a fact that very many records
# confirm must not become one huge row.
FACTS = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("to_day", T.DateType()),
        T.StructField("edge_label", T.StringType()),
        T.StructField("fact_type", T.StringType()),
        T.StructField("fact", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("source_record", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_at", T.TimestampType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("stale", T.BooleanType()),
        T.StructField("replaced_by", T.StringType()),
        T.StructField("valid_until", T.DateType()),
        T.StructField("op_area", T.StringType()),
    ]
)

FACT_SOURCES = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("confidence", T.StringType()),
    ]
)

ALIASES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("surface_form", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("source_record", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("expert_name", T.StringType()),
        T.StructField("expert_version", T.StringType()),
        T.StructField("indexed", T.BooleanType()),
        T.StructField("classification", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("human_context", T.StringType()),
    ]
)


def vocabulary(spark: SparkSession, additions: DataFrame | None = None) -> DataFrame:
    """(edge_label, fact_type) pairs: the anchors, plus a deployment's own types.

    Additions under a label that is not an anchor label are left out, and a type that is already
    there is kept once.
    """
    rows = [(label, name) for label, names in FACT_TYPES.items() for name in names]
    base = small_table(spark, rows, "edge_label string, fact_type string")
    if additions is None:
        return base
    allowed = additions.select("edge_label", "fact_type").filter(
        F.col("edge_label").isin(*FACT_TYPES) & F.col("fact_type").isNotNull()
    )
    return base.unionByName(allowed).distinct()


_SCALARS = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "number": T.DecimalType(38, 18),
    "boolean": T.BooleanType(),
}


def _field_type(spec: dict) -> T.DataType:
    kind = spec.get("type", "string")
    if kind == "array":
        return T.ArrayType(_field_type(spec.get("items", {})))
    if kind == "object":
        return T.MapType(T.StringType(), T.StringType())
    return _SCALARS.get(kind, T.StringType())


def struct_from_json_schema(schema: dict) -> T.StructType:
    """The Spark schema of a declared record type."""
    required = set(schema.get("required", ()))
    return T.StructType(
        [
            T.StructField(name, _field_type(spec), name not in required)
            for name, spec in schema.get("properties", {}).items()
        ]
    )


def schema_fingerprint(schema: dict) -> str:
    """Changes exactly when the declared schema changes; independent of key order."""
    return hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()[:16]


# Declared record types.  --- fixed values ---
RECORD_TYPES = {
    "email": {
        "type": "object",
        "properties": {
            name: {"type": "string"}
            for name in "message_id thread_id sender recipients subject body received_at".split()
        },
        "required": ["message_id", "sender", "subject", "body"],
    },
    "linear_issue": {
        "type": "object",
        "properties": {
            **{
                name: {"type": "string"}
                for name in (
                    "linear_id identifier title description status priority assignee project"
                ).split()
            },
            "labels": {"type": "array", "items": {"type": "string"}},
            "comments": {"type": "array", "items": {"type": "object"}},
            **{
                name: {"type": "string"}
                for name in "url linear_created_at linear_updated_at".split()
            },
        },
        "required": ["linear_id", "title"],
    },
    "linear_issue_change": {
        "type": "object",
        "properties": {
            name: {"type": "string"}
            for name in (
                "issue_record_id field from_value to_value linear_history_id changed_by changed_at"
            ).split()
        },
        "required": ["issue_record_id", "field", "changed_at"],
    },
    "github_pr": {
        "type": "object",
        "properties": {
            "github_id": {"type": "integer"},
            "number": {"type": "integer"},
            **{
                name: {"type": "string"}
                for name in "title body state author branch base_branch".split()
            },
            "labels": {"type": "array", "items": {"type": "string"}},
            "reviewers": {"type": "array", "items": {"type": "string"}},
            **{name: {"type": "string"} for name in "url created_at updated_at merged_at".split()},
        },
        "required": ["github_id", "number", "title"],
    },
    "github_issue": {
        "type": "object",
        "properties": {
            "github_id": {"type": "integer"},
            "number": {"type": "integer"},
            **{name: {"type": "string"} for name in "title body state author".split()},
            "assignees": {"type": "array", "items": {"type": "string"}},
            "labels": {"type": "array", "items": {"type": "string"}},
            **{name: {"type": "string"} for name in "url created_at updated_at closed_at".split()},
        },
        "required": ["github_id", "number", "title"],
    },
}
