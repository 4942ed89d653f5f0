"""Data model: the five tables, their field order and types, and fixed values.

Raw tables hold STRING columns, as read from the markup. The typed layer is made by
``operators.validate`` with ``try_cast``, never while scanning.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------
# Field order of the five tables, which is also the CSV header order.
NODE_FIELDS = ("id", "lat", "lon", "user", "uid", "version", "changeset", "timestamp")
NODE_TAG_FIELDS = ("id", "key", "value", "type")
WAY_FIELDS = ("id", "user", "uid", "version", "changeset", "timestamp")
WAY_NODE_FIELDS = ("id", "node_id", "position")
WAY_TAG_FIELDS = ("id", "key", "value", "type")

# Elements that own children, in the sense of the document model.
TOP_LEVEL = ("node", "way", "relation")
SHAPED = ("node", "way")
# Elements that belong to one of these.
CHILDREN = ("tag", "nd", "member")

# A key with any of these characters is a problem key.
PROBLEM_CHARS = r"""[=\+/&<>;'"\?%#$@\,\. \t\r\n]"""

# Type given to a tag whose key is not split.
REGULAR = "regular"

# Key classes in order of precedence.
KEY_CLASSES = ("lower", "lower_colon", "problemchars", "other")

# Street types that need no correction.
EXPECTED_STREET_TYPES = (
    "Street", "Avenue", "Boulevard", "Drive", "Court", "Place", "Square", "Lane",
    "Road", "Trail", "Parkway", "Commons", "Circle", "Trace", "Suite",
)

# First characters of a phone value that is to be reformatted.
PHONE_STARTS = ("6", "7", "4", "(")

# Prefix of the audited post codes.
AUDITED_POSTCODE_PREFIX = "300"

# Every k-th top-level element goes into a sample.
SAMPLE_STEP = 10
# ----------------------------------------------------------------------------------

# Attributes the scan turns into columns; any other attribute is dropped.
ATTRIBUTES = NODE_FIELDS + ("k", "v", "ref", "type", "role")

_TYPES = {
    "integer": T.LongType(),
    "position": T.IntegerType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
}


def _kinds(fields: tuple[str, ...], **special: str) -> dict[str, str]:
    return {f: special.get(f, "string") for f in fields}


# Declared kind of every field; every field is required.
TABLE_KINDS: dict[str, dict[str, str]] = {
    "nodes": _kinds(NODE_FIELDS, id="integer", lat="float", lon="float", uid="integer",
                    changeset="integer"),
    "nodes_tags": _kinds(NODE_TAG_FIELDS, id="integer"),
    "ways": _kinds(WAY_FIELDS, id="integer", uid="integer", changeset="integer"),
    "ways_nodes": _kinds(WAY_NODE_FIELDS, id="integer", node_id="integer", position="position"),
    "ways_tags": _kinds(WAY_TAG_FIELDS, id="integer"),
}

TABLES = tuple(TABLE_KINDS)


# The same as a declared record: an element holds one record of its own and lists of records, all fields required.
RECORDS = {
    name: {
        "type": "list" if name in ("nodes_tags", "ways_nodes", "ways_tags") else "dict",
        "schema": {field: {"type": kind, "required": True} for field, kind in kinds.items()},
    }
    for name, kinds in TABLE_KINDS.items()
}


def spark_type(kind: str) -> T.DataType:
    return _TYPES[kind]


def typed_schema(table: str) -> T.StructType:
    """Schema of the typed layer of ``table``."""
    return T.StructType([T.StructField(f, _TYPES[k]) for f, k in TABLE_KINDS[table].items()])


def raw_schema(table: str) -> T.StructType:
    """Schema of the raw layer of ``table``: text only."""
    return T.StructType([T.StructField(f, T.StringType()) for f in TABLE_KINDS[table]])
