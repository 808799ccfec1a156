"""The property graph's schema: node labels with their columns, and the edge tables between labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Labels, their columns besides the key `id`, and the edge tables.
_SYMBOL = "name string, qualified_name string"
_LINES = f"{_SYMBOL}, start_line long, end_line long, visibility string"
NODE_COLUMNS = {
    "Directory": "path string, name string",
    "File": "path string, name string, extension string, size_bytes long",
    "Module": _SYMBOL,
    "Function": f"{_LINES}, is_async boolean",
    "Method": f"{_LINES}, is_async boolean, receiver_type string",
    "Struct": _LINES,
    "Enum": _LINES,
    "Variant": _SYMBOL,
    "Trait": _LINES,
    "Field": "name string, type_annotation string, visibility string",
    "Constant": f"{_SYMBOL}, type_annotation string",
    "TypeAlias": f"{_SYMBOL}, target_type string",
    "Import": "path string, alias string, is_glob boolean",
    "CallSite": "callee_name string, line long, col long",
    "Community": "name string, algorithm string, resolution_param double, member_count long, modularity_contribution double",
    "Process": "name string, entry_point_id string, entry_kind string, entry_confidence double, depth long, symbol_count long",
    "StdlibSymbol": "name string, language string, receiver_type string, canonical_path string",
}
_TYPES = ["Struct", "Enum", "Trait", "TypeAlias"]
#: (kind, labels of the from end, labels of the to end)
_EDGES = [
    ("Contains", ["Directory"], ["File", "Directory"]),
    ("Contains", ["File"], ["Module"]),
    ("Defines", ["File", "Module"], ["Function", "Struct", "Enum", "Trait", "Constant", "TypeAlias", "Import"]),
    ("HasMethod", ["Struct", "Enum", "Trait"], ["Method"]),
    ("HasField", ["Struct", "Enum"], ["Field"]),
    ("HasVariant", ["Enum"], ["Variant"]),
    ("Imports", ["File"], ["File", "Module", "Function", "Method", "Struct", "Enum", "Trait", "Constant", "TypeAlias"]),
    ("Imports", ["Module"], ["Function", "Struct", "Enum", "Trait", "Constant", "TypeAlias"]),
    ("Calls", ["Function", "Method"], ["Function", "Method", "StdlibSymbol"]),
    ("Implements", ["Struct", "Enum"], ["Trait", "StdlibSymbol"]),
    ("Extends", ["Trait"], ["Trait"]),
    ("Uses", ["Function", "Method", "Field"], _TYPES),
    ("Uses", ["Struct"], ["Struct", "Enum", "Trait"]),
    ("MemberOf", ["Function", "Method", "Struct", "Enum", "Trait", "Constant", "TypeAlias", "Module"], ["Community"]),
    ("EntryPointOf", ["Function", "Method"], ["Process"]),
    ("ParticipatesIn", ["Function", "Method"], ["Process"]),
]
EDGE_PROPERTIES = {
    **dict.fromkeys(["Imports", "Calls", "Implements", "Extends", "Uses"], "confidence double, resolution_method string"),
    "EntryPointOf": "confidence double",
    "ParticipatesIn": "depth long",
}
#: Labels that searches, clusters and contexts are about, in the order in which lookups prefer them.
SEARCHABLE = ["Function", "Method", "Struct", "Enum", "Trait", "Constant", "TypeAlias", "Module"]


def _rel(kind: str, a: str, b: str) -> str:
    short = lambda label: "Dir" if label == "Directory" and kind == "Contains" else label
    return f"{kind}_{short(a)}_{short(b)}"


LABELS = list(NODE_COLUMNS)
#: name of an edge table: (kind, from label, to label)
REL_TABLES = {_rel(kind, a, b): (kind, a, b) for kind, froms, tos in _EDGES for a in froms for b in tos}


_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _fields(ddl: str) -> list[T.StructField]:
    return [T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(","))]


def _all_columns() -> dict[str, T.DataType]:
    out: dict[str, T.DataType] = {"id": T.StringType(), "label": T.StringType()}
    for ddl in NODE_COLUMNS.values():
        for f in _fields(ddl):
            out.setdefault(f.name, f.dataType)
    return out


def columns_of(label: str) -> list[str]:
    return ["id", *(f.name for f in _fields(NODE_COLUMNS[label]))]


#: One table holds the nodes of all labels; a label's view has its own columns only. file: where a symbol stands.
NODES = T.StructType([T.StructField(n, k) for n, k in _all_columns().items()] + [T.StructField("file", T.StringType())])
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("rel", "kind", "from_label", "from_id", "to_label", "to_id")] + [T.StructField("confidence", T.DoubleType()), T.StructField("resolution_method", T.StringType()), T.StructField("depth", T.LongType())])


def rel_tables(spark: SparkSession) -> DataFrame:
    """The edge tables as a table: rel, kind, from_label, to_label. It has a fixed number of rows."""
    return spark.createDataFrame([(r, *x) for r, x in REL_TABLES.items()], "rel string, kind string, from_label string, to_label string")
