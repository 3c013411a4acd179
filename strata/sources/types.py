"""Lake type names and Spark types, evolved read schemas, and default values."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Lake type to Spark type; an unknown name is read as a string.
SIMPLE = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "uint8": T.ShortType(), "int16": T.ShortType(),
    "uint16": T.IntegerType(), "int32": T.IntegerType(), "uint32": T.LongType(), "int64": T.LongType(),
    "uint64": T.DecimalType(20, 0), "int128": T.DecimalType(38, 0), "uint128": T.DecimalType(38, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "varchar": T.StringType(), "json": T.StringType(),
    "uuid": T.StringType(), "blob": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamp_s": T.TimestampNTZType(), "timestamp_ms": T.TimestampNTZType(), "timestamp_ns": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "variant": T.VariantType(), "geometry": T.BinaryType(),
    "timetz": T.StructType([T.StructField("micros", T.LongType()), T.StructField("offset_s", T.IntegerType())]),
    "interval": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
}
if hasattr(T, "TimeType"):
    SIMPLE["time"] = T.TimeType(6)
#: Types never kept inline.
NEVER_INLINE = ("variant", "geometry")
#: Reserved field id of the row id that rewritten files carry.
ROW_ID, ROW_ID_FIELD = "_strata_row_id", 2_000_000_000
_WIDER = {("int8", "int16"), ("int8", "int32"), ("int8", "int64"), ("int16", "int32"), ("int16", "int64"), ("int32", "int64"), ("uint8", "int32"), ("uint8", "int64"), ("uint16", "int64"), ("float32", "float64"), ("int32", "float64"), ("int16", "float64"), ("int8", "float64")}


def to_spark(name: str) -> T.DataType:
    """The Spark type of a lake type such as ``int32``, ``decimal(10,2)``, ``list<int32>``, ``map<varchar,int64>`` or ``struct<a:int32>``."""
    name = name.strip().lower()
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"(list|map|struct)<(.*)>", name):
        parts = _split(m[2])
        if m[1] == "list":
            return T.ArrayType(to_spark(parts[0]))
        if m[1] == "map":
            return T.MapType(to_spark(parts[0]), to_spark(parts[1]))
        return T.StructType([T.StructField(p.split(":", 1)[0], to_spark(p.split(":", 1)[1])) for p in parts])
    return SIMPLE.get(name, T.StringType())


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def from_spark(kind: T.DataType) -> str:
    """The lake type of a Spark type."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"list<{from_spark(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{from_spark(kind.keyType)},{from_spark(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"{f.name}:{from_spark(f.dataType)}" for f in kind) + ">"
    plain = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "float": "float32", "double": "float64", "string": "varchar", "varchar": "varchar", "char": "varchar", "binary": "blob", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}
    name = kind.typeName()
    if name.startswith("time("):
        return "time"
    return plain.get(name.split("(")[0], name)


def widens(old: str, new: str) -> bool:
    """Whether files of the old type can be read as the new one."""
    if old == new or (old, new) in _WIDER:
        return True
    a, b = re.fullmatch(r"decimal\((\d+),(\d+)\)", old), re.fullmatch(r"decimal\((\d+),(\d+)\)", new)
    return bool(a and b and int(b[2]) >= int(a[2]) and int(b[1]) - int(b[2]) >= int(a[1]) - int(a[2]))


def read_schema(columns: list[dict], row_id: bool = False) -> T.StructType:
    """The schema that reads files of all ages: matched by field id, absent columns filled with their first default."""
    fields = []
    for c in columns:
        meta: dict = {"parquet.field.id": c["column_id"]}
        if c["initial_default"] is not None:
            meta["EXISTS_DEFAULT"] = c["initial_default"]
        fields.append(T.StructField(c["column_name"], to_spark(c["column_type"]), True, meta))
    if row_id:
        fields.append(T.StructField(ROW_ID, T.LongType(), True, {"parquet.field.id": ROW_ID_FIELD}))
    return T.StructType(fields)
