"""Canonical JSON as columns: sorted keys, ``, `` and ``: `` between, nothing but control characters, quotes and backslashes escaped."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: short escapes of JSON.
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _quoted(text: Column) -> Column:
    out = text
    for raw, escaped in _SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for code in range(32):
        if chr(code) not in _SHORT:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def _listed(parts: Column, left: str, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(parts, ", "), F.lit(right))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The JSON of a column of type ``kind``; SQL null is ``null``.

    Structs and maps with text keys are objects, in the order of their keys' code points; decimals are texts, dates and times texts in ISO form. Floating-point
    numbers are refused: their shortest texts differ between languages.
    """
    if isinstance(kind, T.StructType):
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = _listed(F.array(*fields), "{", "}") if fields else F.lit("{}")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_quoted(k), F.lit(": "), canonical_json(value[k], kind.valueType)))
        out = _listed(entries, "{", "}")
    elif isinstance(kind, T.ArrayType):
        out = _listed(F.transform(value, lambda x: canonical_json(x, kind.elementType)), "[", "]")
    elif isinstance(kind, T.StringType):
        out = _quoted(value)
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = _quoted(value.cast("string"))
    elif isinstance(kind, T.DateType):
        out = _quoted(F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        out = _quoted(F.when(F.date_trunc("second", value) == value, whole).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_hash(value: Column, kind: T.DataType) -> Column:
    """sha256 of the canonical JSON, in hexadecimal digits."""
    return F.sha2(canonical_json(value, kind), 256)
