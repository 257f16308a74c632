"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def ratio(top: Column, bottom: Column) -> Column:
    """Division as double; null when the divisor is zero or either part is null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def round_half_away(value: Column, digits: int = 0) -> Column:
    """Round to `digits` decimals, halves away from zero, staying in double."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.trim(text, F.lit(WHITE_SPACE))


def local_date(df: DataFrame, name: str, tz: str) -> Column:
    """Calendar date of column `name` in `tz`.

    A timestamp without zone is UTC wall-clock time; an instant is shifted from the session zone;
    a date stays as it is.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.col(name)
    source = F.lit("UTC") if isinstance(kind, T.TimestampNTZType) else F.current_timezone()
    return F.to_date(F.convert_timezone(source, F.lit(tz), F.col(name).cast("timestamp_ntz")))


def plain_date(df: DataFrame, name: str) -> Column:
    """Calendar date of column `name` in UTC. A bare cast where possible: scans can filter by it."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.to_date(name)
    return local_date(df, name, "UTC")


def json_items(df: DataFrame, name: str) -> Column:
    """Elements of the array in column `name`, for `json_object`; null if it holds no array.

    Elements of a document of text are texts, each parsed on its own: an odd one costs nothing
    but itself, and a document may be as long as a text may.
    """
    if isinstance(df.schema[name].dataType, T.VariantType):
        return F.try_variant_get(name, "$", "array<variant>")
    return F.from_json(F.col(name), "array<string>")


def json_object(df: DataFrame, name: str, schema: str) -> Column:
    """The element in column `name` as a struct of texts and arrays of texts.

    What is missing or of another kind is null. Of equal keys the last one counts. Numbers keep
    the text they are written with, but in a variant, which stores `1.0` as 1.
    """
    is_variant = isinstance(df.schema[name].dataType, T.VariantType)
    return F.from_json(F.to_json(name) if is_variant else F.col(name), schema)


def json_scalar(doc: Column, path: str) -> Column:
    """Text of the scalar at `path`; null for a missing value, a JSON null, an object or an array."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(~nested, F.try_variant_get(doc, path, "string"))


def json_texts(df: DataFrame, name: str, parent: str, keys: list[str]) -> list[Column]:
    """Texts of the scalars `keys` of the object `parent` in the documents of column `name`.

    A typed parse finds them in one pass, but shows a nested value as its text too; only where a
    text looks like one is the document parsed in full to tell.
    """
    if isinstance(df.schema[name].dataType, T.VariantType):
        return [json_scalar(F.col(name), f"$.{parent}.{key}").alias(key) for key in keys]
    inner = ",".join(f"{key}:string" for key in keys)
    parsed = F.from_json(F.col(name), f"struct<{parent}:struct<{inner}>>")
    return [_checked(parsed[parent][key], F.col(name), f"$.{parent}.{key}").alias(key) for key in keys]


def json_text(df: DataFrame, name: str, path: str) -> Column:
    """Text of the scalar at `path` in the documents of column `name`."""
    if isinstance(df.schema[name].dataType, T.VariantType):
        return json_scalar(F.col(name), path)
    return _checked(F.get_json_object(F.col(name), path), F.col(name), path)


def _checked(text: Column, doc: Column, path: str) -> Column:
    nested = text.startswith("{") | text.startswith("[")
    return F.when(nested, json_scalar(F.try_parse_json(doc), path)).otherwise(text)


def scalar_of(df: DataFrame, name: str, text: Column, path: str) -> Column:
    """`text` as found by `json_object` at `path` of column `name`; null for a nested value."""
    doc = F.col(name)
    if isinstance(df.schema[name].dataType, T.VariantType):
        doc = F.to_json(doc)
    return _checked(text, doc, path)
