"""Column expressions on texts, without Python code in the tasks."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: every ASCII character that is no digit and no letter a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a text of ASCII characters only takes the fast way."""
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(folded)


def plain_words(text: Column) -> Column:
    """Lower-case words of digits, letters a-z and characters beyond ASCII; a null has none."""
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_id() -> Column:
    """One number for a row of documents: rows with the same id and text share it."""
    return F.xxhash64("doc_id", "text")
