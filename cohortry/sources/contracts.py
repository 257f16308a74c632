"""What the input tables have to look like, and how others are made to.

Every column has a kind. A type that the kind accepts is left alone, so a table that is as declared is
read as it is, only without undeclared columns. Any other type is cast value by value. A row with a
value that cannot be cast is not guessed at: it is left out of the table and set aside with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    """Types that are fine as they are, and the type that values of others are cast to."""

    accepts: tuple[type[T.DataType], ...]
    cast: str | None


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Kinds. An id is a whole number; codes and names are text; a document is JSON as text or variant.
ID = Kind(WHOLE, "bigint")
COUNT = Kind(WHOLE, "bigint")
TEXT = Kind((T.StringType,), "string")
ANY_ID = Kind((*WHOLE, T.StringType), "string")
AMOUNT = Kind((*WHOLE, T.FloatType, T.DoubleType, T.DecimalType), "double")
MOMENT = Kind(MOMENTS, "timestamp")
FLAG = Kind((T.BooleanType,), "boolean")
DOCUMENT = Kind((T.StringType, T.VariantType), None)

CONTRACTS: dict[str, dict[str, Kind]] = {
    "users": {
        "id": ID,
        "email": TEXT,
        "created_from": ANY_ID,
        "created_at": MOMENT,
        "last_login": MOMENT,
        "is_certified": FLAG,
        "is_withdrawn": FLAG,
        "is_active": FLAG,
    },
    "user_info": {"user_id": ID, "country_code": TEXT, "gender_type": ANY_ID, "birth": MOMENT},
    "order_mart": {
        "user_id": TEXT,
        "order_no": ANY_ID,
        "total_revenue": AMOUNT,
        "event_id": TEXT,
        "option_code": TEXT,
        "order_qty": COUNT,
        "ip_name": TEXT,
        "market_type": TEXT,
        "data_source": TEXT,
        "pay_date": MOMENT,
    },
    "event_mart": {"event_id": TEXT, "artist_id": ID, "album_name": TEXT},
    "commerce_orders": {
        "id": ID,
        "user_id": ANY_ID,
        "order_number": TEXT,
        "order_status": COUNT,
        "payment_status": TEXT,
        "payment_data": DOCUMENT,
        "shipping_information": DOCUMENT,
        "ordered_data": DOCUMENT,
    },
    "winner_groups": {"winner_list": DOCUMENT},
    "event_data": {"id": ID, "product_event_type": COUNT, "product_id": ID},
    "products": {"id": ID, "artist_id": ID},
    "artists": {"id": ID, "name": TEXT},
    "items": {"product_event_code": TEXT, "product_option_id": TEXT, "sku_code": TEXT},
    "skus": {"sku_code": TEXT, "sku_type": TEXT, "virtual_child_sku_count": COUNT},
    "internal_accounts": {"user_id": TEXT},
}


class BrokenContract(ValueError):
    """An input table lacks a column, or has one of a type that its kind cannot be cast from."""


def _broken(table: str, problems: list[str]) -> BrokenContract:
    return BrokenContract(f"{table}: {'; '.join(problems)}")


class Checked:
    """An input table by its contract: `rows` as declared, and `rejected`, the rows set aside."""

    def __init__(self, table: str, df: DataFrame):
        contract = CONTRACTS[table]
        kinds = {f.name: f.dataType for f in df.schema}
        missing = [f"column {c} is missing" for c in contract if c not in kinds]
        self.table = table
        casts: dict[str, Column] = {}
        for name, kind in contract.items():
            if name in kinds and not isinstance(kinds[name], kind.accepts):
                if kind.cast is None or isinstance(kinds[name], (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
                    missing.append(f"column {name} is {kinds[name].simpleString()}")
                else:
                    casts[name] = self._cast(F.col(f"`{name}`"), kinds[name], kind)
        if missing:
            raise _broken(table, missing)
        names = list(contract)
        if not casts:
            self.rows = df.select(*names)
            self._rejected = None
            return
        lost = {c: F.col(f"`{c}`").isNotNull() & cast.isNull() for c, cast in casts.items()}
        reasons = F.array_compact(
            F.array(*[F.when(bad, F.lit(f"{c} is no {contract[c].cast}")) for c, bad in lost.items()])
        )
        fine = ~self._any(list(lost.values()))
        self.rows = df.filter(fine).select(*[casts[c].alias(c) if c in casts else F.col(f"`{c}`") for c in names])
        self._rejected = df.filter(~fine).select(
            F.lit(table).alias("table_name"),
            F.array_join(reasons, "; ").alias("reason"),
            F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])).alias("row"),
        )

    @staticmethod
    def _cast(value: Column, have: T.DataType, kind: Kind) -> Column:
        # A fraction is no whole number, though a cast would cut it to one.
        if kind.cast == "bigint" and isinstance(have, (T.FloatType, T.DoubleType, T.DecimalType)):
            whole = value.try_cast("bigint")
            return F.when(whole.cast("double") == value.cast("double"), whole)
        if kind.cast == "bigint" and isinstance(have, T.StringType):
            return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("bigint"))
        return value.try_cast(kind.cast)

    @staticmethod
    def _any(tests: list[Column]) -> Column:
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    def rejected(self) -> DataFrame | None:
        """(table_name, reason, row) of the rows set aside; none if no column needs a cast."""
        return self._rejected
