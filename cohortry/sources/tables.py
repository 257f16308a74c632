"""The input tables by logical name."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from cohortry.sources.contracts import Checked

NAMES = (
    "users",
    "user_info",
    "order_mart",
    "event_mart",
    "commerce_orders",
    "winner_groups",
    "event_data",
    "products",
    "artists",
    "items",
    "skus",
    "internal_accounts",
)


class Sources:
    """Input tables, each as its contract declares. JSON columns may be text or variant.

    A missing column is an error. Columns of other types than declared are cast; `rejected` has the
    rows with a value for which that fails, which are left out of the table.

    users              id, email, created_from, created_at, last_login, is_certified,
                       is_withdrawn, is_active
    user_info          user_id, country_code, gender_type, birth
    order_mart         user_id (text), order_no, total_revenue, event_id, option_code, order_qty,
                       ip_name, market_type, data_source, pay_date
    event_mart         event_id, artist_id, album_name
    commerce_orders    id, user_id, order_number, order_status, payment_status, payment_data,
                       shipping_information, ordered_data
    winner_groups      winner_list
    event_data         id, product_event_type, product_id
    products           id, artist_id
    artists            id, name
    items              product_event_code, product_option_id (text), sku_code
    skus               sku_code, sku_type, virtual_child_sku_count
    internal_accounts  user_id (text)
    """

    def __init__(self, load: Callable[[str], DataFrame]):
        """`load` opens a table by logical name; it is called when the table is first used."""
        self._load = load
        self._opened: dict[str, Checked] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        self._opened[name] = Checked(name, self._load(name))
        setattr(self, name, self._opened[name].rows)
        return getattr(self, name)

    def rejected(self) -> DataFrame | None:
        """(table_name, reason, row) of the rows set aside in the tables used so far; none if every
        column had its declared type."""
        found = [rows for table in self._opened.values() if (rows := table.rejected()) is not None]
        return reduce(DataFrame.unionByName, found) if found else None

    def sized(self) -> list[DataFrame]:
        """The two tables with a row or more per order: the ones that shuffles have to be wide for."""
        return [self.order_mart, self.commerce_orders]

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Sources:
        """Data frames at hand, by logical name."""
        return cls(frames.__getitem__)

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str]) -> Sources:
        """Tables or views of the session catalog, by logical name."""
        return cls(lambda name: spark.table(names[name]))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Sources:
        """One parquet folder per logical name below `root`."""
        return cls(lambda name: spark.read.parquet(f"{root}/{name}"))
