"""The input tables made from a star schema of customers, orders, lines, parts and suppliers.

Only for running the operators on data that has no order documents of its own: it also encodes
the documents that the operators then decode.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.rules import Rules
from cohortry.sources.tables import Sources

STAR_RULES = Rules(
    as_of=date(2001, 9, 1),
    run_ts=datetime(2001, 9, 1),
    order_source="new",
    price_type="bigint",
    agent_since=date(2001, 1, 1),
    challenger_ratio=5.0,
    price_tiers=((600_000, 0.2), (300_000, 0.3)),
    bulk_ticket_qty=45,
    album_max_qty=25,
    v2_album_qty_below=25,
    v1_challenger_ratio=1.0,
)

# A document holds the lines of one order found among this many neighbouring input rows, so its
# size is bounded even if one order owns most lines.
DOCUMENT_ROWS = 1 << 16


def money(value: Column) -> Column:
    """Amount in whole minor units."""
    return F.floor(value * 100 + 0.5).cast("long")


def _text(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _net() -> Column:
    return money(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def _order_number() -> Column:
    prefix = F.when(F.col("o_orderpriority") == "5-LOW", "B").otherwise("C")
    return F.concat(prefix, F.col("o_orderkey").cast("string"))


def _users(customer: DataFrame, orders: DataFrame) -> DataFrame:
    login = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate"))
    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(login).alias("last_login"), F.min("o_orderdate").alias("created_at")
    )
    withdrawn = F.col("c_custkey") % 50 == 0
    return customer.join(seen, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.test")).alias("email"),
        F.col("c_mktsegment").alias("created_from"),
        "created_at",
        "last_login",
        (F.col("c_acctbal") > 0).alias("is_certified"),
        withdrawn.alias("is_withdrawn"),
        (~withdrawn).alias("is_active"),
    )


def _user_info(customer: DataFrame, nation: DataFrame) -> DataFrame:
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    born = F.date_add(F.lit(date(1980, 1, 1)), (F.col("c_custkey") % 9000).cast("int"))
    known = customer.filter(F.col("c_custkey") % 10 != 0).join(home, "c_nationkey", "left")
    return known.select(
        F.col("c_custkey").alias("user_id"),
        F.col("n_name").alias("country_code"),
        (F.col("c_custkey") % 2).alias("gender_type"),
        born.cast("timestamp_ntz").alias("birth"),
    )


def _order_mart(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    status = F.col("o_orderstatus")
    market = F.when(status == "F", "B2C").when(status == "O", "B2B").otherwise("ETC")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderkey").alias("order_no"),
            _net().alias("total_revenue"),
            _text("E", "l_suppkey").alias("event_id"),
            F.col("l_partkey").cast("string").alias("option_code"),
            F.col("l_quantity").cast("long").alias("order_qty"),
            F.col("p_brand").alias("ip_name"),
            market.alias("market_type"),
            F.when(F.col("o_orderpriority") < "4", "new").otherwise("old").alias("data_source"),
            F.col("o_orderdate").alias("pay_date"),
        )
    )


def _documents(lines: DataFrame) -> DataFrame:
    placed = lines.select(
        "id",
        "l_suppkey",
        F.struct(
            F.col("l_partkey").alias("id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            _net().alias("price"),
        ).alias("option"),
        F.floor(F.monotonically_increasing_id() / DOCUMENT_ROWS).alias("part"),
    )
    offers = (
        placed.repartition("id", "part")
        .groupBy("id", "part", "l_suppkey")
        .agg(F.collect_list("option").alias("buying_option_list"))
    )
    offer = F.struct(
        F.col("l_suppkey").alias("id"), _text("E", "l_suppkey").alias("code"), "buying_option_list"
    )
    return offers.groupBy("id", "part").agg(
        F.to_json(F.collect_list(offer)).alias("ordered_data")
    )


def _commerce_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    status = F.col("o_orderstatus")
    address = F.struct(
        F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("address"),
        F.concat(F.lit("K"), (F.col("o_orderkey") % 5).cast("string")).alias("detail_address"),
    )
    paid = F.when(F.col("o_orderkey") % 2 == 0, "CONFIRMED").otherwise("CANCELED")
    header = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        _order_number().alias("order_number"),
        (F.col("o_orderkey") % 12).alias("order_status"),
        F.when(status == "F", "CONFIRMED")
        .when(status == "O", "PARTIAL_CANCELED")
        .alias("payment_status"),
        F.to_json(F.struct(paid.alias("status"))).alias("payment_data"),
        F.to_json(F.struct(address.alias("information"))).alias("shipping_information"),
    )
    lines = lineitem.filter(F.col("l_returnflag") == "R").withColumn("id", F.col("l_orderkey"))
    # Not one outer join: adaptive execution can split the many documents of one order only in an
    # inner join, and the orders without lines need but one row per order of the lines.
    filled = _documents(lines).drop("part").join(header, "id")
    empty = header.join(lines.select("id").distinct(), "id", "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def _winner_groups(events: DataFrame, orders: DataFrame) -> DataFrame:
    wins = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 150))
    winner = F.when(F.col("event_id") % 10 == 0, "-1").otherwise(F.col("o_custkey").cast("string"))
    entry = F.struct(
        F.struct(winner.alias("id")).alias("user"),
        F.struct(F.struct(_order_number().alias("order_number")).alias("order")).alias(
            "information"
        ),
    )
    return wins.join(orders, F.col("event_id") == F.col("o_orderkey")).select(
        F.to_json(F.array(entry)).alias("winner_list")
    )


def _items(lineitem: DataFrame) -> DataFrame:
    pairs = lineitem.filter(F.col("l_partkey") % 13 != 0).select("l_suppkey", "l_partkey").distinct()
    second = F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit(""), F.lit("x")))
    suffixes = F.explode(second.otherwise(F.array(F.lit(""))))
    return pairs.select("*", suffixes.alias("suffix")).select(
        _text("E", "l_suppkey").alias("product_event_code"),
        F.col("l_partkey").cast("string").alias("product_option_id"),
        F.concat(_text("S", "l_partkey"), F.col("suffix")).alias("sku_code"),
    )


def _skus(part: DataFrame) -> DataFrame:
    kind = F.when(F.col("p_type") == "PROMO", "C").when(F.col("p_type") != "SMALL", "P")
    size = F.col("p_size").cast("long")
    versions = F.when(F.col("p_type") == "STANDARD", F.lit(0)).otherwise(size).cast("long")
    first = part.select(
        _text("S", "p_partkey").alias("sku_code"),
        kind.alias("sku_type"),
        versions.alias("virtual_child_sku_count"),
    )
    second = part.filter(F.col("p_partkey") % 5 == 0).select(
        F.concat(_text("S", "p_partkey"), F.lit("x")).alias("sku_code"),
        F.lit("P").alias("sku_type"),
        (size + 1).alias("virtual_child_sku_count"),
    )
    return first.unionByName(second)


def _event_mart(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        _text("E", "s_suppkey").alias("event_id"),
        F.when(key % 20 != 0, key % 25).alias("artist_id"),
        F.concat(F.lit("A"), (key % 7).cast("string")).alias("album_name"),
    )


def _event_data(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("id"),
        F.when(key % 20 != 0, key % 3).alias("product_event_type"),
        (key + 1000).alias("product_id"),
    )


def _products(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        (key + 1000).alias("id"), F.when(key % 10 != 0, key % 25).alias("artist_id")
    )


def _artists(supplier: DataFrame) -> DataFrame:
    ids = supplier.select((F.col("s_suppkey") % 25).alias("id")).distinct()
    return ids.filter(F.col("id") != 24).select("id", _text("Artist ", "id").alias("name"))


def _internal_accounts(customer: DataFrame) -> DataFrame:
    staff = customer.filter(F.col("c_custkey") % 97 == 0)
    return staff.select(F.col("c_custkey").cast("string").alias("user_id"))


# Logical name -> how it is made, and from which tables.
_RECIPES = {
    "users": (_users, "customer", "orders"),
    "user_info": (_user_info, "customer", "nation"),
    "order_mart": (_order_mart, "orders", "lineitem", "part"),
    "event_mart": (_event_mart, "supplier"),
    "commerce_orders": (_commerce_orders, "orders", "lineitem"),
    "winner_groups": (_winner_groups, "events", "orders"),
    "event_data": (_event_data, "supplier"),
    "products": (_products, "supplier"),
    "artists": (_artists, "supplier"),
    "items": (_items, "lineitem"),
    "skus": (_skus, "part"),
    "internal_accounts": (_internal_accounts, "customer"),
}


def star_sources(spark: SparkSession, root: str) -> Sources:
    """All input tables from the star-schema parquet files below `root`."""

    @cache
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}.parquet")

    def load(name: str) -> DataFrame:
        make, *needs = _RECIPES[name]
        return make(*[table(need) for need in needs])

    return Sources(load)
