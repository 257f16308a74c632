"""Order and winner documents flattened into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortry.functions.columns import json_items, json_object, json_text, scalar_of
from cohortry.functions.staging import stage
from cohortry.rules import NO_WINNER_ID, OFFER_TYPES, SHOP_OFFER, Rules


OFFER = "struct<id:string, code:string, buying_option_list:array<string>>"
OPTION = "struct<id:string, quantity:string, price:string>"
WINNER = "struct<user:struct<id:string>, information:struct<order:struct<order_number:string>>>"


def winners(groups: DataFrame, orders: DataFrame) -> DataFrame:
    """Users whose order is named in a winner list. Entries without a winner do not count."""
    entries = groups.select(F.explode(json_items(groups, "winner_list")).alias("entry"))
    parsed = json_object(entries, "entry", WINNER)
    number_path = "$.information.order.order_number"
    number = parsed["information"]["order"]["order_number"]
    won = entries.select(
        scalar_of(entries, "entry", parsed["user"]["id"], "$.user.id").alias("winner"),
        scalar_of(entries, "entry", number, number_path).alias("order_number"),
    ).filter((F.col("winner") != NO_WINNER_ID) & F.col("order_number").isNotNull())
    # Staged: the list is parsed once, and its size decides how the orders are searched.
    numbers = stage(won.select("order_number").distinct(), "won-orders")
    return (
        orders.select("order_number", "user_id")
        .join(numbers, "order_number", "left_semi")
        .select(F.col("user_id").cast("string").alias("user_id"))
        .filter(F.col("user_id").isNotNull())
        .distinct()
    )


def order_lines(orders: DataFrame, rules: Rules, seen: Observation | None = None) -> DataFrame:
    """One row per order, offer and option. The price of a line is its whole amount.

    A document that is null or no array has no lines; `unread_documents` counts those with text, and
    so does `seen`, as `documents` and `unread`, while the lines are read.
    """
    status = F.coalesce(F.col("payment_status"), json_text(orders, "payment_data", "$.status"))
    if seen is not None:
        written = F.col("ordered_data").isNotNull()
        orders = orders.observe(
            seen,
            F.count_if(written).alias("documents"),
            F.count_if(written & json_items(orders, "ordered_data").isNull()).alias("unread"),
        )
    offers = orders.select(
        F.col("id").alias("order_id"),
        "user_id",
        "order_status",
        status.alias("payment_status"),
        F.left("order_number", F.lit(1)).alias("order_no_prefix"),
        F.explode(json_items(orders, "ordered_data")).alias("offer"),
    )
    offer = json_object(offers, "offer", OFFER)
    options = offers.select(
        "order_id",
        "user_id",
        "order_status",
        "payment_status",
        "order_no_prefix",
        offer["id"].try_cast("bigint").alias("offer_id"),
        scalar_of(offers, "offer", offer["code"], "$.code").alias("offer_code"),
        F.explode(offer["buying_option_list"]).alias("option"),
    )
    option = F.from_json("option", OPTION)
    return options.select(
        *[name for name in options.columns if name != "option"],
        option["id"].try_cast("bigint").alias("option_id"),
        option["quantity"].try_cast("bigint").alias("order_qty"),
        option["price"].try_cast(rules.price_type).alias("total_revenue"),
    )


def unread_documents(orders: DataFrame) -> DataFrame:
    """How many order documents there are, and how many are not null but hold no array."""
    written = F.col("ordered_data").isNotNull()
    return orders.agg(
        F.count_if(written).alias("documents"),
        F.count_if(written & json_items(orders, "ordered_data").isNull()).alias("unread"),
    )


def offer_lookup(event_data: DataFrame, products: DataFrame, artists: DataFrame) -> DataFrame:
    """Type and artist of every offer whose product exists."""
    kind = F.lit(None).cast("string")
    for code, name in OFFER_TYPES.items():
        kind = F.when(F.col("product_event_type") == code, name).otherwise(kind)
    product = products.select(F.col("id").alias("product_id"), "artist_id")
    artist = artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"))
    return (
        event_data.select(F.col("id").alias("offer_id"), kind.alias("offer_type"), "product_id")
        .join(product, "product_id")
        .join(artist, "artist_id", "left")
        .select("offer_id", "offer_type", "artist_id", "artist_name")
    )


def artist_names(offers: DataFrame) -> DataFrame:
    """Name of every artist with an offer. An artist has one name, as the lookup has unique keys."""
    return offers.filter(F.col("artist_id").isNotNull()).select("artist_id", "artist_name").distinct()


def paid_b2c_lines(lines: DataFrame, offers: DataFrame, rules: Rules) -> DataFrame:
    """Paid lines of retail orders, with offer type and artist.

    A shop order whose number starts with the business prefix settles a business order. The test
    is unknown, and the line dropped, for an offer of unknown type with that prefix.
    """
    paid = lines.filter(
        (
            F.col("payment_status").isin(*rules.paid_payments)
            | F.col("order_status").isin(*rules.paid_statuses)
        )
        & F.col("order_status").isin(*rules.kept_statuses)
    )
    settles_business = (F.col("offer_type") == SHOP_OFFER) & (
        F.col("order_no_prefix") == rules.business_prefix
    )
    return (
        paid.join(offers, "offer_id", "left")
        .filter(~settles_business)
        .select(
            F.col("user_id").cast("string").alias("user_id"),
            F.col("offer_code").alias("event_id"),
            F.col("option_id").cast("string").alias("option_code"),
            "order_qty",
            "total_revenue",
            "offer_type",
            "artist_id",
            "artist_name",
        )
    )
