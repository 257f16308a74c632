import json

from pyspark.sql import functions as F

from cohortry.operators import nested
from tests.conftest import rows

ORDERS = (
    "id long, user_id long, order_number string, order_status long, payment_status string, "
    "payment_data string, ordered_data string"
)


def order(id, data, number="C1", status=1, payment="CONFIRMED", payment_data=None):
    return (id, 100 + id, number, status, payment, payment_data, data)


def test_order_lines_of_odd_documents(frame, rules):
    option = {"id": "7", "quantity": "3", "price": 12.5}
    good = [{"id": 1, "code": "E1", "buying_option_list": [option, {"id": "x", "quantity": 2}]}]
    mixed = [5, None, {"id": "y", "code": {"no": 1}, "buying_option_list": [7, {"id": 8, "price": "?"}]}]
    data = [json.dumps(good), json.dumps(mixed), None, "", "[]", "{", json.dumps(good[0]),
            '[{"id": 1}]', '[{"id": 1, "buying_option_list": {"id": 2}}]',
            '[{"id": 1, "buying_option_list": []}]']
    table = frame([order(i, d) for i, d in enumerate(data)], ORDERS)
    got = rows(nested.order_lines(table, rules), "order_id", "offer_id", "offer_code", "option_id",
               "order_qty", "total_revenue")
    assert got == [
        (0, 1, "E1", None, 2, None),
        (0, 1, "E1", 7, 3, 12.5),
        (1, None, None, None, None, None),
        (1, None, None, 8, None, None),
    ]


REPEATED = (
    '[{"id":7,"code":"E6","code":"E7","buying_option_list":[{"id":1,"id":2,"quantity":1.0},'
    '{"id":3,"quantity":"4"}]},{"id":8,"code":"E8","buying_option_list":[{"id":5,"quantity":6}]},'
    '{"id":9,"code":"E9","buying_option_list":"[{}]"},"{}",[{"id":1}]]'
)


def test_repeated_keys_and_written_fractions(frame, rules):
    """The last of equal keys counts, neighbours stay, and 1.0 is no whole number."""
    table = frame([order(0, REPEATED), order(1, '[{"id":1'), order(2, "{}"), order(3, None)], ORDERS)
    got = rows(nested.order_lines(table, rules), "offer_id", "offer_code", "option_id", "order_qty")
    assert got == [(7, "E7", 2, None), (7, "E7", 3, 4), (8, "E8", 5, 6)]
    assert tuple(nested.unread_documents(table).first()) == (3, 2)


def test_repeated_key_in_a_winner_list(frame):
    entry = '{"user":{"id":%s},"information":{"order":{"order_number":"%s"}}%s}'
    groups = frame(
        [("[" + ",".join([entry % ("5", "C1", ""), entry % ('1,"id":6', "C2", ',"x":1,"x":2')]) + "]",)],
        "winner_list string",
    )
    orders = frame([("C1", 11), ("C2", 12)], "order_number string, user_id long")
    assert rows(nested.winners(groups, orders)) == [("11",), ("12",)]


def test_a_document_is_parsed_once_into_elements(frame, rules):
    plan = nested.order_lines(frame([], ORDERS), rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(StringType") == 1 and "SinglePartition" not in plan


def test_a_document_above_the_size_of_a_variant(spark, rules):
    n = 1_500_000
    option = F.concat(F.lit('{"id":1,"quantity":2,"price":3,"note":"'), F.repeat(F.lit("x"), 60), F.lit('"}'))
    data = F.concat(
        F.lit('[{"id":1,"code":"E","buying_option_list":['),
        F.array_join(F.array_repeat(option, n), ","),
        F.lit("]}]"),
    )
    table = spark.createDataFrame([order(0, None)], ORDERS).withColumn("ordered_data", data)
    sums = nested.order_lines(table, rules).agg(F.count("*"), F.sum("order_qty"), F.max(F.length(data)))
    got = sums.first()
    assert got[0] == n and got[1] == 2 * n and got[2] > 128 << 20


def test_payment_status_falls_back_to_the_document(frame, rules):
    one = json.dumps([{"id": 1, "buying_option_list": [{"id": 1}]}])
    table = frame(
        [order(0, one, payment="CANCELED", payment_data='{"status":"CONFIRMED"}'),
         order(1, one, "B7", payment=None, payment_data='{"status":"CONFIRMED"}'),
         order(2, one, payment=None, payment_data='{"status":{"a":1}}')],
        ORDERS,
    )
    got = rows(nested.order_lines(table, rules), "order_id", "payment_status", "order_no_prefix")
    assert got == [(0, "CANCELED", "C"), (1, "CONFIRMED", "B"), (2, None, "C")]


def test_documents_return_the_lines_they_were_made_of(spark, rules):
    """Brute force: lines written as documents come back whole, whatever the parsing does."""
    lines = [(o, s, p, q, 10 * q) for o in range(20) for s in range(o % 4) for p, q in ((1, o), (2, s))]
    docs = {}
    for o, s, p, q, price in lines:
        option = {"id": p, "quantity": str(q) if q % 2 else q, "price": price}
        docs.setdefault(o, {}).setdefault(s, []).append(option)
    table = spark.createDataFrame(
        [order(o, json.dumps([{"id": s, "code": f"E{s}", "buying_option_list": opts} for s, opts in d.items()]))
         for o, d in docs.items()],
        ORDERS,
    )
    got = nested.order_lines(table, rules).select(
        "order_id", "offer_id", "option_id", "order_qty", F.col("total_revenue").cast("long")
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(lines)
    variant = table.withColumn("ordered_data", F.parse_json("ordered_data"))
    assert nested.order_lines(variant, rules).count() == len(lines)


def test_offer_lookup(frame):
    data = frame([(1, 0, 10), (2, 1, 11), (3, 2, 12), (4, None, 10), (5, 9, 10), (6, 0, 99)],
                 "id long, product_event_type long, product_id long")
    products = frame([(10, 7), (11, None), (12, 8)], "id long, artist_id long")
    artists = frame([(7, "Seven")], "id long, name string")
    assert rows(nested.offer_lookup(data, products, artists)) == [
        (1, "F_FUNDING", 7, "Seven"),
        (2, "P_POB", None, None),
        (3, "S_SHOPPING", 8, None),
        (4, None, 7, "Seven"),
        (5, None, 7, "Seven"),
    ]


def test_paid_lines(frame, rules):
    cases = [
        # id, status, payment, prefix, offer -> kept?
        (1, 2, "CONFIRMED", "C", 1, True),
        (2, 2, "CANCELED", "C", 1, False),
        (3, 10, "CANCELED", "C", 1, True),
        (4, 3, "CONFIRMED", "C", 1, False),
        (5, 2, None, "C", 1, False),
        (6, 1, None, "C", 1, True),
        (7, 1, None, "B", 1, True),
        (8, 1, None, "B", 3, False),
        (9, 1, None, "C", 3, True),
        (10, 1, None, "B", 4, False),
        (11, 1, None, "C", 4, True),
        (12, 1, None, "B", 99, False),
        (13, 1, None, "C", None, True),
        (14, 2, "PARTIAL_CANCELED", "C", 1, True),
    ]
    lines = frame(
        [(i, i, status, payment, prefix, offer, f"E{offer}", 1, 1, 5.0)
         for i, status, payment, prefix, offer, _ in cases],
        "order_id long, user_id long, order_status long, payment_status string, "
        "order_no_prefix string, offer_id long, offer_code string, option_id long, "
        "order_qty long, total_revenue double",
    )
    offers = frame([(1, "P_POB", 7, "S"), (3, "S_SHOPPING", 7, "S"), (4, None, 7, "S")],
                   "offer_id long, offer_type string, artist_id long, artist_name string")
    kept = {int(r["user_id"]) for r in nested.paid_b2c_lines(lines, offers, rules).collect()}
    assert kept == {case[0] for case in cases if case[-1]}


def test_winners(frame):
    def entry(user, number):
        return {"user": {"id": user}, "information": {"order": {"order_number": number}}}

    groups = frame(
        [(json.dumps([entry("5", "C1"), entry("-1", "C2"), entry(6, "C3")]),),
         (json.dumps([entry("5", "C1"), entry(None, "C4"), {"information": {"order": {"order_number": "C4"}}},
                      entry({"x": 1}, "C4"), entry("5", "C99"), entry("5", None), 3]),),
         ("[]",), (None,), ("{",)],
        "winner_list string",
    )
    orders = frame([("C1", 11), ("C2", 12), ("C3", 13), ("C4", 14), ("C3", 13), (None, 15), ("C1", None)],
                   "order_number string, user_id long")
    assert rows(nested.winners(groups, orders)) == [("11",), ("13",)]
