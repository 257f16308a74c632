import json
from datetime import date

from cohortry.functions.staging import without_users
from cohortry.operators import exclusions
from tests.conftest import rows, users


def ship(address, code):
    return json.dumps({"information": {"address": address, "detail_address": code}})


def test_shared_address(frame, rules):
    def orders(user, shipments, status="CONFIRMED"):
        return [(user, status, s) for s in shipments]

    data = (
        orders(1, [ship(" depot ", "A"), ship("depot", "B"), ship("depot", "C")])
        + orders(2, [ship("x", "A"), ship("y", "B"), ship("z", "C")])
        + orders(3, [ship("d", "A"), ship("d", " A "), ship("d", "B"), ship("d", "")])
        + orders(4, [ship("d", "A"), ship("d", "B"), ship("d", {"o": 1}), ship("d", None)])
        + orders(5, [ship("", "A"), ship(" ", "B"), ship("", "C"), ship("", "D")])
        + orders(6, [ship("[d] 1", 1), ship("[d] 1", 2), ship("[d] 1", 3)], "PARTIAL_CANCELED")
        + orders(7, [ship("d", "A"), ship("d", "B"), ship("d", "C")], None)
        + orders(None, [ship("d", "A"), ship("d", "B"), ship("d", "C")])
        + orders(8, [None, "broken", "[]"])
        + orders(9, [ship(a, c) for a in ("p", "q") for c in "ABC"])
    )
    table = frame(data, "user_id long, payment_status string, shipping_information string")
    assert rows(exclusions.shared_address_buyers(table, rules)) == [("1",), ("6",), ("9",)]


def test_multi_artist(frame, rules):
    day, old = date(2025, 1, 1), date(2024, 12, 31)
    orders = frame(
        [("a", "e1", "B2C", day), ("a", "e2", "B2C", day), ("b", "e1", "B2C", day),
         ("b", "e2", "B2C", old), ("c", "e1", "B2C", day), ("c", "e2", "B2B", day),
         ("d", "e1", "B2C", day), ("d", "e3", "B2C", day), ("d", "e4", "B2C", day),
         (None, "e1", "B2C", day), (None, "e2", "B2C", day)],
        "user_id string, event_id string, market_type string, pay_date date",
    )
    events = frame(
        [("e1", 1, "x"), ("e2", 2, "x"), ("e3", None, "x"), ("e4", 1, "y")],
        "event_id string, artist_id long, album_name string",
    )
    assert users(exclusions.multi_artist_buyers(orders, events, rules)) == {"a"}


def test_excluded_users_and_null_users(frame):
    shared = frame([("1",), ("2",), ("2",)], "user_id string")
    several = frame([("2",), ("3",)], "user_id string")
    agents = exclusions.purchasing_agents(shared, several)
    assert rows(agents) == [("2",)]
    internal = frame([("2",), ("9",), ("9",), (None,)], "user_id string")
    out = exclusions.excluded_users(internal, agents)
    assert rows(out) == [("2",), ("9",)]
    data = frame([("1",), ("2",), (None,)], "user_id string")
    assert rows(without_users(data, out)) == [("1",)]
    assert rows(without_users(data, out.filter("false"))) == [("1",), ("2",)]
