from cohortry.operators import mart_variants, nested, rollup
from tests.conftest import rows

C, A, P, S, B = "Challenger", "Album Collector", "Poca Collector", "Shopper", "Beginner"


def test_mode(frame):
    data = [("a", C), ("a", C), ("a", B), ("a", B), ("b", B), ("b", B), ("b", B), ("b", C), ("b", C),
            ("c", P), ("c", B), ("d", P), ("d", C), ("e", B)]
    df = frame(data, "k string, label string")
    got = rollup.mode_with_priority(df, ["k"], "label", (C, P, B), "mode")
    assert rows(got) == [("a", C), ("b", B), ("c", P), ("d", C), ("e", B)]


def test_two_levels(frame):
    data = [("u", 1, C), ("u", 1, C), ("u", 1, C), ("u", 2, B), ("u", 3, B), ("u", None, P), ("v", None, C)]
    by_artist = rollup.artist_labels(frame(data, "user_id string, artist_id long, option_label string"))
    assert rows(by_artist) == [("u", 1, C), ("u", 2, B), ("u", 3, B)]
    assert rows(rollup.user_labels(by_artist)) == [("u", B)]


# user: (artists, max qty, event lines, option label, certain)
CASES = {
    "winner": (1, 1, 1, None, True),
    "label challenger": (5, 1, 1, C, False),
    "album": (3, 5, 1, P, False),
    "album two": (3, 2, 1, P, False),
    "six each": (3, 6, 1, P, False),
    "two artists": (2, 2, 1, P, False),
    "no qty": (3, None, 1, None, False),
    "shop": (1, 9, 0, None, False),
    "shop label": (1, 9, 0, B, False),
    "rest": (1, 9, 1, B, False),
    "no label": (1, 9, 1, None, False),
}


def dimension(frame, rules, variant):
    bought = frame([(u, a, q, e) for u, (a, q, e, _, _) in CASES.items()],
                   "user_id string, distinct_artists long, max_qty long, event_lines long")
    labels = frame([(u, c[3]) for u, c in CASES.items() if c[3]], "user_id string, user_label string")
    certain = frame([(u,) for u, c in CASES.items() if c[4]], "user_id string")
    return dict(rows(rollup.final_dimension(bought, labels, certain, rules, variant)))


def test_final_dimension(frame, rules):
    want = {"winner": C, "label challenger": C, "album": A, "album two": A, "six each": P, "two artists": P,
            "no qty": B, "shop": S, "shop label": S, "rest": B, "no label": B}
    assert dimension(frame, rules, "v3") == want
    older = {**want, "album": P, "no qty": "N/A", "no label": "N/A"}
    assert dimension(frame, rules, "v2") == older


def test_first_rule_set(frame, rules):
    stats = frame(
        [("a", 1, 1.0, 1.0), ("b", 1, 1.01, 1.0), ("c", 1, 0.1, 1.0), ("w", 1, 0.1, 1.0), ("n", None, 9.0, 1.0)],
        "user_id string, artist_id long, qty_ratio double, unit_price double",
    )
    winners = frame([("w",)], "user_id string")
    assert rows(mart_variants.final_dimension_v1(stats, winners, rules)) == [
        ("a", "Collector"), ("b", C), ("c", B), ("w", C)
    ]


def test_main_artist(frame):
    purchases = frame(
        [("a", 1, 5), ("a", 2, 3), ("a", 2, 3), ("b", 9, 4), ("b", 4, 4), ("c", 1, None), ("c", 7, 1),
         ("d", None, 50), ("e", 3, None)],
        "user_id string, artist_id long, total_revenue long",
    )
    offers = frame([(a, f"n{a}") for a in (1, 2, 3, 4, 9, 9)] + [(7, None), (None, None)],
                   "artist_id long, artist_name string")
    artist = rollup.main_artist(purchases, nested.artist_names(offers))
    assert rows(artist) == [("a", 2, "n2", 6), ("b", 4, "n4", 4), ("c", 7, None, 1), ("e", 3, "n3", None)]
    labels = frame([("a", C), ("d", B)], "user_id string, dimension_label string")
    assert rows(rollup.user_dimension(labels, artist)) == [("a", C, 2, "n2", 6), ("d", B, None, None, None)]
