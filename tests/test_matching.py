"""Numbers within groups of any size, and the one-to-one match of orders and events."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from souk.operators.ranks import Asc, Desc, group_row_number
from souk.plans.merge import mapping_one_to_one
from tests.helpers import frame


@pytest.mark.parametrize("slices", [1, 7])
def test_numbers_within_groups(spark, store, slices):
    """Half of the rows in one group, which lies in several slices; a null group has no numbers."""
    rnd = random.Random(4)
    rows = [{"g": rnd.choice([1, 1, 1, 2, 3, None]), "h": rnd.choice(["a", "b"]), "v": rnd.randrange(9), "k": k} for k in range(400)]
    found = group_row_number(frame(spark, rows), ["g", "h"], [Desc("v"), Asc("k")], store, "groups", "n", slices)
    assert found.columns == ["g", "h", "v", "k", "n"]
    got = {r.k: r.n for r in found.collect()}
    groups = defaultdict(list)
    for r in rows:
        if r["g"] is not None:
            groups[r["g"], r["h"]].append((-r["v"], r["k"]))
    assert got == {k: n for members in groups.values() for n, (_, k) in enumerate(sorted(members), 1)}


def test_no_rows(spark, store):
    empty = frame(spark, [{"g": 1, "k": 1}]).limit(0)
    assert group_row_number(empty, ["g"], [Asc("k")], store, "none").collect() == []


def _match(orders, events):
    """Brute force: pairs of order and seller."""
    left, right = defaultdict(list), defaultdict(list)
    for o in sorted(orders, key=lambda o: o["order_id"]):
        left[o["customer_id"], o["order_date"], o["order_value"]].append(o["order_id"])
    for e in sorted(events, key=lambda e: (e["event_timestamp"], e["event_id"])):
        right[e["customer_id"], e["event_timestamp"].date(), e["order_value"]].append(e["seller_id"])
    return sorted(pair for key in left if None not in key for pair in zip(left[key], right[key]))


@pytest.mark.parametrize("slices", [1, 6])
def test_each_row_is_used_once(spark, store, slices):
    rnd = random.Random(8)
    at = lambda: dt.datetime(2024, 1, rnd.randint(1, 2), rnd.randint(0, 23))
    who = lambda: rnd.choice([1, 1, 1, 1, 2, None])
    orders = [{"order_id": n, "customer_id": who(), "order_date": at().date(), "order_value": rnd.choice([5.0, 7.5]), "product_id": "p", "category": "c"} for n in range(300)]
    events = [{"event_id": n, "customer_id": who(), "event_timestamp": at(), "order_value": rnd.choice([5.0, 7.5, None]), "seller_id": n} for n in range(250)]
    found = mapping_one_to_one(frame(spark, orders), frame(spark, events), -1, store, slices).collect()
    assert sorted((r.order_id, r.seller_id) for r in found) == _match(orders, events)
    late = mapping_one_to_one(frame(spark, orders), frame(spark, events), 99, store, slices).collect()
    assert sorted((r.order_id, r.seller_id) for r in late) == _match(orders[100:], events)
