"""Matches under budgets against plain deferred acceptance, and that no pair blocks them."""

import random
from decimal import Decimal

import pytest
from support import rows

from lapsewise.operators import campaigns as C
from lapsewise.operators import matching as M

OFFERS = [
    C.Campaign("a", "a is not null", 2, Decimal("3.00"), Decimal("9.00")),
    C.Campaign("b", "b is not null", 1, Decimal("2.50"), Decimal("6.00")),
    C.Campaign("c", "c is not null", 3, Decimal("1.00"), Decimal("0.50")),
    C.Campaign("d", "d is not null", 3, Decimal("0.70"), Decimal("100.00")),
]
NAMES = [c.campaign_id for c in OFFERS]
WORTHS = {k: k for k in NAMES}
WISHES = {k: f"w{k}" for k in NAMES}


def table(spark, data):
    cols = ", ".join(f"{k} int, w{k} int" for k in NAMES)
    return spark.createDataFrame(data, f"customer_id bigint, {cols}")


def plain(data):
    """One proposal at a time; a campaign keeps its best as long as they fit."""
    cost = {c.campaign_id: c.unit_cost for c in OFFERS}
    cap = {c.campaign_id: c.cap for c in OFFERS}
    worth = {(r[0], k): r[1 + 2 * i] for r in data for i, k in enumerate(NAMES)}
    wish = {(r[0], k): r[2 + 2 * i] for r in data for i, k in enumerate(NAMES)}
    left = {
        r[0]: sorted((k for k in NAMES if worth[r[0], k] is not None and wish[r[0], k] is not None), key=lambda k, c=r[0]: (wish[c, k], k))
        for r in data
    }
    held = {k: [] for k in NAMES}
    free = list(left)
    while free:
        c = free.pop()
        if not left[c]:
            continue
        k = left[c].pop(0)
        held[k] = sorted([*held[k], c], key=lambda x: (-worth[x, k], x))
        fits = int(cap[k] // cost[k])
        free += held[k][fits:]
        held[k] = held[k][:fits]
    return sorted(((k, c, place + 1) for k, cs in held.items() for place, c in enumerate(cs)), key=repr)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limit", [0, 1000])
def test_match_is_deferred_acceptance(spark, seed, limit):
    rng = random.Random(seed)
    some = lambda n: rng.choice([None, *range(n)])
    data = [(c, *[x for _ in NAMES for x in (some(6), some(3))]) for c in range(25)]
    scored = table(spark, data)
    found = M.match(scored, OFFERS, WISHES, WORTHS, single_task_rows=limit).cache()
    assert rows(found, "campaign_id", "customer_id", "place") == plain(data)
    assert found.columns == [*scored.columns, "campaign_id", "priority", "cost", "place", "spent"]
    assert not rows(M.blocking_pairs(scored, found, OFFERS, WISHES, WORTHS, single_task_rows=limit))


def test_refused_customers_get_their_next_offer(spark):
    both = [(c, 100 - c, 0, 100 - c, 0, None, None, None, None) for c in range(8)]
    scored = table(spark, both)
    found = M.match(scored, OFFERS, worth="a")
    # b has room for two, then a for three; by first offers alone a would stay empty.
    assert rows(found, "campaign_id", "customer_id") == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1)]
    first = C.budget(C.assign(scored, OFFERS), {c.campaign_id: c.cap for c in OFFERS}, "a")
    assert rows(first, "campaign_id", "customer_id") == [("b", 0), ("b", 1)]
    blocking = M.blocking_pairs(scored, first, OFFERS, worth="a")
    assert {r[0] for r in rows(blocking)} == {2, 3, 4, 5, 6, 7} and {r[1] for r in rows(blocking)} == {"a"}


def test_closed_campaigns_nulls_and_nobody(spark):
    none = (None,) * 2
    scored = table(spark, [(1, *none, *none, 5, 0, 7, 1), (2, *none, *none, None, 0, 7, 1), (3, *none, *none, *none, *none)])
    # c costs more than its cap, so its wish is refused.
    assert rows(M.match(scored, OFFERS, WISHES, WORTHS), "customer_id", "campaign_id") == [(1, "d"), (2, "d")]
    assert not rows(M.match(scored.limit(0), OFFERS, WISHES, WORTHS))
    assert not rows(M.match(scored.where("customer_id = 3"), OFFERS, WISHES, WORTHS))
