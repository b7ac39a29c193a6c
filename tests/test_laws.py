"""Laws that any model and rows obey."""

from collections import Counter

import pytest

FILTERS = ["has Fuel: 'electric'", "lies in Port: 1", "runs Sailing", "runs Sailing carries Cargo is of Goods: 'FI'", "has relief Ferry"]
WHOLE = "LIST f FROM Ferry f"


def hulls(ask, tail=""):
    return Counter(r[0] for r in ask(f"{WHOLE} {tail}"))


@pytest.mark.parametrize("f", FILTERS)
def test_a_filter_and_its_absence_split_the_whole(ferries, f):
    inside, outside = hulls(ferries, f"[{f}]"), hulls(ferries, f"BUT NOT {f}")
    assert inside + outside == hulls(ferries)
    assert inside == hulls(ferries, f"AND ALSO {f}") == hulls(ferries, f"WHERE {f}")
    assert outside == hulls(ferries, f"WHERE NOT {f}")


@pytest.mark.parametrize(("f", "g"), [(f, g) for k, f in enumerate(FILTERS) for g in FILTERS[k + 1 :]])
def test_conjunction_commutes_and_disjunction_counts(ferries, f, g):
    both = hulls(ferries, f"[{f}] [{g}]")
    assert both == hulls(ferries, f"[{g}] [{f}]") == hulls(ferries, f"WHERE {f} AND {g}")
    either = hulls(ferries, f"AND ALSO ({f} OR OTHERWISE {g})")
    assert sum(either.values()) == sum(hulls(ferries, f"[{f}]").values()) + sum(hulls(ferries, f"[{g}]").values()) - sum(both.values())


def test_distinct_never_adds_and_removes_repeats(ferries):
    assert Counter(ferries("LIST p FROM DISTINCT Sailing starts in Port p")) == Counter(set(ferries("LIST p FROM Sailing starts in Port p")))


def test_groups_add_up_to_the_whole(ferries):
    groups = ferries("LIST p, c FROM Sailing s goes to Port p AND ALSO THE COUNT OF s GROUPED BY p AS c")
    assert sum(c for _, c in groups) == ferries("THE COUNT OF Sailing")[0][0]
    sums = ferries("LIST p, t FROM Sailing goes to Port p AND ALSO has Fare x AND ALSO THE SUM OF x GROUPED BY p AS t")
    assert sum(t for _, t in sums) == ferries("THE SUM OF x IN Sailing has Fare x")[0][0]


def test_extremes_are_listed_values(ferries):
    listed = {r[0] for r in ferries("LIST s FROM Ferry has Seats s")}
    assert ferries("LIST THE MAXIMUM Ferry has Seats AS a, THE MINIMUM Ferry has Seats AS b") == [(max(listed), min(listed))]


def test_cut_is_a_stretch_of_the_order(ferries):
    whole = ferries("LIST n FROM Ferry has FerryName n ORDERED WITH n DESCENDING")
    assert ferries("LIST n FROM Ferry has FerryName n ORDERED WITH n DESCENDING THE FIRST 2") == whole[:2]
    assert ferries("LIST n FROM Ferry has FerryName n ORDERED WITH n DESCENDING THE FIRST 2 AFTER 2") == whole[2:4]


def test_subtypes_are_within_their_supertype(ferries):
    assert {r[0] for r in ferries("LIST i FROM Icebreaker i")} < set(hulls(ferries))


def test_set_operations_agree_with_sets(ferries):
    one, two = "LIST f FROM Ferry f [has Fuel: 'diesel']", "LIST f FROM Ferry f [has relief Ferry]"
    a, b = ({r[0] for r in ferries(t)} for t in (one, two))
    got = lambda op: {r[0] for r in ferries(f"({one}) {op} ({two})")}
    assert (got("UNITED WITH"), got("INTERSECTED WITH"), got("MINUS")) == (a | b, a & b, a - b)
