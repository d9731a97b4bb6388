"""Costs of the cheapest parse: values by their 64-bit range, and the reason of every failing record from them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.operators import error_parse as ep

NUMBERS = [str(n) for n in (2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**18, 10**19, "+" + str(2**63), "-" + "0" * 40 + "9", "0" * 40 + str(2**63), "00", "-", "1_0", " 7 ", "7 7")]


@pytest.mark.parametrize("number", NUMBERS)
def test_range_is_a_cost(number):
    assert ep.cheapest(f"A,{number},true")[0] == (0, 0, int(not ep.typed("long", number)[0]))


def test_failing_records_are_decided_by_the_program(monkeypatch):
    asked = []
    whole = ep.cheapest
    monkeypatch.setattr(ep, "cheapest", lambda record, kinds=ep.KINDS: asked.append(record) or whole(record, kinds))
    assert [ep.parse_record(r)[1:3] for r in ("A,5,no", f"A,{2**63},no", "A,5,true")] == [("active", "give up active"), ("age", "give up age; give up active"), (None, "")]
    assert asked == ["A,5,no", f"A,{2**63},no"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0189+- x", max_size=24), st.sampled_from(["true", "FALSE ", "", "tru", "t rue", "yes"]))
def test_values_given_up(number, flag):
    bad = [k for k, f in (("long", number), ("bool", flag)) if not ep.typed(k, f)[0]]
    assert ep.cheapest(f"A,{number},{flag}") == ((0, 0, len(bad)), [], f"A,{number},{flag}")
