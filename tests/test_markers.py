import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstream.functions import markers as m


@pytest.mark.parametrize(("text", "kinds"), [("plain", ["text"]), ("⟦CODE3⟧", ["placeholder"]), ("<em0>a <strong1>b</strong1></em0>", ["open", "text", "open", "text", "close", "close"]), ("a < b <x1>", ["text"]), ("<link0>t</link0>", ["open", "text", "close"]), ("", [])])
def test_valid(text, kinds):
    assert [t.kind for t in m.scan(text)] == kinds


@pytest.mark.parametrize("text", ["<em0>a", "<em0>a</em1>", "a</em0>", "⟦CODE", "⟦0⟧", "⟦CODE⟧", "<em00>a</em00>", "<em0>a</strong0>"])
def test_invalid(text):
    with pytest.raises(m.MarkerError):
        m.scan(text)


def test_opening_digits_are_a_number():
    assert m.marker_set("<em00>a</em0>") == {("em", 0)}


def test_kind_of_a_placeholder_does_not_matter_but_a_tag_name_does():
    assert m.missing("⟦CODE0⟧", "⟦FOO0⟧") == []
    assert m.missing("<strong0>x</strong0>", "<em0>x</em0>") == ["the <strong0>...</strong0> tag pair"]
    assert m.missing("⟦BR1⟧ x", "x") == ["the placeholder at index 1"]
    assert m.missing("x", "⟦BR1⟧ x") == []
    assert m.missing("broken </em0>", "x") == []


@pytest.mark.parametrize(("attempts", "expected"), [(["a ⟦X0⟧"], ("a ⟦X0⟧", "ok", 0)), (["a", "b ⟦X0⟧"], ("b ⟦X0⟧", "repaired", 1)), (["a", "b", "c ⟦X0⟧"], ("c ⟦X0⟧", "repaired", 2)), (["a", "b", "c", "d ⟦X0⟧"], ("s ⟦X0⟧", "unrecoverable", 2)), (["a"], ("s ⟦X0⟧", "unrecoverable", 0)), ([None, "b ⟦X0⟧"], ("b ⟦X0⟧", "repaired", 1)), ([], ("s ⟦X0⟧", "unrecoverable", 0))])
def test_heal(attempts, expected):
    assert m.heal("s ⟦X0⟧", attempts) == expected


def test_splice_faults():
    tables = ({0: "`x`"}, {}, {})
    assert m.splice("a ⟦CODE0⟧", *tables) == "a `x`"
    for bad in ("⟦CODE1⟧", "⟦CODE0⟧⟦CODE0⟧", "<link0>x</link0>", "<em0>x</em0>"):
        assert m.splice_or_source(bad, "src", tables, lambda: "slice") == ("slice", True)


@given(st.text(alphabet="a⟦⟧<>/em0strongCODE1", max_size=40))
def test_only_its_own_error(text):
    try:
        m.scan(text)
    except m.MarkerError:
        pass
