"""P6 recursive splitter: hand-traced fixtures and invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.splitter import split_text


def test_fixtures():
    assert split_text("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"]
    assert split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split_text("p1p1\n\np2p2", 6, 0) == ["p1p1", "p2p2"]
    assert split_text("", 500, 50) == []
    assert split_text(None, 500, 50) == []
    assert split_text("   \n\n  ", 10, 2) == []


def test_window_case_matches_fixed_windows():
    text = "x" * 1000
    chunks = split_text(text, 500, 50)
    assert chunks == [text[0:500], text[450:950], text[900:1000]]


@settings(max_examples=200, deadline=None)
@given(
    st.text(alphabet=st.sampled_from(list("ab \n\t.")), max_size=300),
    st.integers(min_value=2, max_value=40),
    st.data(),
)
def test_invariants(text, size, data):
    overlap = data.draw(st.integers(min_value=0, max_value=size - 1))
    chunks = split_text(text, size, overlap)
    for c in chunks:
        assert 0 < len(c) <= size
        assert c == c.strip()
        assert c in text
    if text.strip():
        assert chunks
