import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from psephos.functions.text import one_pattern
from psephos.operators.flags import any_flag, flag_by_patterns
from psephos.plans import config as c


def test_religious_names(one_column, by_id):
    names = ["PAIXAO", "SR PAI", "PASTORAL", "JOAO PASTOR", "IRMÃO JOSE", "pastor joao", None, "o PASTOR"]
    flagged = flag_by_patterns(one_column(names), "value", c.RELIGIOUS_NAMES, "flag")
    assert by_id(flagged, "flag") == [1, 0, 0, 1, 1, 0, 0, 1]


def test_security_names(one_column, by_id):
    names = ["EDSON PM", "CABO LUIZ", "LUIZ CABO", "MAJORITARIO", None, "T. C. SILVA", "TXCX", "STE", "ST E"]
    flagged = flag_by_patterns(one_column(names), "value", c.SECURITY_NAMES, "flag")
    assert by_id(flagged, "flag") == [1, 1, 0, 1, 0, 1, 0, 0, 1]


def test_occupations_match_inside_the_text(one_column, by_id):
    jobs = ["POLICIAL MILITAR", "EX POLICIAL MILITAR", "ADVOGADO", None]
    flagged = flag_by_patterns(one_column(jobs), "value", c.SECURITY_OCCUPATIONS, "flag")
    assert by_id(flagged, "flag") == [1, 1, 0, 0]


def test_no_patterns_flag_nothing(one_column, by_id):
    assert by_id(flag_by_patterns(one_column(["a", None]), "value", [], "flag"), "flag") == [0, 0]


def test_list_sizes():
    assert (len(c.RELIGIOUS_NAMES), len(c.SECURITY_NAMES)) == (51, 88)
    assert sum(map(len, c.SPECTRUM_PARTIES.values())) == 47


@pytest.mark.parametrize("patterns", [c.RELIGIOUS_NAMES, c.SECURITY_NAMES])
@settings(max_examples=300, deadline=None)
@given(data=st.data())
def test_one_pattern_finds_what_the_alternation_finds(patterns, data):
    plain = [re.sub(r"\\s|[\\^$]", " ", p).strip() for p in patterns]
    pieces = st.one_of(st.sampled_from(plain), st.text(alphabet="ABCEMPRST. ao", max_size=4))
    text = "".join(data.draw(st.lists(pieces, max_size=4)))
    expected = re.search("|".join(patterns), text) is not None
    assert (re.search(one_pattern(patterns), text) is not None) == expected


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.from_regex(r"\^?[ab]{1,3}(\\\.)?[ab]?\$?", fullmatch=True), min_size=1, max_size=6),
    st.text(alphabet="ab.", max_size=8),
)
def test_one_pattern_on_any_list(patterns, text):
    expected = re.search("|".join(patterns), text) is not None
    assert (re.search(one_pattern(patterns), text) is not None) == expected


def test_patterns_with_their_own_alternation():
    patterns = ["^a|b", "c+", "x?y"]
    for text in ["za", "a", "zb", "ccc", "y", "z"]:
        assert bool(re.search(one_pattern(patterns), text)) == bool(re.search("|".join(patterns), text))


def test_any_flag_replaces_its_inputs(spark):
    rows = [(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)]
    df = any_flag(spark.createDataFrame(rows, "id int, a int, b int"), ["a", "b"], "a")
    assert df.columns == ["id", "a"]
    assert sorted(map(tuple, df.collect())) == [(0, 0), (1, 1), (2, 1), (3, 1)]
