import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelake.plans import ast
from tidelake.plans.api import Session
from tidelake.plans.parser import QueryError, parse, parse_duration


@pytest.mark.parametrize(
    ("text", "printed"),
    [
        ("1 + 2 * 3", "1 + 2 * 3"),
        ("-a ^ 2", "-a ^ 2"),
        ("sum by(a)(rate(x[5m]))", "sum by (a) (rate(x[5m]))"),
        ("sum(x) without (b)", "sum without (b) (x)"),
        ('{__name__="a",b!~"c.*"}', 'a{b!~"c.*"}'),
        ("x[1h30m:1m] offset -5m", "x[1h30m:1m] offset -5m"),
        ("x @ end() offset 1w", "x @ end() offset 1w"),
        ("a / on(x) group_left(y) b", "a / on (x) group_left (y) b"),
        ("topk(3, x) > bool 4", "topk(3, x) > bool 4"),
        ("0x1F + 1e3 + .5", "31 + 1000 + 0.5"),
        ("5m", "300"),
        ("'a\\'b'", "\"a'b\""),
    ],
)
def test_printed_form(text, printed):
    assert str(parse(text)) == printed
    assert str(parse(printed)) == printed


def test_precedence():
    e = parse("a or b and c == d + e * f ^ g")
    assert e.op == "or" and e.right.op == "and" and e.right.right.op == "=="
    power = parse("2 ^ 3 ^ 2")
    assert power.right.op == "^"
    assert isinstance(parse("-1 ^ 2"), ast.Unary) or parse("-1 ^ 2").op == "^"


@pytest.mark.parametrize(
    "text",
    [
        "", "x[", "x[5m", "sum(x, 1)", "topk(x)", "1 > 2", "rate(x)", "rate(x[5m], 1)", '{a=~".*"}', "{}", "x offset", "x offset 1m offset 2m",
        "x @ 1 @ 2", "1 offset 5m", "foo(x)", "a and 1", "x + bool y", "a and on(b) group_left() c", 'x{__name__="y"}', "sum(1)", "x[0s]", "x{a='b'",
        "a == on(x) group_left(x) b", "abs(x[5m])", "x[5m][5m]", 'label_replace(x, "a")', "1 +", "$", 'x{a=~"("}', "1m1h",
    ],
)
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def test_experimental_functions_need_the_option():
    parse("mad_over_time(x[5m])")
    with pytest.raises(QueryError):
        parse("mad_over_time(x[5m])", experimental=False)
    with pytest.raises(QueryError):
        parse("limitk(1, x)", experimental=False)


@given(st.integers(0, 10**10))
def test_durations_round_trip(ms):
    assert parse_duration(ast.format_duration(ms)) == ms


_names = st.sampled_from(["a", "b_total", "job:x:rate5m"])
_expr = st.recursive(
    st.one_of(_names, st.integers(0, 9).map(str), _names.map(lambda n: f'{n}{{x="y"}}')),
    lambda inner: st.one_of(
        st.tuples(inner, st.sampled_from(["+", "*", "^", "/", "%"]), inner).map(" ".join), inner.map(lambda e: f"({e})"), inner.map(lambda e: f"abs(({e}))")
    ),
    max_leaves=6,
)


@given(_expr)
def test_printing_parses_to_the_same(text):
    try:
        e = parse(text)
    except QueryError:
        return
    assert parse(str(e)) == e


def test_pretty_and_matchers():
    text = 'sum by (job) (rate(requests_total{code=~"5.."}[5m])) / on (job) group_left () sum by (job) (rate(requests_total[5m]))'
    assert parse(Session.format(text)) == parse(text)
    assert "\n" in Session.format(text)
    assert Session.set_matcher("a + rate(b[5m])", "env", "=", "x") == 'a{env="x"} + rate(b{env="x"}[5m])'
    assert Session.drop_matcher('a{env="x",b="c"}', "env") == 'a{b="c"}'
    assert Session.tree("a + 1")["children"][1]["type"] == "scalar"
