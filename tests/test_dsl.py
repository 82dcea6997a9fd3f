"""Query language: parsing and compilation."""

import pytest

from lumidex.plans.compile import Keyword, Range, compile_query
from lumidex.plans.dsl import Match, QueryError, Term, parse


@pytest.mark.parametrize("text", [":v", "f:", "f::v", "p:>-10", "f:<", "+", "a;b", 'a;"2.0"', "a~1.5", "a~1;2", "1.2.3", "ü", "a:b:c", '"open', "a;", 'a~"1"', r'"\q"'])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize(
    "text,terms",
    [
        ("", []),
        (" \t\n", []),
        ("fox", [Term("fox")]),
        ("+fox -cat", [Term("fox", "+"), Term("cat", "-")]),
        ("+ fox", [Term("fox", "+")]),
        ("-250", [Term("250", "-")]),
        ("10-5", [Term("10"), Term("5", "-")]),
        ("7up 2.5kg", [Term("7"), Term("up"), Term("2.5"), Term("kg")]),
        ('"big fox"', [Term("big fox")]),
        (r'"say \"hi\" now"', [Term('say "hi" now')]),
        (r'"\"both\""', [Term("both")]),
        ('"x""y"', [Term("x"), Term("y")]),
        ('""', [Term("")]),
        ("name:fox", [Term("name", "", Match("fox"))]),
        ('+name:"big fox"', [Term("name", "+", Match("big fox"))]),
        ("size:>=10", [Term("size", "", Match("10", ">="))]),
        ('size:>"-10"', [Term("size", "", Match("-10", ">"))]),
        ("day:<2024-02-01", [Term("day", "", Match("2024-02-01", "<"))]),
        ('day:"2024-02-01"', [Term("day", "", Match("2024-02-01"))]),
        ('rate:<="0.5"', [Term("rate", "", Match("0.5", "<="))]),
        ("12:30", [Term("12", "", Match("30"))]),
        ("fox;2.5", [Term("fox", "", None, 2.5)]),
        ("fox;2~1", [Term("fox", "", None, 2.0, 1)]),
        ("+name:fox;3~2", [Term("name", "+", Match("fox"), 3.0, 2)]),
        ("señor ñu", [Term("señor"), Term("ñu")]),
    ],
)
def test_parse(text, terms):
    assert parse(text) == terms


def test_marks_inside_words():
    assert [t.word for t in parse("well-known a+b C++ x=y p/q a@b wild* off%")] == ["well-known", "a+b", "C++", "x=y", "p/q", "a@b", "wild*", "off%"]


FIELDS = {"body": "en", "size": "int", "rate": "float", "day": "date", "tag": "keyword"}


def test_compile():
    q = compile_query('+"Running Dogs";2 -tag:Big size:>3 rate:<=1.5 day:2024-01-02~2', FIELDS, "en")
    assert q.must == [Keyword("run", None, 2.0, 0), Keyword("dog", None, 2.0, 0)]
    assert q.must_not == [Keyword("Big", "tag", 1.0, 0)]
    assert q.should == [Range("size", low=3, closed="none"), Range("rate", high=1.5, closed="both"), Keyword(19724 * 86_400 * 10**9, "day", 1.0, 2)]


def test_bare_words_use_the_default_analyser_even_when_pinned_to_a_field():
    assert compile_query("Dogs", {"tag": "keyword"}, "en", "tag").should == [Keyword("dog", "tag")]
    assert compile_query("Dogs other:Dogs", {}, None).should == [Keyword("Dogs"), Keyword("Dogs", "other")]
    assert compile_query("other:Dogs", {}, "en").should == [Keyword("dog", "other")]


def test_values_without_tokens_disappear():
    with pytest.warns(UserWarning):
        q = compile_query("+size:abc fox", FIELDS, "en")
    assert q.must == [] and q.should == [Keyword("fox")]
