"""Pages that browsers show in part, and long or broken pages within time."""

import time

import pytest

from hearsay.llm.html_text import visible_text as show

MEGABYTE = 1 << 20


@pytest.mark.parametrize("source", ["<a ", "<ul><li>", "<div>", "<a b=\"", "<a 'b\" ", "<p><span>", "<table>", "<table><tr><td>", "<b><table><tr><td></b>", "<td rowspan=9>", "<tr><td rowspan=9999>", "<td>", "<!--", "<!", "</", "<b>x", "&", "&am", "<ul><li>x", "<table><tr><td>x<td>", "<select><option>", "<style>.a{", "<li><i>", "x</b>", "<details>", "<a =", "<br>", "<head>", "<td colspan=1000 rowspan=65534>", "文<i>", "<table><tr><td>x<br>y<td>"])
def test_a_megabyte_of_each_kind(source):
    page = source * (MEGABYTE // len(source.encode()))
    began = time.process_time()
    show(page)
    assert time.process_time() - began < 5, source


def test_lists_with_spans_are_found_at_once():
    began = time.process_time()
    show("<ul>" + "<span>" * 20_000 + "<li>x</li>" * 20_000 + "</b>" * 20_000)
    show("<b><table><tr><td>" + "</b>" * 100_000)
    show("<style>" + "".join(f".c{i}{{display:none}}" for i in range(20_000)) + "</style>" + "".join(f"<i class=c{i}>x</i>" for i in range(20_000)))
    assert time.process_time() - began < 8


def test_tags_cut_off_and_quotes():
    assert show("text <a href='x") == "text"
    assert show("a<b title='>'>b</b>") == "ab"
    assert show('<p title="a>b" data-x=\'"\'>c') == "c"
    assert show("1 < 2 and 3 <4") == "1 < 2 and 3 <4"
    assert show("<a b='1' b='2' c=d/>e</a>") == "e"
    assert show("a<!-- b -- > c --> d<!x>e<?y>f") == "a def"


def test_visibility():
    assert show('<div style="visibility:hidden">no<b style="visibility: visible">yes</b>no</div>') == "yes"
    assert show('<div style="display:none">no<b style="display:block">no</b></div>yes') == "yes"
    assert show("<style>.h, p#x {display : none} i{visibility:hidden}</style><p class='a h'>no<p id=x>no<p class=a>yes <i>no</i><div id=x>too</div>") == "yes\n\ntoo"
    assert show("<style>.h{display:none} .h.k{display:block} /* .k{display:none} */ div .k{display:none}</style><p class=h>no<p class='k h'>yes") == "yes"
    assert show("<style>@media print {.h{display:none}} p:hover{display:none}</style><p class=h>yes") == "yes"
    assert show("<style>.h{display:none}</style><p class=h style='display:block'>yes") == "yes"
    assert show("<p hidden style='display:block'>yes") == "yes" and show("<p hidden>no") == ""
    assert show("<details><summary>more</summary>no<p>no</p></details><details open><summary>s</summary>yes</details>") == "more\ns\nyes"


def test_fields():
    assert show("<input type=submit value='Send it'><input type=hidden value=no><input value=typed><input type=password value=no><input type=checkbox value=no>") == "Send ittyped"
    assert show("<select><option>a<option selected>b<option>c</select>") == "b" and show("<select><option>a<option>b</select>") == "a"
    assert show("<select multiple><optgroup label=g><option>a<option>b</select>") == "a b" and show("<select></select>") == ""


def test_wide_characters_are_aligned():
    assert show("<table><tr><td>文字<td>x<tr><td>abcde<td>y</table>") == "文字   x\nabcde  y"
    assert show("<table><tr><td>é<td>x<tr><td>ab<td>y</table>") == "é   x\nab  y"


def test_depth():
    lines = show("<ul><li>x" * 300).split("\n")
    assert len([line for line in lines if line]) == 300 and max(map(len, lines)) == 2 * 100 + 3
    assert show("<table><tr><td>a<td>b" * 700).split() == ["a", "b"] * 700


def test_many_lines_within_many_tables():
    began = time.process_time()
    text = show("<table><tr><td>a<td>" * 400 + "line<br>" * 50_000)
    assert time.process_time() - began < 10 and text.count("line") == 50_000 and text.count("a") == 400


def test_layout_does_not_depend_on_the_lines_of_inner_tables():
    began = time.process_time()
    for levels, rows in ((2, 3), (400, 20_000)):
        page = "<table><tr><td>a<td>" * levels + "<table>" + "<tr><td>r" * rows + "</table>" * (levels + 1) + "<table><tr><td>long<td>x<tr><td>b<td>y"
        assert show(page).split("\n") == ["a  " * levels + "r", *[" " * 3 * levels + "r"] * (rows - 1), "", "long  x", "b     y"]
    assert time.process_time() - began < 10


def test_lines_of_tables_side_by_side():
    inner = "<table><tr><td>a<td>b<br>c<br>d<tr><td>文</table>"
    assert show(f"<table><tr><td>{inner}<td>1<br>2<td>{inner}<br>e") == "a   b  1  a   b\n    c  2      c\n    d         d\n文        文\n          e"
    assert show(f"<ul><li>{inner}") == "- a   b\n    c\n    d\n文"
    assert show("<table><tr><td><table><caption><p>a<p>b</caption><tr><td>c</table><td>d") == "a  d\nb\nc"
