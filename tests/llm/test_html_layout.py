"""HTML at any depth, style rules, visibility, and separators in select and pre."""

import time

import pytest

from sparkcase.llm import html

DEEP = "<div>" * 205


@pytest.mark.parametrize("page,text", [
    (DEEP + "<div>a</div>b", "a\nb"), (DEEP + "<p>one</p><p>two</p>three", "one\n\ntwo\n\nthree"), (DEEP + "<ul><li>x<li>y</ul>z", "- x\n- y\n\nz"),
    (DEEP + "<table><tr><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"), (DEEP + "<b>x</b>y <i>z</i>", "xy z"), (DEEP + "<div hidden>a<p>b</div>c", "c"),
    ("<div>" * 100_000 + "a<p>b", "a\n\nb"), ("<span>" * 100_000 + "a" + "</span>" * 100_000 + "b", "ab"),
    ("<style>.x{display:none} #y , p.z { color:red; visibility: hidden }</style><p class='a x'>1</p><p id=y>2</p><p class=z>3</p><div class=z>4</div>", "4"),
    ("<style>/* .x{} */ @media print { .x { display: none } } .y{display:none}</style><p class=x>1</p><p class=y>2</p>", "1"),
    ("<style>b{display:none}</style>a<b>x</b><b style='display:inline'>y</b>", "ay"), ("<style>#i{display:none}.c{display:block}</style><p id=i class=c>x</p>y", "y"),
    ("<style>p{margin:0}</style><p>x</p>", "x"), ("<style>.c{display:none!important}</style><p class=c style='display:block'>x</p>y", "y"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<p>d</p></div>e", "b\n\ne"), ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>e", "e"),
    ("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b</table>", "b"), ("<pre style='visibility:hidden'>a<b style='visibility:visible'>b</b></pre>", "b"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<select><optgroup label=g><option>a</optgroup><option>b</select>c", "a\nb\nc"), ("<pre>x<ul><li>q<li>r</ul>s</pre>", "x\nq\nr\ns"), ("<pre>a<img alt='pic'>b\n c</pre>", "apicb\n c"),
    ("a\0b<br>c", "ab\nc"), ("<pre>a\0b</pre>", "ab"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li value=5>b<li>c</ol>", "9. a\n5. b\n4. c"),
    ("a<br><br>b<br>", "a\n\nb"), ("<ol><li>a<ol><li>b</ol><li>c</ol>", "1. a\n   1. b\n2. c"),
])
def test_pages(page, text):
    assert html.rendered(page)[0] == text


@pytest.mark.parametrize("piece", ["<ul><li>w", "<blockquote>w", "<table><tr><td>w", "<dl><dd>w", "<div>w", "<p><b>w", "<table><tr><td>w<table><tr><td>w"])
def test_every_word_of_deep_pages_stands_alone(piece):
    n = 3_000
    page, words = "", []
    for i in range(n):
        page += piece.replace("w", f"w{i}.")
        words += [f"w{i}"] * piece.count("w")
    began = time.time()
    text = html.rendered(page)[0]
    assert sorted(text.replace("-", " ").replace(".", " ").split()) == sorted(words)
    assert time.time() - began < 60 and len(text) < 40 * 1_000_000
