import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from quantspark.llm.html_text import extract_html, render

SEEN = [
    ("<svg><title>no</title><desc>no</desc><text>drawn</text></svg>", "drawn"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
    ("a <span aria-hidden=true>seen</span>", "a seen"),
    ("<input value='typed'><input type=password value=no><input type=checkbox value=no><input type=email value=' me'>", "typed me"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<details>no<summary>short</summary><p>no</p><summary>no</summary></details>after", "short\nafter"),
    ("<details open><summary>short</summary>long</details>", "short\nlong"),
    ("in <select><option>no<option selected>two<optgroup><option>no</optgroup></select> out", "in two out"),
    ("<select multiple><option selected>a<option>no<option selected>b</select>", "a b"),
    ("<div style='white-space: pre'>a\n   b</div><div style='white-space:pre-line'>a   b</div>", "a\n   b\n\na b"),
    ("<button value=no>Press</button>", "Press"),
    ("<div style='visibility:hidden'><input value=no><select><option selected>no</select></div>x", "x"),
]


@pytest.mark.parametrize("source,want", SEEN)
def test_a_reader_sees_what_is_rendered(source, want):
    assert render(source)[1] == want


class Words(HTMLParser):
    """Words outside head, scripts and styles, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.closed, self.pieces = 0, []

    def handle_starttag(self, tag, attrs):
        self.closed += tag in ("head", "script", "style")
        self.pieces.append(" " if tag not in ("b", "i", "em", "strong", "a", "span") else "")

    def handle_endtag(self, tag):
        self.closed -= tag in ("head", "script", "style")
        self.pieces.append(" " if tag not in ("b", "i", "em", "strong", "a", "span") else "")

    def handle_data(self, data):
        if not self.closed:
            self.pieces.append(data)


def letters(text):
    return Counter(re.findall(r"[^\W\d_]+", text))


def test_words_of_all_pages_equal_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in extract_html(pages).collect()}
    rows = pages.collect()
    assert len(texts) == len(rows)
    for r in rows:
        other = Words()
        other.feed(r.html or "")
        other.close()
        assert letters(texts[r.page_id]) == letters("".join(other.pieces)), r.page_id
