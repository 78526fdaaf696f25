"""Bounds of rendered text, rules of visibility, and dotted names in the mix."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing
from tessella.llm.html_text import render


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" + "x" * 100_000 + "<td>y" + "<tr><td>a<td>b" * 3_000 + "</table>",
        "<table><tr><td>" + "<td>".join(["w" * 80] * 500) + "<tr><td colspan=1000><td>x" * 1_500,
        "<ul><li>x" * 3_000,
        "<table><tr><td>a<td>" * 500,
        "<blockquote>x" * 3_000,
    ],
)
def test_text_is_bounded_by_the_page(page):
    text = render(page)
    assert len(text) <= 50 * len(page)
    assert sorted(text.split())[:5] and len("".join(text.split())) <= len(page)


def test_cells_align_where_that_is_cheap():
    assert render("<table><tr><td>ab<td>c<tr><td>abcdef<td>d</table>").split("\n") == ["ab      c", "abcdef  d"]
    wide = render("<table><tr><td>" + "x" * 1_000 + "<td>y" + "<tr><td>a<td>b" * 100 + "</table>").split("\n")
    assert wide[0].endswith("x  y") and set(wide[1:]) == {"a  b"}


def test_visibility_is_handed_down():
    assert render('<div style="visibility:hidden">no<p style="visibility: visible">yes<b style="visibility:collapse">no</b></p>no</div>after').split() == ["yes", "after"]
    assert render('<p style="display:none">no<b style="visibility:visible">no</b></p>on').split() == ["on"]
    assert render("<details><summary>first</summary>closed</details><details open><summary>second</summary>opened</details>").split() == ["first", "second", "opened"]


def test_mix_of_rows_with_dotted_names(spark):
    rows = [(i, f"source{i % 3}", "some words of a text " * (1 + i % 4), i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, `a.b` int").withColumn("__row", F.lit("own"))
    mix = mixing.mixed(docs)
    assert mix.where("`a.b` = doc_id and __row = 'own'").count() == 60
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() > 0 and mixing.emitted(mix).count() == out.count()
