"""Pages that leave out tags, and text of elements inside an article."""

import pytest

from foliant.llm.html_blocks import Contexts, blocks


def texts(page):
    return [b[0] for b in blocks(page, Contexts())]


@pytest.mark.parametrize("page", [
    "<head><title>T</title><p>article</p>",
    "<html><head><meta charset=utf-8><title>T</title><link rel=x><noscript><img src=x></noscript><div>article</div>",
    "<head><title>T</title>article",
    "<html><head><title>T</title></head><body><p>article</p></body></html>",
])
def test_head_ends(page):
    assert texts(page) == ["article"]


def test_text_inside_elements_stays():
    page = "<body><p>one <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two <object>three</object> <canvas>four</canvas> <noscript>five</noscript> <svg><text>six</text></svg></p><script>no</script>"
    assert texts(page) == ["one x=2 two three four five six"]
