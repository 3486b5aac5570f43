"""Odd and long pages: time in proportion to their length, and no text lost."""

import time

import pytest

from fanloom.llm import htmlwrap


@pytest.mark.parametrize("page", ["<a x " * 200_000, "<!x " * 250_000, "<a '\" " * 150_000, "<div>" * 100_000 + "</p>" * 100_000, "<li><ul>" + "<x>" * 50_000 + "<li></li>" * 50_000])
def test_long_broken_pages(page):
    began = time.time()
    shape = htmlwrap.shape_of(htmlwrap.parse(page)[0])
    htmlwrap.induce([shape, shape.replace("div(div)", "div(p(div))")])
    assert time.time() - began < 60


def test_deep_elements_are_kept():
    page = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"
    root, texts, _ = htmlwrap.parse(page)
    assert [t for _, t in texts] == ["deep", "after"]
    assert htmlwrap.shape_of(root) == "#root(" + "div(" * 4999 + "div(#)" + ")" * 4999 + " p(#))"
    depth, node = 0, root
    while node.kids:
        depth, node = depth + 1, node.kids[0]
    assert depth == 5001


def test_only_scripts_styles_and_comments_are_left_out():
    page = "<noscript>a</noscript><template>b</template><textarea>c</textarea><select><option>d<option>e</select><svg><text>f</text></svg><script>x</script><style>y</style><!-- z --><p>1 < 2 and <b"
    assert [t for _, t in htmlwrap.parse(page)[1]] == ["a", "b", "c", "d", "e", "f", "1 < 2 and <b"]


def test_content_against_counting_texts(spark):
    """With pages of one shape, the content is what a count of (place, text) leaves."""
    texts = [["head", f"item {k % 3}", f"body {k}", "foot"] for k in range(7)]
    rows = [(k, "http://h.example/x", "".join(f"<p>{t}</p><hr><h2></h2>" for t in own)) for k, own in enumerate(texts)]
    got = {r.page_id: r.content for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    page_count = {}
    for own in texts:
        for spot in set(own):
            page_count[spot] = page_count.get(spot, 0) + 1
    # neighbours of equal structure are one repeated node, so a text counts wherever it stands among them
    assert got == {k: "\n".join(t for t in own if not (page_count[t] >= 2 and page_count[t] >= htmlwrap.CONSTANT * 7)) for k, own in enumerate(texts)}
