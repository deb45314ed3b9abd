"""Templates before the body, and pages of very many images."""

import time

from lectern.operators import html


def contents(page):
    return [s["content"] for s in html.parse(page, "http://h/")["sections"]]


def test_templates_are_no_content():
    assert contents("<template><p>a</p></template><p>b</p>") == ["<p>b</p>"]
    assert contents("<head><template><template><p>a</p></template>x<title>no</title></template><title>T</title></head><p>b</p>") == ["<p>b</p>"]
    assert html.parse("<head><template><title>no</title></template><title>T</title></head><p>b</p>", "http://h/")["title"] == "T"
    assert contents("<p>b</p><template><p>a</p></template><p>c</p>") == ["<p>b</p>", "<p>c</p>"]


def test_many_images_take_time_in_proportion():
    began = time.time()
    page = "<p>" + '<img src="a.png" alt="x"> ' * 20_000 + "</p>"
    assert contents(page)[0].count("[Image: x]") == 20_000
    assert time.time() - began < 60
