"""The ratios choose: constant ones give other texts; class words only assist."""

import time

import numpy as np
import pytest

from skein.llm import html

BODY = ["Paragraph %d of the article says many things, and then more of them; all in one text." % k for k in range(8)]
TEXT = "".join(f"<p>{b}</p>" for b in BODY)
LINKED = "".join(f"<li><a href=/{k}>Other page {k}</a></li>" for k in range(9))


def test_unmarked_boilerplate_goes_by_its_ratio(monkeypatch):
    page = f"<html><body><div><ul>{LINKED}</ul></div><div><div><h1>A title</h1>{TEXT}<ul>{LINKED}</ul><ul><li>one</li><li>two</li></ul></div></div><div><span>Imprint</span><span>Contact</span></div></body></html>"
    assert html.main_text(page).split("\n") == ["A title", *BODY, "one", "two"]
    real = html.path_ratios
    monkeypatch.setattr(html, "path_ratios", lambda nodes: np.where(real(nodes) > 0, 1.0, 0.0))
    assert "Other page 3" in html.main_text(page) and "Imprint" in html.main_text(page)


@pytest.mark.parametrize("name", ["main-menu", "main-nav", "post-sidebar", "content-sidebar", "article-footer", "story-related", "entry-share", "commentBody", "text-ad"])
def test_combined_class_names_are_noise(name):
    page = f"<html><body><div class=post><h1>A title</h1>{TEXT}<div class='{name}'><p>Not the article, at all.</p></div></div></body></html>"
    assert html.main_text(page).split("\n") == ["A title", *BODY]


def test_words_are_overruled_by_the_ratios():
    for wrap in ("<div class='content has-sidebar'>%s</div>", "<div class=widget><div>%s</div></div>", "<div id=related><article>%s</article></div>"):
        assert html.main_text(f"<html><body>{wrap % ('<h1>A title</h1>' + TEXT)}</body></html>").split("\n") == ["A title", *BODY]
    page = f"<html><body><article><div class=header><h1>A title</h1></div>{TEXT}<p class=follow-up>One more thing, at last.</p></article></body></html>"
    assert html.main_text(page).split("\n") == ["A title", *BODY, "One more thing, at last."]


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a "', "<a \"x' ", "<!-- ", "</a ", "<div>", "<p>", "<", "<!x "])
def test_hostile_pages_take_linear_time(part):
    times = []
    for n in (4_000, 16_000):
        page = f"<html><body>{TEXT}" + part * n
        began = time.process_time()
        html.main_text(page)
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.5, times
