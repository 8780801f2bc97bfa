"""Pages without article or main: sections of the post that hold little of its text stay."""

import pytest

from skein.llm import html

INTRO, LAST = "A short intro, with words.", "The last words, of all."
BODY = ["Long paragraph number %d, which says many things, and then more of them; all in one text." % k for k in range(12)]
PARTS = "".join(f"<p>{b}</p>" for b in BODY)


@pytest.mark.parametrize("wrap", ["<div class=post>%s</div>", "<div><div><div>%s</div></div></div>", "%s", "<table><tr><td>%s</table>"])
def test_small_siblings_stay(wrap):
    post = f"<div class=intro><h1>The title of it</h1><p>{INTRO}</p></div><div class=text>{PARTS}</div><div class=outro><p>{LAST}</p></div>"
    page = f"<html><body><nav>Home, About.</nav>{wrap % post}<div class=sidebar><p>Side, stuff.</p></div><footer>(c), us.</footer></body></html>"
    assert html.main_text(page).split("\n") == ["The title of it", INTRO, *BODY, LAST]
