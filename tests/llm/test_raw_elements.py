"""Script and style texts that look like tags."""

import pytest

from skein.llm import html

HEAD, TAIL = "<html><body><p>First words, here.</p>", "<p>Last words, there.</p></body></html>"


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){}</script>",
        "<SCRIPT>if(a<b){s='it\\'s'}</ScRiPt >",
        "<style>a>b{content:\"<c\"}</style>",
        "<script>x='<!--'</script>",
        "<script><!-- document.write(\"<script src=x></script>\") --></script>",
        "<script><!--> a<b </script>",
        "<script>'<scripts>' + '</scripty>'</script\n>",
        "<title>a <b</title>",
        "<textarea>a<b \"</textarea>",
        "<script></script>",
    ],
)
def test_text_after_raw_elements_is_kept(raw):
    assert html.main_text(HEAD + raw + TAIL).split("\n") == ["First words, here.", "Last words, there."]


def test_a_raw_element_without_end_takes_the_rest():
    assert html.main_text(HEAD + "<script>a<b; x" + TAIL) == html.main_text(HEAD + "<script>x</script") == "First words, here."
