"""Text that a word of a class or id, a formula or a form around the page must not lose; chrome still goes."""

import pytest

from tidelog.llm.html_extract import main_text


@pytest.mark.parametrize("part,want", [
    ('<section id="related-work"><h2 id="comments-on-the-method">Head</h2><p>Kept.</p></section>', "Head\nKept."),
    ('<p data-id="share" class="promo">Kept.</p>', "Kept."), ('<h2><span id="related">Related</span></h2>', "Related"),
    ('<div class="social-history">Kept.</div>', "Kept."), ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
    ('<div class="cookie-banner">Gone</div><div class="x relatedPosts">Gone</div><div id="sidebar-left">Gone</div><div class="ad">Gone</div>', ""),
])
def test_inside_an_article(part, want):
    assert main_text(f"<article><p>Body of the text.</p>{part}</article>") == "Body of the text." + ("\n" + want if want else "")


def test_form_around_the_page():
    assert main_text("<form><div><p>A whole page of text.</p><p>More of its text.</p></div></form>") == "A whole page of text.\nMore of its text."
    assert main_text("<div><p>A whole page of text.</p><p>More of its text.</p></div><form><p>Search</p></form>") == "A whole page of text.\nMore of its text."
