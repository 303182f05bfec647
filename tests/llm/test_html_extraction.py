"""The page scan: best run against all runs, markup that never ends, deep nesting, and parts around the text."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spectraloom.llm import html_extraction as H

WEIGHTS = H.fit(H.labelled_pages())
LONG = "one two three four five six seven eight nine ten"


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=9))
def test_best_run_is_the_best_of_all(scores):
    def total(first, end):
        return sum(s for s, _ in scores[first:end]) - sum(before for _, before in scores[first + 1 : end])

    first, end = H.best_run(scores)
    every = [total(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert (total(first, end) if end else 0) == max([0, *every])


BROKEN = {
    "tags without an end": "<b " * 330_000,
    "scripts without an end": "<script " * 130_000,
    "declarations without an end": "<!x " * 250_000,
    "quotes that never close": '<b "' * 200_000 + "'>",
    "ends inside quotes": '<b ">" ' * 150_000,
    "deep nesting": "<div>x " * 150_000,
    "inline nesting before rules": "<b>" * 200_000 + "<hr>" * 200_000 + "x",
    "ends of what is not open": "<div>" * 100_000 + "</x>" * 200_000,
    "attributes": "<p " + 'a=" ' * 250_000 + ">x",
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_grows_with_the_length(name):
    start = time.process_time()
    H.extract(BROKEN[name], WEIGHTS)
    assert time.process_time() - start < 30  # seconds a megabyte; quadratic scans take an hour


def test_nothing_is_lost_after_a_gallery_or_a_broken_tag():
    gallery = "<figure><img></figure>" * 300
    assert H.extract(f"<article><p>{LONG}</p>{gallery}<p>{LONG}</p></article>", WEIGHTS) == f"{LONG}\n\n{LONG}"
    assert H.extract(f"<article><p class='a>{LONG}</p><p>{LONG}</p></article>", WEIGHTS) == f"{LONG}\n\n{LONG}"
    assert H.extract(f"<article><p>{LONG}</p><p>a < b</p></article><a href='x", WEIGHTS).startswith(f"{LONG}\n\na < b")


@pytest.mark.parametrize("mark", ['class="responses"', 'id="feedback-list"', 'id="gdpr"', 'class="cookie-notice"', 'class="comment"'])
def test_comments_and_notices_go(mark):
    assert H.extract(f"<article><p>{LONG}</p><p>{LONG}</p></article><div {mark}><p>{LONG}</p></div>", WEIGHTS) == f"{LONG}\n\n{LONG}"
