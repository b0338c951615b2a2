"""Visible text of pages against plain patterns, and pages of unclosed marks."""

import re
import time
from html import unescape

import numpy as np
import pytest

from skyqa.llm.language import _visible

PLAIN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.IGNORECASE | re.DOTALL)


def test_equals_plain_patterns():
    draw = np.random.default_rng(2)
    parts = ["<!--", "-->", "<script", "<SCRIPT x>", "</script>", "</Script  >", "<style>", "</style", "<", ">", "a", " ", "&amp;", "<b>", "\n", "<scripts>", "-", "<!-"]
    for _ in range(20_000):
        html = "".join(parts[k] for k in draw.integers(0, len(parts), int(draw.integers(0, 14))))
        assert _visible(html) == unescape(PLAIN.sub(" ", html)), html
    assert _visible(None) == _visible("") == ""


@pytest.mark.parametrize("part", ["<!--", "<script>", "<style ", "<", "<script></script ", "<!-- <script> "])
def test_time_is_in_proportion_to_the_page(part):
    began = time.perf_counter()
    _visible(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 5
