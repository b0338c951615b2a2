"""Licence expressions with other text behind them."""

import pytest

from skyqa.llm import licenses


@pytest.mark.parametrize(("text", "labels"), [
    ("MIT", {"mit"}), ("MIT.", {"mit"}), ("MIT Copyright 2020", {"mit"}), ('MIT"', {"mit"}), ("MIT)", {"mit"}),
    ("MIT OR Apache-2.0. All rights", {"mit", "apache-2"}), ("(MIT OR GPL-3.0-only) AND Apache-2.0 Copyright", {"mit", "gpl-3", "apache-2"}),
    ("MIT OR", None), ("(MIT", None), ("", None), (") MIT", None), ("MIT AND ) x", {"mit"}), ("MIT. OR more", {"mit"}),
])
def test_the_longest_expression_counts(text, labels):
    found = licenses.parse(text)
    assert (found and found[0]) == labels


def test_tags_of_one_line():
    found = licenses._TAG_LINE.findall("SPDX-License-Identifier: MIT x SPDX-License-Identifier: Apache-2.0 y\nz")
    assert [sorted(licenses.parse(f)[0]) for f in found] == [["mit"], ["apache-2"]]
