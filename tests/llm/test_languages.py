"""No language is left out without a word."""

import pytest

from skyqa.llm import language


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(lang, "some text") for lang in ("a", "b", None)]
    assert language.train(spark.createDataFrame(rows, "lang string, text string"))[0] == ["a", "b"]
    with pytest.raises(ValueError, match="languages"):
        language.train(spark.createDataFrame([*rows, ("c", "more")], "lang string, text string"))
