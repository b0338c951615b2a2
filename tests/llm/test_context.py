"""Context vectors of all places against a plain count over every text, however the texts are dealt over tasks."""

import numpy as np
import pyarrow as pa

from skyqa.llm import quality
from skyqa.llm.words import text_blocks


def plain_table(texts):
    which, sign = quality.index_vectors()
    table = np.zeros((quality.WORDS, quality.DIMENSIONS))
    for text in texts:
        if not text:
            continue
        for _, _, data, offsets in text_blocks(pa.array([text])):
            place = quality._places(data, offsets)[3].tolist()
        for i, word in enumerate(place):
            for j in range(max(0, i - quality.REACH), min(len(place), i + quality.REACH + 1)):
                if j != i:
                    for s in range(quality.SIGNS):
                        table[word, which[place[j], s]] += sign[place[j], s]
    size = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return (table / np.where(size > 0, size, 1)).astype(np.float32)


def test_context_table_is_the_plain_one(spark):
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 60, int(draw.integers(0, 40)))) for _ in range(80)]
    texts += [None, "", "one", "a b", "same same same same", texts[0], texts[0]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    want = plain_table(texts)
    for parts in (1, 7):
        assert np.array_equal(quality.context_table(rows.repartition(parts)), want)


def test_no_text_gives_an_empty_context_table(spark):
    assert not quality.context_table(spark.createDataFrame([], "text string")).any()
