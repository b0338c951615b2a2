"""Language of web pages: text likelihood, declared language and address, fused by Bayes' rule.

The text likelihood comes from hashed letter trigrams counted in labelled documents. How far declarations and addresses
can be trusted is counted over the pages themselves, grouped by what the text alone says; the prior of a host falls back
to its domain, the domain to its address suffix, the suffix to all pages, each weighted by how much it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import cut, join_on
from skyqa.llm.words import PLAIN, find_words, list_array, mix, text_blocks

#: Hashed places of trigrams; languages that a model may have; share of the text evidence (trigrams overlap).
TRIGRAMS, LANGUAGES, TEXT_WEIGHT = 1 << 14, 256, 1 / 3
#: Pages that a coarser level of the address counts as, beside those a level has itself.
SMOOTHING = 5.0
#: Added to every count of (language, declaration).
DECLARED_SMOOTHING = 0.5

#: What stands after the ``<`` of a part that is dropped with all it holds, and what ends such a part.
_OPENS = re.compile(r"!--|script\b|style\b", re.IGNORECASE)
_ENDS = {"!": re.compile("-->"), "c": re.compile(r"</script\s*>", re.IGNORECASE), "t": re.compile(r"</style\s*>", re.IGNORECASE)}


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the byte trigrams inside words (with a space on each side), and the text of each."""
    words = find_words(data, offsets, PLAIN, lower=True)
    size = words.end - words.start
    where = np.repeat(words.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    owner = np.repeat(np.arange(len(size)), size)
    padded = np.concatenate([[32], words.data, [32]]).astype(np.uint64)
    digit = (words.data[where] >= 48) & (words.data[where] <= 57)
    left = np.where(where > words.start[owner], padded[where], 32).astype(np.uint64)
    right = np.where(where < words.end[owner] - 1, padded[where + 2], 32).astype(np.uint64)
    code = left << np.uint64(16) | padded[where + 1] << np.uint64(8) | right
    place = (mix(code) >> np.uint64(50)).astype(np.int64)
    return place[~digit], words.doc[owner][~digit]


def train(labelled: DataFrame, text: str = "text", language: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the logarithm of each trigram's share in them, from all rows with a language and text.

    More than ``LANGUAGES`` values are an error: no language is left out.
    """
    names = [r[0] for r in labelled.where(F.col(language).isNotNull()).groupBy(language).count()
             .orderBy(F.desc("count"), language).limit(LANGUAGES + 1).select(language).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: those beyond could never be named")
    names.sort()
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(names), TRIGRAMS), np.int64)
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()])
            for at, _, data, offsets in text_blocks(batch.column(1)):
                place, doc = _trigrams(data, offsets)
                lang = own[at + doc]
                use = lang >= 0
                table += np.bincount(lang[use] * TRIGRAMS + place[use], minlength=table.size).reshape(table.shape)
        lang, place = np.nonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(table[lang, place])],
            ["lang", "place", "n"],
        )

    rows = labelled.select(language, text).mapInArrow(count, "lang int, place int, n long")
    table = np.full((len(names), TRIGRAMS), 0.5)
    for r in rows.groupBy("lang", "place").agg(F.sum("n").alias("n")).collect():  # LANGUAGES x TRIGRAMS at most
        table[r.lang, r.place] += r.n
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def _visible(html: str | None) -> str:
    """The text of a page: comments, scripts, styles and marks are a space each, character references are read.

    A comment, script or style that nothing closes is dropped as a mark alone, and a ``<`` without any ``>`` after it
    stays. An end that was not found once is not looked for again, so the time is in proportion to the page.
    """
    if not html:
        return ""
    out, at, missing = [], 0, set()
    while (mark := html.find("<", at)) >= 0:
        end, opens = None, _OPENS.match(html, mark + 1)
        if opens:
            kind = html[mark + 1] if html[mark + 1] == "!" else html[mark + 2].lower()
            if kind not in missing:
                end = _ENDS[kind].search(html, opens.end())
                if end is None:
                    missing.add(kind)
        to = end.end() if end else html.find(">", mark) + 1
        if not to:
            break  # no mark ends after this place
        out += [html[at:mark], " "]
        at = to
    return unescape("".join([*out, html[at:]]))


def _declared(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    return F.nullif(found, F.lit(""))


def identify(
    pages: DataFrame, names: list[str], model: np.ndarray,
    id_column: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """``page_id, declared, text_language, language, probability`` of every row of ``pages``.

    NULL or empty html has no text evidence, a NULL or odd address only the prior of all pages, and no declaration
    (or an unknown one) says what that says. Ties go to the first name. Other columns are ignored; repeated
    rows each give a row. With no languages the result is NULL.
    """
    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([_visible(h) for h in batch.column(1).to_pylist()], pa.large_string())
            for at, to, data, offsets in text_blocks(texts):
                place, doc = _trigrams(data, offsets)
                score = np.zeros((to - at, len(names)))
                if len(names):
                    for i, share in enumerate(model):
                        score[:, i] = np.bincount(doc, share[place], to - at)
                    score = (score - score.max(axis=1, keepdims=True)) * TEXT_WEIGHT
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, to - at) for c in (batch.column(0), *batch.columns[2:])),
                     list_array(score.ravel(), np.full(to - at, len(names)))],
                    ["page", "declared", "host", "said"],
                )

    host = F.nullif(F.lower(F.regexp_extract(F.col(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+?)\.*(?:[/:?#]|$)", 1)), F.lit(""))
    seen = pages.select(
        F.col(id_column).cast("long").alias("page"), F.col(html).alias("html"), _declared(F.col(html)).alias("declared"), host.alias("host")
    ).mapInArrow(likelihood, "page long, declared string, host string, said array<double>")
    count = len(names)
    if not count:
        none = F.lit(None).cast("string")
        return seen.select(F.col("page").alias(id_column), "declared", none.alias("text_language"), none.alias("language"), F.lit(None).cast("double").alias("probability"))
    seen = cut(
        seen.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
        .withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
        .withColumn("guess", (F.array_position("said", F.array_max("said")) - 1).cast("int"))
        .withColumn("declared", F.when(F.col("declared").isin(names), F.col("declared")))
    )
    # counts of what the text says, by level of the address and by declaration
    by_host = seen.groupBy("host", "domain", "suffix").agg(_counts("guess", count).alias("n_host"))
    def level(of: DataFrame, keys: list[str], source: str, name: str) -> DataFrame:
        sums = [F.sum(F.col(source)[i]) for i in range(count)]
        return of.groupBy(*keys).agg(F.array(*sums).alias(name))

    by_domain = level(by_host, ["domain", "suffix"], "n_host", "n_domain")
    by_suffix = level(by_domain, ["suffix"], "n_domain", "n_suffix")
    everything = level(by_suffix, [], "n_suffix", "n_all")
    prior = cut(
        join_on(join_on(by_host, by_domain, ["domain", "suffix"]), by_suffix, ["suffix"])  # hosts without a dot share the domain ''
        .crossJoin(F.broadcast(everything))  # one row
        .select("host", *(f"n_{x}" for x in ("host", "domain", "suffix", "all")))
    )
    declared = seen.where(F.col("declared").isNotNull()).groupBy("declared").agg(_counts("guess", count).alias("n")).collect()
    trust = np.full((count, count), DECLARED_SMOOTHING)  # language, declaration
    for r in declared:
        trust[:, names.index(r.declared)] += np.array(r.n, float)
    trust = np.log(trust / trust.sum(axis=1, keepdims=True))
    says = F.lit(None).cast("array<double>")
    for i, n in enumerate(names):
        says = F.when(F.col("declared") == n, F.array(*[F.lit(float(v)) for v in trust[:, i]])).otherwise(says)
    joined = seen.join(prior.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")
    # a page does not vouch for itself: its own guess is taken out of every level
    shares = [(F.col("n_all")[i] - _own(i) + 1) / (F.aggregate("n_all", F.lit(0.0), lambda a, x: a + x) - 1 + count) for i in range(count)]
    for name in ("n_suffix", "n_domain", "n_host"):
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x) - 1
        shares = [(F.col(name)[i] - _own(i) + SMOOTHING * s) / (total + SMOOTHING) for i, s in enumerate(shares)]
        joined = joined.withColumn(f"p_{name}", F.array(*shares))
        shares = [F.col(f"p_{name}")[i] for i in range(count)]
    fused = joined.withColumn("log_prior", F.transform("p_n_host", lambda p: F.log(F.greatest(p, F.lit(1e-12)))))
    fused = fused.withColumn("says", F.coalesce(says, F.array_repeat(F.lit(0.0), count)))
    fused = fused.withColumn("post", F.transform("said", lambda x, i: x + F.col("log_prior")[i] + F.col("says")[i]))
    top = F.array_max("post")
    mass = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    label = F.array(*[F.lit(n) for n in names])
    return fused.select(
        F.col("page").alias(id_column),
        "declared",
        label[F.col("guess")].alias("text_language"),
        label[(F.array_position("post", top) - 1).cast("int")].alias("language"),
        (1 / mass).alias("probability"),
    )


def _counts(guess: str, count: int) -> Column:
    return F.array(*[F.sum(F.when(F.col(guess) == i, 1.0).otherwise(0.0)) for i in range(count)])


def _own(i: int) -> Column:
    return F.when(F.col("guess") == i, 1.0).otherwise(0.0)
