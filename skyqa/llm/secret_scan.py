"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` key characters with ``DISTINCT`` different ones; ``=`` belongs to its end only.
The forest sees its length, how its characters follow each other, how much of it dictionary words of
the corpus cover, the path of the document and the words around it. It learns from labelled findings; without
any, from what :func:`judge` can tell of the corpus and from :func:`planted_findings`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import cut
from skyqa.llm.words import PLAIN, find_words, text_blocks

SHORTEST, AROUND = 16, 48
#: Different characters of a candidate: fewer are a ruled line or a filler.
DISTINCT = 4
#: Labelled findings that are fitted at most, words of the dictionary, trees and their depth.
FIT_FINDINGS, DICTIONARY, TREES, DEPTH = 20_000, 4096, 24, 7

# A name ends at its "=" or ":"; a "=" is padding only where no value follows it.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?" % SHORTEST)
# Words beside a finding that name a credential, or something that only looks like one.
_NAMES = re.compile(r"token|secret|passw|api.?key|auth|credential|private|access.?key", re.IGNORECASE)
_OTHERS = re.compile(r"sha|md5|commit|checksum|hash|uuid|digest|iban|card|order|isbn|phone", re.IGNORECASE)
# Parts of a path that say how likely its files hold live keys.
_CONFIG = re.compile(r"conf|env|settings|\.ya?ml|\.ini|\.properties|secret", re.IGNORECASE)
_SAMPLES = re.compile(r"test|example|sample|mock|fixture|doc", re.IGNORECASE)
_ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
_VOWEL = re.compile("[aeiouy]")
# What :func:`judge` goes by. The name just before a value, headers, and prefixes that issuers give their keys.
_LAST_NAME = re.compile(r"([A-Za-z][\w.\-]*(?: (?:key|token|secret))?)[\"'`\]]{0,2}\s{0,3}(?::=|=>|[=:])\s{0,3}[\"'`]?$", re.IGNORECASE)
_HEADER = re.compile(r"authorization[\"']?\s*[:=]\s*[\"']?(?:[a-z]+\s+)?$|\bBearer\s+$", re.IGNORECASE)
_KNOWN_KEY = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w\-]{20,}|[sr]k_(?:live|test)_\w{16,}"
    r"|xox[abprs]-[\w\-]{10,}|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}"
)
_NAMED_OTHER = re.compile(
    r"(?:^|[^a-z0-9])(?:sha-?\d*|md5|commit|revision|checksum|hash|uuid|guid|digest|etag|iban|card(?: (?:no|number))?|order|isbn|phone)"
    r"(?:[ _-]?(?:id|no|number|sum))?[\"'`\])]{0,2}[\s:=#\-]{0,4}[\"'`]?$",
    re.IGNORECASE,
)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_WORDS_ONLY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[\-_/+]+(?:[A-Z]?[a-z]+|[A-Z]+))*[\-_/+]*|[a-z]*(?:[A-Z][a-z]+)*")
_FILLER = re.compile(r"example|placeholder|change.?me|your|dummy|redacted|x{5}|\.\.\.", re.IGNORECASE)

FEATURES = (
    "length", "class changes", "digits", "capitals", "signs", "entropy", "surprise", "vowels",
    "dictionary", "config path", "sample path", "name before", "other before", "assigned", "quoted", "words around",
)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """The ``size`` most frequent words of 3 to 8 ASCII letters (lower case) in all of ``docs(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                words = find_words(data, offsets, PLAIN, lower=True)
                size = words.end - words.start
                bad = np.concatenate([[0], np.cumsum((words.data < 97) | (words.data > 122))])
                use = (size >= 3) & (size <= 8) & (bad[words.end] == bad[words.start])
                padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
                eight = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
                rest = (np.uint64(64) - np.uint64(8) * size[use].astype(np.uint64))
                code = eight[words.start[use]] << rest >> rest
                one, n = np.unique(code, return_counts=True)
                keys, which = np.unique(np.concatenate([keys, one]), return_inverse=True)
                total = np.bincount(which, np.concatenate([total, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "word").limit(size).collect()
    return {int(r.word).to_bytes(8, "little").rstrip(b"\0").decode(): r.n for r in top}


class Features:
    """Turns a candidate and what is around it into numbers."""

    def __init__(self, words: dict[str, int]):
        self.words = frozenset(words)
        pairs: Counter = Counter()
        for word, n in words.items():
            pairs.update({p: n for p in zip(word, word[1:], strict=False)})
        first: Counter = Counter()
        for (a, _), n in pairs.items():
            first[a] += n
        self.surprise = {p: -math.log((n + 1) / (first[p[0]] + 26)) for p, n in pairs.items()}

    def __call__(self, text: str, start: int, end: int, path: str | None) -> list[float]:
        found = text[start:end]
        low, n = found.lower(), end - start
        kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in found]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        count = Counter(found)
        entropy = -sum(c / n * math.log2(c / n) for c in count.values())
        steps = [self.surprise.get(p, 6.0) for p in zip(low, low[1:], strict=False) if p[0].isalpha() and p[1].isalpha()]
        before = text[max(0, start - AROUND) : start].split("\n")[-1]
        after = text[end : end + AROUND].split("\n")[0]
        path = path or ""
        return [
            float(n), changes / n, kinds.count(0) / n, kinds.count(2) / n, kinds.count(3) / n, entropy,
            sum(steps) / len(steps) if steps else 6.0, len(_VOWEL.findall(low)) / n, self._covered(low),
            float(bool(_CONFIG.search(path))), float(bool(_SAMPLES.search(path))),
            float(bool(_NAMES.search(before))), float(bool(_OTHERS.search(before))),
            float(bool(_ASSIGNED.search(before))), float(before[-1:] in "\"'`" and before != "" and after[:1] == before[-1:]),
            float(sum(w.lower().strip(".,;:!?") in self.words for w in (before + " " + after).split())),
        ]

    def _covered(self, low: str) -> float:
        mark = bytearray(len(low))
        for i in range(len(low) - 2):
            for size in range(min(8, len(low) - i), 2, -1):
                if low[i : i + size] in self.words:
                    mark[i : i + size] = b"\1" * size
                    break
        return sum(mark) / len(low)


def candidates(text: str | None) -> Iterator[tuple[int, int]]:
    """Character ranges of all candidates of a text."""
    for m in _CANDIDATE.finditer(text or ""):
        start, end = m.span()
        if text[end - 1] == "=" and text[end : end + 1] in ("\"", "'", "`") and text[start - 1 : start] != text[end : end + 1]:
            end = start + len(m[0].rstrip("="))  # a name before a quoted value
        if end - start >= SHORTEST and len(set(text[start:end])) >= DISTINCT:
            yield start, end


class Forest:
    """Trees on bootstrap samples; each split sees a random part of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = draw.integers(0, len(y), len(y))
            self.trees.append(_grow(x[rows], y[rows], depth, draw))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([_walk(tree, x) for tree in self.trees], axis=0)


def _grow(x: np.ndarray, y: np.ndarray, depth: int, draw) -> tuple | float:
    mean = float(y.mean())
    if depth == 0 or len(y) < 4 or mean in (0.0, 1.0):
        return mean
    best = None
    for j in draw.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False).tolist():
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(at):
            continue
        left, right = ones[at - 1], ones[-1] - ones[at - 1]
        mixed = left * (1 - left / at) + right * (1 - right / (len(y) - at))
        k = int(np.argmin(mixed))
        if best is None or mixed[k] < best[0]:
            best = (mixed[k], j, (v[at[k] - 1] + v[at[k]]) / 2)
    if best is None:
        return mean
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], y[low], depth - 1, draw), _grow(x[~low], y[~low], depth - 1, draw)


def _walk(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _walk(tree[2], x[low]), _walk(tree[3], x[~low])
    return out


def judge(text: str, start: int, end: int) -> int | None:
    """Whether the candidate is a secret by what is written beside it and by its own form; None if these cannot tell.

    1: a known key prefix, a value assigned to a credential's name (quoted, bare, ``.env`` or YAML), an authorization
    header. 0: digests, card numbers, orders and identifiers named as such, UUIDs, numbers with a card's check digit,
    names that are themselves assigned to, and words in running text.
    """
    found = text[start:end]
    before, after = text[max(0, start - AROUND) : start].split("\n")[-1], text[end : end + AROUND].split("\n")[0]
    if _FILLER.search(found):
        return None
    if _KNOWN_KEY.match(found):
        return 1
    wordy = bool(_WORDS_ONLY.fullmatch(found))
    several = len(re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}", found)) > 1
    if wordy and re.match(r"[\"'\]]?\s*[=:]", after):
        return 0
    other = bool(_NAMED_OTHER.search(before))
    name = _LAST_NAME.search(before)
    if (name and _NAMES.search(name[1])) or _HEADER.search(before):
        return None if other or (wordy and several) else 1
    if other:
        return 0
    if _NAMES.search(before):
        return None
    if _UUID.fullmatch(found) or (found.isdigit() and _card(found)):
        return 0
    if wordy and not name and 5 * len(_VOWEL.findall(found.lower())) >= len(found):
        return 0
    return None


def _card(digits: str) -> bool:
    """Whether a number has the length and the check digit of a card's."""
    double = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(double) + sum(int(c) for c in digits[-1::-2])) % 10 == 0


def planted_findings(each: int = 12, seed: int = 11) -> list[tuple[str, int, int, str | None, int]]:
    """Made-up findings ``text, start, end, path, label`` of every kind that :func:`judge` knows.

    So that a forest has seen each kind, and both labels, whatever a corpus happens to hold.
    """
    draw = np.random.default_rng(seed)
    some = lambda letters, n: "".join(draw.choice(list(letters), n))
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed, hexes = small + small.upper() + digits, digits + "abcdef"
    keys = [lambda: some(hexes, 40), lambda: some(hexes, 32), lambda: some(mixed, 40), lambda: some(small, 24), lambda: some(small.upper(), 20)]
    digests = [lambda: some(hexes, 40), lambda: some(hexes, 64), lambda: some(hexes, 32)]
    syllables = "tion ment er en re an al ing is on the ver con pro de ly ness able inter".split()
    words = [lambda: "".join(draw.choice(syllables, 7)), lambda: "_".join(draw.choice(syllables, 6)), lambda: "/".join(draw.choice(syllables, 6))]
    number, uuid = [lambda: some(digits, 16)], [lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))]
    kinds = [
        (1, keys, ['token = "{}"', "token = {}", "api_key: {}", "API_SECRET={}", "AWS_SECRET_ACCESS_KEY={}", "password='{}'", "export AUTH_TOKEN={}",
                   "Authorization: Bearer {}", '"client_secret": "{}"', "here the access key: {} and so on"]),
        (1, [lambda: "AKIA" + some(small.upper() + digits, 16), lambda: "ghp_" + some(mixed, 36)], ["{}", "with {} in it", "key = {}"]),
        (0, digests, ["commit {} was merged", "sha256: {}", "md5 = {}", 'checksum = "{}"', "digest={}"]),
        (0, number, ["card {}", "card number: {}", "order {} of the day", "paid with {} this time"]),
        (0, uuid, ["{}", "uuid: {}", "id = {}"]),
        (0, words, ["{}", "and {} of the", "{} = 5", "{}: some"]),
    ]
    rows = []
    for label, values, frames in kinds:
        for frame in frames:
            front, rest = frame.split("{}")
            for k in range(each):
                value, lead = values[k % len(values)](), " ".join(draw.choice(syllables, 4)) + " " if k % 2 else ""
                if len(value) >= SHORTEST:
                    rows.append((lead + front + value + rest, len(lead + front), len(lead + front + value), None, label))
    return rows


_FINDING = "text string, start int, end int, path string, label int"


def labelled_findings(docs: DataFrame, path: Column, limit: int = FIT_FINDINGS) -> DataFrame:
    """Findings of ``docs(doc_id, text)`` that :func:`judge` can label, and planted ones: ``text, start, end, path, label``.

    What it cannot judge is left out. At most ``limit`` findings, half of each label at most, taken by hash of
    their text. For a corpus without a labelled set; where there is one, give that to :func:`fit`.
    """
    planted = planted_findings()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end in candidates(text):
                    label = judge(text, start, end)
                    if label is not None:
                        at = max(0, start - AROUND)
                        rows.append((text[at : end + AROUND], start - at, end - at, where, label))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["text", "start", "end", "path", "label"]
            )

    rows = docs.select("text", path.cast("string").alias("path")).mapInArrow(find, _FINDING)
    order = F.xxhash64("text", "start")
    half = (limit - len(planted)) // 2
    halves = [rows.where(F.col("label") == k).orderBy(order, "text", "start", "path").limit(half) for k in (0, 1)]
    return halves[0].unionByName(halves[1]).unionByName(docs.sparkSession.createDataFrame(planted, _FINDING))


def fit(findings: DataFrame, words: dict[str, int]) -> Forest | float:
    """A forest for findings ``text, start, end, path, label``; the share of label 1 if there is only one label."""
    rows = findings.select("text", "start", "end", "path", "label").limit(FIT_FINDINGS).collect()
    rows.sort(key=lambda r: (r.text, r.start, r.path or "", r.label))
    if len({r.label for r in rows}) < 2:
        return float(rows[0].label) if rows else 0.0
    of = Features(words)
    x = np.array([of(r.text, r.start, r.end, r.path) for r in rows])
    return Forest(x, np.array([r.label for r in rows], float))


def finder(words: dict[str, int], model: Forest | float, threshold: float = 0.5) -> Callable[[Column, Column], Column]:
    """A function of a text and a path column that gives ``n_candidates, n_secrets, secrets, clean``.

    ``secrets`` holds start, end (characters) and score of each finding the model keeps, ``clean`` the text with
    each replaced by ``[SECRET]`` (NULL for NULL text).
    """

    def find(texts: pa.Array, paths: pa.Array) -> pa.Array:
        of = Features(words)
        spans, x, counts = [], [], []
        texts = texts.to_pylist()
        for text, path in zip(texts, paths.to_pylist(), strict=True):
            own = list(candidates(text))
            spans += own
            counts.append(len(own))
            x += [of(text, a, b, path) for a, b in own]
        score = np.zeros(0)
        if x:
            score = model.score(np.array(x)) if isinstance(model, Forest) else np.full(len(x), model)
        out, at = [], 0
        for text, n in zip(texts, counts, strict=True):
            ranges = zip(spans[at : at + n], score[at : at + n].tolist(), strict=True)
            own = [{"start": a, "end": b, "score": s} for (a, b), s in ranges if s >= threshold]
            at += n
            for f in reversed(own):
                text = text[: f["start"]] + "[SECRET]" + text[f["end"] :]
            out.append({"n_candidates": n, "n_secrets": len(own), "secrets": own, "clean": text})
        return pa.array(out, _FOUND)

    return F.arrow_udf(find, "n_candidates long, n_secrets long, secrets array<struct<start: int, end: int, score: double>>, clean string")


_FOUND = pa.struct(
    [
        ("n_candidates", pa.int64()),
        ("n_secrets", pa.int64()),
        ("secrets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
        ("clean", pa.string()),
    ]
)


def fit_finder(
    docs: DataFrame, path: Column, findings: DataFrame | None = None, threshold: float = 0.5
) -> Callable[[Column, Column], Column]:
    """:func:`finder` with a dictionary of ``docs`` and a forest from ``findings`` (else :func:`labelled_findings`)."""
    words = dictionary(docs)
    known = labelled_findings(docs, path) if findings is None else findings
    return finder(words, fit(cut(known), words), threshold)


def find_secrets(docs: DataFrame, path: Column, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: ``doc_id, n_candidates, n_secrets, secrets`` as :func:`fit_finder` finds.

    NULL or empty text has none. Rows that repeat are scanned one by one; other columns than ``path`` are ignored.
    """
    found = fit_finder(docs, path, findings, threshold)(F.col("text"), path.cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), found.alias("found"))
    return rows.select("doc_id", "found.n_candidates", "found.n_secrets", "found.secrets")
