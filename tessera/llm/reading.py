"""Problem 8: reading level of each document.

The prose of a document (without code, tables, lists, headings, links and markers) is cut into sentences;
each sentence gets a distribution over levels from two regularised linear models in one softmax, one over its
words and one over its character trigrams; a document's difficulty is the word-weighted mean of those distributions,
calibrated to years of schooling on the rated documents, each by a model that was fitted without it.

The classifier is fitted on the driver to a bounded sample of rated documents (``fit_documents``); every document
is scored in Spark by a map over Arrow batches, without any shuffle. The model is a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small, stage

WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 14
#: Upper ends, in years of schooling, of all levels but the last.
LEVEL_ENDS = (4.5, 8.5, 12.5)
LEVELS = len(LEVEL_ENDS) + 1

# Frequent English function words, by which a text is taken to be English.
ENGLISH = frozenset(
    "a an and are as at be by can do each every for from has have if in is it its no not of on one or so that the their then there "
    "this to was we when which with you your".split()
)

_FENCES = ("```", "~~~")
#: What opens a line that is no prose: of tables, lists, headings, quotes and bare links, then of code.
_SKIP = re.compile(
    r"\t| {4,}|\s*(?:[|#>]|[-*+•] |\d{1,3}[.)] |https?://|={3,}|-{3,}"
    r"|import \S+$|def \w|defp? |return\b.*[^.]$|assert \w+[( ]|let (?:mut )?\w+ ?=|for \w+ in \w+:|if [\w.]+ [=!<>]=|//|@\w+|\w+ = \S|[\w.]+\(.*\);?$)"
)
_LONE_DO = re.compile(r"\bdo$")
_URL = re.compile(r"https?://\S+|\]\([^)\s]*\)|www\.\S+")
_MARK = re.compile(r"\[\d+\]|`[^`\n]*`|<[^<>\n]{1,80}>")
# starts with a set of characters, as that is searched for fast; the mark belongs to the sentence that it ends
_SENTENCE = re.compile(r"[.!?…\n](?:(?<!\n)[\"'”’)\]]*\s+(?=[\"'“‘(`]?\w)|(?<=\n)\n+)")
_ABBREVIATION = re.compile(r"\b(e\.g|i\.e|cf|ch|v|vs|fig|no|etc)\.$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Stands between sentences, none of which holds it.
_BREAK = "\n\n"
_PIECE = re.compile(_WORD.pattern + "|\n\n")
_PLAIN_PIECE = re.compile("[a-z]+(?:'[a-z]+)*|\n\n")  # the same for lower-cased ASCII


def prose(text: str) -> str:
    """The running text: lines of code, tables, lists, headings, quotes and bare links are left out, and so
    are links, citation markers, tags and inline code within lines."""
    lines, fenced, fences = [], False, "```" in text or "~~~" in text
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if fences and line.lstrip().startswith(_FENCES):
            fenced = not fenced
        elif not fenced and not _SKIP.match(line) and not _is_code(line):
            lines.append(line)
        elif lines and lines[-1]:
            lines.append("")  # what was left out ends a paragraph
    kept = "\n".join(lines)
    if "http" in kept or "](" in kept or "www." in kept:
        kept = _URL.sub(" ", kept)
    return _MARK.sub(" ", kept) if "[" in kept or "`" in kept or "<" in kept else kept


def _is_code(line: str) -> bool:
    """Whether a line is code by what it holds or ends in."""
    return "::" in line or "->" in line or line.rstrip().endswith((";", "{", "}")) or ", do: " in line or (line.endswith("do") and _LONE_DO.search(line) is not None)


def sentences(text: str) -> list[str]:
    """Sentences of a prose text; an abbreviation in front of a lower-case word or a digit ends none."""
    out: list[str] = []
    start = 0
    for mark, after in [*(m.span() for m in _SENTENCE.finditer(text)), (len(text), 0)]:
        part = text[start : mark + 1].strip()
        start = after
        if not part:
            continue
        # the tail is longer than any abbreviation and what must not stand in front of it
        if out and out[-1][-1] == "." and _ABBREVIATION.search(out[-1][-6:]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _trigrams(a, b, c):
    """Buckets of trigrams by their bytes."""
    return ((a * 961 + b * 31 + c) * 40503 >> 4) % CHAR_BUCKETS


class _Features:
    """Hashed features of sentences; words are hashed once per worker."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def chars(words: list[str]) -> np.ndarray:
        b = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        return _trigrams(b[:-2], b[1:-1], b[2:])

    def of(self, text: str) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[str]]:
        """Per sentence: number of words, word features, character features; and all words."""
        sizes, word_ids, char_ids, everything = [], [], [], []
        for sentence in sentences(text):
            words = _WORD.findall(sentence.lower())
            if words:
                sizes.append(len(words))
                word_ids.append(self.words(words))
                char_ids.append(self.chars(words))
                everything += words
        return sizes, word_ids, char_ids, everything


def is_english(words: list[str], breaks: int = 0) -> bool:
    """Whether enough of the words are frequent English ones and nearly all of the letters plain; so many entries are breaks, no words."""
    n = len(words) - breaks
    return n > 0 and sum(map(ENGLISH.__contains__, words)) >= 0.15 * n and sum(map(str.isascii, words)) - breaks >= 0.9 * n


@dataclass(frozen=True)
class LevelModel:
    """Weights per word and character bucket, and the years of each level; its size is fixed."""

    word: np.ndarray
    char: np.ndarray
    bias: np.ndarray
    years: np.ndarray

    def distributions(self, word_ids: list[np.ndarray], char_ids: list[np.ndarray]) -> np.ndarray:
        """(sentences, LEVELS) probabilities."""
        return _softmax(_pooled(self.word, word_ids) + _pooled(self.char, char_ids) + self.bias)

    def difficulty(self, distributions: np.ndarray, sizes: np.ndarray) -> float:
        return float(np.clip(np.average(distributions, axis=0, weights=sizes) @ self.years, 1, 18))


def _pooled(weights: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(i) for i in ids])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(weights[np.concatenate(ids)], starts, axis=0) / sizes[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Words of which a scorer keeps what they add to a sentence, and words that are scored at once.
KNOWN_WORDS, CHUNK_WORDS = 300_000, 50_000


class _Scorer:
    """Scores whole texts, many at once. What a word adds to its sentence (the weights of its bucket, those of all trigrams within it and
    the blanks around it) is summed once per worker, so that only the trigrams across two words are looked up for every word."""

    def __init__(self, model: LevelModel):
        self.model = model
        letter = np.arange(256)
        #: Weights of the trigram of a last byte, a blank and a first byte; byte 0 is no word's and adds nothing.
        self.across = model.char[_trigrams(letter[:, None], 32, letter[None, :])]
        self.across[0] = self.across[:, 0] = 0
        self.across = self.across.reshape(-1, LEVELS)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {_BREAK: 0}
        #: Per word: weights of its bucket, sum of its trigrams' weights; first and last byte, bytes with one blank.
        self.sums = np.zeros((1 << 12, 2 * LEVELS))
        self.first, self.last, self.length = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _learn(self, pieces: list[str]) -> None:
        new = list(dict.fromkeys(w for w in pieces if w not in self.known))
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        at = len(self.known)
        while at + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.first, self.last, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.last, self.length))
        these = slice(at, at + len(new))
        size = np.fromiter(map(len, coded), np.int64, len(new))
        start = np.cumsum(size + 1) - size - 1
        b = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8).astype(np.int64)
        # a word has as many trigrams as bytes; the one from its last byte on reaches into the next word and is left out
        inside = np.ones(len(b) - 2, bool)
        inside[start[1:] - 1] = False
        self.sums[these, :LEVELS] = self.model.word[np.fromiter((xxhash.xxh32_intdigest(c) % WORD_BUCKETS for c in coded), np.int64, len(new))]
        weights = self.model.char[_trigrams(b[:-2], b[1:-1], b[2:])[inside]].astype(np.float64)
        self.sums[these, LEVELS:] = np.add.reduceat(weights, np.cumsum(size) - size, axis=0)
        self.first[these], self.last[these], self.length[these] = b[start + 1], b[start + size], size + 1
        self.known.update(zip(new, range(at, at + len(new))))

    def _levels(self, pieces: list[str], lengths: list[int]) -> tuple[list[int], list[float], list[list[float]]]:
        """Sentences, years and shares of texts; ``pieces`` has a break after every sentence, and ``lengths`` many belong to each text."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        try:
            ids = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            self._learn(pieces)
            ids = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ends = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        starts, ends = starts[ends > starts], ends[ends > starts]
        sizes, spans = ends - starts, np.stack([starts, ends], axis=1).ravel()
        added = self.sums[ids]
        added[:-1, LEVELS:] += self.across[self.last[ids[:-1]] * 256 + self.first[ids[1:]]]
        # every other sum is that of a sentence without any row besides, so that it is the same in every batch
        sums = np.add.reduceat(added, spans, axis=0)[::2]
        trigrams = np.add.reduceat(self.length[ids], spans)[::2] - 1
        found = _softmax(sums[:, :LEVELS] / sizes[:, None] + sums[:, LEVELS:] / trigrams[:, None] + self.model.bias)
        first = np.searchsorted(starts, np.cumsum(lengths) - lengths)
        shares = np.add.reduceat(found * sizes[:, None], first, axis=0) / np.add.reduceat(sizes, first)[:, None]
        years = np.clip((shares * self.model.years).sum(axis=1), 1, 18)
        return np.diff(np.append(first, len(starts))).tolist(), years.tolist(), shares.tolist()

    def score(self, texts: Iterable[str | None]) -> list[tuple[bool, int, int | None, float | None, list[float] | None]]:
        """(english, words, sentences, years, shares of the levels) of every text."""
        out: list = []
        places, pieces, lengths = [], [], []
        for text in texts:
            running = _BREAK.join(sentences(prose(text))).lower() if text else ""
            found = (_PLAIN_PIECE if running.isascii() else _PIECE).findall(running)
            breaks = found.count(_BREAK)
            if not is_english(found, breaks):
                out.append((False, len(found) - breaks, None, None, None))
                continue
            places.append(len(out))
            out.append((True, len(found) - breaks))
            pieces += found
            pieces.append(_BREAK)
            lengths.append(len(found) + 1)
            if len(pieces) >= CHUNK_WORDS:
                self._fill(out, places, pieces, lengths)
                places, pieces, lengths = [], [], []
        if places:
            self._fill(out, places, pieces, lengths)
        return out

    def _fill(self, out: list, places: list[int], pieces: list[str], lengths: list[int]) -> None:
        for i, *levels in zip(places, *self._levels(pieces, lengths)):
            out[i] = (*out[i], *levels)


#: Folds of rated documents by which a model's distributions are calibrated.
FOLDS = 3


def fit(texts: list[str], years: list[float], rounds: int = 60, ridge: float = 1e-5, step: float = 0.5) -> LevelModel:
    """Softmax regression on sentences that carry their document's level, then the years of each level by ridge regression of the ratings on
    the documents' mean distributions.

    The distributions that calibrate are those of models that did not see the document (one per fold), as a model is surer of
    what it was fitted to; they are fitted in half the rounds, which is as good. ``ridge`` is the value with the least error on held-out documents (0.90 school years at 1e-5, 1.01 at 1e-4, 1.52 at
    1e-3). Without any rated prose every document is put at the middle of the scale.
    """
    features, documents, kept = _Features(), [], []
    for text, y in zip(texts, years):
        s, w, c, words = features.of(prose(text))
        if s and is_english(words):
            kept.append(y)
            documents.append((np.array(s, np.float64), w, c))
    middle = np.full(LEVELS, 9.0)
    if not kept:
        return LevelModel(np.zeros((WORD_BUCKETS, LEVELS), np.float32), np.zeros((CHAR_BUCKETS, LEVELS), np.float32), np.zeros(LEVELS, np.float32), middle)
    rated = np.array(kept)
    model = LevelModel(*_regress(documents, rated, rounds, ridge, step), middle)
    mean = np.zeros((len(kept), LEVELS))
    fold = np.arange(len(kept)) % FOLDS
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        held = model if not len(rest) else LevelModel(*_regress([documents[i] for i in rest], rated[rest], rounds // 2, ridge, step), middle)
        for i in np.flatnonzero(fold == f):
            sizes, w, c = documents[i]
            mean[i] = np.average(held.distributions(w, c), axis=0, weights=sizes)
    prior = np.array([3.0, 7.0, 10.0, 16.0])
    calibrated = prior + np.linalg.solve(mean.T @ mean + 0.5 * np.eye(LEVELS), mean.T @ (rated - mean @ prior))
    return LevelModel(model.word, model.char, model.bias, np.maximum.accumulate(calibrated))


def _regress(documents: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]], rated: np.ndarray, rounds: int, ridge: float, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of words, of character trigrams and of the levels, by Adam on the full batch."""
    of_ = np.repeat(np.arange(len(documents)), [len(s) for s, _, _ in documents])
    weight = np.concatenate([s for s, _, _ in documents])
    truth = np.eye(LEVELS)[np.searchsorted(LEVEL_ENDS, rated)[of_]]
    # each document counts once, whatever its length
    share = weight / np.bincount(of_, weights=weight)[of_] / len(documents)
    bags = []
    for ids, buckets in (([i for _, w, _ in documents for i in w], WORD_BUCKETS), ([i for _, _, c in documents for i in c], CHAR_BUCKETS)):
        n = np.array([len(i) for i in ids])
        bags.append((np.concatenate(ids), np.repeat(np.arange(len(ids)), n), np.concatenate([[0], np.cumsum(n)[:-1]]), n, buckets))
    params = [np.zeros((WORD_BUCKETS, LEVELS)), np.zeros((CHAR_BUCKETS, LEVELS)), np.zeros(LEVELS)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        logits = params[2] + sum(np.add.reduceat(p[ids], starts, axis=0) / n[:, None] for p, (ids, _, starts, n, _) in zip(params, bags))
        error = (_softmax(logits) - truth) * share[:, None]
        gradients = []
        for p, (ids, row, _, n, buckets) in zip(params, bags):
            per = error / n[:, None]
            gradients.append(np.stack([np.bincount(ids, weights=per[row, k], minlength=buckets) for k in range(LEVELS)], axis=1) + ridge * p)
        gradients.append(error.sum(axis=0))
        for p, g, a, b in zip(params, gradients, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return tuple(p.astype(np.float32) for p in params)


def fit_on_ratings(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "school_years", fit_documents: int = 600) -> LevelModel:
    """The model from at most ``fit_documents`` rated documents, picked by a hash of their key.

    Several ratings of a document are averaged; null ratings and null texts are left out.
    """
    mean = ratings.where(F.col(rating).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(rating).alias("years"))
    # ordered by a hash: the same documents in every run
    picked = stage(mean.orderBy(F.xxhash64("key"), "key").limit(fit_documents), "rated")
    rated = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull()).join(broadcast_if_small(picked, 32), "key")
    rows = rated.dropDuplicates(["key"]).orderBy("key").toPandas()
    return fit(rows["text"].tolist(), rows["years"].tolist())


def reading_levels(docs: DataFrame, model: LevelModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, english, prose_words, sentences, school_years, level_shares) of every row.

    ``school_years`` is null where the text has no prose or is not English; null, empty and blank texts have no
    prose. Long texts are read whole. Rows that repeat a key come out as often. An empty table gives an empty
    result; other columns are not carried along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            rows = [(k, *levels) for k, levels in zip(batch["key"].tolist(), scorer.score(batch["text"].tolist()))]
            yield pd.DataFrame(rows, columns=["key", "english", "prose_words", "sentences", "school_years", "level_shares"]).astype({"sentences": "Int32"})

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, english boolean, prose_words int, sentences int, school_years double, level_shares array<double>"
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInPandas(score, schema).withColumnRenamed("key", key)
