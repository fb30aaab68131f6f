"""Problem 3: text garbled by a wrong character encoding: find the records, restore the text.

Every record has a latent chain: clean, or one of the known ways in which bytes of one encoding were read in
another (also twice over), or lost beyond repair. Tokens with other than plain characters are the
evidence: undoing a chain either fails or gives a token that a character model of clean text finds more or less likely than
what stands there. Expectation-maximization alternates between

* E: the posterior of each record's chain from its tokens and from the prior of its group (its source and field), and
* M: the priors of the groups and, with the damaged tokens taken out, the character model,

so weak evidence adds up within a record and across the records of a source. Each record is then repaired by its
posterior chain.

Spark counts and joins tokens; a record is cut once and a distinct token scored once. The character model is a pair of hashed
tables of bigrams of fixed size, and so is what reaches the driver of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import mix
from tessera.runtime import broadcast_if_small, forget, spread_join, stage

#: Slots of each of the two hash tables of bigrams, and of the table of characters.
BIGRAMS, CHARS = 1 << 21, 1 << 16
LOST = "lost"
#: Priors of an undamaged record and of damage in general, before any evidence.
FIRST_DAMAGE = 0.02
#: Half of a damaged record's suspicious tokens may be clean: damage may cover one stretch only.
STRETCH = 0.5

# Code pages in which UTF-8 is misread, and pairs (true, misread as) of other encodings.
_UTF8_AS = "cp1252 latin-1 iso8859-15 iso8859-2 cp1250 cp1251 koi8-r cp866 cp437 cp850 mac-roman cp1254 cp1257 cp1253 cp932 gbk big5 cp949".split()
_LEGACY = {
    "cp1252": "cp1250 iso8859-2 cp1251 mac-roman cp437 cp850 koi8-r cp866 cp1253",
    "cp1250": "cp1252 latin-1 cp1251 cp852 iso8859-2 cp437 mac-roman",
    "iso8859-2": "cp1252 latin-1 cp1250 cp437",
    "cp1251": "cp1252 latin-1 koi8-r cp866 mac-roman iso8859-5",
    "koi8-r": "cp1252 latin-1 cp1251 cp866",
    "cp866": "cp1252 latin-1 cp1251 koi8-r cp437",
    "iso8859-5": "cp1252 latin-1 cp1251",
    "mac-roman": "cp1252 latin-1",
    "cp850": "cp1252 latin-1",
    "cp437": "cp1252 latin-1",
    "cp932": "cp1252 latin-1 mac-roman",
    "euc_jp": "cp1252 latin-1 cp932 mac-roman",
    "gbk": "cp1252 latin-1",
}


def chains() -> dict[str, tuple[tuple[str, str], ...]]:
    """Name -> (true, misread as) steps in the order in which they happened."""
    out = {f"utf-8>{wrong}": (("utf-8", wrong),) for wrong in _UTF8_AS}
    out |= {f"utf-8>{wrong} twice": (("utf-8", wrong),) * 2 for wrong in ("cp1252", "latin-1", "iso8859-15", "mac-roman", "cp1250", "cp1251", "cp437", "cp850")}
    out |= {"utf-8>cp1252 then latin-1": (("utf-8", "cp1252"), ("utf-8", "latin-1")), "utf-8>latin-1 then cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252"))}
    return out | {f"{true}>{wrong}": ((true, wrong),) for true, wrongs in _LEGACY.items() for wrong in wrongs.split()}


CHAINS = chains()
_UTF8_CHAINS = [name for name, steps in CHAINS.items() if steps[0][0] == "utf-8"]
_UTF8_NAMES = frozenset(_UTF8_CHAINS)
_LEGACY_CHAINS = [name for name in CHAINS if name not in _UTF8_CHAINS]


def _tables() -> dict[str, dict[str, bytes]]:
    """For every single-byte misreading: character -> byte; bytes without a character keep their number."""
    out = {}
    for name in {wrong for steps in CHAINS.values() for _, wrong in steps}:
        if name in ("cp932", "gbk", "big5", "cp949"):
            continue
        table = {chr(b): bytes([b]) for b in range(256)} if name != "latin-1" else {}
        for b in range(256):
            try:
                table[bytes([b]).decode(name)] = bytes([b])
            except UnicodeDecodeError:
                pass
        out[name] = table
    return out


_TABLES = _tables()
_ALPHABETS = {name: frozenset(table) if table else frozenset(map(chr, range(256))) for name, table in _TABLES.items()}
_PLAIN = frozenset(map(chr, range(128)))
_ANY_PAGE = frozenset().union(*_ALPHABETS.values()) - _PLAIN
_WIDE = frozenset(name for name, steps in CHAINS.items() if steps[-1][1] not in _ALPHABETS)
#: Control and private characters, which no repaired text holds.
_UNFIT = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ue000-\uf8ff]")


def possible(token: str, names: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(chain, undone) of the chains among ``names`` that the token may have gone through."""
    special, known = frozenset(token) - _PLAIN, {}
    if special.isdisjoint(_ANY_PAGE):  # nothing of a single-byte page: most text in Chinese characters
        names = [n for n in names if n in _WIDE]
    for chain in names:
        step = CHAINS[chain][-1]
        if step not in known:
            known[step] = _reach(token, special, *step)
        if known[step] == 0:
            continue
        before = undo(token, chain) if known[step] == 2 else None
        if before is None:
            before = undo_stretches(token, chain)
        if before is not None and not _UNFIT.search(before):
            yield chain, before


def _reach(token: str, special: frozenset[str], true: str, wrong: str) -> int:
    """2 if the whole token may be bytes of ``true`` read as ``wrong``, 1 if stretches of it may, 0 if none of it can."""
    alphabet = _ALPHABETS.get(wrong)
    if alphabet is None:
        if true != "utf-8":
            return 2
        # clean text of such a page has sequences by chance, but hardly three on end
        return 2 if (_UTF8 if len(special) < 4 else _UTF8_THREE).search(token.encode(wrong, "ignore")) else 0
    if alphabet.isdisjoint(special) or not _ONES[true, wrong].search(token):
        return 0
    return 2 if alphabet >= special else 1


def _bytes(text: str, wrong: str) -> bytes:
    table = _TABLES.get(wrong)
    if not table:
        return text.encode(wrong)
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        return b"".join([table[c] for c in text])  # KeyError: not a character of that code page


def undo(text: str, chain: str) -> str | None:
    """What ``text`` was before ``chain``, or None if that cannot be. Up to a tenth of it may stay unreadable (U+FFFD)
    where characters were cut apart, if far more was restored."""
    for true, wrong in reversed(CHAINS[chain]):
        try:
            raw = _bytes(text, wrong)
        except (UnicodeEncodeError, KeyError):
            return None
        try:
            undone = raw.decode(true)
        except UnicodeDecodeError:
            undone = raw.decode(true, "replace")
            unread, restored = undone.count("�"), sum(c > "\x7f" and c != "�" for c in undone)
            if unread > max(1, len(undone) // 10) or restored < 4 * unread:
                return None
        if undone == text:
            return None
        text = undone
    return text


# What one character other than ASCII is in the bytes of an encoding (as Latin-1 text); in single-byte ones, one byte.
_SEQUENCES = {
    "utf-8": "[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}",
    "cp932": "[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]",
    "euc_jp": "\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2}",
    "gbk": "[\x81-\xfe][\x40-\x7e\x80-\xfe]",
}
_SINGLE = "[\x80-\xff]"
#: Stands for a character that the misreading code page has not.
_FOREIGN = "\u0100"


_UTF8 = re.compile(_SEQUENCES["utf-8"].encode("latin-1"))
_UTF8_THREE = re.compile(b"(?:[\x00-\x7f]*(?:" + _UTF8.pattern + b")){3}")


def _runs() -> tuple[dict[tuple[str, str], re.Pattern], dict[tuple[str, str], re.Pattern]]:
    """(true, misread as) -> a whole character of the one, spelt in the characters of the other if that is single-byte; and runs of such."""
    ones, out = {}, {}
    for true, wrong in {step for steps in CHAINS.values() for step in steps}:
        one = _SEQUENCES.get(true, _SINGLE)
        if wrong in _TABLES:
            of = {}
            for char in _ALPHABETS[wrong]:
                of.setdefault(_bytes(char, wrong)[0], []).append(char)

            def spelt(m: re.Match) -> str:
                held = [c for b in range(256) if re.match(m[0], chr(b)) for c in of.get(b, ())]
                return "[" + "".join(map(re.escape, held)) + "]"

            one = re.sub(r"\[[^]]+\]|[\x80-\xff]", spelt, one)
        ones[true, wrong] = re.compile(one)
        out[true, wrong] = re.compile(f"(?:[\x00-\x7f]*(?:{one}))+")
    return ones, out


_ONES, _RUNS = _runs()


def stretches(text: str, true: str, wrong: str) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of characters of ``wrong`` in ``text`` that are whole characters of ``true``.

    What chance brings about in clean text is left out: where all characters are of the code page, a lone pair (but for
    those of Latin-1 that touch no other such character), and in a multi-byte page, which holds clean text as well, less
    than nine bytes. Next to a character that is lost (U+FFFD) nothing is whole.
    """
    if "�" in text:
        return []
    run = _RUNS[true, wrong]
    if wrong in _TABLES:
        found = [m.span() for m in run.finditer(text)]
        least = 3 if found and _ALPHABETS[wrong].issuperset(c for c in text if c > "\x7f") else 2
        return [(a, b) for a, b in found if sum(c > "\x7f" for c in text[a:b]) >= least or true == "utf-8" and _lone(text, a, b, wrong)]
    if not any(m.end() - m.start() >= 9 for m in run.finditer(text.encode(wrong, "ignore").decode("latin-1"))):
        return []
    parts = [c.encode(wrong, "ignore").decode("latin-1") or _FOREIGN for c in text]
    raw, ends = "".join(parts), [0, *accumulate(map(len, parts))]
    # runs begin and end where characters do
    at, found, place = {end: n for n, end in enumerate(ends)}, [], 0
    while place < len(parts):
        m = run.match(raw, ends[place])
        while m and m.end() not in at:
            m = run.match(raw, ends[place], m.end() - 1)
        if m and sum(c > "\x7f" for c in m[0]) >= 9:
            found.append((place, at[m.end()]))
        place = at[m.end()] if m else place + 1
    return found


def _lone(text: str, start: int, end: int, wrong: str) -> bool:
    """Whether the run ends in a pair for one character of Latin-1 with nothing but ASCII around it."""
    around = text[max(0, min(start, end - 3)) : end - 2] + text[end : end + 1]
    # of the page itself, not bytes that kept their number
    return around.isascii() and text[end - 2].encode(wrong, "ignore") in (b"\xc2", b"\xc3")


def undo_stretches(text: str, chain: str) -> str | None:
    """``text`` with the runs undone that can have gone through ``chain`` (see ``stretches``) where the whole cannot,
    such as a damaged stretch in a sentence written without blanks; None if there are none."""
    out, last = [], 0
    for a, b in stretches(text, *CHAINS[chain][-1]):
        before = undo(text[a:b], chain)
        if before is not None and "�" not in before and not _UNFIT.search(before):
            out += [text[last:a], before]
            last = b
    return "".join([*out, text[last:]]) if out else None


_CODE = re.compile(r"`[^`\s]{1,40}`")
_CUT = re.compile(r"[ \t\r\n]+|(?<=[、。])")


def tokens_of(text: str) -> list[str]:
    """The tokens with other than ASCII characters, hyphens at line ends undone, inline code left out.

    A token ends at white space and after an ideographic comma or full stop.
    """
    text = text.replace("-\r\n", "").replace("-\n", "")
    if "`" in text:
        text = _CODE.sub(" ", text)
    return [t for t in _CUT.split(text) if not t.isascii()]


def token_lists(records: DataFrame) -> DataFrame:
    """(rec, kind, key, group, length, tokens, times) of the records whose text is not plain ASCII: a number of the record's own, how many
    tokens with other than ASCII characters it has, which ones, and how often each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [Counter(tokens_of(t)) for t in batch["text"]]
            yield pd.DataFrame(
                {"kind": batch["kind"], "key": batch["key"], "group": batch["group"], "length": [c.total() for c in counts], "tokens": [list(c) for c in counts], "times": [list(c.values()) for c in counts]}
            )

    # more bytes than characters: some character is not ASCII; a missing group is a group
    special = records.select("kind", "key", _group(), "text").where(F.octet_length("text") > F.length("text"))
    kinds = dict(records.dtypes)
    lists = special.mapInPandas(cut, ", ".join(f"{c} {kinds[c]}" for c in ("kind", "key")) + ", `group` string, length int, tokens array<string>, times array<int>")
    return lists.withColumn("rec", F.monotonically_increasing_id())


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("none")).alias("group")


class CharModel:
    """A smoothed bigram model of the characters of clean tokens.

    Bigrams are counted in two hash tables of fixed size; the lesser count holds, so two bigrams are
    confused only if they collide in both.
    """

    def __init__(self, bigrams: np.ndarray, chars: np.ndarray):
        self._bigrams = np.maximum(bigrams, 0.0).astype(np.float32)
        self._context = np.maximum(chars, 0.0).astype(np.float32)
        self._alone = ((self._context + 0.01) / (self._context.sum(dtype=np.float64) + 0.01 * CHARS)).astype(np.float32)

    @staticmethod
    def codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, characters and where each token starts; every token is framed by spaces."""
        codes = np.frombuffer((" " + " ".join(tokens) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % CHARS
        sizes = np.array([len(t) + 1 for t in tokens])
        return codes[:-1], codes[1:], np.concatenate([[0], np.cumsum(sizes)[:-1]])

    @staticmethod
    def buckets(context: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots in the first table and, behind it, in the second."""
        h = mix((context.astype(np.uint64) << np.uint64(16)) + char.astype(np.uint64))
        return (h & np.uint64(BIGRAMS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BIGRAMS - 1)).astype(np.int64) + BIGRAMS

    def each(self, context: np.ndarray, char: np.ndarray, own: float = 0.0) -> np.ndarray:
        """Natural log-probabilities of the characters in their contexts; ``own`` occurrences are left out of the counts."""
        first, second = self.buckets(context, char)
        seen = np.maximum(np.minimum(self._bigrams[first], self._bigrams[second]) - own, 0.0)
        return np.log((seen + 2.0 * self._alone[char]) / (np.maximum(self._context[context] - own, seen) + 2.0))

    def tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token its log-probability, the same with one occurrence of it left out of the counts, and that of its least likely character."""
        context, char, starts = self.codes(tokens)
        p = self.each(context, char)
        return np.add.reduceat(p, starts), np.add.reduceat(self.each(context, char, 1.0), starts), np.minimum.reduceat(p, starts)

    def gains(self, tokens: list[str], chains: list[str], undone: list[str]) -> np.ndarray:
        """Log-likelihood ratios of the undone tokens to the tokens as they stand.

        That bytes are valid UTF-8 is evidence of its own: there, the occurrence in question does not speak for itself. Other
        chains undo anything, and a rare token would be taken for any other rare one.
        """
        whole, rest, _ = self.tokens(tokens)
        stands = np.where([c in _UTF8_NAMES for c in chains], rest, whole)
        # undone tokens may hold white space: it is scored like any other character
        return self.tokens([t.replace(" ", "\xa0") for t in undone])[0] - stands + _strays(tokens)


def _counted(weighted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and context tables of (token, weight), summed in Spark and of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bigrams, chars = np.zeros(2 * BIGRAMS), np.zeros(CHARS)
        for batch in batches:
            tokens = batch["token"].tolist()
            if tokens:
                context, char, _ = CharModel.codes(tokens)
                weight = np.repeat(batch["weight"].to_numpy(np.float64), [len(t) + 1 for t in tokens])
                for slots in CharModel.buckets(context, char):
                    np.add.at(bigrams, slots, weight)
                chars += np.bincount(context, weights=weight, minlength=CHARS)
        both = np.concatenate([bigrams, chars])
        at = np.flatnonzero(both)
        yield pd.DataFrame({"slot": at.astype(np.int32), "weight": both[at]})

    summed = weighted.mapInPandas(count, "slot int, weight double").groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()
    both = np.zeros(2 * BIGRAMS + CHARS)
    both[summed["slot"].to_numpy()] = summed["weight"].to_numpy()
    return both[: 2 * BIGRAMS], both[2 * BIGRAMS :]


#: A character less likely than this (natural log) makes a token suspicious of any chain. Misread UTF-8 is
#: looked for in every token, as hardly any clean token happens to be valid UTF-8 once misread.
SURPRISE = -5.5
_STRAY = re.compile("[�\x80-\x84\x86-\x9f]")


def undone_tokens(vocabulary: DataFrame, model: CharModel) -> DataFrame:
    """(token, chain, undone, gain) for every chain that a suspicious token may have gone through.

    ``gain`` is the log-likelihood ratio of the undone token to the token as it stands. A token with the
    replacement character, or with stray control characters that no chain explains, has the chain ``lost``.
    """
    sent = vocabulary.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            tokens = batch["token"].tolist()
            if not tokens:
                continue
            least = model.tokens(tokens)[2]
            which, names, undone = [], [], []
            lost = []
            for n, token in enumerate(tokens):
                stray, before = _STRAY.search(token), len(which)
                surprising = stray or least[n] < SURPRISE
                ways = list(possible(token, _UTF8_CHAINS))
                if ways or surprising:
                    ways += possible(token, _LEGACY_CHAINS)
                for chain, text in ways:
                    which.append(n)
                    names.append(chain)
                    undone.append(text)
                if stray and ("�" in token or len(which) == before):
                    lost.append((token, LOST, None, 40.0 if "�" in token else 25.0))
            rows = [pd.DataFrame(lost, columns=["token", "chain", "undone", "gain"])] if lost else []
            if which:
                found = pd.DataFrame({"token": [tokens[n] for n in which], "chain": names, "undone": undone})
                rows.append(found.assign(gain=model.gains(found["token"].tolist(), names, undone)))
            if rows:
                yield pd.concat(rows)

    return vocabulary.select("token").mapInPandas(score, "token string, chain string, undone string, gain double")


def _strays(tokens: Iterable[str]) -> np.ndarray:
    """Control characters are next to impossible in clean text, however many the corpus has of them."""
    return np.array([6.0 * len(_STRAY.findall(t)) for t in tokens])


def rescored(undone: DataFrame, model: CharModel) -> DataFrame:
    """The same rows with their gains under another model."""
    sent = undone.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["chain"] != LOST
            some = batch[known]
            if len(some):
                batch.loc[known, "gain"] = sent.value.gains(some["token"].tolist(), some["chain"].tolist(), some["undone"].tolist())
            yield batch

    return undone.mapInPandas(score, undone.schema)


@dataclass(frozen=True)
class Repairs:
    """``damaged``: (kind, key, chain, posterior) of the records found; ``priors``: (group, chain, prior); ``rounds`` until it settled."""

    damaged: DataFrame
    priors: DataFrame
    rounds: int


def find_damage(records: DataFrame, most_rounds: int = 8, settled: float = 1e-3, at_least: float = 0.5) -> Repairs:
    """Damaged records among ``records`` (kind, key, group, text).

    ``group`` names the source and field whose records share a prior (null is a group). Null keys stay null. Records
    with null, empty or plain ASCII text are never damaged. Repeated rows are evidence each and come out
    once per (kind, key). Very long texts are read whole. An empty table gives an empty result. Text inside inline code
    (back quotes around a word) is a quotation and no evidence. Of chains with equal posteriors the first by name.

    The rounds end when the expected number of damaged records changes by no more than ``settled`` of it. A token that occurs m times in a
    record weighs 1 + log(m), as its occurrences are no independent evidence.
    """
    lists = stage(token_lists(records), "tokens")
    each = lists.select("rec", "group", "length", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("rec", "group", "length", F.col("t.tokens").alias("token"), F.col("t.times").alias("times"))
    # few bytes, but much work for each: dealt out to all cores
    cores = records.sparkSession.sparkContext.defaultParallelism
    vocabulary = stage(each.groupBy("token").agg(F.sum("times").alias("n")).repartition(cores, "token"), "vocabulary")
    base = _counted(vocabulary.select("token", F.col("n").alias("weight")))
    likely = F.col("gain") > -2
    undone = stage(undone_tokens(vocabulary, CharModel(*base)), "undone")
    suspects = stage(undone.where(likely).select("token").distinct(), "suspects")
    # the few suspicious tokens: all that the rounds need of records and chains
    undone = stage(undone.join(broadcast_if_small(suspects, 16), "token", "left_semi").repartition(cores, "token"), "undone-suspects")
    found = spread_join(each, suspects, "token", row_bytes=16).withColumn("n", 1 + F.log(F.col("times").cast("double")))
    found = stage(found.withColumn("weight", F.sum("n").over(Window.partitionBy("rec"))), "evidence")
    sizes = stage(records.select(_group()).groupBy("group").agg(F.count(F.lit(1)).alias("records")), "groups")
    whole = sizes.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    scores = undone.where(likely)
    prior, before, expected, staged, n = None, -1.0, None, None, 0
    for n in range(1, most_rounds + 1):
        forget(expected)
        expected = stage(_expected(found, scores, prior), "expected")
        here = stage(expected.groupBy("group", "chain").agg(F.sum("posterior").alias("expected")), "expected-shares")
        everywhere = {r["chain"]: r["e"] for r in here.groupBy("chain").agg(F.sum("expected").alias("e")).collect()}  # a row per chain
        forget(prior)
        prior = stage(_priors(here, sizes, everywhere, whole), "priors")
        forget(here)
        damage = sum(everywhere.values())
        if abs(damage - before) <= settled * max(damage, 1.0) or n == most_rounds:
            break
        before = damage
        model = CharModel(*_without_damage(base, found, scores, expected))
        forget(staged)
        staged = stage(rescored(undone, model), "scores")
        scores = staged.where(likely)
    best = expected.where(F.col("damage") >= at_least).groupBy("rec").agg(F.min(F.struct(-F.col("posterior"), "chain")).alias("best"), F.max("damage").alias("damage"))
    damaged = lists.select("rec", "kind", "key").join(best, "rec").groupBy("kind", "key").agg(F.min("best").alias("best"), F.max("damage").alias("posterior"))
    return Repairs(damaged.select("kind", "key", F.col("best.chain").alias("chain"), "posterior"), prior, n)


def _expected(found: DataFrame, scores: DataFrame, prior: DataFrame | None) -> DataFrame:
    """(rec, group, chain, posterior, damage): the E step, one row per record and chain that some of its tokens speak for."""
    clean = math.log(1 - STRETCH)
    log_mix = F.log(F.lit(1 - STRETCH) + F.lit(STRETCH) * F.exp(F.least("gain", F.lit(300.0))))
    rows = spread_join(found, scores.select("token", "chain", (log_mix - clean).alias("speaks")), "token", row_bytes=32)
    # what a record is ("group", "weight", "length") is the same in all its rows
    rows = rows.groupBy("rec", "chain").agg(F.sum(F.col("n") * F.col("speaks")).alias("evidence"), F.first("group").alias("group"), F.first("weight").alias("weight"), F.first("length").alias("length"))
    if prior is None:
        rows = rows.withColumn("prior", F.lit(FIRST_DAMAGE / (len(CHAINS) + 1)))
    else:
        rows = spread_join(rows, prior, ["group", "chain"], "left", row_bytes=40).withColumn("prior", F.coalesce("prior", F.lit(1e-6)))
    # tokens that the chain does not explain stand as clean ones inside the record, and the stretch may begin and end anywhere
    joint = F.col("evidence") + F.col("weight") * clean - 2 * F.log(F.col("length").cast("double")) + F.log("prior")
    record = Window.partitionBy("rec")
    rows = rows.withColumn("joint", joint).withColumn("top", F.greatest(F.max("joint").over(record), F.lit(0.0)))
    rows = rows.withColumn("mass", F.exp(F.col("joint") - F.col("top"))).withColumn("bad", F.sum("mass").over(record))
    every = F.col("bad") + F.exp(-F.col("top"))
    return rows.select("rec", "group", "chain", (F.col("mass") / every).alias("posterior"), (F.col("bad") / every).alias("damage"))


def _priors(here: DataFrame, sizes: DataFrame, everywhere: dict[str, float], whole: int) -> DataFrame:
    """(group, chain, prior): expected shares per group, drawn towards those of the whole."""
    general = {c: (e + FIRST_DAMAGE / (len(CHAINS) + 1)) / (whole + 1) for c, e in everywhere.items()}
    table = F.create_map(*[F.lit(x) for pair in general.items() for x in pair]) if general else F.create_map().cast("map<string,double>")
    strength = 20.0
    shares = here.join(sizes, "group")
    return shares.select("group", "chain", ((F.col("expected") + strength * F.try_element_at(table, F.col("chain"))) / (F.col("records") + strength)).alias("prior"))


def _without_damage(base: tuple[np.ndarray, np.ndarray], found: DataFrame, scores: DataFrame, expected: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts with the expected damaged occurrences taken out. Their undone forms are not put in: that
    would let a wrong repair speak for itself in the next round."""
    # within a damaged record a token is damaged as far as its own gain says
    odds = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least("gain", F.lit(30.0)), F.lit(-30.0))))
    damaged = stage(expected.where("posterior > 0.01").select("rec", "chain", "posterior"), "damaged-chains")
    held = found.select("rec", "token", "times").join(broadcast_if_small(damaged, 40), "rec")
    weights = held.groupBy("token", "chain").agg(F.sum(F.col("times") * F.col("posterior")).alias("w"))
    out = _counted(weights.join(scores.select("token", "chain", odds.alias("odds")), ["token", "chain"]).groupBy("token").agg(F.sum(F.col("w") * F.col("odds")).alias("weight")))
    forget(damaged)
    return base[0] - out[0], base[1] - out[1]


def repair_text(text: str, chain: str) -> str | None:
    """The text with the stretches undone that went through ``chain``; None if there is nothing to undo."""
    if chain == LOST:
        return None
    whole = undo(text, chain)
    if whole is not None and "�" not in whole:
        return whole
    parts = re.split(r"([ \t\r\n]+|(?<=[。、]))", text)
    changed = 0
    for n, part in enumerate(parts):
        if part and not part.isascii() and not re.fullmatch(r".?`[^`]+`.?", part):
            before = undo(part, chain)
            if before is None:
                before = undo_stretches(part, chain)
            if before is not None:
                parts[n], changed = before, changed + 1
    return "".join(parts) if changed else None


def repaired(records: DataFrame, damage: Repairs) -> DataFrame:
    """(kind, key, chain, posterior, repaired) of the damaged records; ``repaired`` is null where nothing can be restored."""

    @F.pandas_udf("string")
    def repair(text: pd.Series, chain: pd.Series) -> pd.Series:
        return pd.Series([repair_text(t, c) if t is not None and c is not None else None for t, c in zip(text, chain)], dtype="object")

    wanted = broadcast_if_small(stage(damage.damaged, "damaged"), 64)
    rows = records.select("kind", "key", "text").join(wanted, ["kind", "key"])
    return rows.select("kind", "key", "chain", "posterior", repair("text", "chain").alias("repaired"))
