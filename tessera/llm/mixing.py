"""Problem 7: mixing sources to target weights by entropy balancing.

Each document gets an expected number of copies: the rates that stay closest (in entropy) to one common
rate while every source reaches its tokens, ``rate = base * exp(lambda_source * length)``, at most ``max_repeats``. The
multipliers come from Newton iterations on the convex dual: each is one distributed aggregation to gradients and
curvatures per source, at the Newton point and at points around it that keep it inside a bracket. Documents of a source and
a length are alike to the dual, so they are counted once and the iterations run over the distinct lengths.

The rates are then rounded: every document adds its own hash-uniform threshold, and one offset per source makes the
rounded tokens meet the target; it is read off a histogram of the offsets at which documents gain or lose a copy. A source whose dual
has no solution is at its cap with every document: the mix itself shows that it falls short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import clean_source
from tessera.runtime import stage

#: Sources of a mix at most: the targets are a configuration, not data that grows.
MOST_SOURCES = 10_000
#: A multiplier that puts every document at its cap.
TOP = 1e9
#: Classes of a histogram of offsets; two rounds of it tell offsets a millionth apart.
CLASSES = 1024


def _rate(base: float, x: Column) -> Column:
    """Expected copies under a multiplier; lengths are in units of the source's mean document."""
    tilt = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x * F.col("tokens") / F.col("mean")))
    return F.least(F.col("repeats").cast("double"), F.lit(base) * F.exp(tilt))


class SourceMix:
    """A mix of ``size_share`` of all tokens of ``docs`` in which each source has its target share.

    ``docs`` has a key, a source and a number of tokens; ``targets`` has (source, target_share, max_repeats). Source names are compared after
    cleaning (case, outer spaces, ``-`` or ``_``). Documents of other sources, without a source, or with no tokens
    (null counts as 0) get no copies, but count in the size of the whole. A source that cannot reach its target is
    taken ``max_repeats`` times whole and reported as missed; one without any documents likewise. Rows
    that repeat a key, or have none, are documents of their own. Empty tables give an empty mix. Ties in rounding
    are broken by a hash of the key.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", size_share: float = 0.5, rounds: int = 40):
        self._spark = docs.sparkSession
        rows = targets.where(F.col("source").isNotNull()).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources in a mix")
        wanted = self._spark.createDataFrame([(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows], "source string, share double, repeats int")
        wanted = wanted.select(clean_source(F.col("source")).alias("s"), F.col("source").alias("spelled"), "share", "repeats")
        self._wanted = F.broadcast(wanted)  # at most MOST_SOURCES rows
        named = docs.select(F.col(f"`{key}`").alias("key"), clean_source(F.col(f"`{source}`")).alias("s"), F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("bigint").alias("tokens"))
        self._docs = stage(named, "mix-documents")
        self.total = int(self._docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
        self.size = size_share * self.total
        self._joined = self._docs.where(F.col("tokens") > 0).join(self._wanted, "s")
        self._lengths = stage(self._joined.groupBy("s", "tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
        held = self._lengths.groupBy("s").agg(F.sum(F.col("n") * F.col("tokens")).alias("held"), F.sum("n").alias("n")).join(self._wanted, "s")
        self.sources = {r.s: r for r in held.collect()}
        self.iterations = 0
        self.multipliers = self._balance(rounds)
        self.offsets = self._round()

    def _base(self) -> float:
        aim = sum(r.share for r in self.sources.values()) * self.size
        held = sum(r.held for r in self.sources.values())
        return aim / held if held else 0.0

    def _aim(self, s: str) -> float:
        return self.sources[s].share * self.size

    def _table(self, columns: str, rows: list[tuple]) -> DataFrame:
        """A table of one row per source (at most MOST_SOURCES), to be joined by ``s``."""
        return F.broadcast(self._spark.createDataFrame(rows, f"s string, mean double, repeats int, {columns}"))

    def _fixed(self, s: str) -> tuple:
        r = self.sources[s]
        return s, r.held / r.n, r.repeats

    def _evaluate(self, points: dict[str, list[float]]) -> dict[str, list[tuple[float, float, float]]]:
        """Per source and multiplier: (multiplier, expected tokens, their derivative); one distributed job."""
        asked = self._table("x array<double>", [(*self._fixed(s), xs) for s, xs in points.items()])
        each = self._lengths.join(asked, "s").select("*", F.explode("x").alias("at"))
        rate = _rate(self._base(), F.col("at"))
        weight = F.col("n") * rate * F.col("tokens")
        free = (rate < F.col("repeats")).cast("double")
        sums = each.groupBy("s", "at").agg(F.sum(weight).alias("got"), F.sum(free * weight * F.col("tokens") / F.col("mean")).alias("slope"))
        out: dict[str, list[tuple[float, float, float]]] = {s: [] for s in points}
        for r in sums.collect():
            out[r.s].append((r["at"], r.got, r.slope))
        return {s: sorted(v) for s, v in out.items()}

    def _balance(self, rounds: int) -> dict[str, float]:
        """Newton iterations per source, kept inside a bracket that every evaluation narrows."""
        found: dict[str, float] = {}
        points = {s: [-20.0, -5.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 5.0, 20.0, TOP] for s, r in self.sources.items() if r.share > 0 and r.repeats > 0}
        known: dict[str, list[tuple[float, float, float]]] = {s: [] for s in points}
        while points and self.iterations < rounds:
            self.iterations += 1
            seen = self._evaluate(points)
            points = {}
            for s, values in seen.items():
                known[s] = sorted({*known[s], *values})
                aim = self._aim(s)
                at, got, slope = min(known[s], key=lambda v: abs(v[1] - aim))
                found[s] = at
                # at the top all are at their cap; no more is to be had
                if abs(got - aim) <= 1e-6 * aim or known[s][-1][1] <= aim:
                    continue
                low = max((v[0] for v in known[s] if v[1] < aim), default=-50.0)
                high = min((v[0] for v in known[s] if v[1] >= aim), default=TOP)
                newton = at + (aim - got) / slope if slope > 0 else math.inf
                if high == TOP:
                    spread = [max(1.0, low) * 2.0**n for n in range(1, 7)]
                else:
                    spread = [low + (high - low) * n / 6 for n in range(1, 6)]
                step = newton if low < newton < high else (low + min(high, 2 * abs(low) + 1)) / 2
                points[s] = sorted({x for x in (step, *spread) if low < x < high})
                if not points[s]:
                    del points[s]
        return found

    def _expected(self) -> DataFrame:
        """The documents of the mix's sources with their expected copies plus their thresholds."""
        rows = [(*self._fixed(s), float(self.multipliers.get(s, 0.0)), s in self.multipliers) for s in self.sources]
        solved = self._table("x double, solved boolean", rows)
        lot = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
        rate = F.when(F.col("solved"), _rate(self._base(), F.col("x"))).otherwise(F.lit(0.0))
        held = self._joined.select("key", "s", "spelled", "tokens").join(solved, "s").withColumn("rate", rate)
        # expected copies that are whole (those at the cap) are not rounded
        return held.withColumn("level", F.when(F.col("rate") >= F.col("repeats"), F.col("repeats").cast("double")).otherwise(F.col("rate") + lot))

    def _round(self) -> dict[str, float]:
        """One offset per source such that the rounded tokens come closest to the target."""
        base = F.least(F.col("repeats"), F.floor("level"))
        rows = self._expected().select("s", "tokens", "level", "rate", "repeats", base.alias("copies"))
        start = {r.s: r.got for r in rows.groupBy("s").agg(F.sum(F.col("copies") * F.col("tokens")).alias("got")).collect()}
        # a document gains a copy at an offset of 1 - its fraction, and loses one just beyond its fraction
        gains = {s: self._aim(s) >= got for s, got in start.items()}
        reached = dict(start)
        window = {s: (0.0, 1.0) for s in start}
        for _ in range(2):
            asked = self._table("gains boolean, low double, high double, aim double, held double", [(*self._fixed(s), gains[s], *window[s], self._aim(s), float(reached[s])) for s in window])
            some = rows.drop("repeats").join(asked, "s")
            fraction = F.col("level") - F.floor("level")
            step = F.when(F.col("gains"), 1 - fraction).otherwise(fraction)
            able = F.when(F.col("gains"), F.col("copies") < F.col("repeats")).otherwise((F.col("copies") > 0) & (F.col("rate") < F.col("repeats")))
            some = some.withColumn("step", step).where(able & (F.col("step") >= F.col("low")) & (F.col("step") < F.col("high")))
            place = F.least(F.lit(CLASSES - 1), F.floor((F.col("step") - F.col("low")) / (F.col("high") - F.col("low")) * CLASSES)).cast("int")
            counted = some.groupBy("s", place.alias("place"), "low", "high", "gains", "aim", "held").agg(F.sum("tokens").alias("t"))
            # at most CLASSES rows per source
            upto = F.sum("t").over(Window.partitionBy("s").orderBy("place"))
            summed = counted.withColumn("upto", upto).withColumn("after", F.when(F.col("gains"), F.col("held") + F.col("upto")).otherwise(F.col("held") - F.col("upto")))
            past = F.when(F.col("gains"), F.col("after") >= F.col("aim")).otherwise(F.col("after") <= F.col("aim"))
            first = summed.where(past).groupBy("s").agg(F.min(F.struct("place", "t", "after", "low", "high")).alias("m"))
            hits = {r.s: r.m for r in first.collect()}
            for s, m in hits.items():
                width = (m["high"] - m["low"]) / CLASSES
                window[s] = m["low"] + m["place"] * width, m["low"] + (m["place"] + 1) * width
                reached[s] = m["after"] - m["t"] if gains[s] else m["after"] + m["t"]
                self._past = {**getattr(self, "_past", {}), s: m["after"]}
            window = {s: w for s, w in window.items() if s in hits}
        out = {}
        for s, (low, high) in window.items():
            before, after = abs(reached[s] - self._aim(s)), abs(self._past[s] - self._aim(s))
            at = low if before <= after else high
            out[s] = at if gains[s] else -at
        return out

    def _placed(self) -> DataFrame:
        """(key, source, tokens, repeats, rate, copies) of all documents of the mix's sources, those without a copy included."""
        rows = self._expected()
        offsets = F.broadcast(self._spark.createDataFrame([(s, float(self.offsets.get(s, 0.0))) for s in self.sources], "s string, offset double"))
        rows = rows.join(offsets, "s")
        rounded = F.when(F.col("rate") >= F.col("repeats"), F.col("repeats")).otherwise(F.least(F.col("repeats"), F.floor(F.col("level") + F.col("offset"))))
        return rows.select("key", F.col("spelled").alias("source"), "tokens", "repeats", "rate", F.greatest(F.lit(0), rounded).cast("int").alias("copies"))

    def mix(self) -> DataFrame:
        """(key, source, tokens, rate, copies): the documents that are in the mix, with their copies."""
        return self._placed().drop("repeats").where(F.col("copies") > 0)

    def shares(self) -> DataFrame:
        """One row per target: (source, target_share, max_repeats, held_tokens, mix_tokens, mix_documents, most_copies, target_tokens,
        actual_share, share_of_target, missed).

        ``missed`` is read off the mix: it holds less of the source than its target although no document may be used once more.
        """
        copies, tokens = F.col("copies"), F.col("tokens")
        got = self._placed().groupBy("source").agg(
            F.sum("tokens").alias("held_tokens"), F.sum(copies * tokens).alias("mix_tokens"), F.count_if(copies > 0).alias("mix_documents"), F.max("copies").alias("most_copies"), F.sum((F.col("repeats") - copies) * tokens).alias("spare_tokens")
        )
        every = self._wanted.select(F.col("spelled").alias("source"), F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        rows = stage(every.join(got, "source", "left").select("source", "target_share", "max_repeats", *[zero(c) for c in ("held_tokens", "mix_tokens", "mix_documents", "most_copies", "spare_tokens")]), "shares")
        whole = rows.agg(F.sum("mix_tokens")).first()[0] or 0
        aim = F.col("target_share") * self.size
        return rows.select(
            *[c for c in rows.columns if c != "spare_tokens"],
            aim.alias("target_tokens"),
            (F.col("mix_tokens") / max(whole, 1)).alias("actual_share"),
            F.coalesce(F.try_divide(F.col("mix_tokens"), aim), F.lit(1.0)).alias("share_of_target"),
            ((F.col("mix_tokens") < aim) & (F.col("spare_tokens") == 0)).alias("missed"),
        )
