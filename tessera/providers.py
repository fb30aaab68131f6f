"""Providers of embeddings and answers (S14, S15, A14): the protocol of an embedder, a local stand-in, response normalisation."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.textops import leading_int, terms


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class HashedEmbedder:
    """A deterministic embedder for tests and offline runs: signed counts of hashed terms, unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: Column) -> Column:
        size = self.size

        @F.pandas_udf("array<float>")
        def counted(places: pd.Series) -> pd.Series:
            out = []
            for p in places:
                at = np.asarray(p, np.int64)
                counts = np.bincount(at >> 1, weights=np.where(at & 1, -1.0, 1.0), minlength=size)
                norm = np.linalg.norm(counts)
                out.append((counts / norm if norm else counts).astype(np.float32))
            return pd.Series(out)

        # a term's place, and its sign in the last bit
        return counted(F.transform(terms(text), lambda t: (2 * F.pmod(F.xxhash64(t), F.lit(size)) + F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2))).cast("int")))


def usage(body: Column) -> Column:
    """(input, output, total) tokens of a response in either of its two shapes; anything else is all zeros."""
    at = lambda key: F.get_json_object(body, f"$.usage.{key}").try_cast("bigint")
    shape = lambda *keys: F.when(F.array_size(F.array_compact(F.array(*map(at, keys)))) == 3, F.struct(*[at(k).alias(n) for k, n in zip(keys, ("input", "output", "total"))]))
    nothing = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("input", "output", "total")])
    return F.coalesce(shape("input_tokens", "output_tokens", "total_tokens"), shape("prompt_tokens", "completion_tokens", "total_tokens"), nothing)


def retry_after(header: Column) -> Column:
    """The seconds at the start of a ``retry-after`` header, or null."""
    return leading_int(header)


def response_kind(status: Column, body: Column, transport: Column) -> Column:
    """``ok``, or the kind of an error: of the transport (``timeout``, ``transport``), by status (``auth``, ``rate_limited``, ``http``), or by a body of
    status 200 (``malformed_response``, ``empty_response``)."""
    text = answer_text(body)
    return (
        F.when(transport == "timeout", F.lit("timeout")).when(transport.isNotNull(), F.lit("transport"))
        .when(status == 401, F.lit("auth")).when(status == 429, F.lit("rate_limited")).when(status.isNull() | (status != 200), F.lit("http"))
        .when(F.get_json_object(body, "$.output").isNull() | F.get_json_object(body, "$.usage").isNull(), F.lit("malformed_response"))
        .when(text.isNull(), F.lit("malformed_response")).when(text == "", F.lit("empty_response")).otherwise(F.lit("ok"))
    )


def _first_content(body: Column) -> Column:
    """The first item of the output that has content."""
    items = F.from_json(F.get_json_object(body, "$.output"), "array<struct<content:array<struct<text:string>>,status:string>>")
    return F.get(F.filter(items, lambda x: x["content"].isNotNull()), F.lit(0))


def answer_text(body: Column) -> Column:
    return F.get(_first_content(body)["content"], F.lit(0))["text"]


def finish_reason(body: Column) -> Column:
    """``length`` for an answer that was broken off, else ``stop``."""
    return F.when(_first_content(body)["status"] == "incomplete", F.lit("length")).otherwise(F.lit("stop"))
