"""What is searched and how: corpora, defaults and the query builder (Q1-Q6, Q13, Q15)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Defaults:
    """The search and prompt defaults."""

    size: int = 30
    k: int = 30
    keyword_weight: float = 0.8
    neighbor_offset: int = 2
    max_context_chunks: int = 10
    relevance_floor: float = 0.3
    history_exchanges: int = 5
    builder_size: int = 10


DEFAULTS = Defaults()


@dataclass(frozen=True)
class CorpusSpec:
    """A document category: its index, its search fields with boosts, and its optional neighbour expansion.

    ``load`` gives the units with at least ``id``, ``text`` and ``embedding``; ``prompt_context`` and ``citable`` build columns; ``expand`` is
    None for corpora without an order (expansion is then the identity).
    """

    index: str
    fields: dict[str, float]
    load: Callable[..., DataFrame] | None = None
    prompt_context: Callable[[], Column] | None = None
    citable: Callable[[], Column] | None = None
    expand: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None


@dataclass(frozen=True)
class RetrievalQuery:
    """An immutable query: k-NN clauses must match, text clauses should, filters cut without scoring."""

    index: str
    size: int = DEFAULTS.builder_size
    min_score: float | None = None
    must: tuple[dict, ...] = ()
    should: tuple[dict, ...] = ()
    filters: tuple[dict, ...] = field(default=())

    @staticmethod
    def new(index: str) -> RetrievalQuery:
        return RetrievalQuery(index)

    def knn(self, column: str, vector: list[float], k: int = DEFAULTS.k) -> RetrievalQuery:
        if k <= 0:
            raise ValueError("k must be positive")
        return replace(self, must=(*self.must, {"knn": {column: {"vector": list(vector), "k": k}}}))

    def match(self, text: str, fields: list[str], boost: float = 1.0) -> RetrievalQuery:
        return replace(self, should=(*self.should, {"multi_match": {"query": text, "fields": list(fields), "boost": boost}}))

    def filter_term(self, column: str, value) -> RetrievalQuery:
        return replace(self, filters=(*self.filters, {"term": {column: value}}))

    def with_min_score(self, score: float | None) -> RetrievalQuery:
        return replace(self, min_score=score)

    def with_size(self, size: int) -> RetrievalQuery:
        return replace(self, size=size)

    def to_map(self) -> dict:
        """The query as a nested map; clauses keep their order, ``min_score`` is left out when not set."""
        body = {"size": self.size, "query": {"bool": {"must": list(self.must), "should": list(self.should), "filter": list(self.filters)}}}
        return body if self.min_score is None else body | {"min_score": self.min_score}
