"""Reranking by a scorer of the user's own, run in batches on the executors, its answers checked before they count.

A scorer gets a query and its candidates' texts and answers with (index, score) pairs, best first, as a reranking model does.
It is made once in each Python worker, so that a model is loaded once. An answer is malformed if it has more pairs than may
be returned, an index that is no whole number, out of range or given twice, a score that isn't a finite number, or nothing for candidates that
are there. Then this query alone keeps its candidates' order, without scores.

Null texts and queries are empty ones. A query's candidates are bounded by the selection before, so a row may hold them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Scorer(Protocol):
    """Scores texts for a query: at most ``most`` pairs of index and score, best first."""

    def rank(self, query: str, texts: Sequence[str], most: int) -> Sequence[tuple[int, float]]: ...


@lru_cache(maxsize=8)
def loaded(make: Callable[[], Scorer]) -> Scorer:
    """The scorer that ``make``, a function of a module, gives; one in each worker."""
    return make()


class TermOverlap:
    """The share of the query's distinct words that a text has; ties by place."""

    def rank(self, query: str, texts: Sequence[str], most: int) -> list[tuple[int, float]]:
        asked = set(query.lower().split())
        shares = [len(asked & set(t.lower().split())) / max(len(asked), 1) for t in texts]
        return [(k, shares[k]) for k in sorted(range(len(texts)), key=lambda k: (-shares[k], k))[:most]]


def valid(pairs: object, n: int, most: int) -> bool:
    """Whether an answer for ``n`` candidates is well formed."""
    if not isinstance(pairs, Sequence) or len(pairs) > most or (n and not pairs):
        return False
    seen = set()
    for pair in pairs:
        if not isinstance(pair, Sequence) or len(pair) != 2:
            return False
        index, score = pair
        if isinstance(index, bool) or not isinstance(index, int) or not 0 <= index < n or index in seen:
            return False
        if isinstance(score, bool) or not isinstance(score, int | float) or not math.isfinite(score):
            return False
        seen.add(index)
    return True


_OUT = "place int, score double, rank int, verdict string"


def reranked(candidates: DataFrame, make: Callable[[], Scorer], most: int, least: float | None = None) -> DataFrame:
    """query_id, chunk_id, place, score, rank and verdict (``reranked`` or ``rejected``) of up to ``most`` candidates of a query.

    ``candidates``: query_id, query, chunk_id, place, text. ``least``: scores below it are left out, after ranking; rejected
    queries keep their first ``most`` candidates.
    """
    listed = F.array_sort(F.collect_list(F.struct("place", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))))
    held = candidates.groupBy("query_id").agg(F.coalesce(F.max("query"), F.lit("")).alias("query"), listed.alias("listed"))
    made = StructType([candidates.schema["query_id"], candidates.schema["chunk_id"], *StructType.fromDDL(_OUT).fields])
    kind = to_arrow_schema(made)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(make)
        for batch in batches:
            rows = []
            for query_id, query, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                pairs = scorer.rank(query, [i["text"] for i in items], most)
                fine = valid(pairs, len(items), most)
                for k, (index, score) in enumerate(pairs if fine else [(k, None) for k in range(min(most, len(items)))], 1):
                    if not fine or least is None or score >= least:
                        rows.append({"query_id": query_id, "chunk_id": items[index]["chunk_id"], "place": items[index]["place"], "score": score, "rank": k, "verdict": "reranked" if fine else "rejected"})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return held.mapInArrow(rank, made)
