"""Parameters of search and the schemas of the library's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class SearchConfig:
    """Limits apply before thresholds; scores are scaled after thresholds."""

    dense_limit: int = 20
    sparse_limit: int = 20
    late_limit: int = 5
    top_k: int = 10
    dense_threshold: float = 0.5
    sparse_threshold: float = 2.0
    threshold: float = 0.3
    alpha: float = 0.5
    cache_threshold: float = 0.8
    cache_probe: int = 5
    least_rating: float = 3.0

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")


COLLECTION = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("collection", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("document", T.StringType()),
        T.StructField("dense", T.ArrayType(T.FloatType())),
        T.StructField("late", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    ]
)

SESSION_ENTRY = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("display_docs", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

CACHED_ANSWER = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("display_docs", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("rating_count", T.LongType()),
        T.StructField("dense", T.ArrayType(T.FloatType())),
    ]
)

SEARCH_REPLY = T.StructType(
    [
        T.StructField(
            "documents",
            T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("source", T.StringType())])),
        )
    ]
)
