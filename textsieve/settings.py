"""Settings of a session, as Spark configuration: SET textsieve.similarity_threshold = 0.4."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Names without the prefix, and what holds where a session doesn't set them.
DEFAULTS: dict[str, float | int] = {
    "similarity_threshold": 0.3,  # of trgm_sim_op and similarity_join
    "word_similarity_threshold": 0.3,
    "strict_word_similarity_threshold": 0.3,
    "match_timeout_ms": 0,  # for a text, of searches that go text by text; 0: no limit
    "max_states": 10_000,  # of a pattern's automaton
    "most_tiles": 64,  # alternatives of a pattern that the index is asked for
    "index_below": 0.05,  # share of rows expected, from which on the index is left out
}


def setting(name: str) -> float | int:
    """What the active session says, or the default; a value of another kind is an error."""
    spark = SparkSession.getActiveSession()
    value = spark.conf.get(f"textsieve.{name}", None) if spark else None
    return DEFAULTS[name] if value is None else type(DEFAULTS[name])(value)
