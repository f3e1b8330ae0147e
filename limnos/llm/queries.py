"""All registered queries of this subpackage."""

from limnos.llm import (  # noqa: F401
    archives,
    chats,
    decontamination,
    extraction,
    jaccard,
    mixing,
    negatives,
    neighbours,
    ranking,
    sharding,
    substrings,
    suffixes,
    toxicity,
)
from limnos.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
