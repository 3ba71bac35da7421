"""All queries of this folder."""

from __future__ import annotations

from memlake.llm import class_lm, dialogue, language, media, merkle, mixing, neighbours, ngram_join, packing, quality, records, secrets, surrogates  # noqa: F401
from memlake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
