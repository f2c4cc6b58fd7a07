"""Every registered query of this package."""

from shelfline.llm import bpe, collocations, language, license_scan, merkle, ngram_lm, prefix_trie, privacy, quality, simhash, tiling, toxicity, warc  # noqa: F401
from shelfline.llm.registry import COMPARISONS, QUERIES

__all__ = ["COMPARISONS", "QUERIES"]
