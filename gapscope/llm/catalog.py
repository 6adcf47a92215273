"""Imports every module with queries of this subpackage."""

from . import collision_search, crf, debruijn, fill_middle, filter_audit, lbl, mixing, ngram_join, packing, repetition, secrets, speculative_bpe, warc  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
