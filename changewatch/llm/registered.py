"""All queries of the subpackage: importing the operators registers them."""

from . import decontaminate, fingerprint, jaccard, langid, merkle, ordinal, periodic, pieces, revisits, shuffle, suffix_dedup, token_counts, toxicity  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
