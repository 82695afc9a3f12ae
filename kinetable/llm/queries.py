"""All queries of the training-data operators; importing the module fills the registry."""

from kinetable.llm import (  # noqa: F401
    decontamination,
    language_id,
    license_scan,
    line_dedup,
    multi_index,
    ngram_join,
    piece_codec,
    prefix_trie,
    quality,
    secret_scan,
    token_alignment,
    token_counts,
    toxicity,
)
from kinetable.llm.base import ORACLES, QUERIES  # noqa: F401
