"""Every registered query of this subpackage."""

from pagelib.llm import (chat, forest, jaccard, licenses, mixing, pseudolikelihood, quality, ranked, runs,  # noqa: F401
                         sentencepiece_codec, substrings, topk, toxicity)
from pagelib.llm.common import QUERIES, SQL  # noqa: F401
