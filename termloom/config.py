"""Settings of the engine. Defaults are the values that define the observable rankings."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class QueryType(Enum):
    INTERSECTION = "intersection"
    PHRASE = "phrase"
    RANKED = "ranked"


class Ranking(Enum):
    TF_IDF = "tf_idf"
    PAGERANK = "pagerank"
    COMBINATION = "combination"
    HITS = "hits"


@dataclass(frozen=True)
class TokenizerConfig:
    """How texts become terms. ``patterns`` are regular expressions for non-standard words, tried in their order.
    ``flush_last=False`` drops the last chunk of a text that does not end in a separator."""

    case_folding: bool = True
    remove_diacritics: bool = False
    remove_punctuation: bool = True
    patterns: tuple[str, ...] = ()
    flush_last: bool = True


@dataclass(frozen=True)
class EngineConfig:
    tokenizer: TokenizerConfig = field(default_factory=TokenizerConfig)
    k: int = 2  # letters of a k-gram
    pagerank_weight: float = 0.007  # of the combined ranking
    alpha: float = 0.2  # weight added to a query term that feedback finds again
    beta: float = 0.8  # weight of the relevant documents' terms
    jaccard: float = 0.3  # least k-gram likeness of a spelling candidate
    max_edit: int = 6  # largest edit distance of a spelling candidate
    bored: float = 0.15  # chance of a random jump
    epsilon: float = 1e-4  # change at which iterations stop
    integer_idf: bool = True  # idf as log10 of the integer quotient N / df
    feedback_depth: int = 10  # results whose marks count
