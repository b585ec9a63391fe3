"""Settings, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: The word lists that define the instruction features.
LEXICON: dict[str, tuple[str, ...]] = {
    "if": ("if", "when", "whether", "case", "switch"),
    "conditional": ("condition", "scenario", "situation", "otherwise", "else"),
    "loop": ("loop", "iterate", "for each", "while", "repeat", "mapping", "filter"),
    "collection": ("list", "array", "dictionary", "map", "set", "collection", "stream"),
    "class": ("class", "object", "method", "inheritance", "interface", "abstract"),
    "func": ("function", "procedure", "recursive", "recursion"),
    "logic": ("logic", "algorithm", "validate", "parse", "sort", "search"),
}
#: Substrings that show nesting and algorithmic intent.
NESTING = ("nested", "recursive", "recursion", "inner", "inside", "sub-task", "hierarchy", "depth", "tree")
ALGORITHMS = ("sort", "search", "filter", "map", "reduce", "aggregate", "validate", "parse", "convert", "transform")

FEATURES = ("inst_tokens", "inst_if_count", "inst_conditional_count", "inst_loop_count", "inst_collection_count", "inst_class_count", "inst_func_count", "inst_logic_count", "inst_total_structural", "inst_avg_word_len")


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 10
    seed: int = 42
    resample_rows: bool = True  # whether a tree sees a sample of the rows with replacement
    folds: int = 10
    fits: int = 4  # forests that are fitted at a time
    grid_start: float = 2.0
    grid_end: float = 15.0
    grid_step: float = 0.5
    bootstrap: int = 500
    placebo: int = 500
    min_regime: int = 100
    success_at: float = 0.8
    fallback_gamma: float = 6.0
    instruments: tuple[str, ...] = ("inst_tokens", "inst_if_count", "inst_loop_count", "inst_class_count", "inst_func_count", "inst_logic_count", "inst_total_structural", "inst_avg_word_len")
    controls: tuple[str, ...] = ("e_norm", "m_mem_jaccard")
    lexicon: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(LEXICON))

    @property
    def grid(self) -> list[float]:
        """Threshold candidates; the end itself is not one."""
        return [float(g) for g in np.arange(self.grid_start, self.grid_end, self.grid_step)]


def present(wanted: tuple[str, ...], columns: list[str]) -> list[str]:
    """The wanted columns that a frame has, in the wanted order."""
    return [c for c in wanted if c in columns]
