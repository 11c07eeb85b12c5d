"""Settings of the comparison, immutable and passed by value into UDFs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """The defaults of the comparison's tunables."""

    #: Inner steps of the search that one comparison may take over all its parts; None is without limit.
    budget: int | None = 20_000
    #: Whether a long common middle may be taken without proof that it is part of a shortest script.
    half_match: bool = True
    edit_cost: int = 4
    match_threshold: float = 0.5
    match_distance: int = 1000
    patch_delete_threshold: float = 0.5
    patch_margin: int = 4
    match_max_bits: int = 32


DEFAULT = Config()
#: A shortest script is searched for to the end.
EXACT = Config(budget=None, half_match=False)
