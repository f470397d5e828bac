"""Execution policies: hints for block sizes that never change a result."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """``cutoff`` elements make a block of a plan in levels; ``checkout`` elements an Arrow batch; an order is made in ``ranges``.

    ``ranges`` are the session's shuffle partitions by default.
    """

    cutoff: int = 65_536
    checkout: int | None = None
    ranges: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.batch <= self.cutoff:
            raise ValueError("0 < checkout <= cutoff must hold")

    @property
    def batch(self) -> int:
        return self.cutoff if self.checkout is None else self.checkout


SEQ = Policy(cutoff=1 << 20, ranges=1)
PAR = Policy()
