"""Parameters of an annotation run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """k: k-mer size. window, band: bases. identity: least score of a cell. tolerance: empty windows that end a run.
    threshold: percentage of a region's k-mers that a class must hold to name it.
    compat: the original tool's accidental rules, where results differ by them: coordinates without a range are one less,
    a region's end is one short and its base 0 isn't read, a start is moved by k, the k-mer 0 counts as one, and an array
    whose ends aren't found goes, or stands as 0 to 1 if none is near."""

    k: int = 21
    window: int = 2000
    band: int = 2_000_000
    identity: float = 86.0
    tolerance: int = 2
    threshold: float = 25.0
    compat: bool = False

    def __post_init__(self):
        if self.window < 2 or self.band < self.window or self.band % self.window:
            raise ValueError("band must be a multiple of window")

    @property
    def interval(self) -> int:
        """How far an overlapping window reaches beyond its plain one on either side."""
        return (self.window + 1) // 2

    @property
    def windows(self) -> int:
        return self.band // self.window
