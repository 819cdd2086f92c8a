"""Grid geometry and the constants shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Bits of the per-block flag word.
BLOCK_FLAGS = {
    "HAS_AIR": 1 << 0,
    "DOM_BORDER": 1 << 1,
    "COARSE_FINE": 1 << 2,
    "FINE_COARSE": 1 << 3,
    "EMPTY": 1 << 4,
    "NO_FLUID": 1 << 5,
    "ONLY_FLUID": 1 << 6,
    "BOUNDARY_ZONE": 1 << 7,
    "HAS_UNDEFINED": 1 << 8,
    "SLOW": 1 << 9,
    "TMP_MARK": 1 << 10,
    "FIXED": 1 << 11,
    "EXISTS": 1 << 12,
    "UNIFORM_EMPTY": 1 << 13,
    "HAS_DEFINED": 1 << 14,
    "CUTS_SOLID": 1 << 15,
}

# Bits of the per-cell flag word.
CELL_FLAGS = {
    "SOLID": 1 << 0,
    "FIXED": 1 << 1,
    "AIR": 1 << 2,
    "AIR_BORDER": 1 << 3,
    "EMPTY_U": 1 << 4,
    "EMPTY_V": 1 << 5,
    "PARTIAL_SOLID": 1 << 6,
    "OUT_OF_DOMAIN": 1 << 7,
    "BLK_BORDER": 1 << 8,
    "COARSE_FINE": 1 << 9,
    "FINE_COARSE": 1 << 10,
    "EMPTY_C": 1 << 11,
    "VOID": 1 << 12,
    "BOUNDARY_ZONE": 1 << 13,
    "TMP_MARK_2": 1 << 14,
    "EMPTY_W": 1 << 15,
}

STATES = ("EMPTY", "FULL", "INVALID", "VALUE")
BOUNDARY_TYPES = ("DIRICHLET", "NEUMANN", "PERIODIC", "FREESLIP")


@dataclass(frozen=True)
class Grid:
    """Extent of a grid in finest-level cells, and its block edge length.

    Halving the resolution halves the block edge too, so a block keeps its id
    on every level.
    """

    sx: int
    sy: int
    sz: int
    bsx: int = 16
    n_levels: int = 3

    def __post_init__(self) -> None:
        if self.bsx < 1 or self.bsx & (self.bsx - 1) or self.bsx > 32:
            raise ValueError("block edge must be a power of two, at most 32")
        for s in (self.sx, self.sy, self.sz):
            if s < 1 or s % self.bsx:
                raise ValueError("extents must be positive multiples of the block edge")
        if not 1 <= self.n_levels <= 4:
            raise ValueError("between 1 and 4 levels")

    @property
    def shift(self) -> int:
        return self.bsx.bit_length() - 1

    @property
    def nbx(self) -> int:
        return self.sx >> self.shift

    @property
    def nby(self) -> int:
        return self.sy >> self.shift

    @property
    def nbz(self) -> int:
        return self.sz >> self.shift

    @property
    def n_blocks(self) -> int:
        return self.nbx * self.nby * self.nbz

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.sx, self.sy, self.sz

    @property
    def block_dims(self) -> tuple[int, int, int]:
        return self.nbx, self.nby, self.nbz

    def block_edge(self, level: int) -> int:
        return max(self.bsx >> level, 1)

    def coarsened(self, level: int) -> "Grid":
        """The same blocks seen at a coarser level."""
        return Grid(
            max(self.sx >> level, 1),
            max(self.sy >> level, 1),
            max(self.sz >> level, 1),
            max(self.bsx >> level, 1),
            self.n_levels,
        )

    @staticmethod
    def default_block_edge(sx: int, sy: int, sz: int) -> int:
        """Block edge used when none is asked for."""
        return 32 if min(sx, sy, sz) >= 400 or max(sx, sy, sz) >= 1000 else 16

    @staticmethod
    def covering(nx: int, ny: int, nz: int, bsx: int, n_levels: int = 3) -> "Grid":
        """Smallest grid of whole blocks that contains nx × ny × nz cells."""
        up = lambda n: max(-(-n // bsx), 1) * bsx
        return Grid(up(nx), up(ny), up(nz), bsx, n_levels)
