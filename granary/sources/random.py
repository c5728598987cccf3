"""A small seeded generator whose sequence is fixed, for results that must replay exactly."""

from __future__ import annotations

# Fixed value: the increment of the 32-bit generator.
_STEP = 0x6D2B79F5
_MASK = 0xFFFFFFFF


class Mulberry:
    """Uniform numbers in [0, 1) from a 32-bit state (the public mulberry32 generator)."""

    def __init__(self, seed: int):
        if not isinstance(seed, int) or isinstance(seed, bool):
            raise TypeError("The seed must be an integer")
        self.state = seed & _MASK

    def __call__(self) -> float:
        self.state = (self.state + _STEP) & _MASK
        x = self.state
        x = ((x ^ (x >> 15)) * (x | 1)) & _MASK
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & _MASK)) & _MASK
        return ((x ^ (x >> 14)) & _MASK) / 2**32

    def below(self, n: int) -> int:
        return int(self() * n)

    def places(self, n: int, height: int, with_replacement: bool = False) -> list[int]:
        """n of ``height`` places; without replacement by the first n swaps of a shuffle, kept sparse."""
        if with_replacement:
            return [self.below(height) for _ in range(n)]
        moved: dict[int, int] = {}
        out = []
        for i in range(n):
            j = i + self.below(height - i)
            out.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        return out
