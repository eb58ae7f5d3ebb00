"""A reproducible generator (PCG64, XSL-RR output) for workloads, with derived sub-streams."""

from __future__ import annotations

# Fixed values of the generator.
MULTIPLIER = (2549297995355413924 << 64) | 4865540595714422341
STREAM = 1442695040888963407
M64, M128 = (1 << 64) - 1, (1 << 128) - 1


class Pcg64:
    def __init__(self, seed: int):
        self._step = STREAM << 1 | 1
        self._state = 0
        self.next()
        self._state = (self._state + seed) & M128
        self.next()

    def next(self) -> int:
        s = self._state
        self._state = (s * MULTIPLIER + self._step) & M128
        folded, turn = (s >> 64 ^ s) & M64, s >> 122
        return (folded >> turn | folded << (64 - turn)) & M64 if turn else folded

    def below(self, n: int) -> int:
        """Uniform in [0, n), by rejecting the incomplete last block of values."""
        if n <= 1:
            return 0
        whole = (1 << 64) // n * n if (1 << 64) % n else M64 + 1 - n
        while True:
            x = self.next()
            if x < whole:
                return x % n
