"""Run options, with the checks every run makes before it reads anything."""

from __future__ import annotations

import math
from dataclasses import dataclass


class AmpliconError(ValueError):
    """Input or options that a run refuses. header: that of the entry at fault, if it is one."""

    def __init__(self, why: str, header: str | None = None):
        super().__init__(why)
        self.header = header


@dataclass(frozen=True)
class Options:
    """d: differences a link may have. ceiling, bloom_bits, threads and disable_sse3 are checked and change no result."""

    d: int = 1
    breaking: bool = True
    fastidious: bool = False
    boundary: int | None = None
    ceiling: int | None = None
    bloom_bits: int | None = None
    default_abundance: int | None = None
    usearch: bool = False
    match: int | None = None
    mismatch: int | None = None
    gap_open: int | None = None
    gap_extend: int | None = None
    disable_sse3: bool = False
    threads: int = 1
    network: bool = False

    def checked(self) -> "Options":
        """Self, or AmpliconError."""

        def need(ok: bool, why: str) -> None:
            if not ok:
                raise AmpliconError(why)

        need(1 <= self.threads <= 512, "the number of threads must be 1 to 512")
        need(0 <= self.d <= 255, "the number of differences must be 0 to 255")
        need(not self.fastidious or self.d == 1, "the fastidious pass needs d = 1")
        need(not self.disable_sse3 or self.d > 1, "SSE3 can be disabled with d > 1 only")
        for name in ("boundary", "ceiling", "bloom_bits"):
            need(self.fastidious or getattr(self, name) is None, f"{name} needs the fastidious pass")
        for name, least in (("match", 1), ("mismatch", 1), ("gap_open", 0), ("gap_extend", 0)):
            value = getattr(self, name)
            need(self.d > 1 or value is None, f"{name} can be set with d > 1 only")
            need(value is None or value >= least, f"{name} must be {least} or more")
        need(self.score("gap_open") + self.score("gap_extend") >= 1, "the gap penalties must not both be zero")
        need(self.boundary is None or self.boundary >= 2, "the boundary must be 2 or more")
        need(self.ceiling is None or 40 <= self.ceiling <= 2**30, "the memory ceiling must be 40 to 2**30 MB")
        need(self.bloom_bits is None or 2 <= self.bloom_bits <= 64, "the Bloom bits must be 2 to 64")
        need(self.default_abundance is None or self.default_abundance >= 1, "the default abundance must be 1 or more")
        need(not self.network or self.d == 1, "the network needs d = 1")
        need(self.penalties[0] <= 255, "the mismatch penalty is too high")
        need(self.d <= 1 or self.d * max(self.penalties[0], self.penalties[1] + self.penalties[2]) < 65535, "d is too high for these penalties")
        return self

    def score(self, name: str) -> int:
        value = getattr(self, name)
        return {"match": 5, "mismatch": 4, "gap_open": 12, "gap_extend": 4}[name] if value is None else value

    @property
    def penalties(self) -> tuple[int, int, int]:
        """Costs of a mismatch, of opening and of extending a gap, for matches that cost nothing, in lowest terms."""
        m, p, g, e = (self.score(n) for n in ("match", "mismatch", "gap_open", "gap_extend"))
        costs = (2 * (m + p), 2 * g, m + 2 * e)
        common = math.gcd(*costs)
        return tuple(c // common for c in costs)

    @property
    def limit(self) -> int:
        """Mass from which a cluster is heavy."""
        return 3 if self.boundary is None else self.boundary
