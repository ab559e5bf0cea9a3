"""Optimal global alignments with affine gaps, for batches of pairs.

Costs: 0 for a match, mismatch, open + k extend for a gap of k. Of equally cheap alignments the one is taken that,
read from the end, prefers a gap in the query (I), then a pair of letters (M), then a gap in the hit (D), and that goes
on with a gap only where that is strictly cheaper than opening one anew.

Pairs of one length difference are aligned together in a band; the band doubles for those pairs whose cost another
alignment outside of it could reach, so results are those of the full matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Cells of one block of pairs, which bound its memory.
CELLS = 3_000_000


def _layers(query: np.ndarray, hit: np.ndarray, m: np.ndarray, delta: int, k: int, costs: tuple[int, int, int]):
    """(layers, each pair's cost, lowest offset): the least costs of each cell of the band by how an alignment ends there.

    layers[0] ends with a pair of letters, layers[1] with a gap in the query, layers[2] with a gap in the hit; cells are
    [row of the query, pair, offset of the hit], and offsets run from min(0, delta) - k.
    """
    mismatch, start, extend = costs
    low = min(0, delta) - k
    width = abs(delta) + 2 * k + 1
    pairs, rows = len(m), int(m.max())
    kind = np.int32 if (rows + width) * (mismatch + start + extend) < 2**28 else np.int64
    big = kind(2**29 if kind is np.int32 else 2**60)
    off = np.arange(width) + low
    least = np.where(off > 0, start + extend * off, np.where(off == 0, 0, big)).astype(kind)[None].repeat(pairs, 0)
    layers = np.full((3, rows + 1, pairs, width), big, kind)
    cost = np.where(m == 0, least[:, delta - low], 0)
    ramp = (extend * np.arange(width)).astype(kind)
    for i in range(1, rows + 1):
        pair, in_query, in_hit = layers[:, i]
        j = i + off
        letters = hit[:, np.clip(j - 1, 0, hit.shape[1] - 1)]
        inner = j > 0
        pair[:, inner] = (least + np.where(letters == query[:, i - 1 : i], 0, mismatch).astype(kind))[:, inner]
        down = np.minimum(least[:, 1:] + start, layers[2, i - 1, :, 1:]) + extend
        in_hit[:, :-1][:, inner[:-1]] = down[:, inner[:-1]]
        ended = np.minimum(pair, in_hit)
        ended[:, j == 0] = start + extend * i
        across = np.minimum.accumulate(ended - ramp, axis=1)[:, :-1] + start + ramp[1:]
        in_query[:, 1:][:, inner[1:]] = across[:, inner[1:]]
        least = np.minimum(np.minimum(ended, in_query), big)
        done = m == i
        cost[done] = least[done, delta - low]
    return layers, cost, low


def _trace(layers: np.ndarray, low: int, start: int, query: np.ndarray, hit: np.ndarray, m: np.ndarray, n: np.ndarray):
    """(operations from the end, one row a step, 0 after a pair's start; matches), by the costs of the cell at hand."""
    pairs = np.arange(len(m))
    i, j = m.copy(), n.copy()
    gap = {letter: np.zeros(len(m), bool) for letter in "ID"}  # whether the step before was in that gap
    matches = np.zeros(len(m), np.int64)
    steps = []
    while ((i > 0) | (j > 0)).any():
        inside = (i > 0) & (j > 0)
        pair, in_query, in_hit = layers[:, i, pairs, np.clip(j - i - low, 0, layers.shape[3] - 1)]
        best = np.minimum(np.minimum(pair, in_query), in_hit)
        longer = {"I": gap["I"] & (in_query < best + start), "D": gap["D"] & (in_hit < best + start)}
        free = ~longer["I"] & ~longer["D"]
        query_gap = np.where(inside, longer["I"] | (free & (in_query == best)), j > 0)
        hit_gap = np.where(inside, longer["D"] | (free & (in_query > best) & (in_hit < pair)), i > 0)
        both = inside & ~query_gap & ~hit_gap
        matches += both & (query[pairs, np.maximum(i - 1, 0)] == hit[pairs, np.maximum(j - 1, 0)])
        steps.append(np.select([query_gap, hit_gap, both], [ord("I"), ord("D"), ord("M")], 0).astype(np.uint8))
        gap = {"I": query_gap, "D": hit_gap}
        i, j = i - (both | hit_gap), j - (both | query_gap)
    return np.array(steps, np.uint8).reshape(len(steps), len(m)), matches


def _padded(texts: list[bytes]) -> np.ndarray:
    size = max(1, max(map(len, texts)))
    return np.frombuffer(b"".join(t.ljust(size, b"\0") for t in texts), np.uint8).reshape(len(texts), size)


def run_length(ops: bytes) -> str:
    """Operations as a CIGAR string; a count of one is left out."""
    out, at = [], 0
    while at < len(ops):
        end = at
        while end < len(ops) and ops[end] == ops[at]:
            end += 1
        out.append((str(end - at) if end - at > 1 else "") + chr(ops[at]))
        at = end
    return "".join(out)


def align(queries: list[str], hits: list[str], costs: tuple[int, int, int] = (18, 24, 13), cigars: bool = True, block: int = 512):
    """(differences, alignment lengths, CIGAR strings or None) of each query with its hit."""
    q, t = [x.encode() for x in queries], [x.encode() for x in hits]
    m, n = np.array([len(x) for x in q], np.int64), np.array([len(x) for x in t], np.int64)
    diff, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    text: list[str | None] = [None] * len(q)
    todo: list[tuple[np.ndarray, int]] = []

    def add(rows: np.ndarray, k: int) -> None:
        step = max(1, min(block, CELLS // (int(m[rows].max()) + 1) // (abs(int(n[rows[0]] - m[rows[0]])) + 2 * k + 1)))
        todo.extend((rows[at : at + step], k) for at in range(0, len(rows), step))

    for d in np.unique(n - m):
        add(np.flatnonzero(n - m == d), 4)
    while todo:
        rows, k = todo.pop()
        a, b = _padded([q[r] for r in rows]), _padded([t[r] for r in rows])
        layers, cost, low = _layers(a, b, m[rows], int(n[rows[0]] - m[rows[0]]), k, costs)
        sure = (cost < costs[1] + costs[2] * (k + 1)) | (k >= np.maximum(m[rows], n[rows]))
        if not sure.all():
            add(rows[~sure], 2 * k)
        if not sure.any():
            continue
        kept = rows[sure]
        ops, matches = _trace(np.ascontiguousarray(layers[:, :, sure]), low, costs[1], a[sure], b[sure], m[kept], n[kept])
        length = (ops > 0).sum(0) if len(ops) else np.zeros(len(kept), np.int64)
        diff[kept], size[kept] = length - matches, length
        if cigars:
            for c, r in enumerate(kept):
                text[r] = run_length(ops[: length[c], c][::-1].tobytes())
    return diff, size, text


def affine_diff(costs: tuple[int, int, int]):
    """Arrow UDF (query, hit) -> differences in the optimal alignment."""

    @F.pandas_udf("int")
    def run(query: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series(align(list(query), list(hit), costs, cigars=False)[0].astype("int32")) if len(query) else pd.Series([], dtype="int32")

    return run


def alignment(costs: tuple[int, int, int]):
    """Arrow UDF (query, hit) -> struct of diff, alen and cigar."""

    @F.pandas_udf("diff int, alen int, cigar string")
    def run(query: pd.Series, hit: pd.Series) -> pd.DataFrame:
        diff, size, text = align(list(query), list(hit), costs) if len(query) else ([], [], [])
        return pd.DataFrame({"diff": pd.Series(diff, dtype="int32"), "alen": pd.Series(size, dtype="int32"), "cigar": pd.Series(text, dtype="object")})

    return run
