"""Problem 1: groups and pairs of records that differ by small edits.

Method: fast similarity sketching. Every record is the set of its 8-letter windows. In round i each window falls into
one of t bins with a fresh hash, and a bin keeps the smallest (round, hash); in round t + i all windows go to bin i,
so that every coordinate fills, after about log t rounds as a rule. Bins that agree estimate the Jaccard similarity
with Chernoff-type bounds. Three coordinates make a band; records that share a band are candidates; candidates are
verified exactly on their windows.

Windows in more than `common` of the records (primers, adapters) say little and would fill the same bands for half of
the table; they are left out of the sketch (never of the verification). It is a share at every size of the table. Where a share c of a pair's windows is common
and in both, the sketch sees (s - c) / (1 - c) instead of s. c is at most the share f of common windows in either
record, so a record gets as many further bands, in blocks of BLOCK, as keep the miss over all windows at its bound for
c = f. Where MOST blocks are too few (f over a third), it gets all of them, and bands over all its windows as well.

Chance meetings in a band grow with the square of the table: with 3 coordinates a record of 31 million met 17 others by
chance. So a band gets one coordinate more from WIDER records on, and again from every STEP times as many, with as many
bands as keep the miss where it was.

Exact copies are collapsed first. Bands travel as arrays by bucket; a reducer holds one bucket at a time, and a band that
is too long already passes through it. The records of bands with more than HOT of them are not paired by band: they meet
under their rarest windows. Of a record's m windows, rarest first, the first m - ceil(s m) + 1 must hold one that a record
of similarity s has among its own first ones, so this loses no pair. There are only 65,536 windows of four letters, so
among many records none is rare: where a record would meet more than RARE others, these records get fresh bands instead,
two coordinates wider, that miss AGAIN at most, and so on until WIDEST. Rarest windows over all records are the exact mode
(exact=True), for measuring what the bands miss. A window that over HOT records have among their rarest stands for
records alike nearly everywhere; they are paired by a join that adaptive execution can split.

With 30 bands of 3 coordinates a pair of similarity s without common windows is missed with (1 - s**3)**30: 0.02 at
0.5, 7e-4 at 0.6, 5e-6 at 0.7; a pair with common windows, at 0.6 and over, with 7e-4 at most. Wider bands keep the figure
at the similarity asked for. Nulls, empty texts and texts under 8 letters have no windows and no links.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.bytescan import binary_column, flat, mix64, rows_of
from ampliq.llm.nucleotides import Folded, first_of_key
from ampliq.plans.scratch import stage_partitions, table

SHINGLE = 8
BUCKETS = 1 << 18
HOT = 512
BLOCK = 8
MOST = 9
WIDER, STEP = 1 << 21, 32
RARE = 512
AGAIN = 1e-6
WIDEST = 7
MANY = 600
CHUNK = 1000
HELD = 1 << 20
_TWO = np.full(27, 255, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    _TWO[_c - 64] = _k
_QUAD = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
_LETTER = np.array([c - 64 for c in b"ACGT"], np.uint8)


def pack(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of letter codes as binary: a head byte, then four letters a byte; rows with other letters keep a byte a letter."""
    lengths = np.diff(offsets)
    two = _TWO[codes]
    odd = np.zeros(len(lengths), bool)
    odd[rows_of(offsets)[two == 255]] = True
    size = 1 + (lengths + 3) // 4
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(ends[-1] * 4, np.uint8)
    index = np.arange(len(codes)) - np.repeat(offsets[:-1], lengths)
    out[np.repeat(ends[:-1] * 4 + 4, lengths) + index] = np.where(two == 255, 0, two)
    q = out.reshape(-1, 4)
    packed = (q[:, 0] << 6) | (q[:, 1] << 4) | (q[:, 2] << 2) | q[:, 3]
    packed[ends[:-1]] = (-lengths) % 4
    if not odd.any():
        return binary_column(packed, ends)
    return pa.array(
        [(b"\xff" + codes[offsets[i] : offsets[i + 1]].tobytes()) if odd[i] else packed[ends[i] : ends[i + 1]].tobytes() for i in range(len(lengths))], pa.binary()
    )


def unpack(column) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of packed rows."""
    data, offsets, _ = flat(column)
    size = np.diff(offsets)
    head = data[offsets[:-1]]
    raw = head == 255
    pad = np.where(raw, 0, head).astype(np.int64)
    full = _QUAD[data].reshape(-1)
    keep = np.ones(len(full), bool)
    for k in range(4):
        keep[offsets[:-1] * 4 + k] = False
    for k in (1, 2, 3):
        keep[offsets[1:][pad >= k] * 4 - k] = False
    lengths = (size - 1) * 4 - pad
    if not raw.any():
        return _LETTER[full[keep]], np.concatenate(([0], np.cumsum(lengths)))
    lengths[raw] = size[raw] - 1
    ends = np.concatenate(([0], np.cumsum(lengths)))
    out = np.zeros(ends[-1], np.uint8)
    row = np.repeat(np.arange(len(size)), size * 4)
    out[np.repeat(~raw, lengths)] = _LETTER[full[keep & ~raw[row]]]
    for i in np.flatnonzero(raw):
        out[ends[i] : ends[i + 1]] = data[offsets[i] + 1 : offsets[i + 1]]
    return out, ends


def windows(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window codes of 5 bits a letter, row of each)."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = codes.astype(np.uint64)
    c = (c[:-1] << np.uint64(5)) | c[1:]
    c = (c[:-2] << np.uint64(10)) | c[2:]
    c = (c[:-4] << np.uint64(20)) | c[4:]
    row = rows_of(offsets)[:n]
    whole = np.arange(n) + SHINGLE <= np.repeat(offsets[1:], np.diff(offsets))[:n]
    return c[whole], row[whole]


def bucket(w: np.ndarray) -> np.ndarray:
    return (mix64(w) >> np.uint64(46)).astype(np.int64)


def sketch(w: np.ndarray, row: np.ndarray, n: int, t: int) -> np.ndarray:
    """The n x t sketches of the sets {w[row == r]}; rows without windows stay at the largest value."""
    full = np.uint64(2**64 - 1)
    out = np.full(n * t, full, np.uint64)
    base = row * t
    for i in range(2 * t):
        h = mix64(w ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        low = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        to = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, base + to, low)
        open_rows = (out.reshape(n, t) == full).any(axis=1)
        live = open_rows[row]
        if not live.any():
            break
        if not live.all():
            w, row, base = w[live], row[live], base[live]
    return out.reshape(n, t)


def band_keys(s: np.ndarray, bands: int, width: int, salt: int) -> np.ndarray:
    """One 64-bit key by row and band."""
    key = np.tile((np.arange(bands, dtype=np.uint64) + np.uint64(salt * 1000 + 1)), (len(s), 1))
    for k in range(width):
        key = mix64(key * np.uint64(0xA24BAED4963EE407) ^ s[:, k : bands * width : width])
    return key.view(np.int64)


def _strings(batches):
    """Packed nucleotides and ids, the batch's copies collapsed."""
    for batch in batches:
        f = Folded(batch.column(1))
        rows = np.flatnonzero(f.lengths > 0)
        if not len(rows):
            continue
        ids = batch.column(0).to_numpy()
        h1, h2 = f.hashes()
        rows = rows[np.argsort(ids[rows], kind="stable")]
        first = rows[first_of_key(h1[rows], h2[rows], np.arange(len(rows)))]
        first = np.where(f.same(rows, first), first, rows)
        lead = np.unique(first)
        codes, ends = f.codes_of(lead)
        yield pa.RecordBatch.from_arrays([pack(codes, ends), pa.array(ids[lead])], names=["packed", "entry_id"])


def distinct_strings(df: DataFrame, key: str = "entry_id", text: str = "sequence") -> DataFrame:
    """(packed, entry_id): every distinct nucleotide string with its smallest id; rows with a null id are left out."""
    return (
        df.select(F.col(key).cast("bigint").alias("entry_id"), F.col(text).cast("string").alias("sequence"))
        .filter("entry_id is not null and sequence is not null")
        .mapInArrow(_strings, "packed binary, entry_id bigint")
        .groupBy("packed").agg(F.min("entry_id").alias("entry_id"))
    )


def _once(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; x is sorted in place."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _window_counts(batches):
    """(bucket, records of this partition that have it)."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            w, row = windows(*unpack(batch.column(0).slice(at, CHUNK)))
            total += np.bincount(_once(row * BUCKETS + bucket(w)) % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def window_counts(strings: DataFrame) -> np.ndarray:
    """In how many records each of BUCKETS hashed windows stands. Partitions and the driver get BUCKETS counts at most."""
    counts = strings.mapInArrow(_window_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def common_windows(counts: np.ndarray, records: int, share: float) -> np.ndarray:
    """Bitmap of hashed windows that stand in more than share of the records. The miss bound holds for any choice."""
    return counts > share * records


def bands_for(miss: float, similarity: float, width: int) -> int:
    """The fewest bands of so many coordinates that miss a pair of this similarity with miss at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-(min(similarity, 1 - 1e-9) ** width)) - 1e-9))


def widened(records: int, similarity: float, bands: int, width: int) -> tuple[int, int]:
    """(bands, width) for so many records, with the miss of the bands given."""
    miss = (1 - min(similarity, 1 - 1e-9) ** width) ** bands
    at = WIDER
    while 0 < miss < 1 and records >= at and (more := bands_for(miss, similarity, width + 1)) <= MANY:
        bands, width, at = more, width + 1, at * STEP
    return bands, width


def block_size(bands: int) -> int:
    return max(BLOCK, -(-BLOCK * bands // 30))


def further_blocks(share: np.ndarray, similarity: float, bands: int, width: int) -> np.ndarray:
    """Blocks of further bands for records with so large a share of common windows; MOST + 1: MOST are too few."""
    top = min(similarity, 1 - 1e-9)
    left = np.maximum((top - share) / np.maximum(1 - share, 1e-9), 1e-3)
    need = bands * np.log1p(-(top**width)) / np.log1p(-(left**width))
    return np.ceil(np.clip((need - bands) / block_size(bands) - 1e-9, 0, MOST + 1)).astype(np.int64)


def _bands(bitmap: np.ndarray, similarity: float, bands: int, width: int, level: int = 0):
    packed_map = np.packbits(bitmap)
    block, first = block_size(bands), level * (MOST + 2)

    def run(batches):
        common = np.unpackbits(packed_map).astype(bool)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(1).to_numpy()
                codes, offsets = unpack(part.column(0))
                w, row = windows(codes, offsets)
                n = len(ids)
                once = _once((row.astype(np.uint64) << np.uint64(40)) | w)
                w, row = once & np.uint64(2**40 - 1), (once >> np.uint64(40)).astype(np.int64)
                rare = ~common[bucket(w)]
                kept = np.bincount(row[rare], minlength=n)
                every = np.bincount(row, minlength=n)
                more = further_blocks(1 - kept / np.maximum(every, 1), similarity, bands, width)
                sketches = [(kept > 0, rare, 0, bands), ((every > 0) & (more > MOST), ~rare | rare, 1, bands)]
                sketches += [((kept > 0) & (more > k), rare, 2 + k, block) for k in range(MOST)]
                for some, use, salt, m in sketches:
                    if not some.any():
                        continue
                    to = np.cumsum(some) - 1
                    use = use & some[row]
                    s = sketch(w[use] ^ np.uint64(first + salt << 40), to[row[use]], int(some.sum()), m * width)
                    keys = band_keys(s, m, width, first + salt)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids[some], m))], names=["band", "id"])

    return run


def _rarest(counts: np.ndarray, num: int, den: int):
    """A key for each of a record's rarest windows, as many as a record of similarity num / den cannot miss all of."""
    rank = np.zeros(BUCKETS, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(1).to_numpy()
                w, row = windows(*unpack(part.column(0)))
                once = _once((row.astype(np.uint64) << np.uint64(40)) | w)
                w, row = once & np.uint64(2**40 - 1), (once >> np.uint64(40)).astype(np.int64)
                order = np.lexsort((w, rank[bucket(w)], row))
                w, row = w[order], row[order]
                size = np.bincount(row, minlength=len(ids))
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                first = place <= (size - -(-size * num // den))[row]
                yield pa.RecordBatch.from_arrays([pa.array(mix64(w[first]).view(np.int64)), pa.array(ids[row[first]])], names=["band", "id"])

    return run


def _pairs(batches, most=HOT):
    """Candidate pairs (a, b) of every band with 2 to most records; a longer band's records as (id, null, band)."""

    def emit(key, ids):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        hot = np.repeat(size > most, size)
        a, b = [], []
        cold_key, cold = key[~hot], ids[~hot]
        for d in range(1, int(size[size <= most].max(initial=1))):
            same = np.flatnonzero(cold_key[d:] == cold_key[:-d])
            a.append(cold[same])
            b.append(cold[same + d])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        lo, hi = lo[lo < hi], hi[lo < hi]
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[: len(lo)]
        pairs = np.stack((lo[new], hi[new]), 1)
        n, m = len(pairs), int(hot.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((pairs[:, 0], ids[hot]))),
                pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key[hot])]),
            ],
            names=["a", "b", "band"],
        )

    key, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot_key = None
    for batch in batches:
        k, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if hot_key is not None:  # the band that ran on from the batch before is a hot one: its records pass through
            n = int(np.searchsorted(k, hot_key, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(i[:n]), pa.nulls(n, pa.int64()), pa.array(k[:n])], names=["a", "b", "band"])
            k, i = k[n:], i[n:]
            if not len(k):
                continue
            hot_key = None
        key, ids = np.concatenate((key, k)), np.concatenate((ids, i))
        cut = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - cut > most:
            hot_key, cut = key[-1], len(key)
        yield emit(key[:cut], ids[:cut])
        key, ids = key[cut:], ids[cut:]
    yield emit(key, ids)


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                n = part.num_rows
                sets = []
                for k in (2, 3):
                    w, row = windows(*unpack(part.column(k)))
                    sets.append(_once((row.astype(np.uint64) << np.uint64(40)) | w))
                both = np.concatenate(sets)
                both.sort()
                shared = both[1:][both[1:] == both[:-1]]
                inter = np.bincount((shared >> np.uint64(40)).astype(np.int64), minlength=n)
                size = sum(np.bincount((s >> np.uint64(40)).astype(np.int64), minlength=n) for s in sets)
                union = size - inter
                ok = (union > 0) & (inter * den >= union * num)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(keep), part.column(1).filter(keep), pa.array(inter[ok] / union[ok])], names=["entry_a", "entry_b", "similarity"]
                )

    return run


def _bucketed(run, buckets: int):
    """What run yields as (band, id), as (bucket, 32-bit keys, ids) by bucket of the band; ids less their smallest where that saves half."""

    def flush(held):
        key, ids = (np.concatenate(x) for x in zip(*held))
        key = key.view(np.uint64)
        at = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16)
        order = np.argsort(at, kind="stable")
        at, low, ids = at[order], key[order].astype(np.uint32), ids[order]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(start, len(at))
        base = int(ids.min())
        narrow = int(ids.max()) - base < 2**32
        sent = (ids - base).astype(np.uint32) if narrow else ids
        return pa.RecordBatch.from_arrays(
            [
                pa.array(at[start].astype(np.int32)),
                pa.array(np.full(len(start), base if narrow else 0)),
                binary_column(low.view(np.uint8), ends * 4),
                binary_column(sent.view(np.uint8), ends * sent.itemsize),
            ],
            names=["bucket", "base", "keys", "ids"],
        )

    def packed(batches):
        held, rows = [], 0
        for batch in run(batches):
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= HELD:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)

    return packed


def _meet(most: int):
    """_pairs of buckets that come one after another. Bands over most of a bucket over HELD leave it at once, so that a long band is never held."""

    def long_bands(key):
        key = np.sort(key)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[start[np.diff(np.append(start, len(key))) > most]]

    def passed(key, ids):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(key)], names=["a", "b", "band"])

    def meet(held):
        key, ids = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same)
        rows = pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(ids[shared])], names=["band", "id"])
        yield from _pairs((rows.slice(at, 10_000) for at in range(0, rows.num_rows, 10_000)), most)

    def run(batches):
        now, held, rows, limit, hot = None, [], 0, HELD, np.zeros(0, np.int64)
        for batch in batches:
            for at, base, keys, ids in zip(*(batch.column(k) for k in range(4))):
                if at.as_py() != now:
                    if rows:
                        yield from meet(held)
                    now, held, rows, limit, hot = at.as_py(), [], 0, HELD, np.zeros(0, np.int64)
                key = np.frombuffer(keys.as_buffer(), np.uint32).astype(np.int64) | now << 32
                i = np.frombuffer(ids.as_buffer(), np.uint32 if keys.as_buffer().size == ids.as_buffer().size else np.int64).astype(np.int64) + base.as_py()
                if len(hot):
                    out = np.isin(key, hot)
                    yield passed(key[out], i[out])
                    key, i = key[~out], i[~out]
                held.append((key, i))
                rows += len(key)
                if rows > limit:
                    key, i = (np.concatenate(x) for x in zip(*held))
                    hot = np.concatenate((hot, more := long_bands(key)))
                    out = np.isin(key, more)
                    yield passed(key[out], i[out])
                    held, rows = [(key[~out], i[~out])], int((~out).sum())
                    limit = 2 * rows + HELD
        if rows:
            yield from meet(held)

    return run


def _met(strings: DataFrame, run, name: str) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of the keys that run gives to HOT records at most, records (band, id) of the others)."""
    parts = stage_partitions(strings.sparkSession)
    keys = strings.mapInArrow(_bucketed(run, min(1 << 16, 16 * parts)), "bucket int, base bigint, keys binary, ids binary")
    spread = keys.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = table(spread.mapInArrow(_meet(HOT), "a bigint, b bigint, band bigint"), name)
    return found.filter("b is not null").select("a", "b"), found.filter("b is null").select("band", F.col("a").alias("id"))


def rarest_meetings(counts: np.ndarray, similarity: float) -> float:
    """About how many pairs meet under their rarest windows, by the records that have each hashed window."""
    c = np.sort(counts).astype(np.float64)
    used = c[np.cumsum(c) <= (1 - similarity) * c.sum()]
    return float((used * used).sum() / 2)


def _by_rarest(strings: DataFrame, counts: np.ndarray, similarity: Fraction) -> DataFrame:
    """(a, b): every pair of similarity or more, and others."""
    pairs, dense = _met(strings, _rarest(counts, similarity.numerator, similarity.denominator), "rarest")
    if dense.isEmpty():
        return pairs
    other = dense.select("band", F.col("id").alias("b"))
    return pairs.unionByName(dense.join(other.hint("merge"), "band").filter("id < b").select(F.col("id").alias("a"), "b"))


def _by_bands(strings: DataFrame, counts: np.ndarray, common: np.ndarray, similarity: Fraction, bands: int, width: int, level: int = 0) -> DataFrame:
    """(a, b): the pairs that share a band, and of the records of long bands those that meet again."""
    pairs, hot = _met(strings, _bands(common, float(similarity), bands, width, level), "candidates")
    if hot.isEmpty():
        return pairs
    some = table(strings.join(hot.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_semi").select("packed", "entry_id"), "hot")
    wider = bands_for(AGAIN, float(similarity), width + 2)
    if width + 2 > WIDEST or wider > MANY or rarest_meetings(window_counts(some), float(similarity)) <= RARE * some.count():
        return pairs.unionByName(_by_rarest(some, counts, similarity))
    return pairs.unionByName(_by_bands(some, counts, common, similarity, wider, width + 2, level + 1))


def similar_pairs(
    df: DataFrame, key: str = "entry_id", text: str = "sequence", similarity: float = 0.6, bands: int = 30, width: int = 3, common: float = 0.02, exact: bool = False
) -> DataFrame:
    """(entry_a, entry_b, similarity): every pair of distinct nucleotide strings, each by its smallest id, that is at least so similar.

    bands, width: of tables under WIDER records; larger ones get wider bands with the same miss. exact: no sketches and no missed pairs, at several times the cost. common: the share of the records from which on a
    window is left out of the sketches; 1 leaves none out.
    """
    least = Fraction(str(similarity))
    strings = table(distinct_strings(df, key, text), "strings")
    counts = window_counts(strings)
    if exact:
        pairs = _by_rarest(strings, counts, least)
    else:
        records = strings.count()
        pairs = _by_bands(strings, counts, common_windows(counts, records, common), least, *widened(records, similarity, bands, width))
    pairs = pairs.distinct()
    left = strings.select(F.col("entry_id").alias("a"), F.col("packed").alias("pa"))
    right = strings.select(F.col("entry_id").alias("b"), F.col("packed").alias("pb"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")
        .mapInArrow(_verify(least.numerator, least.denominator), "entry_a bigint, entry_b bigint, similarity double")
    )


def similar_groups(df: DataFrame, key: str = "entry_id", text: str = "sequence", **options) -> DataFrame:
    """(entry_id, group_id): every row with nucleotides and the smallest id among those it is linked to, over any chain of links.

    Rows that repeat an id come out as often as they came in; their texts should be alike, or one of them decides.
    """
    from ampliq.llm.duplicates import duplicate_entries
    from ampliq.operators.components import connected_components

    links = table(similar_pairs(df, key, text, **options).select("entry_a", "entry_b"), "links")
    of = connected_components(links, "entry_a", "entry_b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    copies = table(duplicate_entries(df, key, text), "copies")
    reps = copies.groupBy("sequence_md5").agg(F.min("entry_id").alias("rep"))
    rep_of = copies.join(reps, "sequence_md5").groupBy("entry_id").agg(F.min("rep").alias("rep"))
    with_letters = df.select(F.col(key).cast("bigint").alias("entry_id")).filter(F.col(text).rlike("[A-Za-z]"))
    return (
        with_letters.join(rep_of, "entry_id", "left").withColumn("rep", F.coalesce("rep", "entry_id"))
        .join(of, "rep", "left").select("entry_id", F.coalesce("group_id", "rep").alias("group_id"))
    )
