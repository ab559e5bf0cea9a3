import datetime
import random

import pytest

from ampliq.llm.duplicates import collapse, duplicate_entries, true_flags
from ampliq.llm.seen import BloomChain, seen_before, wrong_answers
from ampliq.llm.similar import pack, similar_groups, similar_pairs, unpack
from ampliq.llm import similar

NAMES = "entry_id bigint, sequence string, loaded_at timestamp, spread string, h1 int, packed string"


def table(spark, rows):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, s, None if m is None else t + datetime.timedelta(minutes=m), "x", 1, "y") for i, s, m in rows], NAMES)


def letters(s):
    return "".join(c for c in (s or "").upper() if "A" <= c <= "Z").replace("U", "T")


ROWS = [(1, "AC GT", 5), (2, "acgu\r\n", 3), (3, None, 1), (4, "", 1), (5, "--12", 1), (6, "ACGTA", None), (7, "A-CG-T", 4), (8, "N" * 5000, 9), (9, "n" * 5000 + ".", 8), (10, "é", 1)]


def test_duplicates(spark):
    df = table(spark, ROWS)
    assert sorted(r["entry_id"] for r in duplicate_entries(df).collect()) == [1, 2, 7, 8, 9]
    assert sorted((r["entry_id"], r["copies"]) for r in collapse(df).collect()) == [(1, 3), (6, 1), (8, 2)]
    assert {r["entry_id"] for r in true_flags(df).filter("has_duplicates").collect()} == {1, 2, 7, 8, 9}
    assert duplicate_entries(df.limit(0)).count() == 0
    twice = df.filter("entry_id = 6").unionByName(df.filter("entry_id = 6"))
    assert [r["entry_id"] for r in duplicate_entries(twice).collect()] == [6, 6]


def test_hot_duplicates_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).selectExpr("id as entry_id", "if(id % 3 = 0, 'acg t', concat('A', repeat('C', cast(id % 50 as int)))) as sequence").repartition(5)
        by = {}
        for r in df.collect():
            by.setdefault(letters(r["sequence"]), []).append(r["entry_id"])
        assert sorted(r["entry_id"] for r in duplicate_entries(df).collect()) == sorted(i for v in by.values() if len(v) > 1 for i in v)
        assert sorted((r["entry_id"], r["copies"]) for r in collapse(df).collect()) == sorted((min(v), len(v)) for v in by.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_seen(spark):
    known = spark.createDataFrame([("ACGTA",), (None,)], "sequence string")
    df = table(spark, ROWS)
    assert sorted(r["entry_id"] for r in seen_before(df, known).collect()) == [1, 6, 7, 8]
    got = wrong_answers(df, known).first()
    assert (got["entries"], got["new_keys"], got["truly_seen"], got["wrong"]) == (6, 2, 4, 0)
    assert seen_before(df.limit(0), known).count() == 0 and wrong_answers(df.limit(0), known.limit(0)).first()["entries"] == 0


def test_bloom_chain_keeps_its_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 60_000) for _ in range(2))
    chain = BloomChain(error=0.01, capacity=1000)
    chain.add(a[:20_000], b[:20_000])
    assert chain.contains(a[:20_000], b[:20_000]).all() and len(chain.layers) > 2 and chain.bound <= 0.01
    assert chain.contains(a[20_000:], b[20_000:]).mean() < 0.012


def brute(rows, least):
    first = {}
    for i, s, _ in rows:
        if letters(s):
            first[letters(s)] = min(i, first.get(letters(s), i))
    sets = {i: {s[k : k + 8] for k in range(len(s) - 7)} for s, i in first.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_similar(spark, monkeypatch):
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(150):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        rows.append((i, "".join(s), 0))
    rows += [(200, None, 0), (201, "", 0), (202, "ACG", 0), (203, "acg", 0), (204, "ACGTRYKMACGTNNACGT", 0), (205, "ACGTRYKMACGTNNACGTA", 0), (206, rows[0][1].lower(), 0)]
    want = brute(rows, 0.6)
    df = table(spark, rows)
    assert {(r["entry_a"], r["entry_b"]) for r in similar_pairs(df).collect()} == want and len(want) > 100
    groups = {r["entry_id"]: r["group_id"] for r in similar_groups(df).collect()}
    assert set(groups) == {i for i, s, _ in rows if letters(s)} and groups[203] == 202 and groups[206] == groups[0]
    assert all(groups[a] == groups[b] for a, b in want)
    assert similar_pairs(df.limit(0)).count() == 0
    assert {(r["entry_a"], r["entry_b"]) for r in similar_pairs(df, exact=True).collect()} == want
    monkeypatch.setattr(similar, "HOT", 5)
    assert {(r["entry_a"], r["entry_b"]) for r in similar_pairs(df).collect()} == want


@pytest.mark.parametrize("conserved, edits", [(70, 5), (45, 4)])
def test_pairs_that_share_a_conserved_block_are_found(spark, conserved, edits):
    rng = random.Random(5)
    block = "".join(rng.choice("ACGT") for _ in range(conserved))
    rows = []
    for i in range(150):
        a = [rng.choice("ACGT") for _ in range(90)]
        b = list(a)
        for at in rng.sample(range(8, 82), edits):
            b[at] = "ACGT"[("ACGT".index(b[at]) + 1) % 4]
        rows += [(2 * i, block + "".join(a), 0), (2 * i + 1, block + "".join(b), 0)]
    want = brute(rows, 0.6)
    got = {(r["entry_a"], r["entry_b"]) for r in similar_pairs(table(spark, rows)).collect()}
    assert len(want) > 90 and got <= want and len(got) >= 0.985 * len(want)


def test_common_windows_are_a_share_of_the_records(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(60)), 0) for i in range(300)]
    rows = [(i, "GATTACAG" + s if i < 30 else s + "ACGT" * 100 if i < 33 else s, 0) for i, s, _ in rows]
    strings = similar.distinct_strings(table(spark, rows))
    at = similar.bucket(similar.windows(np.frombuffer(b"GATTACAGACGTACGT", np.uint8) - 64, np.array([0, 8, 16]))[0])
    for n in (1, 7):
        bitmap = similar.common_windows(similar.window_counts(strings.repartition(n)), 300, 0.02)
        assert bitmap[at].tolist() == [True, False]


def test_hot_bands_give_the_same_pairs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate((rng.integers(0, 50, 400), np.full(700, 60), rng.integers(61, 90, 100))))
    ids = np.arange(len(key))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 90]), pa.array(ids[a : a + 90])], names=["band", "id"]) for a in range(0, len(key), 90)]
    out = pa.Table.from_batches(list(similar._pairs(iter(batches)))).to_pylist()
    assert sorted(r["a"] for r in out if r["b"] is None) == ids[key == 60].tolist()
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == {(i, j) for k in np.unique(key) if k != 60 for i in ids[key == k].tolist() for j in ids[key == k].tolist() if i < j}


def test_pack_round_trip():
    import numpy as np

    texts = [b"ACGTA", b"", b"N", b"ACGN", b"TTTT"]
    codes = np.frombuffer(b"".join(texts), np.uint8) - 64
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got, ends = unpack(pack(codes, offsets))
    assert (got == codes).all() and (ends == offsets).all()


def two_letter_rows(rng, n):
    rows = [(2 * i, "".join(rng.choice("AC") for _ in range(60)), 0) for i in range(n)]
    return rows + [(2 * i + 1, s[: i % 50] + s[i % 50 + 1 :], 0) for (_, s, _), i in zip(rows, range(n // 10))]


def test_chance_candidates_of_a_larger_table_stay_few(spark, monkeypatch):
    def everything(num, den):
        def run(batches):
            for b in batches:
                yield b.select([0, 1]).append_column("similarity", b.column(0).cast("double")).rename_columns(["entry_a", "entry_b", "similarity"])

        return run

    rows = two_letter_rows(random.Random(7), 1400)
    want = brute(rows, 0.6)
    monkeypatch.setattr(similar, "WIDER", 500, raising=False)
    monkeypatch.setattr(similar, "STEP", 2, raising=False)
    assert {(r["entry_a"], r["entry_b"]) for r in similar_pairs(table(spark, rows), common=1).collect()} == want and len(want) > 130
    monkeypatch.setattr(similar, "_verify", everything)
    assert similar_pairs(table(spark, rows), common=1).count() < 15_000


def test_wider_bands_keep_the_miss():
    assert similar.widened(310_000, 0.6, 30, 3) == (30, 3)
    for n, width in ((31_000_000, 4), (155_000_000, 5)):
        b, k = similar.widened(n, 0.6, 30, 3)
        assert k == width and (1 - 0.6**k) ** b <= (1 - 0.6**3) ** 30 < (1 - 0.6**k) ** (b - 1)
    assert similar.widened(10**9, 0.05, 30, 3)[1] == 3 and similar.widened(10**9, 1.0, 30, 3)[0] <= 31


@pytest.mark.parametrize("rare", [512, 0])
def test_records_of_long_bands_meet_again(spark, monkeypatch, rare):
    rng = random.Random(8)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(150):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        rows.append((i, "".join(s), 0))
    monkeypatch.setattr(similar, "HOT", 5)
    monkeypatch.setattr(similar, "RARE", rare)
    assert {(r["entry_a"], r["entry_b"]) for r in similar_pairs(table(spark, rows)).collect()} == brute(rows, 0.6)


def test_rarest_windows_of_many_records_are_known_to_meet_too_often():
    import numpy as np

    n = 300_000
    assert similar.rarest_meetings(np.full(65536, n * 133 // 65536), 0.6) > similar.RARE * n
    assert similar.rarest_meetings(np.full(65536, 1000 * 133 // 65536), 0.6) < similar.RARE * 1000


@pytest.mark.parametrize("far", [1, 2**40])
def test_buckets_give_the_pairs_of_all_keys(monkeypatch, far):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similar, "HELD", 300)
    rng = np.random.default_rng(4)
    values = rng.integers(-(2**63), 2**63 - 1, 400)
    key = np.concatenate((rng.choice(values, 3000), np.full(60, values[0]), np.full(60, values[1])))
    ids = rng.permutation(len(key)) * far - 5
    order = rng.permutation(len(key))
    key, ids = key[order], ids[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 70]), pa.array(ids[a : a + 70])], names=["band", "id"]) for a in range(0, len(key), 70)]
    sent = pa.Table.from_batches(list(similar._bucketed(lambda b: b, 5)(iter(batches)))).sort_by("bucket").to_batches(max_chunksize=3)
    out = pa.Table.from_batches(list(similar._meet(20)(iter(sent)))).to_pylist()
    group = {k: ids[key == k].tolist() for k in np.unique(key).tolist()}
    assert sorted(r["a"] for r in out if r["b"] is None) == sorted(i for g in group.values() if len(g) > 20 for i in g)
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == {(i, j) for g in group.values() if len(g) <= 20 for i in g for j in g if i < j}
