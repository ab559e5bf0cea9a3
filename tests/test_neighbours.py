import random

import pytest

from ampliq.operators import neighbours
from ampliq.operators.neighbours import candidates, pairs_between, pairs_of


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s)) if s else 0
        s[at : at + 1] = rng.choice(["A", "C", "G", "T", "", "AC"])
    return "".join(s)


def dense(seed, n=120, size=14):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(3)]
    out = {"A", "AC", "ACG"}
    while len(out) < n:
        out.add(mutated(rng, rng.choice(base), rng.randint(0, 4)) or "T")
    return sorted(out)


@pytest.mark.parametrize("d, hot", [(1, 512), (1, 3), (2, 512), (2, 3), (3, 4)])
def test_every_pair_within_d_edits_is_found(spark, monkeypatch, d, hot):
    monkeypatch.setattr(neighbours.candidates, "__defaults__", (hot,))
    seqs = dense(d)
    df = spark.createDataFrame(list(enumerate(seqs)), "ord bigint, sequence string")
    want = {(a, b) for a in range(len(seqs)) for b in range(a + 1, len(seqs)) if edit(seqs[a], seqs[b]) <= d}
    got = [tuple(r) for r in pairs_of(df, d).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1")
    got = [tuple(r) for r in pairs_between(left, right, d).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {p for a, b in want for p in ((a, b), (b, a)) if p[0] % 2 == 0 and p[1] % 2 == 1}


@pytest.mark.parametrize("d", [1, 2])
def test_a_conserved_start_makes_no_more_than_a_few_candidates_a_row(spark, d):
    rng = random.Random(3)
    start = "".join(rng.choice("ACGT") for _ in range(60))
    for n in (2000, 20000):
        rows = [(i, start + "".join(rng.choices("ACGT", k=90))) for i in range(n)]
        twin = [(n + i, s[:100] + ("A" if s[100] != "A" else "C") + s[101:]) for i, s in rows[:50]]
        df = spark.createDataFrame(rows + twin, "id bigint, s string")
        both = df.selectExpr("explode(array(0, 1)) as side", "id", "s")
        got = {tuple(sorted(r)) for r in candidates(both, d, 0, d).collect()}
        assert {(i, n + i) for i in range(50)} <= got and len(got) < n


def test_no_rows(spark):
    none = spark.createDataFrame([], "ord bigint, sequence string")
    assert pairs_of(none, 2).count() == 0 and pairs_between(none, none, 2).count() == 0


def test_variant_counts_are_those_of_the_variants_made(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    sequences = sorted({"A", "AA", "AC", "AAAA", "ACAC", "AACCA", "T" * 40, *("".join(rng.choice("ACGT"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 30))) for _ in range(60))})
    df = spark.createDataFrame(list(enumerate(sequences)), "ord bigint, sequence string")
    counts = neighbours.variant_counts(F.col("sequence"))
    got = {r["ord"]: tuple(r)[1:] for r in df.select("ord", *[n.alias(k) for k, n in counts.items()]).collect()}
    made: dict = {k: {"substitution": [], "deletion": [], "insertion": []} for k in got}
    for r in neighbours.microvariants(df).collect():
        made[r["ord"]][r["kind"]].append(r["variant"])
    for k, s in enumerate(sequences):
        near = {s[:i] + b + s[i + 1 :] for i in range(len(s)) for b in "ACGT"} | {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + b + s[i:] for i in range(len(s) + 1) for b in "ACGT"}
        kinds = [made[k][x] for x in ("substitution", "deletion", "insertion")]
        assert {v for x in kinds for v in x} == near - {s}
        assert got[k] == (*map(len, kinds), len(near - {s}))


def test_microvariant_counts_shuffle_no_variants(spark, tmp_path):
    from ampliq import queries

    rows = [(1, "acgu-u", 2), (2, "AAAA", None), (3, "ACGTT", 1), (4, None, 1), (5, "", 1)]
    spark.createDataFrame(rows, "entry_id bigint, sequence string, abundance bigint").write.parquet(f"{tmp_path}/db.parquet")
    got = queries.microvariant_counts(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(12, 1, 16, 29), (15, 4, 19, 38)]
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
