import random

import pytest

from ampliq.functions.alignment import align
from ampliq.plans.run import run
from ampliq.sinks.text import write_file


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def walk(seqs, weight, linked, breaking):
    """Sequential seed walk: seqs by ord; returns ord -> (root, generation, parent)."""
    out = {}
    for seed in range(len(seqs)):
        if seed in out:
            continue
        out[seed] = (seed, 0, None)
        level = [seed]
        g = 0
        while level:
            g += 1
            found = []
            for a in sorted(level):
                for b in range(len(seqs)):
                    if b not in out and linked(a, b) and (not breaking or weight[a] >= weight[b]):
                        out[b] = (seed, g, a)
                        found.append(b)
            level = found
    return out


def data(seed, n=60, size=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(4)]
    seen = {}
    while len(seen) < n:
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice(["A", "C", "G", "T", "", "AC"])
        if s and "".join(s):
            seen.setdefault("".join(s), rng.choice([1, 1, 2, 3, 9]))
    rows = sorted(((w, f"x{i}_{w}", s) for i, (s, w) in enumerate(seen.items())), key=lambda r: (-r[0], r[1]))
    return [r[2] for r in rows], [r[0] for r in rows], [(r[1], r[2]) for r in rows]


@pytest.mark.parametrize("d, breaking", [(1, True), (1, False), (2, True)])
def test_equals_sequential_walk(spark, d, breaking):
    seqs, weight, rows = data(d)
    if d == 1:
        linked = lambda a, b: edit(seqs[a], seqs[b]) == 1
    else:
        linked = lambda a, b: a != b and align([seqs[a]], [seqs[b]], cigars=False)[0][0] <= 2
    random.Random(1).shuffle(rows)
    got = run(spark.createDataFrame(rows, "header string, sequence string"), d=d, breaking=breaking).members.collect()
    assert {r["ord"]: (r["root"], r["generation"], r["parent"]) for r in got} == walk(seqs, weight, linked, breaking)


def test_chain_and_outputs(spark, tmp_path):
    """A9-B1-C4: breaking splits the chain; the light cluster's graft is listed after the heavy one's own."""
    rows = [("a_9", "AAAAAAAAAA"), ("b_1", "AAAAAAAAAC"), ("c_4", "AAAAAAAACC"), ("d_1", "AAAAAAGGAA")]
    df = spark.createDataFrame(rows, "header string, sequence string")
    r = run(df, fastidious=True)
    for name, text in {
        "clusters": "a_9 b_1 d_1\nc_4\n", "mothur": "otu_1\t2\ta_9,b_1,d_1\tc_4\n", "structure": "a\tb\t1\t1\t1\na\td\t2\t1\t1\n", "network": None,
        "statistics": "3\t11\ta\t9\t2\t1\t1\n1\t4\tc\t4\t0\t0\t0\n", "seeds": ">a_11\nAAAAAAAAAA\n>c_4\nAAAAAAAACC\n",
        "uclust": "C\t0\t3\t*\t*\t*\t*\t*\ta_9\t*\nS\t0\t10\t*\t*\t*\t*\t*\ta_9\t*\nH\t0\t10\t90.0\t+\t0\t0\t10M\tb_1\ta_9\nH\t0\t10\t80.0\t+\t0\t0\t10M\td_1\ta_9\nC\t1\t1\t*\t*\t*\t*\t*\tc_4\t*\nS\t1\t10\t*\t*\t*\t*\t*\tc_4\t*\n",
    }.items():
        write_file(r, name, str(tmp_path / name))
        assert text is None or (tmp_path / name).read_text() == text, name
    assert {tuple(x) for x in r.network().select("source", "target").collect()} == {("a_9", "b_1"), ("c_4", "b_1")}


def test_components_and_singleton_generation(spark):
    from ampliq.operators.components import connected_components

    pairs = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 49), (7, 7), (99, 99), (None, 3)], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in connected_components(pairs).collect()} == {k: 0 for k in range(31)} | {49: 49, 50: 49, 99: 99}
    assert run(spark.createDataFrame([("a_1", "ACGT")], "header string, sequence string"), d=2).statistics().first()["maxgen"] == 1


def test_a_long_chain_takes_no_disk_for_its_rounds(spark, monkeypatch):
    from ampliq.operators import clustering
    from ampliq.plans import scratch

    live = set()
    new, drop = scratch.new_path, clustering.drop_scratch
    monkeypatch.setattr(scratch, "new_path", lambda s, n: live.add(p := new(s, n)) or p)
    monkeypatch.setattr(clustering, "drop_scratch", lambda s, p: (live.discard(p), drop(s, p)))
    n = 24
    amps = spark.range(n).selectExpr("id as ord")
    links = spark.createDataFrame([(k, k + 1, 1 + k % 2) for k in range(n - 1)] + [(k + 1, k, 2) for k in range(3)], "src bigint, dst bigint, diff int")
    got = {r["ord"]: tuple(r)[1:] for r in clustering.membership(amps, links, True).collect()}
    assert got == {k: (0, k, k - 1 if k else None, sum(1 + j % 2 for j in range(k))) for k in range(n)}
    assert len(live) <= 3
