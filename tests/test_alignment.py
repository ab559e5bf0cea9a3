import random

from ampliq.functions.alignment import align, run_length


def model(q, d, costs):
    """Plain full-matrix dynamic programme."""
    mm, o, e = costs
    m, n, big = len(q), len(d), 10**9
    h, ie, fe, dg = ([[big] * (n + 1) for _ in range(m + 1)] for _ in range(4))
    h[0] = [0] + [o + e * j for j in range(1, n + 1)]
    for i in range(1, m + 1):
        h[i][0] = o + e * i
        for j in range(1, n + 1):
            ie[i][j] = min(h[i][j - 1] + o, ie[i][j - 1]) + e
            fe[i][j] = min(h[i - 1][j] + o, fe[i - 1][j]) + e
            dg[i][j] = h[i - 1][j - 1] + (q[i - 1] != d[j - 1]) * mm
            h[i][j] = min(ie[i][j], fe[i][j], dg[i][j])
    i, j, op, ops = m, n, "", ""
    while i and j:
        if not (op == "I" and ie[i][j] < h[i][j] + o) and not (op == "D" and fe[i][j] < h[i][j] + o):
            op = "I" if ie[i][j] == h[i][j] else "D" if fe[i][j] < dg[i][j] else "M"
        i, j, ops = i - (op in "MD"), j - (op in "MI"), ops + op
    ops = (ops + "D" * i + "I" * j)[::-1]
    a = b = same = 0
    for c in ops:
        same += c == "M" and q[a] == d[b]
        a, b = a + (c in "MD"), b + (c in "MI")
    return len(ops) - same, len(ops), run_length(ops.encode())


def test_align_equals_full_matrix():
    rng = random.Random(7)
    q, t = [], []
    for _ in range(400):
        x = [rng.choice("ACGT"[: rng.choice((2, 4))]) for _ in range(rng.randint(1, 20))]
        y = [c for c in x if rng.random() > 0.1] + [rng.choice("ACGT") for _ in range(rng.randint(0, 2))] or ["A"]
        q.append("".join(x))
        t.append("".join(y))
    for costs in ((18, 24, 13), (1, 0, 1)):
        assert [(int(a), int(b), c) for a, b, c in zip(*align(q, t, costs))] == [model(a, b, costs) for a, b in zip(q, t)]


def test_affine_exceeds_edits():
    assert align(["CGGGGTAA"], ["CGGCGGCTAA"])[0][0] == 3


def test_run_length():
    assert run_length(b"") == "" and run_length(b"M") == "M" and run_length(b"MMDII") == "2MD2I"
