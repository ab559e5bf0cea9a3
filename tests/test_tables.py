import pytest

from ampliq import queries
from ampliq.operators.contingency import contingency, observations, repeated_samples
from ampliq.operators.graph import nodes_and_edges
from ampliq.plans.options import AmpliconError


def test_contingency(spark):
    rows = spark.createDataFrame([("a;size=2;", "s1"), ("b;size=3", "s2"), ("a;size=1;", "s2"), ("b;size=1", "s2")], "header string, sample string")
    got = contingency(observations(rows)).orderBy("ord").collect()
    assert [(r["amplicon"], r["s1"], r["s2"], r["total"]) for r in got] == [("b", 0, 4, 4), ("a", 2, 1, 3)]
    with pytest.raises(AmpliconError):
        observations(spark.createDataFrame([("a_3", "s")], "header string, sample string"))
    assert repeated_samples(spark.createDataFrame([("s",), ("s",), (None,), (None,)], "sample string")).collect() == [("s", 2)]


def test_pivot_has_every_spelling_of_a_sample(spark, tmp_path):
    rows = [(1, "a", "S01", 5), (1, "a", "S01", 5), (2, "a", "s13.1", 2), (3, "b", "S28 1", 9), (4, "b", "blank38", None), (5, None, "S02", 4), (6, "c", None, 4)]
    spark.createDataFrame(rows, "row_id bigint, amplicon string, sample string, abundance bigint").write.parquet(f"{tmp_path}/amplicon_contingency_table.parquet")
    got = queries.contingency_pivot(spark, str(tmp_path)).orderBy("ord")
    assert got.columns == ["ord", "amplicon", "S01", "S28 1", "blank38", "s13.1", "total"]
    assert [tuple(r) for r in got.collect()] == [(0, "b", 0, 9, 0, 0, 9), (1, "a", 5, 0, 0, 2, 7)]


def test_graph(spark):
    members = spark.createDataFrame([("a", 20), ("b", 4), ("c", 1), ("z", 9)], "amplicon string, abundance bigint")
    structure = spark.createDataFrame([("a", "b", 1, 1, 1), ("b", "c", 1, 1, 2)], "parent string, child string, diffs int, cluster_no int, steps int")
    nodes, edges = nodes_and_edges(members, structure, 1, 1)
    assert {(r["amplicon"], r["size"], r["label"]) for r in nodes.collect()} == {("a", 100.0, "20"), ("b", 44.0, "")}
    assert edges.collect() == [("a", "b")]


def test_contingency_is_ordered_before_it_is_wide(spark, monkeypatch):
    from ampliq.operators import contingency as module

    seen, order = [], module.dense_order
    monkeypatch.setattr(module, "dense_order", lambda df, *by, **k: seen.append(len(df.columns)) or order(df, *by, **k))
    monkeypatch.setattr(module, "CELLS", 500, raising=False)
    rows = [(f"a{i}", f"s{(i * 7 + j) % 60:02d}", i * j) for i in range(50) for j in range(i % 9)] + [("none", "s00", None), ("all", "s1.x", 5), ("all", "s59", 6), ("all", "s59", 7), (None, "s00", 8), ("all", None, 9)]
    got = contingency(spark.createDataFrame(rows, "amplicon string, sample string, abundance bigint"))
    assert max(seen) < 5  # as many columns as samples were sorted and shuffled before
    want: dict = {}
    for a, s, n in rows:
        if a and s:
            want.setdefault(a, {})[s] = want.get(a, {}).get(s, 0) + (n or 0)
    names = sorted({s for a, s, _ in rows if a and s})
    assert got.columns == ["ord", "amplicon", *names, "total"]
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [
        (k, a, *[cells.get(s, 0) for s in names], sum(cells.values())) for k, (a, cells) in enumerate(sorted(want.items(), key=lambda x: (sum(x[1].values()), x[0]), reverse=True))
    ]
    assert contingency(spark.createDataFrame([], "amplicon string, sample string, abundance bigint")).collect() == []
    some = contingency(spark.createDataFrame(rows, "amplicon string, sample string, abundance bigint"), samples=["s59", "other"])
    assert some.columns == ["ord", "amplicon", "s59", "other", "total"] and some.first()["total"] == max(sum(c.values()) for c in want.values())
    assert some.filter("amplicon = 'all'").select("s59", "other", "total").first() == (13, 0, 18)


def test_contingency_file_is_small_and_keeps_names(spark, tmp_path, monkeypatch):
    rows = [(1000 * i + j, f"a{i}", f"s{(i * 7 + j) % 300:03d}", i + j) for i in range(300) for j in range(i % 4)] + [(-1, " spaced ", "S26 1", 5), (-2, " spaced ", "S26 1", None), (-3, "q\"\\u", "s24.25", -2), (-4, None, "s000", 1)]
    spark.createDataFrame(rows, "row_id bigint, amplicon string, sample string, abundance bigint").write.parquet(f"{tmp_path}/amplicon_contingency_table.parquet")
    monkeypatch.setattr(queries, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    got = queries.contingency_file(spark, str(tmp_path))
    want = queries.contingency_pivot(spark, str(tmp_path)).orderBy("ord").drop("ord")
    assert got.columns == want.columns and {t for _, t in got.dtypes} == {"string"}
    assert sorted(map(tuple, got.collect())) == sorted(tuple(map(str, r)) for r in want.collect())
    files = sorted((tmp_path / "contingency").glob("part-*"))
    assert sum(f.stat().st_size for f in files) < 60_000  # 135,000 as plain text
    lines = [r["value"] for f in files for r in spark.read.text(str(f)).collect()]
    head = "\t".join(want.columns)
    assert lines.count(head) == len(files) and [x for x in lines if x != head] == ["\t".join(map(str, r)) for r in want.collect()]


def test_contingency_file_with_tabs_in_names(spark, tmp_path):
    rows = [(1, "a\tb", "s\t1", 5), (2, "c", "s2", 3)]
    spark.createDataFrame(rows, "row_id bigint, amplicon string, sample string, abundance bigint").write.parquet(f"{tmp_path}/amplicon_contingency_table.parquet")
    got = queries.contingency_file(spark, str(tmp_path))
    assert got.columns == ["amplicon", "s\t1", "s2", "total"] and sorted(map(tuple, got.collect())) == [("a\tb", "5", "0", "5"), ("c", "0", "3", "3")]


def test_contingency_file_without_rows_has_a_head(spark, tmp_path):
    spark.createDataFrame([(1, None, "s", 1)], "row_id bigint, amplicon string, sample string, abundance bigint").write.parquet(f"{tmp_path}/amplicon_contingency_table.parquet")
    got = queries.contingency_file(spark, str(tmp_path))
    assert got.columns == ["amplicon", "total"] and got.collect() == []
