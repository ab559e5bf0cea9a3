import pytest

from ampliq.plans.options import AmpliconError, Options
from ampliq.plans.run import run
from ampliq.operators.amplicons import amplicons
from ampliq.sources.fasta import read_fasta


def entries(spark, *rows):
    return spark.createDataFrame(rows or [], "header string, sequence string")


def test_records(spark, tmp_path):
    path = tmp_path / "x.fas"
    path.write_bytes(b">a_b_12 note\r\nacg\r\nuT\r\n>c\tx_007\nA\n>empty_1\n")
    assert [tuple(r) for r in read_fasta(spark, str(path)).select("header", "sequence").collect()] == [("a_b_12", "ACGTT"), ("c\tx_007", "A"), ("empty_1", "")]
    (tmp_path / "none.fas").write_text("")
    assert read_fasta(spark, str(tmp_path / "none.fas")).count() == 0
    (tmp_path / "bad.fas").write_text("ACGT\n")
    with pytest.raises(AmpliconError):
        read_fasta(spark, str(tmp_path / "bad.fas"))


@pytest.mark.parametrize(
    "rows, options",
    [
        ([("a_1", "")], {}), ([("a_1", "ACN")], {}), ([("abc_", "A")], {}), ([("a_0", "A")], {}), ([("_5", "A")], {}), ([("a_1", "A"), ("a_2", "C")], {}), ([("a_1", "A"), ("b_2", "A")], {}),
        ([("a", "A")], {}), ([("a;size=0;", "A")], {"usearch": True}), ([("a;size=3;b", "A"), ("a;size=3;c", "C")], {"usearch": True}), ([("a_1", "É")], {}), ([(None, None)], {}),
    ],
)
def test_refused(spark, rows, options):
    with pytest.raises(AmpliconError):
        amplicons(entries(spark, *rows), Options(**options))


def test_order_and_headers(spark):
    got = amplicons(entries(spark, ("b_2", "AC"), ("a_2", "AG"), ("z_9", "u"), ("x", "C"), ("y_123456789012345678901", "G")), Options(default_abundance=4)).orderBy("ord").collect()
    assert [(r["ord"], r["shown"], r["label"], r["sequence"]) for r in got] == [
        (0, "z_9", "z", "T"), (1, "x_4", "x", "C"), (2, "y_123456789012345678901_4", "y_123456789012345678901", "G"), (3, "a_2", "a", "AG"), (4, "b_2", "b", "AC"),
    ]
    u = amplicons(entries(spark, ("a;size=3;b", "A"), ("size=2;c", "C")), Options(usearch=True)).orderBy("ord").collect()
    assert [(r["label"], r["id"], r["abundance"]) for r in u] == [("a;b", "a", 3), ("c", "c", 2)]
    assert [r["header"] for r in run(entries(spark, ("a;size=3;b", "A"), ("size=2;c", "C")), d=0, usearch=True).seeds().orderBy("ord").collect()] == ["a;size=3;b", "size=2;c"]


def test_empty(spark):
    for d in (0, 1, 2):
        r = run(entries(spark), d=d)
        assert r.statistics().count() == 0 and r.member_lists().count() == 0 and r.hits().count() == 0 and r.structure().count() == 0


def test_marks_lines_and_places(spark, tmp_path, monkeypatch):
    import io

    from ampliq.sources.fasta import line_of, read_samples

    (tmp_path / "a.fas").write_text(">>x_1\nAC\nGT\n>>y_2\nA\n")
    (tmp_path / "b.fas").write_text(">z_3\nC\n>z_3 n\nNN\n")
    got = read_fasta(spark, [str(tmp_path / "a.fas"), str(tmp_path / "b.fas")])
    assert sorted(tuple(r) for r in got.select("file_name", "header", "sequence").collect()) == [("a.fas", ">x_1", "ACGT"), ("a.fas", ">y_2", "A"), ("b.fas", "z_3", "C"), ("b.fas", "z_3", "NN")]
    assert line_of(spark, str(tmp_path / "a.fas"), ">y_2")[1] == 4 and line_of(spark, str(tmp_path / "a.fas"), "no") is None
    rows, twice = read_samples(spark, [str(tmp_path / "a.fas"), str(tmp_path / "b.fas"), str(tmp_path / "b.fas")])
    assert twice == ["b"] and {r["sample"] for r in rows.collect()} == {"a", "b"}
    monkeypatch.setattr("sys.stdin", io.StringIO(">>s_1\nac\n>t_2\nG\n"))
    assert [tuple(r) for r in read_fasta(spark, "-").select("header", "sequence").collect()] == [(">s_1", "AC"), ("t_2", "G")]


def test_command_line(spark, tmp_path, capsys):
    from ampliq.__main__ import main

    (tmp_path / "a.fas").write_text(">x_3\nACGT\n>y_1\nACGA\n")
    assert main(["-o", str(tmp_path / "o"), "-l", str(tmp_path / "l"), "-f", str(tmp_path / "a.fas")]) == 0
    assert (tmp_path / "o").read_text() == "x_3 y_1\n" and "Grafts made: 0\n" in (tmp_path / "l").read_text()
    (tmp_path / "b.fas").write_text(">x_3\nAC\n>y_1\nACGN\n")
    assert main([str(tmp_path / "b.fas")]) == 1 and "line 3" in capsys.readouterr().err
    assert main(["-d", "1_0", str(tmp_path / "a.fas")]) == 1


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from ampliq.streaming.dereplicate import dereplicate_folder

    def put(*rows):
        spark.createDataFrame(rows, "sequence string, abundance bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        return sorted(tuple(r) for r in dereplicate_folder(spark, f"{tmp_path}/in", "sequence string, abundance bigint", lambda s: s, 1, f"{tmp_path}/home").collect())

    put(("A", 2), ("C", None), (None, 1))
    assert go() == [("A", 1, 2), ("C", 1, 1)]
    assert go() == [("A", 1, 2), ("C", 1, 1)]
    put(("A", 5), ("G", 1))
    assert go() == [("A", 2, 7), ("C", 1, 1), ("G", 1, 1)]
