from ampliq.sources.rejects import read_entries, valid_entries


def test_reasons(spark):
    cases = [
        (None, "columns"), ("", "columns"), ('"', "quoting"), ('1,a"b,0,A,S', "quoting"), ('"a"b,c', "quoting"), ("1,a_1,0,A", "columns"), ("0,a_1,0,A,S", "lineno"), ("1,;size=2;,0,A,S", "header"),
        ("1,a_,0,A,S", "header"), ("1,a_1,1,A,S", "missingabundance"), ("1,a,2,A,S", "missingabundance"), ("1,a_1,0,AN,S", "sequence"), ('1,a_1,0,"\n",S', "sequence"), ('1,"x ""y"", z_4",1,"ac\nu",S\r', None), ("7,a_1,0,A,S", None), ("7,a_1,0,A,S", None), ("1,a_1,0," + "ACGT" * 5000 + ",S", None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], "line_id bigint, line string, reason string")
    got = {r["line_id"]: r for r in read_entries(df).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {i: w for i, (_, w) in enumerate(cases)}
    assert (got[13]["header"], got[13]["label"], got[13]["sequence"], got[13]["sample"]) == ('x "y", z_4', "x", "ACT", "S")
    assert valid_entries(df).count() == 4 and valid_entries(df.limit(0)).count() == 0
