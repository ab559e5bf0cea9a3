from collections import Counter

from ampliq.llm.frequent import frequent_items, top_items
from ampliq.llm.mixing import mix
from ampliq.llm.subjects import clean, document_subjects, sentences
from ampliq.llm.terms import term_counts
from ampliq.llm.tokens import VOCABULARY, decode_ids, encode_texts, encoding


def test_frequent(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("",)] * 30 + [(None,)] * 40 + [(f"x{i}",) for i in range(920)] + [("y" * 20000,)] * 11, "v string")
    got = {(r["field"], r["item"][:3], r["n"]) for r in frequent_items({"f": (df, "v"), "g": (df.limit(0), "v")}).collect()}
    assert got == {("f", "a", 50), ("f", "", 30), ("f", "yyy", 11)}


def test_terms(spark):
    rows = [(i % 400, "hot" if i % 3 else f"v{i % 40}", None if i % 7 == 0 else "s", i % 5) for i in range(900)] + [(None, "n", "s", 1), (1000, "", "s", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "row_id bigint, a string, item string, field int, _id string, _n int")
    got = {(r["field"], r["item"]): (r["rows"], r["records"], r["mark"]) for r in term_counts(df, ["a", "item", "field"]).collect()}
    want = {}
    every = {r[0] for r in rows if r[0] is not None}
    for name, k in (("a", 1), ("item", 2), ("field", 3)):
        for v in {r[k] for r in rows if r[k] is not None}:
            ids = {r[0] for r in rows if r[k] == v and r[0] is not None}
            want[name, str(v)] = (sum(r[k] == v for r in rows), len(ids), "rare" if len(ids) == 1 else "common" if len(ids) > 0.05 * len(every) else None)
    assert got == want
    assert term_counts(df.limit(0), ["a"]).count() == 0


def test_runs_go_on_from_batch_to_batch(spark):
    """Tiny Arrow batches: every run, record and text is cut into several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 23 if i % 11 else None, f"v{i % 3}" if i % 2 else f"w{i % 40}", None if i % 5 == 0 else "s" * (1 + i % 2)) for i in range(400)]
        df = spark.createDataFrame(rows, "row_id bigint, a string, b string").repartition(3)
        got = {(r["field"], r["item"]): (r["rows"], r["records"]) for r in term_counts(df, ["a", "b"]).collect()}
        want = {}
        for name, k in (("a", 1), ("b", 2)):
            for v in {r[k] for r in rows if r[k] is not None}:
                want[name, v] = (sum(r[k] == v for r in rows), len({r[0] for r in rows if r[k] == v and r[0] is not None}))
        assert got == want
        count = Counter(r[1] for r in rows)
        best = sorted(((n, v) for v, n in count.items()), reverse=True)[:4]
        assert [(r["n"], r["item"], r["place"]) for r in top_items({"a": (df, "a")}, 4).orderBy("place").collect()] == [(n, v, k + 1) for k, (n, v) in enumerate(best)]
        assert {r["item"]: r["n"] for r in frequent_items({"a": (df, "a")}, 0.05).collect()} == {v: n for v, n in count.items() if n > 20}
        texts = [(k, " ".join(f"word{(k * j) % 97}" for j in range(k % 60))) for k in range(60)]
        one = encoding(VOCABULARY).encode_ordinary
        assert {r["doc_id"]: r["ids"] for r in encode_texts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()} == {k: one(x) for k, x in texts}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


TEXTS = [(1, "Hello  world's <|endoftext|>\n\n x"), (2, None), (3, ""), (4, "naïve ​日本語 12345"), (5, "a" * 3000 + " b" * 2000), (6, "same"), (6, "same"), (6, "other"), (None, "n")]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id bigint, text string, word string, doc int")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in encode_texts(df).collect())
    assert got == Counter((i, tuple(encoding(VOCABULARY).encode_ordinary(t or ""))) for i, t in TEXTS)
    once = df.filter("doc_id < 6")
    assert {r["doc_id"]: r["text"] for r in decode_ids(encode_texts(once)).collect()} == {i: t or "" for i, t in TEXTS if i and i < 6}
    assert encode_texts(df.limit(0)).count() == 0


def test_mix(spark):
    docs = [(i, "word " * (i % 9 + 1), "big") for i in range(600)] + [(1000 + i, "some text", "small") for i in range(20)] + [(2000, None, "big"), (2001, "x", None), (2002, "x", "unlisted")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mix(df, goal)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["none"]["selected_tokens"] == 0 and abs(rows["big"]["actual_share"] - 7 / 9) < 0.02 and abs(rows["small"]["actual_share"] - 2 / 9) < 0.02
    assert all(r["copies"] == 3 for r in selection.filter("source = 'small'").collect())
    smaller = {r["doc_id"] for r in mix(df, goal, budget=100)[0].filter("source = 'big'").collect()}
    assert smaller <= {r["doc_id"] for r in selection.collect()} and smaller
    assert mix(df.limit(0), goal)[0].count() == 0 and mix(df, goal.limit(0))[0].count() == 0


def test_sentences():
    parts, mentions = sentences('The ship was called "Code Lungs". The keys reveal the chords&#46; "The bonds hide the loans," says page 5.')
    assert mentions == ["code", "lungs"] and ["the", "keys", "reveal", "the", "chords"] in parts and any("bonds" in p for p in parts)
    assert clean("d&eacute;j­à") == "déjà" and clean("lÃ ") == "là"


def test_subjects_on_held_out_documents(spark):
    words = {"music": ["violins", "chords", "choirs", "drums"], "sport": ["goals", "medals", "rackets", "leagues"]}
    plain = ["lamps", "boxes", "roads"]
    docs, labels, truth = [], [], {}
    for i in range(600):
        said = [s for k, s in enumerate(words) if i >> k & 1]
        nouns = [words[s][(i + j) % 4] for j, s in enumerate(said)] + [plain[i % 3]]
        docs.append((i, f"The {nouns[0]} change the {nouns[-1]}. The {nouns[-1]} hide the {nouns[0] if len(nouns) < 3 else nouns[1]}.", "a"))
        truth[i] = set(said)
        if i < 400:
            labels += [(i, s, "r") for s in said] or [(i, None, "r")]
    docs += [(900, None, "a"), (901, " \n", None), (902, "", "a")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    s = spark.createDataFrame([("music", ""), ("sport", "")], "subject string, description string")
    y = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string")
    got = {}
    for r in document_subjects(d, s, y).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert not set(got) & {900, 901, 902}
    assert sum(got.get(i, set()) == truth[i] for i in range(400, 600)) >= 190
    assert document_subjects(d, s, y.limit(0)).count() == 0 and document_subjects(d.limit(0), s, y).count() == 0


def test_subjects_are_never_cut_off(spark):
    import pytest

    from ampliq.llm import subjects

    docs = spark.createDataFrame([(i, "the cat sleeps" if i % 2 else "stocks fell today", "web") for i in range(60)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "zoo" if i % 2 else "money") for i in range(60)], "doc_id bigint, subject string")
    listed = spark.createDataFrame([(None,)] * 500 + [("",)] * 300 + [("money",)] * 700 + [("zoo",)], "subject string").coalesce(1)
    assert {r["doc_id"] for r in subjects.document_subjects(docs, listed, labels).filter("subject = 'zoo'").collect()} >= set(range(1, 60, 2))
    many = spark.range(subjects.MAX_SUBJECTS + 1).selectExpr("concat('s', id) as subject")
    with pytest.raises(ValueError):
        subjects.document_subjects(docs, many, labels)
