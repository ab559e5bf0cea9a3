"""The queries of problems 1 to 3 and 5 to 9, and SQL for those that have any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm import duplicates, frequent, mixing, seen, similar, subjects, terms, tokens


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return similar.similar_pairs(_t(spark, d, "db")).select("entry_a", "entry_b")


def p1_groups(spark, d):
    """Every entry with nucleotides and the smallest entry_id of its group of similar sequences."""
    return similar.similar_groups(_t(spark, d, "db"))


def p2_found(spark, d):
    return duplicates.duplicate_entries(_t(spark, d, "db"))


def p2_records(spark, d):
    return duplicates.collapse(_t(spark, d, "db"))


def p2_flags(spark, d):
    """has_duplicates as it should be, of every entry."""
    return duplicates.true_flags(_t(spark, d, "db"))


def p3_found(spark, d):
    return seen.seen_before(_t(spark, d, "db"), _t(spark, d, "known_sequences"))


def p3_rate(spark, d):
    return seen.wrong_answers(_t(spark, d, "db"), _t(spark, d, "known_sequences"))


def _frequent(spark, d):
    return frequent.frequent_items({"sequence": (_t(spark, d, "db"), "sequence"), "abundance": (_t(spark, d, "amplicon_contingency_table"), "abundance")})


def p5_found(spark, d):
    return _frequent(spark, d).select("field", "item")


def p5_counts(spark, d):
    return _frequent(spark, d).select("field", "item", "n")


def p5_top(spark, d):
    """The ten most frequent values of either field."""
    return frequent.top_items({"sequence": (_t(spark, d, "db"), "sequence"), "abundance": (_t(spark, d, "amplicon_contingency_table"), "abundance")})


def _terms(spark, d):
    return terms.term_counts(_t(spark, d, "amplicon_contingency_table"), ["amplicon", "sample", "abundance"])


def p6_found(spark, d):
    return _terms(spark, d).filter("mark is not null").select("field", "item", "mark")


def p6_counts(spark, d):
    return _terms(spark, d).select("field", "item", F.col("rows").alias("n_rows"), F.col("records").alias("n_records"))


def p7_ids(spark, d):
    return tokens.encode_texts(_t(spark, d, "documents"))


def p7_decoded(spark, d):
    """The texts again, from their ids; a null text comes back empty."""
    return tokens.decode_ids(tokens.encode_texts(_t(spark, d, "documents")))


def p8_selection(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return subjects.document_subjects(_t(spark, d, "documents"), _t(spark, d, "subjects"), _t(spark, d, "subject_labels"))


def p9_composition(spark, d):
    """Documents and their part of the corpus by subject; a document of two subjects counts under both."""
    docs = _t(spark, d, "documents")
    n = docs.count()
    return p9_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents")).withColumn("share", F.col("n_documents") / F.lit(max(n, 1)))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_records, p2_flags, p3_found, p3_rate, p5_found, p5_counts, p5_top, p6_found, p6_counts, p7_ids, p7_decoded, p8_selection, p8_shares, p9_found, p9_composition)}


_NUC = "replace(regexp_replace(upper(sequence), '[^A-Z]', '', 'g'), 'U', 'T')"
_DB = f"n as (select entry_id, loaded_at, {_NUC} as n from db), e as (select * from n where n <> '')"
_SEEN = f"""{_DB}, r as (select *, row_number() over (partition by n order by loaded_at, entry_id) as k from e),
t as (select *, k > 1 or n in (select sequence from known_sequences) as seen from r)"""
_PAIRS = f"""{_DB}, s as (select min(entry_id) as id, n from e group by n),
w as (select distinct id, substr(n, i::int, 8) as w from (select id, n, unnest(range(1, length(n) - 6)) as i from s where length(n) >= 8)),
c as (select id, count(*) as c from w group by id),
x as (select a.id as entry_a, b.id as entry_b, count(*) as k from w a join w b on a.w = b.w and a.id < b.id group by 1, 2),
p as (select entry_a, entry_b from x join c ca on ca.id = entry_a join c cb on cb.id = entry_b where 10 * k >= 6 * (ca.c + cb.c - k))"""
_ITEMS = """u as (select 'amplicon' as field, amplicon as item, row_id from amplicon_contingency_table
 union all select 'sample', sample, row_id from amplicon_contingency_table
 union all select 'abundance', cast(abundance as varchar), row_id from amplicon_contingency_table),
g as (select field, item, count(*) as n_rows, count(distinct row_id) as n_records from u where item is not null group by 1, 2)"""
_SHARES = """u as (select 'sequence' as field, sequence as item from db union all select 'abundance', cast(abundance as varchar) from amplicon_contingency_table),
g as (select field, item, count(*) as n from u where item is not null group by 1, 2),
f as (select field, item, n from g where n > 0.01 * (select sum(n) from g h where h.field = g.field))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_PAIRS} select entry_a, entry_b from p",
        "p1_groups": f"""with recursive {_PAIRS}, l as (select entry_a as a, entry_b as b from p union all select entry_b, entry_a from p),
reach as (select id as root, id as node from s union select root, b from reach join l on a = node), g as (select node, min(root) as group_id from reach group by node)
select e.entry_id, group_id from e join s using (n) join g on g.node = s.id""",
        "p3_rate": f"""with {_SEEN},
z as (select count(*) as entries, count(*) filter (not seen) as new_keys, count(*) filter (seen) as truly_seen from t)
select entries, new_keys, truly_seen as answered_seen, truly_seen, 0 as wrong, 0.0::double as wrong_rate, 1e-6::double as rate_bound from z""",
        "p2_found": f"with {_DB} select md5(n) as sequence_md5, entry_id from e where n in (select n from e group by n having count(*) > 1)",
        "p2_records": f"with {_DB} select md5(n) as sequence_md5, min(entry_id) as entry_id, count(*) as copies from e group by n",
        "p2_flags": f"with {_DB} select entry_id, coalesce(n in (select n from e group by n having count(*) > 1), false) as has_duplicates from n",
        "p3_found": f"with {_SEEN} select entry_id from t where seen",
        "p5_found": f"with {_SHARES} select field, item from f",
        "p5_counts": f"with {_SHARES} select field, item, n from f",
        "p5_top": f"with {_SHARES} select field, item, n, place from (select *, row_number() over (partition by field order by n desc, item desc) as place from g) where place <= 10",
        "p6_found": f"with {_ITEMS} select field, item, case when n_records = 1 then 'rare' else 'common' end as mark from g where n_records = 1 or n_records > 0.05 * (select count(distinct row_id) from amplicon_contingency_table)",
        "p6_counts": f"with {_ITEMS} select field, item, n_rows, n_records from g",
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }


__all__ = ["queries", "oracle_sql"]
