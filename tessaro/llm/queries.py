"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table, worker_path
from . import decontaminate, html_extract, langid, minhash, packing, pii, quality, secrets, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


# The SQL twins take words as the contracts do.
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op3_substring_dedup"] = f"""
with w as materialized (select doc_id, {_WORDS.format("text")} as w from documents),
win as materialized (select doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) as h from w, unnest(generate_series(1, len(w) - 49)) as t(k) where len(w) >= 50),
first as (select h, min(doc_id) as lo from win group by h),
gone as (select distinct doc_id, k + j as at from win join first using (h), unnest(generate_series(0, 49)) as u(j) where lo < doc_id),
each as (select doc_id, i as at, w[i] as word from w, unnest(generate_series(1, len(w))) as t(i)),
kept as (select e.doc_id, count(*) as n, string_agg(word, ' ' order by e.at) as t from each e anti join gone g on g.doc_id = e.doc_id and g.at = e.at group by e.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id"""

ORACLE_SQL["op6_quality_cascade"] = f"""
with w as materialized (select doc_id, coalesce(text, '') as text, {_WORDS.format("text")} as w from documents),
tri as materialized (select doc_id, k, array_to_string(w[k:k + 2], ' ') as t from w, unnest(generate_series(1, len(w) - 2)) as t(k) where len(w) >= 3),
twice as (select doc_id, t from tri group by all having count(*) > 1),
cover as (select doc_id, count(distinct k + j) as n from tri join twice using (doc_id, t), unnest(generate_series(0, 2)) as u(j) group by doc_id),
line as (select doc_id, l from w, unnest(string_split(text, chr(10))) as t(l) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup from line group by doc_id),
m as (select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup, 0) as bigint) as n_dup_lines,
  cast(coalesce(cover.n, 0) as bigint) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper
  from w left join cover using (doc_id) left join dup using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (100 * n_symbols > 25 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_upper > 50 * word_chars or 100 * n_dup_lines > 50 * n_lines) as kept from b"""

ORACLE_SQL["op9_near_duplicates"] = f"""
with recursive w as materialized (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as materialized (select distinct doc_id, md5(array_to_string(w[k:k + 4], ' ')) as h from w, unnest(generate_series(1, greatest(1, len(w) - 4))) as t(k) where len(w) > 0),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
meet as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select a, b from meet join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) as (select a, b from links union select r.a, links.b from r join links on r.b = links.a),
c as (select a, min(b) as lo from r group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(lo, d.doc_id)) as component_id, d.doc_id <= coalesce(lo, d.doc_id) as kept
from documents d left join n using (doc_id) left join c on c.a = d.doc_id"""


def query(name: str):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            worker_path(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        return run

    return put


@query("op2_pack_sequences")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with five-word shingle similarity of 0.75 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a document with a smaller id has too are removed."""
    return substrings.drop_repeats(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, judged by how many sources share them."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("found", "digest")


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op6_quality_cascade")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and cascade verdict of all documents."""
    return quality.assess(table(spark, sf_dir, "documents")).drop("rejected_by")


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names or units."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return langid.identify(table(spark, sf_dir, "documents")).drop("has_letters")


@query("op7_html_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))
