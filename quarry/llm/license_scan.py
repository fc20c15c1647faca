"""License scans by canonical digests: whole texts are normalised, hashed, and joined to known licences.

The canonical form is lower-cased, has no copyright lines, single spaces for
whatever is neither letter nor digit, and one spelling of equivalent words; the
digest is its SHA-256. The table of known digests is fixed and small, so it is
broadcast. It knows as whole texts MIT, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause, Unlicense, BSL-1.0 and
Zlib; by the digest of the published text Apache-2.0, Artistic-1.0-Perl, CC0-1.0,
GFDL-1.3, GPL-1.0 to 3.0, LGPL-2.0 to 3.0, MPL-1.1 and 2.0; and 8 notice lines. Other
licences, and copies with other phrases than ``SPELLINGS`` equates (say, another
address of the publisher), have no ``license``. A text that is not a licence as a whole may still hold
lines that are notices; lines with ``licen`` in any case, as every known notice
has, get the same form, and their distinct digests are joined likewise.

Cases: a null text has a null digest and no licence; an empty text, or one of
copyright lines and punctuation alone, has the digest of the empty form, which is
no licence; repeated rows each get their row, ids may be null; a very long text is read whole,
by patterns that look at each character a bounded number of times; of names with the
same digest the first by the alphabet is taken; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.licenses import DIGESTS, NOTICES, SPELLINGS, TEXTS
from quarry.session import limited, stage

#: Copyright lines, lower-cased: the word with a sign, a year, "by" or a place to fill in after it, or a sign that begins a notice.
#: The word alone also begins lines of prose ("copyright holders and contributors").
COPYRIGHT = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|:|by\b|[0-9<\[{])|\(c\)[ \t]*(copyright\b|[0-9])|©|all rights reserved\b)[^\n]*$"
#: In the text as it is: the word and nothing but capitalised names to the line's end.
HOLDER = r"(?m)^[ \t]*Copyright([ \t]+[A-Z][\w.&-]*,?)+[ \t.]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
VARIANT = r"\b(" + "|".join(v for v, _ in SPELLINGS) + r")\b"


def canonical(text: Column) -> Column:
    named = F.when(text.contains("Copyright"), F.regexp_replace(text, F.lit(HOLDER), F.lit(""))).otherwise(text)
    bare = F.regexp_replace(F.lower(named), F.lit(COPYRIGHT), F.lit(""))
    words = F.trim(F.regexp_replace(bare, F.lit(PUNCTUATION), F.lit(" ")))

    def spelled(w: Column) -> Column:
        one = w
        for variant, standard in SPELLINGS:
            one = F.regexp_replace(one, F.lit(rf"\b{variant}\b"), F.lit(standard))
        return F.when(w.rlike(VARIANT), one).otherwise(w)

    # the chain of replacements runs only where there is a variant to replace; the one-element array binds the words once
    return F.get(F.transform(F.array(words), spelled), 0)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """``(license, digest)`` of licence texts, and of ``digests``; each digest once."""
    rows = spark.createDataFrame(texts, "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS + NOTICES, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """``(doc_id, digest, license, notices)``: the licence that a text is, and those its lines name (joined by commas)."""
    spark = docs.sparkSession
    table = known(spark, texts, digests).select(F.col("digest").alias("_digest"), "license")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("(?i)licen"))
    marks = F.when(F.col("text").rlike("(?i)licen"), F.array_distinct(F.transform(lines, digest)))
    # texts become digests once; what follows joins these
    own = stage(docs.select(F.monotonically_increasing_id().alias("_k"), "doc_id", digest(F.col("text")).alias("digest"), marks.alias("_marks")), "digests")
    notice = known(spark, notices).select(F.col("digest").alias("_mark"), F.col("license").alias("_name"))
    held = own.select("_k", F.explode("_marks").alias("_mark")).join(F.broadcast(notice), "_mark")
    named = held.groupBy("_k").agg(F.array_join(F.array_sort(F.collect_set("_name")), ",").alias("notices"))
    out = own.join(F.broadcast(table), F.col("digest") == F.col("_digest"), "left").join(limited(named), "_k", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower(regexp_replace({text}, {_quoted(HOLDER)}, '', 'g')), {_quoted(COPYRIGHT)}, '', 'g'), {_quoted(PUNCTUATION)}, ' ', 'g'))"
    for variant, standard in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{variant}\\b', '{standard}', 'g')"
    return out


def oracle() -> str:
    """The query's result by DuckDB SQL."""
    values = lambda rows: ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in rows)
    return f"""
    with texts(license, text) as (values {values(TEXTS + NOTICES)}),
    lines(license, text) as (values {values(NOTICES)}),
    long(license, digest) as (values {values(DIGESTS)}),
    known as (
      select digest, min(license) as license
      from (select license, sha256({_canonical_sql("text")}) as digest from texts union all select license, digest from long) group by 1),
    notice as (select sha256({_canonical_sql("text")}) as digest, min(license) as license from lines group by 1),
    rows as (select row_number() over () as k, doc_id, text from documents),
    parts as (select k, unnest(string_split(text, chr(10))) as line from rows where regexp_matches(text, '(?i)licen')),
    hits as (
      select p.k, string_agg(distinct n.license, ',' order by n.license) as notices
      from (select k, sha256({_canonical_sql("line")}) as digest from parts where regexp_matches(line, '(?i)licen')) p
      join notice n using (digest) group by p.k
    ),
    own as (select k, doc_id, sha256({_canonical_sql("text")}) as digest from rows)
    select o.doc_id, o.digest, w.license, coalesce(h.notices, '') as notices
    from own o left join known w using (digest) left join hits h using (k)
    """
