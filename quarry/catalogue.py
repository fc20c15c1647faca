"""The catalogue: a query for each operator over the shared tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.embed import HashingEmbedder, KeywordEmbedder, embed_chunks
from quarry.functions import text as T
from quarry.operators import catalog, metrics, search
from quarry.operators.chunking import chunk_documents, pack_table, packed_counts, word_windows
from quarry.plans import chat
from quarry.session import limited, small_batches, spread, stage
from quarry.sources import files, html
from quarry.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What most text queries use of ``documents``, over all cores; columns are picked first, for a shuffle keeps all that it gets."""
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^[{T.SPACE}]+|[{T.SPACE}]+\\z')}, '', 'g')"


def _fields(x: str) -> str:
    return f"regexp_extract_all({x}, {_q(T.FIELD)})"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(T.TOKEN)}))"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'[{T.GAP}]+')}, ' ', 'g')"


def _any(x: str, marks: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {_q(m)})" for m in marks) + ")"


def _kept(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda p: {_trim('p')}), lambda p: p <> '')"


def _cut(x: str, most: int) -> str:
    tries = ", ".join(f"try(decode(encode({x})[1:{most - k}]))" for k in range(4))
    return f"case when strlen({x}) <= {most} then {x} else coalesce({tries}) end"


# vectors

_CHUNKS = "select vec_id as chunk_id, vec_id // 10 as document_id, embedding::double[] as v from embeddings"
_TOP = f"""select document_id, chunk_id, list_cosine_similarity(v, (select embedding::double[] from embeddings where vec_id = 0)) as s
    from ({_CHUNKS}) order by s desc, chunk_id limit 10"""
_BEST = f"select document_id, chunk_id, s from ({_TOP}) qualify row_number() over (partition by document_id order by s desc, chunk_id) = 1"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 10").alias("document_id"), "embedding")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"select document_id, chunk_id, round(s, 6) as score from ({_TOP})")
def vector_topk_chunks(spark, sf_dir):
    top = search.top_chunks(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10)
    return top.select("document_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"select document_id, chunk_id, round(s, 6) as score from ({_BEST})")
def vector_search_documents(spark, sf_dir):
    found = search.search_vectors(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10)
    return found.select("document_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""select document_id, chunk_id, round(s, 6) as score from (
    select document_id, chunk_id, list_cosine_similarity(v, (select embedding::double[] from embeddings where vec_id = 0)) as s from ({_CHUNKS}))
    qualify row_number() over (partition by document_id order by s desc, chunk_id) = 1 order by s desc, document_id limit 10"""
)
def vector_search_dedup_first(spark, sf_dir):
    found = search.search_vectors(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10, dedup_first=True)
    return found.select("document_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""with c as ({_CHUNKS}), q as (select chunk_id as query_id, v as qv from c where chunk_id % 50 = 0),
    s as (select query_id, document_id, chunk_id, list_cosine_similarity(v, qv) as s from c, q),
    t as (select * from s qualify row_number() over (partition by query_id order by s desc, chunk_id) <= 10),
    d as (select * from t qualify row_number() over (partition by query_id, document_id order by s desc, chunk_id) = 1)
    select query_id, document_id, chunk_id, round(s, 6) as score,
      row_number() over (partition by query_id order by s desc, document_id)::int as rank from d"""
)
def batch_vector_search(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return search.search_batch(vectors, asked, 10).withColumn("score", F.round("score", 6))


# keywords and hybrids

_PHRASE = "Services of the erth and that"
_TERMS = _fields(f"lower({_q(_PHRASE)})")
_SCORE = f"""(len(list_filter({_TERMS}, lambda w: contains(lower(text), w))) / len({_TERMS})
    + case when contains(lower(text), array_to_string({_TERMS}, ' ')) then 0.3 else 0.0 end)"""
_WORD_HITS = f"select doc_id as document_id, {_SCORE} as s from documents where {_SCORE} > 0.1 order by s desc, document_id limit 10"


@query(f"select doc_id, round({_SCORE}, 6) as score from documents")
def keyword_score(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", F.round(T.keyword_score(F.col("text"), F.lit(_PHRASE)), 6).alias("score"))


@query(f"select document_id, round(s, 6) as score from ({_WORD_HITS})")
def keyword_search(spark, sf_dir):
    return search.keyword_search(_texts(spark, sf_dir), _PHRASE, 10).withColumn("score", F.round("score", 6))


@query(
    f"""with a as ({_BEST}), b as ({_WORD_HITS}),
    m as (select document_id, s, 0 as k from a union all select document_id, s, 1 from b where document_id not in (select document_id from a))
    select document_id, round(s, 6) as score, row_number() over (order by k, s desc, document_id)::int as rank, k = 1 as fallback_search from m"""
)
def hybrid_search(spark, sf_dir):
    found = search.hybrid_search(_vectors(spark, sf_dir), _texts(spark, sf_dir), _PHRASE, _first_vector(spark, sf_dir), 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""select conv_id, turn, list_bool_or(list_transform({_fields("text")}, lambda w:
      lower(w) in ({", ".join(map(_q, T.TRADE_WORDS))}) or regexp_matches(lower(w), {_q(T.PHONE)})
      or (strlen(w) > 1 and regexp_matches(w, '^[^a-z\\x{{80}}-\\x{{10FFFF}}]') and lower(substr(w, 2)) = substr(w, 2)))) is true as needs_keywords
    from conversations where role = 'user'"""
)
def needs_fallback(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.coalesce(T.needs_keywords(F.col("text")), F.lit(False)).alias("needs_keywords"))


# text functions

_MARKS = " + ".join(f"contains(text, {_q(m)})::int" for m in T.STRUCTURE_MARKS)
_KIND = f"""case when {_any("text", T.CODE_MARKS)} then 'code' when {_MARKS} > 2 then 'structured'
    when (strlen(text) - strlen(replace(text, chr(10) || chr(10), ''))) // 2 > strlen(text) // 500 then 'prose' else 'text' end"""


@query(
    f"""select doc_id, {_tokens("text")} as tokens, {_tokens("text")} > 256 as is_long, strlen(text) as n_bytes, {_KIND} as content_type,
    sha256(text) as content_hash, floor((strlen(text) // 4) * 1.1)::int as model_tokens from documents"""
)
def text_profile(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select(
        "doc_id",
        T.token_count(t).alias("tokens"),
        T.is_long(t, 256).alias("is_long"),
        F.octet_length(t).alias("n_bytes"),
        T.content_type(t).alias("content_type"),
        T.content_hash(t).alias("content_hash"),
        T.token_estimate(t).alias("model_tokens"),
    )


@query(f"select page_id, {_KIND.replace('text', 'html').replace(chr(39) + 'html' + chr(39), chr(39) + 'text' + chr(39))} as content_type from pages")
def content_type_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.content_type(F.col("html")).alias("content_type"))


def _paragraphs(t: str) -> str:
    k = _kept(f"string_split({t}, chr(10) || chr(10))")
    return f"list_transform({k}, lambda x, i: case when i < len({k}) and ends_with(x, '.') then {_trim('left(x, length(x) - 1)')} else x end)"


def _sentences(t: str) -> str:
    marks, parts = f"regexp_extract_all({t}, {_q(T.SENTENCE_END)})", f"string_split_regex({t}, {_q(T.SENTENCE_END)})"
    each = f"list_transform({parts}[1:len({marks})], lambda x, i: {_trim(f'case when i = len({marks}) then x || {marks}[i] else x end')})"
    return f"list_filter(case when len({marks}) = 0 then [{_trim(t)}] else {each} end, lambda x: x <> '')"


def _blocks(t: str) -> str:
    return f"list_filter({_kept(f'string_split_regex({t}, {_q(T.CODE_BREAK)})')}, lambda x: strlen(x) > {T.LEAST_BLOCK_BYTES})"


def _wide(t: str) -> str:
    k = _kept(f"string_split_regex({t}, {_q(T.WIDE_GAP)})")
    return f"case when len({k}) > 1 then {k} else [{_trim(t)}] end"


_UNITS = {"paragraphs": _paragraphs, "sentences": _sentences, "code_blocks": _blocks, "wide_parts": _wide}
_SPLIT_SQL = """select doc_id, len(u) as n_units, md5(array_to_string(u, '|')) as units_md5 from (select doc_id, {} as u from documents)"""


def _split_query(name: str, function, sql: str) -> None:
    def run(spark, sf_dir):
        units = _texts(spark, sf_dir).select("doc_id", function(F.col("text")).alias("u"))
        return units.select("doc_id", F.size("u").alias("n_units"), F.md5(F.array_join("u", "|").cast("binary")).alias("units_md5"))

    run.__name__ = f"split_{name}"
    query(_SPLIT_SQL.format(sql))(run)


for _name, _sql in _UNITS.items():
    _split_query(_name, getattr(T, _name), _sql("text"))
_CASCADE = f"""case when len({_paragraphs("text")}) > 1 then {_paragraphs("text")} when len({_sentences("text")}) > 1 then {_sentences("text")}
    when len({_blocks("text")}) > 1 then {_blocks("text")} else {_wide("text")} end"""
_split_query("sentence_units", T.sentence_units, _CASCADE)


@query(
    f"""with w as (select doc_id, {_fields("text")} as w from documents),
    p as (select doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 256) / 218.0)::int))) as i from w where len(w) > 0)
    select doc_id, i::int as "window", len(w[i * 218 + 1 : i * 218 + 256]) as token_count, sha256(array_to_string(w[i * 218 + 1 : i * 218 + 256], ' ')) as text_sha256 from p"""
)
def word_windows_documents(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.inline_outer(word_windows(F.col("text")))).where("window is not null")
    return rows.select("doc_id", "window", "token_count", F.sha2("window_text", 256).alias("text_sha256"))


@query(
    f"""with u as (select doc_id, list_transform({_CASCADE}, lambda x: {_tokens("x")}) as n from documents where text <> ''),
    s as (select doc_id, n, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])) as upto from u),
    o as (select doc_id, list_transform(n, lambda x, i: {{'n': x::bigint, 'ov': (case when i = 1 then 0 else upto[i - 1]
        - coalesce(list_min(list_filter(list_prepend(0, upto[1:i - 1]), lambda y: upto[i - 1] - y <= 38)), upto[i - 1]) end)::bigint,
        'cur': 0::bigint, 'done': []::bigint[]}}) as p from s),
    f as (select doc_id, list_reduce(p, lambda a, x: case when a.cur = 0 or a.cur + x.n <= 256
        then {{'n': x.n, 'ov': x.ov, 'cur': a.cur + x.n, 'done': a.done}}
        else {{'n': x.n, 'ov': x.ov, 'cur': x.ov + x.n, 'done': list_append(a.done, a.cur)}} end,
        {{'n': 0::bigint, 'ov': 0::bigint, 'cur': 0::bigint, 'done': []::bigint[]}}) as r from o)
    select doc_id, len(list_append(r.done, r.cur)) as n_chunks, array_to_string(list_append(r.done, r.cur), ',') as token_counts from f"""
)
def packed_chunk_counts(spark, sf_dir):
    rows = _texts(spark, sf_dir).where("text <> ''").select("doc_id", packed_counts(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n_chunks"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("token_counts"))


@query()
def chunk_all_documents(spark, sf_dir):
    """Held against a plain chunker in tests; whole texts through the Arrow pass."""
    return chunk_documents(_texts(spark, sf_dir))


@query("select doc_id, case when i = 0 then doc_id::varchar else doc_id::varchar || '_chunk_' || i::varchar end as chunk_id from documents, range(0, 3) r(i)")
def chunk_ids(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return rows.select("doc_id", T.chunk_id(F.col("doc_id"), F.col("i")).alias("chunk_id"))


_RUN = f"{T.TOKEN}(?:[{T.GAP}]+{T.TOKEN})*"


def _extract(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, {_q(pattern)}, 1)"


def _enhanced(t: str) -> str:
    plain = t
    for pattern, by in ((r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (f"#{{1,6}}[{T.GAP}]*", ""), (f"\\t\\+[{T.GAP}]*", " "), (f"\\A[{T.GAP}]*[+\\-*][{T.GAP}]*", " ")):
        plain = f"regexp_replace({plain}, {_q(pattern)}, {_q(by)}, 'g')"
    firms = _extract(t, f"\\*\\*([^*]+)\\*\\*[{T.GAP}]*[^\\n]*(?:Phone|Email|Services):")
    services = f"flatten(list_transform({_extract(t, f'(?i)services?:[{T.GAP}]*([^\\n]+)')}, lambda x: {_kept('string_split(x, chr(44))')}))"
    phones = f"list_transform({_extract(t, f'(?i)phone:[{T.GAP}]*({_RUN})')}, lambda x: 'phone ' || x)"
    emails = f"list_transform({_extract(t, f'(?i)email:[{T.GAP}]*({_RUN})')}, lambda x: 'email ' || x)"
    terms = f"list_concat(list_concat({phones}, {emails}), list_concat({firms}, {services}))"
    marked = _any(t, ["###", "**", "+ ", "\t+", "Phone:", "Email:"])
    return f"case when {marked} then case when len({terms}) > 0 then array_to_string({terms}, ' ') || ' ' else '' end || {plain} else {t} end"


_TIDY = f"select doc_id, {_trim(_collapse('e'))} as t from (select doc_id, {_enhanced('text')} as e from documents)"


@query(
    f"""with c as (select doc_id, t, {_cut("t", 8192)} as s from ({_TIDY})), b as (select *, regexp_replace(s, ' [^ ]*\\z', '') as back from c)
    select doc_id, sha256(case when strlen(t) <= 8192 then t when contains(s, ' ') and strlen(back) > 4096 then back else s end) as processed_sha256 from b"""
)
def preprocess_text(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", T.preprocess(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("processed_sha256"))


@query(
    f"""with q as (select conv_id, turn, {_collapse(_trim("text"))} as q from conversations where role = 'user')
    select conv_id, turn, case when not contains(q, '?') and len({_fields("q")}) < 10 then q || ' ' || q
      || case when regexp_matches(q, {_q(T.TRADE_QUERY)}) then ' business company service provider ' || q else '' end
      || case when regexp_matches(q, {_q(T.PHONE)}) then ' phone contact number ' || q else '' end
      || case when regexp_matches(q, {_q(T.NAME_QUERY)}) then ' person owner operator name ' || q else '' end
      else q end as processed from q"""
)
def preprocess_query(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", T.preprocess_query(F.col("text")).alias("processed"))


@query(f"select doc_id, {_cut('text', 200)} || case when strlen(text) > 200 then '...' else '' end as short from documents")
def truncate_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 200).alias("short"))


@query("select sha256(text) as content_hash, min(doc_id) as id, count(*) as copies from documents group by 1")
def exact_duplicates(spark, sf_dir):
    return catalog.drop_exact_duplicates(_texts(spark, sf_dir))


def _occurrences(t: str, mark: str) -> str:
    return f"((strlen({t}) - strlen(replace({t}, {_q(mark)}, ''))) // {len(mark.encode())})"


_HEADER = f"""(strlen(x) >= 3 and (starts_with(x, '#') or (len({_fields("x")}) between 1 and 8 and contains({_fields("x")}[1], '.') and strlen({_fields("x")}[1]) < 6)
    or (len({_fields("x")}) = 1 and upper(x) = x and strlen(x) < 50)))"""


@query(
    f"""with c as (select doc_id, text, {_kept("string_split(text, chr(10))")} as l from documents)
    select doc_id, md5(array_to_string(l, chr(10))) as cleaned_md5,
      case when {" + ".join(_occurrences("lower(text)", m) for m in T.WORD_CODE_MARKS)} > 3 then 'code'
        when {" + ".join(_occurrences("text", m) for m in T.WORD_STRUCTURE_MARKS)} > 3 then 'structured' else 'prose' end as content_type,
      len(list_filter(l, lambda x: {_HEADER})) as n_headers from c"""
)
def word_processor_text(spark, sf_dir):
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: T.trim(x) != "")
    return _texts(spark, sf_dir).select(
        "doc_id",
        F.md5(T.clean_lines(t).cast("binary")).alias("cleaned_md5"),
        T.word_content_type(t).alias("content_type"),
        F.size(F.filter(lines, T.is_header)).alias("n_headers"),
    )


@query(
    f"""with a as (select doc_id, regexp_replace(text, '[\\x{{200B}}-\\x{{200F}}\\x{{2028}}-\\x{{202F}}\\x{{205F}}-\\x{{206F}}\\x{{FEFF}}]+', '', 'g') as t from documents),
    b as (select doc_id, regexp_replace(t, {_q(f"\\b([a-zA-Z])[{T.GAP}]([a-zA-Z])[{T.GAP}]([a-zA-Z])[{T.GAP}]([a-zA-Z]+)\\b")}, '\\1\\2\\3\\4', 'g') as t from a),
    c as (select doc_id, {_trim(f"regexp_replace(t, {_q(f'[^{T.SPACE}\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}}]+')}, '', 'g')")} as t from b)
    select doc_id, md5(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g')) as cleaned_md5 from c"""
)
def clean_layout_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.clean_layout(F.col("text")).cast("binary")).alias("cleaned_md5"))


@query()
def clean_page_text(spark, sf_dir):
    """SQL's patterns cannot look behind; golden cases are in tests."""
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.clean_page(F.col("text")).cast("binary")).alias("cleaned_md5"))


@query(
    f"""with w as (select doc_id, text, {_fields("text")} as w from documents)
    select doc_id, len(regexp_extract_all(text, '\\b[a-zA-Z] [a-zA-Z] [a-zA-Z]\\b')) > length(text) * 0.05 as spaced_letters,
      len(list_filter(w, lambda x: regexp_matches(x, '^[a-zA-Z]\\z'))) > len(w) * 0.1 as single_letters,
      len(list_filter(w, lambda x: regexp_matches(x, '[a-z][A-Z]') and length(x) > 15)) > 5 as joined_words,
      len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) > 10 as control_characters from w"""
)
def extraction_artifacts(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.artifacts(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("select doc_id, [doc_id::varchar, 'x-' || doc_id::varchar] as cited from documents")
def citations(spark, sf_dir):
    reply = F.format_string("As in [%d] and [x-%d], not [in a b] but [%d].", "doc_id", "doc_id", "doc_id")
    return _texts(spark, sf_dir).select("doc_id", T.citations(reply).alias("cited"))


@query(
    """with m as (select doc_id, regexp_extract_all('[x-1] ' || text || ' [x-1]', '\\[([a-zA-Z0-9_-]+)\\]', 1) as m from documents)
    select doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) as cited from m"""
)
def citations_in_texts(spark, sf_dir):
    """Over whole texts, each between two marks, so that there is one to find and one to leave out in every row."""
    marked = F.concat(F.lit("[x-1] "), "text", F.lit(" [x-1]"))
    return _texts(spark, sf_dir).select("doc_id", T.citations(marked).alias("cited"))


# stored tables

_NOW = "timestamp '2024-01-02 00:00:00'"
_OLD = "timestamp '2024-01-01 00:00:00'"
_STORED = f"select doc_id::varchar as id, text as original_text, {_OLD} as created_at, {_OLD} + to_seconds(doc_id % 1000) as updated_at from documents"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.expr(_OLD)
    return _texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("original_text"),
        old.alias("created_at"),
        (old + F.make_dt_interval(secs=(F.col("doc_id") % 1000).cast("decimal(18,6)"))).alias("updated_at"),
    )


@query(
    f"""with o as ({_STORED}), n as (select id, 'v2 ' || original_text as original_text, {_NOW} as created_at, {_NOW} as updated_at from o where id::bigint % 3 = 0
      union all select 'new-' || id, original_text, {_NOW}, {_NOW} from o where id::bigint % 7 = 0),
    d as (select n.id, n.original_text, coalesce(o.created_at, n.created_at) as created_at, n.updated_at from n left join o using (id))
    select id, md5(original_text) as text_md5, created_at, updated_at from (select * from o where id not in (select id from n) union all select * from d)"""
)
def upsert_documents(spark, sf_dir):
    old = _stored(spark, sf_dir)
    now = F.expr(_NOW)
    changed = old.where("cast(id as bigint) % 3 = 0").withColumn("original_text", F.concat(F.lit("v2 "), "original_text"))
    added = old.where("cast(id as bigint) % 7 = 0").withColumn("id", F.concat(F.lit("new-"), "id"))
    new = changed.unionByName(added).withColumns({"created_at": now, "updated_at": now})
    return catalog.upsert_documents(old, new).select("id", F.md5(F.col("original_text").cast("binary")).alias("text_md5"), "created_at", "updated_at")


@query(f"select id from ({_STORED}) where id not in (select (doc_id // 2)::varchar from documents where doc_id % 10 = 0)")
def delete_documents(spark, sf_dir):
    gone = _read(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.expr("cast(doc_id div 2 as string)").alias("id"))
    return catalog.delete(_stored(spark, sf_dir), gone, "id").select("id")


@query(
    f"""select doc_id::varchar as chunk_id, md5(case when doc_id % 5 = 0 then 'edited text ' || doc_id::varchar else text end) as text_md5,
    case when doc_id % 5 = 0 then 3 else {_tokens("text")} end as token_count,
    strlen(case when doc_id % 5 = 0 then 'edited text ' || doc_id::varchar else text end) as end_pos from documents"""
)
def update_chunks(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"), T.token_count(F.col("text")).alias("token_count"), F.octet_length("text").alias("end_pos"))
    edits = docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("chunk_id"), F.format_string("edited text %d", "doc_id").alias("chunk_text"))
    return catalog.update_chunks(chunks, edits).select("chunk_id", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), "token_count", "end_pos")


@query(f"select id, updated_at, false as is_image from ({_STORED})")
def list_documents(spark, sf_dir):
    listed = _stored(spark, sf_dir).withColumn("doc_type", F.lit("txt"))
    return catalog.list_documents(listed).select("id", "updated_at", "is_image")


@query(f"select id, md5(original_text) as text_md5 from ({_STORED}) where id = '17'")
def get_document(spark, sf_dir):
    return catalog.get_document(_stored(spark, sf_dir), "17").select("id", F.md5(F.col("original_text").cast("binary")).alias("text_md5"))


_PARTS = """select doc_id::varchar || case when i = 0 then '' else '_' || i::varchar end as chunk_id, doc_id::varchar as document_id, i::int as chunk_index,
    substr(text, i::int * size + 1, size) as chunk_text
    from (select *, greatest(1, (length(text) + doc_id % 3) // (doc_id % 3 + 1))::int as size from documents), unnest(range(0, doc_id % 3 + 1)) t(i)"""


def _parts(spark, sf_dir):
    """One to three chunks of each document, of like length; together they are its text."""
    rows = _texts(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("chunk_index"))
    id_, parts = F.col("doc_id").cast("string"), F.col("doc_id") % 3 + 1
    size = F.greatest(F.lit(1), F.floor((F.length("text") + parts - 1) / parts)).cast("int")
    return rows.select(
        F.when(F.col("chunk_index") == 0, id_).otherwise(F.concat(id_, F.lit("_"), F.col("chunk_index").cast("string"))).alias("chunk_id"),
        id_.alias("document_id"), "chunk_index", F.col("text").substr(F.col("chunk_index") * size + 1, size).alias("chunk_text"),
    )


@query(
    f"""with c as ({_PARTS}), e as (select vec_id::varchar as chunk_id from embeddings)
    select chunk_id, 'no vector' as problem from c where chunk_id not in (select chunk_id from e)
    union all select chunk_id, 'no chunk' from e where chunk_id not in (select chunk_id from c)"""
)
def unmatched_vectors(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"))
    return catalog.unmatched(_parts(spark, sf_dir), vectors)


@query(
    f"""select c.document_id as id, md5(d.text) as text_md5, (hash.v % 1000)::double / 1000 as score, c.chunk_index, c.chunk_index > 0 or d.doc_id % 3 > 0 as is_chunk,
    md5(c.chunk_text) as chunk_md5, k.k as doc_type, k.k = 'image' as is_image
    from ({_PARTS}) c join documents d on d.doc_id::varchar = c.document_id,
      lateral (select (d.doc_id * 37 + c.chunk_index * 11) as v) hash, lateral (select case when d.doc_id % 4 = 0 then 'image' else 'txt' end as k) k
    where hash.v % 5 = 0"""
)
def shaped_results(spark, sf_dir):
    """Hits of every fifth chunk, joined with what is known of them, in the shape of an answer."""
    chunks = _parts(spark, sf_dir).withColumns({"chunk_type": F.lit("text"), "page_number": F.lit(None).cast("int")})
    value = F.col("document_id").cast("long") * 37 + F.col("chunk_index") * 11
    hits = chunks.where(value % 5 == 0).select("chunk_id", "document_id", ((value % 1000).cast("double") / 1000).alias("score"))
    docs = _texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("original_text"), (F.col("doc_id") % 3 + 1).cast("int").alias("chunk_count"),
        F.lit("p").alias("file_path"), F.lit("s").alias("source_path"), F.when(F.col("doc_id") % 4 == 0, "image").otherwise("txt").alias("doc_type"),
    )
    got = search.shaped(hits, chunks, docs)
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return got.select("id", md5("text").alias("text_md5"), "score", "metadata.chunk_index", "metadata.is_chunk", md5("metadata.matching_chunk").alias("chunk_md5"), "metadata.doc_type", "metadata.is_image")


@query(f"select chunk_id, chunk_index, row_number() over (order by chunk_index) as place, md5(chunk_text) as chunk_md5 from ({_PARTS}) where document_id = '17'")
def document_chunks(spark, sf_dir):
    """In the order in which they come."""
    got = catalog.document_chunks(_parts(spark, sf_dir), "17").coalesce(1)
    return got.select("chunk_id", "chunk_index", (F.monotonically_increasing_id() + 1).alias("place"), F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(f"select chunk_id, document_id, md5(chunk_text) as chunk_md5 from ({_PARTS}) where chunk_id = '17_1'")
def get_chunk(spark, sf_dir):
    return catalog.get_chunk(_parts(spark, sf_dir), "17_1").select("chunk_id", "document_id", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(f"select id, case when id = '17' then '/new/place' end as source_path, case when id = '17' then {_NOW} else updated_at end as updated_at from ({_STORED})")
def update_source_path(spark, sf_dir):
    docs = _stored(spark, sf_dir).withColumn("source_path", F.lit(None).cast("string"))
    return catalog.update_source_path(docs, "17", "/new/place", F.expr(_NOW)).select("id", "source_path", "updated_at")


# sources

_TYPE = "case " + " ".join(f"when e in ({', '.join(map(_q, v))}) then '{k}'" for k, v in T.DOC_TYPES.items()) + " else 'unknown' end"


@query(
    f"""with e as (select page_id, lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '(\\.[^./]*)\\z', 1)) as e from pages), k as (select page_id, {_TYPE} as k from e)
    select page_id, k as doc_type, case when k in ('pdf', 'docx', 'xlsx', 'html', 'csv', 'image') then k else 'txt' end as parser from k"""
)
def detect_doc_type(spark, sf_dir):
    path = F.regexp_replace("url", "[?#].*", "")
    return _read(spark, sf_dir, "pages").select("page_id", T.doc_type(path).alias("doc_type"), T.parser_of(path).alias("parser"))


@query(
    f"""with e as (select page_id, lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '(\\.[^./]*)\\z', 1)) as e from pages), k as (select page_id, {_TYPE} as k from e)
    select page_id, k <> 'unknown' as known, k in ({", ".join(map(_q, T.PARSED))}) as own_parser, k in ({", ".join(map(_q, T.PARSED))}) or {"txt" in T.PARSED} as supported from k"""
)
def supported_pages(spark, sf_dir):
    """Whether a page's format is known, has a parser of its own, and can be indexed (as text, where it has none)."""
    path = F.regexp_replace("url", "[?#].*", "")
    own = T.doc_type(path).isin(*T.PARSED)
    return _read(spark, sf_dir, "pages").select("page_id", T.is_known(path).alias("known"), own.alias("own_parser"), T.is_supported(path).alias("supported"))


@query("select c_custkey, c_custkey % 4 <> 0 or c_acctbal > 0 as has_data from customer")
def rows_with_data(spark, sf_dir):
    cells = F.array(F.when(F.col("c_custkey") % 4 == 0, F.lit(" \t")).otherwise(F.col("c_name")), F.lit(None).cast("string"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")))
    return _read(spark, sf_dir, "customer").select("c_custkey", T.row_has_data(cells).alias("has_data"))


@query("select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title from pages")
def html_title(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query()
def html_chunks(spark, sf_dir):
    """Titles, sections and their chunks by the HTML parser; golden cases are in tests."""
    pages = spread(_read(spark, sf_dir, "pages").select("page_id", "html")).select(F.concat("page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    parsed = files.parse_files(pages)
    return parsed.select("path", F.explode("chunks").alias("c")).select("path", "c.chunk_index", "c.chunk_type", "c.token_count", "c.chunk_text")


@query()
def html_text(spark, sf_dir):
    small_batches(spark)

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([html.to_text(p) if p is not None else None for p in pages.to_pylist()], pa.string())

    return spread(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", text("html").alias("text"))


_NATION = "'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey"


@query(f"with r as (select *, row_number() over (order by n_nationkey) as i from nation) select i as row_number, 'Row ' || i || ': ' || {_NATION} || chr(10) as row_text from r")
def csv_render_rows(spark, sf_dir):
    return files.render_rows(_read(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


_CUSTOMER = "'Row ' || c_custkey || ': name: ' || c_name || ' | segment: ' || c_mktsegment || chr(10)"


@query(
    f"""with r as (select c_nationkey::varchar as t, c_custkey, {_CUSTOMER} as x from customer),
    l as (select t, list({{'n': {_tokens("x")}::bigint, 'cur': 0::bigint, 'done': []::bigint[]}} order by c_custkey) as p from r group by t),
    f as (select t, list_reduce(p, lambda a, x: case when a.cur = 0 or a.cur + x.n <= 200 then {{'n': x.n, 'cur': a.cur + x.n, 'done': a.done}}
      else {{'n': x.n, 'cur': x.n, 'done': list_append(a.done, a.cur)}} end, {{'n': 0::bigint, 'cur': 0::bigint, 'done': []::bigint[]}}) as r from l),
    c as (select t, unnest(list_append(r.done, r.cur)) as n, generate_subscripts(list_append(r.done, r.cur), 1) as i from f)
    select t as table_id, (i - 1)::int as chunk_index, n as token_count from c"""
)
def csv_pack_rows(spark, sf_dir):
    line = F.concat(F.lit("Row "), "c_custkey", F.lit(": name: "), "c_name", F.lit(" | segment: "), "c_mktsegment", F.lit("\n"))
    rows = _read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", line.alias("row"))
    return pack_table(rows, "c_nationkey", "c_custkey", "row", 200).select("table_id", "chunk_index", "token_count")


@query(
    """select p_partkey, case when i >= 702 then chr(65 + ((((i // 26) - 1) // 26) - 1)::int) else '' end || case when i >= 26 then chr(65 + (((i // 26) - 1) % 26)::int) else '' end
    || chr(65 + (i % 26)::int) as letters from (select p_partkey, p_partkey % 18278 as i from part)"""
)
def excel_column_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.excel_column(F.col("p_partkey") % 18278).alias("letters"))


@query(
    """with d as (select p_partkey, (p_size * 61)::int as w, ((p_partkey % 97) * 23 + 1)::int as h from part)
    select p_partkey, (case when w <= 1120 and h <= 1120 then w when w >= h then 1120 else floor(1120.0::double * w / h) end)::int as width,
    (case when w <= 1120 and h <= 1120 then h when h >= w then 1120 else floor(1120.0::double * h / w) end)::int as height from d"""
)
def fit_images(spark, sf_dir):
    sized = _read(spark, sf_dir, "part").select("p_partkey", files.fit_image((F.col("p_size") * 61).cast("int"), ((F.col("p_partkey") % 97) * 23 + 1).cast("int")).alias("s"))
    return sized.select("p_partkey", "s.width", "s.height")


# embedders

@query(
    f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), {_q(T.TOKEN)})) as w from documents)
    select doc_id, (('0x' || substr(md5(w), 1, 8))::bigint % 64) as slot, count(*) as n from w group by all"""
)
def hashing_slots(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.explode_outer(HashingEmbedder(64).slots(F.col("text"))).alias("slot")).where("slot is not null")
    return rows.groupBy("doc_id", "slot").agg(F.count("*").alias("n"))


@query(
    f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), {_q(T.TOKEN)})) as w from documents),
    n as (select doc_id, (('0x' || substr(md5(w), 1, 8))::bigint % 64) as slot, count(*) as n from w group by all)
    select d.doc_id, round(coalesce(max(n.n) / sqrt(sum(n.n * n.n)), 0), 4) as largest from documents d left join n using (doc_id) group by d.doc_id"""
)
def hashing_embedding(spark, sf_dir):
    small_batches(spark)
    vectors = _texts(spark, sf_dir).select("doc_id", HashingEmbedder(64).column(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.round(F.array_max("v").cast("double"), 4).alias("largest"))


def _keyword_part(k: int) -> str:
    hit = " + ".join(f"case when {_any('lower(text)', list(p))} then {w} else 0 end" for at, w, p in KeywordEmbedder.WORDS if at == k)
    both = " and ".join(f"contains(lower(text), {_q(w)})" for w in KeywordEmbedder.BOTH[0])
    extra = f" + case when {both} then {KeywordEmbedder.BOTH[1][k]} else 0 end"
    return f"round(least(1, strlen(text) % {100 * (k + 1)} / {1000.0 * (k + 1)} + {hit}{extra})::double, 4) as e{k}"


@query(f"select doc_id, {', '.join(_keyword_part(k) for k in range(3))} from documents")
def keyword_embedding(spark, sf_dir):
    vectors = _texts(spark, sf_dir).select("doc_id", KeywordEmbedder().column(F.col("text")).alias("v"))
    return vectors.select("doc_id", *[F.round(F.get("v", k).cast("double"), 4).alias(f"e{k}") for k in range(3)])


@query("select count(*) as chunks, count(distinct text) as texts from documents where trim(text) <> ''")
def embed_distinct(spark, sf_dir):
    """Every chunk gets its vector, though each distinct text is embedded once."""
    docs = _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("chunk_text"))
    vectors = embed_chunks(docs, HashingEmbedder(64)).where("size(embedding) = 64")
    joined = vectors.join(docs.select("chunk_id", F.sha2("chunk_text", 256).alias("digest")), "chunk_id")
    return joined.agg(F.count("*").alias("chunks"), F.count_distinct("digest").alias("texts"))


# prompts

@query(
    f"""with r as (select lang, doc_id, text, {_SCORE} as s, row_number() over (partition by lang order by {_SCORE} desc, doc_id) as k from documents qualify k <= 5),
    b as (select lang, k, 'Source ' || k || ' [' || doc_id || '], relevance ' || printf('%.1f', round(s * 100, 6)) || '%:' || chr(10) || {_cut("text", 2000)} || case when strlen(text) > 2000 then '...' else '' end as b from r)
    select lang, md5({_q(chat.OPENING)} || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) order by k) || chr(10) || chr(10) || {_q(chat.CLOSING)}) as prompt_md5 from b group by lang"""
)
def prompt_context(spark, sf_dir):
    from pyspark.sql import Window

    docs = _read(spark, sf_dir, "documents")
    scored = docs.select("lang", "doc_id", T.keyword_score(F.col("text"), F.lit(_PHRASE)).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).where("rank <= 5")
    ranked = docs.select("doc_id", "text").join(limited(stage(ranked, "ranked")), "doc_id")  # texts join the few that are ranked
    results = ranked.select("lang", "rank", F.col("doc_id").alias("id"), F.round("score", 8).alias("score"), "text")
    return chat.prompts(results, "lang").select("lang", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


# metrics

_BOUNDS = metrics.BUCKETS["document_characters"]


@query(
    "select lang, le, total, value_sum, cumulative from (select lang, count(n_chars) as total, sum(n_chars) as value_sum, "
    + ", ".join(f"count(*) filter (n_chars <= {b}) as c{i}" for i, b in enumerate(_BOUNDS))
    + " from documents group by lang), lateral (select unnest(["
    + ", ".join(f"{float(b)}::double" for b in _BOUNDS)
    + ", null]) as le, unnest(["
    + ", ".join(f"c{i}" for i in range(len(_BOUNDS)))
    + ", total]) as cumulative)"
)
def metric_histogram(spark, sf_dir):
    return metrics.histogram(_read(spark, sf_dir, "documents"), "n_chars", _BOUNDS, ["lang"])


@query("select event_type, count(*) as total from events group by 1")
def metric_counter(spark, sf_dir):
    return metrics.counter(_read(spark, sf_dir, "events"), ["event_type"])


@query("select event_type, arg_max(value, (ts, event_id)) as value from events group by 1")
def metric_gauge(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return metrics.latest(rows, ["event_type"], "value", "at")


@query(f"select lang, sum({_tokens('text')})::bigint as tokens, count(*) as documents from documents group by 1")
def token_totals(spark, sf_dir):
    return metrics.token_totals(_read(spark, sf_dir, "documents"), "text", ["lang"])


@query("select role, sum(floor((strlen(text) // 4) * 1.1)::int)::bigint as tokens, count(*) as requests from conversations group by 1")
def token_usage(spark, sf_dir):
    return metrics.token_usage(_read(spark, sf_dir, "conversations"), "text", ["role"])


@query("select count(*) as requests, count(distinct text) as entries, round((count(*) - count(distinct text)) / count(*), 6) as hit_rate from documents")
def cache_hit_rate(spark, sf_dir):
    return metrics.cache_hit_rate(_texts(spark, sf_dir), F.col("text")).withColumn("hit_rate", F.round("hit_rate", 6))


# event streams

@query(
    """select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type,
    count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3"""
)
def event_windows(spark, sf_dir):
    return ingest.event_windows(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval '30 minutes' then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g)
    select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n, round(sum(value), 4) as total from s group by user_id, k"""
)
def event_sessions(spark, sf_dir):
    return ingest.sessions(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


from quarry import stored_queries  # noqa: E402, F401  registers its own
