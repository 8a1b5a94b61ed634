"""Queries of the memory engine over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions.ids import evidence_ids
from memloom.functions.patterns import GROUPS
from memloom.operators import dense, extract, sparse
from memloom.operators.answer import budgeted, joined_texts, judge_prompt, reader_prompt, verdict
from memloom.operators.metrics import ANSWER_METRICS, EVIDENCE_METRICS, scored_predictions, summary, summary_by_category, summary_overall
from memloom.operators.extract import memory_text
from memloom.operators.records import first_delivery, first_delivery_of_few
from memloom.plans import analyze, grid, registry, report
from memloom.plans import pipeline as pl
from memloom.sources import locomo
from memloom.sources.tables import table
from memloom.workspace import materialize

# ---------------------------------------------------------------- inputs


def turns(spark: SparkSession, d: str) -> DataFrame:
    return first_delivery_of_few(table(spark, d, "turns"), "turn_id", "ingested_at")


def memories(spark: SparkSession, d: str) -> DataFrame:
    return first_delivery_of_few(table(spark, d, "memories").select("memory_id", *sparse.MEMORY, "text", "source_dia_ids", "ingested_at"), "memory_id", "ingested_at")


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = first_delivery_of_few(table(spark, d, "qa_items"), "qid", "ingested_at")
    return q.withColumn("evidence_dia_ids", evidence_ids(F.col("evidence_dia_ids")))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with their question; every retrieved id stands for one memory."""
    p = first_delivery(table(spark, d, "predictions"), "pred_id", "predicted_at")
    q = questions(spark, d).select("qid", "gold_answer", "category", F.col("evidence_dia_ids").alias("evidence"))
    retrieved = F.transform(F.coalesce("retrieved_dia_ids", F.array().cast("array<string>")), lambda x: F.array(x))
    return p.join(q, "qid").withColumn("retrieved", retrieved)


def word_vectors(spark: SparkSession, d: str, texts: DataFrame | None = None) -> DataFrame:
    """Stand-in for a trained table: vectors of four dimensions derived from the digest of each lower-case word; some words have none."""
    texts = memories(spark, d).select("text") if texts is None else texts
    texts = texts.unionByName(questions(spark, d).select(F.col("question").alias("text")))
    words = texts.select(F.explode(T.all_words(F.lower("text"))).alias("word")).distinct()
    byte = lambda i: (F.conv(F.substring(F.md5("word"), 2 * i + 1, 2), 16, 10).cast("double") - 127.5) / 127.5
    return words.filter(F.substring(F.md5("word"), 32, 1) != "0").select("word", F.array(*[byte(i) for i in range(4)]).alias("vec"))


_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_W = r"[\p{L}\p{N}_]"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{_W}+'), lambda w: w not in ({_STOP}))"


_TURNS = "t as (select * exclude (rn) from (select *, row_number() over (partition by turn_id order by ingested_at) rn from turns) where rn = 1)"
_MEM = "m as (select * exclude (rn) from (select memory_id, extractor, conv_id, mem_idx, text, source_dia_ids, row_number() over (partition by memory_id order by ingested_at) rn from memories) where rn = 1)"
_IDS = r"list_transform(regexp_extract_all(array_to_string(coalesce({0}, []), ' | '), 'D:?(\d+):(\d+)'), lambda x: 'D' || regexp_extract(x, 'D:?(\d+):(\d+)', 1)::bigint || ':' || regexp_extract(x, 'D:?(\d+):(\d+)', 2)::bigint)"
_QA = f"q as (select * exclude (rn) replace ({_IDS.format('evidence_dia_ids')} as evidence_dia_ids) from (select *, row_number() over (partition by qid order by ingested_at) rn from qa_items) where rn = 1)"
_PRED = (
    f"{_QA}, p as (select x.* exclude (rn), q.gold_answer, q.category, q.evidence_dia_ids evidence, coalesce(retrieved_dia_ids, []) retrieved from "
    "(select *, row_number() over (partition by pred_id order by predicted_at) rn from predictions) x join q using (qid) where rn = 1)"
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- extraction

_SAID = "coalesce(speaker, '') || ': ' || coalesce(text, '')"
_STAMP = "coalesce(nullif(ts_date, ''), nullif(timestamp_raw, ''))"
_NUMBER = "row_number() over (partition by conv_id order by pos nulls first, dia_id nulls first, text nulls first, speaker nulls first) - 1"


def _shown(m: DataFrame, *more: F.Column) -> DataFrame:
    return m.select("conv_id", "mem_idx", "text", F.coalesce(F.col("source_dia_ids")[0], F.lit("")).alias("source"), *more)


@query(f"with {_TURNS} select conv_id, {_NUMBER} mem_idx, {_SAID} \"text\", coalesce(dia_id, '') source from t")
def append_all(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extract.append_all(turns(spark, d)))


@query(f"with {_TURNS} select conv_id, {_NUMBER} mem_idx, case when {_STAMP} is null then '' else '[' || {_STAMP} || '] ' end || {_SAID} \"text\", coalesce(dia_id, '') source from t")
def append_all_ts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extract.append_all(turns(spark, d), with_timestamp=True))


@query("select conv_id, pos mem_idx, \"text\", dia_id source from turns where false")
def no_memory(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extract.no_memory(turns(spark, d)))


_V = {
    "past": "went|got|ran|made|took|saw|met|had|did|bought|sold|started|finished|joined|visited|tried|found|won|lost|moved|adopted|read|wrote|quit|left|began|became|broke|spoke|taught|thought|felt|kept|held",
    "like": "love|like|enjoy|hate|dislike|prefer|want|hope|plan|need|wish",
}
_FROM, _TO = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_S0 = _SPACES[:-1] + "*"
_SHARED = {
    "temporal": rf"{_FROM}(?:yesterday|today|tomorrow|tonight|last{_SPACES}{_W}+|next{_SPACES}{_W}+|{_W}+{_SPACES}(?:days?|weeks?|months?|years?){_SPACES}ago){_TO}",
    "plan": rf"{_FROM}(?:gonna|going{_SPACES}to|planning{_SPACES}(?:to|on)|plan{_SPACES}to){_TO}",
}
_RE = {
    "v1": {
        "past_event": rf"{_FROM}I{_SPACES}(?:{_V['past']}|{_W}+ed){_TO}",
        "state": rf"{_FROM}I{_S0}(?:'m|am|was){_TO}",
        "preference": rf"{_FROM}I{_SPACES}(?:{_V['like']}){_TO}",
        "possessive": rf"{_FROM}my{_SPACES}{_W}",
        **_SHARED,
    },
    "v2": {
        "past_event": rf"{_FROM}(?:I|we)(?:'ve)?{_SPACES}(?:{_V['past']}|been|done|{_W}+ed){_TO}",
        "preference": rf"{_FROM}(?:I|we)(?:'d)?{_SPACES}(?:{_V['like']}){_TO}",
        "possessive": rf"{_FROM}(?:my|our){_SPACES}{_W}",
        **_SHARED,
    },
}
_BE = rf"\b(?:I|we){_S0}(?:'m|'re|am|are|was|were)\b"
_FILLED = rf"{_BE}{_SPACES}(?:(?:so|really|very){_SPACES})?(?:glad|happy|sorry|sure|excited|proud of you|off\b|gonna|going to)"


def _sql_patterns(version: str) -> str:
    def hit(name: str) -> str:
        if name == "state" and version == "v2":
            count = lambda p: "len(regexp_extract_all(coalesce(text, ''), '(?i)" + p.replace("'", "''") + "'))"
            return f"case when {count(_BE)} > {count(_FILLED)} then 'state' end"
        return f"case when regexp_matches(coalesce(text, ''), '(?i){_RE[version][name].replace(chr(39), chr(39) * 2)}') then '{name}' end"

    return "list_filter([" + ", ".join(hit(g) for g in GROUPS) + "], lambda x: x is not null)"


def _sql_regex(version: str) -> str:
    return (
        f"with {_TURNS}, f as (select *, {_sql_patterns(version)} found from t), k as (select * from f where len(found) > 0) "
        f"select conv_id, {_NUMBER} mem_idx, {_SAID} \"text\", coalesce(dia_id, '') source, array_to_string(found, ',') patterns from k"
    )


def _patterns() -> F.Column:
    return F.array_join("meta.matched_patterns", ",").alias("patterns")


@query(_sql_regex("v1"))
def regex_v1(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extract.regex(turns(spark, d)), _patterns())


@query(_sql_regex("v2"))
def regex_v2(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extract.regex(turns(spark, d), version="v2"), _patterns())


@query(
    f"with {_TURNS}, f as (select 'v1' version, unnest({_sql_patterns('v1')}) pattern from t union all select 'v2', unnest({_sql_patterns('v2')}) from t) "
    "select version, pattern, count(*) n from f group by all"
)
def regex_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    both = F.array(*[F.struct(F.lit(v).alias("version"), extract.matched_patterns(F.col("text"), v).alias("found")) for v in ("v1", "v2")])
    found = t.select(F.inline(both)).select("version", F.explode("found").alias("pattern"))
    return found.groupBy("version", "pattern").agg(F.count("*").alias("n"))


@query()
def rule_ner(spark: SparkSession, d: str) -> DataFrame:
    return _shown(extract.ner(turns(spark, d)), F.array_join(F.col("meta.entities.label"), ",").alias("labels"))


@query(f"with {_TURNS}, o as (select conv_id, row_number() over (order by conv_id) n from dialogues) select conv_id, turn_id from t where conv_id in (select conv_id from o where n <= 3)")
def dialogue_subset(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the first three dialogues (the subset option); the table of dialogues is the unit that is cut."""
    first = table(spark, d, "dialogues").select("conv_id").orderBy("conv_id").limit(3).withColumn("conv_pos", F.lit(1))
    return extract.first_dialogues(turns(spark, d), first, 3).select("conv_id", "turn_id")


# ---------------------------------------------------------------- sources


@query(
    r"with s as (select distinct conv_id, session_no, timestamp_raw raw from sessions), p as (select *, regexp_extract(coalesce(raw, ''), '(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})', ['d', 'm', 'y']) r from s) "
    r"select conv_id, session_no, coalesce(raw, '') raw, coalesce(strftime(try_strptime(r.d || ' ' || r.m || ' ' || r.y, ['%d %B %Y', '%d %b %Y']), '%Y-%m-%d'), '') iso from p"
)
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").select("conv_id", "session_no", "timestamp_raw").distinct()
    iso = F.coalesce(F.date_format(T.parse_date(F.col("timestamp_raw")), "yyyy-MM-dd"), F.lit(""))
    return s.select("conv_id", "session_no", T.or_empty(F.col("timestamp_raw")).alias("raw"), iso.alias("iso"))


@query(f"with {_QA} select qid, array_to_string(evidence_dia_ids, ' ') ids, len(evidence_dia_ids) n_ids from q")
def evidence_normalize(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qid", F.array_join("evidence_dia_ids", " ").alias("ids"), F.size("evidence_dia_ids").alias("n_ids"))


_DOC = (
    "d0 as (select record_id, case when json_valid({0}) then case when json_type({0}) = 'VARCHAR' then json_extract_string({0}, '$') else {0} end end c from locomo10), "
    "d as (select record_id, case when json_valid(c) then c::json end c from d0)"
)


@query(
    f"with {_DOC.format('conversation')}, o as (select * from d where json_type(c) = 'OBJECT') "
    "select record_id, coalesce(json_extract_string(c, '$.speaker_a'), '') a, coalesce(json_extract_string(c, '$.speaker_b'), '') b from o"
)
def locomo_speakers(spark: SparkSession, d: str) -> DataFrame:
    return locomo.load_dialogues(table(spark, d, "locomo10"), "record_id").select(F.col("conv_id").alias("record_id"), F.col("speakers")[0].alias("a"), F.col("speakers")[1].alias("b"))


@query(
    f"with {_DOC.format('conversation')}, o as (select * from d where json_type(c) = 'OBJECT'), "
    "k as (select record_id, c, unnest(json_keys(c)) sid from o), s as (select record_id, sid, c, json_extract(c, '$.\"' || sid || '\"') v from k where regexp_full_match(sid, 'session_[0-9]+')), "
    "l as (select record_id, sid, c, case when json_type(v) = 'ARRAY' then v::json[] else [v] end a from s where json_type(v) <> 'NULL'), "
    "u as (select record_id, sid, c, unnest(a) t, unnest(range(len(a))) turn_no from l) "
    r"select record_id, regexp_extract(sid, '(\d+)$', 1)::int session_no, turn_no, coalesce(json_extract_string(t, '$.speaker'), '') speaker, coalesce(json_extract_string(t, '$.dia_id'), '') dia_id, "
    "coalesce(json_extract_string(t, '$.text'), '') \"text\", coalesce(json_extract_string(c, '$.\"' || sid || '_date_time\"'), '') timestamp_raw from u where json_type(t) <> 'NULL'"
)
def locomo_turns(spark: SparkSession, d: str) -> DataFrame:
    t = locomo.load_turns(table(spark, d, "locomo10"), "record_id")
    return t.select(F.col("conv_id").alias("record_id"), "session_no", "turn_no", "speaker", "dia_id", "text", "timestamp_raw")


@query(
    f"with {_DOC.format('qa')}, l as (select record_id, case json_type(c) when 'ARRAY' then c::json[] when 'OBJECT' then [c] end a from d), "
    "u as (select record_id, unnest(a) q, unnest(range(len(a))) qa_pos from l), "
    "x as (select *, json_extract(q, '$.answer') ans, json_extract(q, '$.category')::int category from u where json_type(q) <> 'NULL') "
    "select record_id, qa_pos, coalesce(json_extract_string(q, '$.question'), '') question, category, "
    "case when ans is null then '' when json_type(ans) = 'NULL' then 'None' when json_type(ans) = 'BOOLEAN' then upper(left(ans::varchar, 1)) || substr(ans::varchar, 2) else json_extract_string(ans, '$') end gold_answer "
    "from x where category is null or category <> 5"
)
def category_exclusion(spark: SparkSession, d: str) -> DataFrame:
    q = locomo.load_qa(table(spark, d, "locomo10"), "record_id")
    return q.select(F.col("conv_id").alias("record_id"), "qa_pos", "question", "category", "gold_answer")


# ---------------------------------------------------------------- term statistics

_POST = f"{_MEM}, k as (select *, {_tok('text')} toks from m), post as (select extractor, conv_id, mem_idx, len(toks) n_terms, term, count(*) tf from (select *, unnest(toks) term from k) group by all)"
_STATS = f"{_POST}, st as (select extractor, conv_id, count(*) n_docs, avg(len(toks)) avg_len from k group by all), dfr as (select extractor, conv_id, term, count(*) df from post group by all)"


@query(f"with {_MEM} select memory_id, array_to_string({_tok('text')}, ' ') tokens from m")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"with {_POST} select * from post")
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.term_freq(memories(spark, d))


@query(f"with {_STATS} select * from dfr")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.doc_freq(sparse.term_freq(memories(spark, d)))


@query(f"with {_STATS} select extractor, conv_id, n_docs, round(avg_len, 6) avg_len from st")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return sparse.doc_stats(memories(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"with {_STATS} select extractor, conv_id, term, df, round(ln((1.0 + n_docs) / (1.0 + df)) + 1.0, 6) idf from dfr join st using (extractor, conv_id)")
def idf_smooth(spark: SparkSession, d: str) -> DataFrame:
    return sparse.idf_table(memories(spark, d), sparse.idf_smooth).withColumn("idf", F.round("idf", 6))


@query(f"with {_STATS} select extractor, conv_id, term, df, round(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)), 6) idf from dfr join st using (extractor, conv_id)")
def idf_bm25(spark: SparkSession, d: str) -> DataFrame:
    return sparse.idf_table(memories(spark, d), sparse.idf_bm25).withColumn("idf", F.round("idf", 6))


# ---------------------------------------------------------------- sparse retrieval

_ASKED = f"{_QA}, qt as (select qid, conv_id, term, count(*) qtf from (select qid, conv_id, unnest({_tok('question')}) term from q) group by all)"
_RANK = "row_number() over (partition by qid, extractor order by round(score, 9) desc, mem_idx)"
_TFIDF = (
    f"{_STATS}, {_ASKED}, idf as (select extractor, conv_id, term, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 idf from dfr join st using (extractor, conv_id)), "
    "w as (select extractor, conv_id, mem_idx, term, tf * idf w from post join idf using (extractor, conv_id, term)), nm as (select extractor, conv_id, mem_idx, sqrt(sum(w * w)) nrm from w group by all), "
    "qw as (select qid, extractor, conv_id, term, qtf * idf qw from qt join idf using (conv_id, term)), qn as (select qid, extractor, sqrt(sum(qw * qw)) qnrm from qw group by all), "
    "sc as (select qid, extractor, conv_id, mem_idx, sum(qw * w) / any_value(nrm * qnrm) score from qw join w using (extractor, conv_id, term) join nm using (extractor, conv_id, mem_idx) join qn using (qid, extractor) group by all), "
    f"top as (select * from (select *, {_RANK} \"rank\" from sc where score > 0) where \"rank\" <= 5)"
)
_BM25 = (
    f"{_STATS}, {_ASKED}, idf as (select extractor, conv_id, term, avg_len, ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) idf from dfr join st using (extractor, conv_id)), "
    "sc as (select qid, extractor, conv_id, mem_idx, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / avg_len))) score from qt join idf using (conv_id, term) join post using (extractor, conv_id, term) group by all), "
    f"top as (select * from (select *, {_RANK} \"rank\" from sc where score > 0) where \"rank\" <= 5)"
)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("qid", "extractor", "mem_idx", "rank", F.round("score", 6).alias("score"))


_RANKED = "select qid, extractor, mem_idx, \"rank\", round(score, 6) score from top"


@query(f"with {_TFIDF} {_RANKED}")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(sparse.tfidf_topk(memories(spark, d), questions(spark, d)))


@query(f"with {_BM25} {_RANKED}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(sparse.bm25_topk(memories(spark, d), questions(spark, d)))


_AS_DOCS = "m as (select 'documents' extractor, conv_id, doc_id mem_idx, text from documents where conv_id is not null)"


@query(f"with {_BM25.replace(_MEM, _AS_DOCS)} {_RANKED}")
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("conv_id is not null").select(F.lit("documents").alias("extractor"), "conv_id", F.col("doc_id").alias("mem_idx"), "text")
    return _ranked(sparse.bm25_topk(docs, questions(spark, d)))


# ---------------------------------------------------------------- dense retrieval

_VEC = (
    f"{_MEM}, {_QA}, vw as (select distinct unnest(regexp_extract_all(lower(coalesce(x, '')), '{_W}+')) word from (select text x from m union all select question from q)), "
    "vec as (select word, i dim, (('0x' || substr(md5(word), 2 * i + 1, 2))::int - 127.5) / 127.5 x from vw, range(4) r(i) where right(md5(word), 1) <> '0'), "
    f"f0 as (select extractor, conv_id, mem_idx, unnest(list_filter(regexp_extract_all(coalesce(text, ''), '{_W}+'), lambda w: lower(w) not in ({_STOP}))) word from m), "
    "f1 as (select extractor, conv_id, mem_idx, word, lower(word) low, count(*) c from f0 group by all), f as (select * exclude (c), sum(c) over (partition by extractor, conv_id, mem_idx, low) n from f1), "
    "sc0 as (select extractor, conv_id, count(*) n_docs from m group by all), d0 as (select extractor, conv_id, low, count(distinct mem_idx) df from f group by all), "
    "idf as (select extractor, conv_id, low, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 idf from d0 join sc0 using (extractor, conv_id)), "
    f"g0 as (select qid, conv_id, unnest(list_filter(regexp_extract_all(coalesce(question, ''), '{_W}+'), lambda w: lower(w) not in ({_STOP}))) word from q), "
    "g1 as (select qid, conv_id, word, lower(word) low, count(*) c from g0 group by all), g as (select * exclude (c), sum(c) over (partition by qid, conv_id, low) n from g1)"
)


def _vec_join(src: str) -> str:
    return f"(select s.*, v.dim, v.x from {src} s join vec v on v.word = case when exists (select 1 from vec e where e.word = s.word) then s.word else s.low end)"


def _vec_sql(weighting: str) -> str:
    if weighting == "uniform":
        mem = f"select extractor, conv_id, mem_idx, dim, sum(n * x) / sum(n) x from {_vec_join('f')} group by all"
        asked = f"select qid, sc0.extractor, conv_id, dim, sum(n * x) / sum(n) x from {_vec_join('g')} join sc0 using (conv_id) group by all"
    else:
        mem = f"select extractor, conv_id, mem_idx, dim, sum(n * idf * x) / sum(n * idf) x from {_vec_join('f')} join idf using (extractor, conv_id, low) group by all"
        asked = (
            f"select qid, sc0.extractor, j.conv_id, dim, sum(n * coalesce(idf, ln(1.0 + n_docs) + 1.0) * x) / sum(n * coalesce(idf, ln(1.0 + n_docs) + 1.0)) x from {_vec_join('g')} j "
            "join sc0 on sc0.conv_id = j.conv_id left join idf on idf.extractor = sc0.extractor and idf.conv_id = j.conv_id and idf.low = j.low group by all"
        )
    return f"{_VEC}, pm as ({mem}), pq as ({asked})"


def _components(pooled: DataFrame) -> DataFrame:
    return pooled.select(*sparse.MEMORY, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"with {_vec_sql('uniform')} select extractor, conv_id, mem_idx, dim, round(x, 6) x from pm")
def pooled_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _components(dense.embed_memories(memories(spark, d), word_vectors(spark, d)))


@query(f"with {_vec_sql('tfidf')} select extractor, conv_id, mem_idx, dim, round(x, 6) x from pm")
def pooled_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _components(dense.embed_memories(memories(spark, d), word_vectors(spark, d), "tfidf"))


_COSINE = (
    ", a as (select qid, extractor, conv_id, sqrt(sum(x * x)) na from pq group by all), b as (select extractor, conv_id, mem_idx, sqrt(sum(x * x)) nb from pm group by all), "
    "sc as (select qid, extractor, conv_id, mem_idx, sum(pq.x * pm.x) / any_value(na * nb) score from pq join pm using (extractor, conv_id, dim) join a using (qid, extractor, conv_id) join b using (extractor, conv_id, mem_idx) where na > 0 and nb > 0 group by all), "
    f"top as (select * from (select *, {_RANK} \"rank\" from sc where score > 0) where \"rank\" <= 5)"
)


@query(f"with {_vec_sql('uniform')}{_COSINE} {_RANKED}")
def word2vec_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(dense.word2vec_topk(memories(spark, d), questions(spark, d), word_vectors(spark, d)))


@query(f"with {_vec_sql('tfidf')}{_COSINE} {_RANKED}")
def word2vec_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(dense.word2vec_topk(memories(spark, d), questions(spark, d), word_vectors(spark, d), weighting="tfidf"))


@query(
    "with e as (select vec_id, embedding::double[] v from embeddings), s as (select a.vec_id query_id, b.vec_id, list_inner_product(a.v, b.v) score from e a, e b where a.vec_id % 50 = 0) "
    "select query_id, vec_id, \"rank\", round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) \"rank\" from s) where \"rank\" <= 5"
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return dense.vector_search(e.filter("vec_id % 50 = 0"), e).withColumn("score", F.round("score", 6))


_SENT = (
    f"{_MEM}, {_QA}, tx as (select 'm' side, extractor, conv_id, mem_idx id, lower('@passage' || coalesce(text, '')) s from m union all select 'q', '', conv_id, qid, lower('@query' || coalesce(question, '')) from q), "
    f"tw as (select side, extractor, conv_id, id, unnest(regexp_extract_all(s, '{_W}+')) w from tx), tc as (select side, extractor, conv_id, id, w, count(*) n from tw group by all), "
    "dg as (select w, i dim, (('0x' || substr(md5('@model ' || w), 2 * i + 1, 2))::int - 127.5) / 127.5 x from (select distinct w from tc), range(8) r(i)), "
    "pv as (select side, extractor, conv_id, id, dim, sum(n * x) / sum(n) x from tc join dg using (w) group by all), "
    "av as (select side, extractor, conv_id, id, dim, coalesce(x, 0.0) x from tx cross join range(8) r(dim) left join pv using (side, extractor, conv_id, id, dim)), "
    "sc as (select a.id qid, b.extractor, b.conv_id, b.id mem_idx, sum(a.x * b.x) score from av a join av b on a.conv_id = b.conv_id and a.dim = b.dim where a.side = 'q' and b.side = 'm' group by all), "
    f"top as (select * from (select *, {_RANK} \"rank\" from sc) where \"rank\" <= 5)"
)


def _sent_sql(model: str, query: str, passage: str) -> str:
    return f"with {_SENT.replace('@model', model).replace('@query', query).replace('@passage', passage)} {_RANKED}"


@query(_sent_sql("plain-stand-in", "", ""))
def sentence_emb_topk(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval by a sentence encoder (a stand-in derived from digests), without prefixes."""
    return _ranked(dense.sentence_topk(memories(spark, d), questions(spark, d), digest_encoder("plain-stand-in"), model_name="plain-stand-in"))


@query(_sent_sql("e5-stand-in", "query: ", "passage: "))
def sentence_emb_e5_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same with the prefixes of the encoder's family."""
    return _ranked(dense.sentence_topk(memories(spark, d), questions(spark, d), digest_encoder("e5-stand-in"), model_name="e5-stand-in"))


@query(f"with {_QA}, {_MEM} select qid, extractor, mem_idx, 0 \"rank\", 0.0::double score from q, m where false")
def no_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(sparse.no_retrieval(questions(spark, d)))


@query(f"with {_MEM}, {_QA}, sc as (select qid, extractor, conv_id, mem_idx, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '{_W}+')), list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_W}+'))))::double score from q join m using (conv_id)), "
       f"top as (select * from (select *, {_RANK} \"rank\" from sc where score > 0) where \"rank\" <= 5) {_RANKED}")
def custom_retriever(spark: SparkSession, d: str) -> DataFrame:
    """A retriever added by a user as a Python function of blocks: the number of shared words."""
    return _ranked(registry.per_block(_shared_words)(memories(spark, d), questions(spark, d), 5, registry.Resources()))


def _shared_words(asked, held):
    import re

    words = lambda texts: [set(re.findall(r"\w+", (t or "").lower())) for t in texts]
    own = words(held["text"])
    return [[len(q & m) for m in own] for q in words(asked["question"])]


@query(f"with {_TURNS}, u as (select conv_id, pos, dia_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n')) line from t) select conv_id, {_NUMBER.replace(', speaker nulls first', '').replace('text nulls first', 'line nulls first')} mem_idx, line \"text\", coalesce(dia_id, '') source from u where trim(line) <> ''")
def custom_extractor(spark: SparkSession, d: str) -> DataFrame:
    """An extractor added by a user as a Python function of batches of turns: each line is a memory."""
    return _shown(registry.per_turn(_lines)(turns(spark, d)))


def _lines(batch):
    return [[line for line in (text or "").split("\n") if line.strip(" ")] for text in batch["text"]]


# ---------------------------------------------------------------- answering


EXTRACTED = ["append_all", "regex", "regex_v2", "ner"]


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).withColumn("n_words", F.size(T.split_words(F.col("text"))))


_BUDGET = (
    f"{_BM25}, tx as (select top.*, m.text, m.source_dia_ids, len(list_filter(regexp_split_to_array(coalesce(m.text, ''), '{_SPACES}'), lambda w: w <> '')) n_words from top join m using (extractor, conv_id, mem_idx)), "
    "run as (select *, sum(n_words) over (partition by qid, extractor order by \"rank\") used from tx)"
)


@query(f"with {_BUDGET} select qid, extractor, \"rank\", n_words, used from run where used <= 40")
def context_budget_40(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.bm25_lists(_counted(spark, d), questions(spark, d), given=("n_words",))
    return found.select("qid", "extractor", F.inline(budgeted(F.col("memories"), 40)))


@query(f"with {_BUDGET} select qid, extractor, string_agg(coalesce(text, ''), chr(10) order by \"rank\") context, count(*) n_used from run where used <= 1500 group by all")
def context_budget_texts(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.bm25_lists(_counted(spark, d), questions(spark, d), given=("n_words", "text"))
    kept = found.select("qid", "extractor", budgeted(F.col("memories")).alias("kept")).filter(F.size("kept") > 0)
    return kept.select("qid", "extractor", joined_texts(F.col("kept")).alias("context"), F.size("kept").cast("bigint").alias("n_used"))


_READ = (
    f"{_BUDGET}, ex as (select distinct extractor from m), "
    "got as (select qid, extractor, count(*) n_memories, arg_min(coalesce(text, ''), \"rank\") first_text from tx group by all), rd as (select q.qid, ex.extractor || '+bm25' config, q.conv_id, q.category, q.gold_answer, "
    "case when n_memories is null then 'no context' else first_text end answer_text, coalesce(n_memories, 0) n_memories "
    "from q cross join ex left join got on got.qid = q.qid and got.extractor = ex.extractor)"
)


def _records(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).withColumnRenamed("evidence_dia_ids", "evidence")
    return pl.read_lists(sparse.bm25_lists(memories(spark, d), q, EXTRACTED, carried=("qid", "conv_id", "category", "question", "gold_answer", "evidence")))


@query(f"with {_READ} select qid, config, answer_text, n_memories from rd")
def read_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("qid", "config", "answer_text", F.size("retrieved").alias("n_memories"))


@query(
    f"with {_READ}, jd as (select *, case when contains(answer_text, coalesce(gold_answer, '')) then 0.9::double else 0.0::double end judge_score from rd) "
    "select qid, config, judge_score, case when judge_score >= 0.5 then 1 else 0 end judge_label from jd"
)
def judge_predictions(spark: SparkSession, d: str) -> DataFrame:
    return pl.judge_predictions(_records(spark, d)).select("qid", "config", "judge_score", "judge_label")


@query(
    f"with {_BUDGET}, ctx as (select qid, extractor, string_agg(coalesce(text, ''), chr(10) order by \"rank\") context from run where used <= 1500 group by all), ex as (select distinct extractor from m) "
    "select q.qid, ex.extractor, 'Context:' || chr(10) || coalesce(nullif(context, ''), 'no context') || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') prompt "
    "from q cross join ex left join ctx on ctx.qid = q.qid and ctx.extractor = ex.extractor"
)
def reader_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model reader is given for each question and extractor."""
    found = sparse.bm25_lists(_counted(spark, d), questions(spark, d), EXTRACTED, carried=("qid", "question"), given=("n_words", "text"))
    return found.select("qid", "extractor", reader_prompt(F.col("question"), joined_texts(budgeted(F.col("memories")))).alias("prompt"))


@query(
    f"with {_QA}, p as (select * exclude (rn) from (select *, row_number() over (partition by pred_id order by predicted_at) rn from predictions) where rn = 1) "
    "select pred_id, 'You grade a question-answering system. Decide whether the predicted answer means the same as the gold answer. Reply with exactly one word: yes or no.' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') "
    "|| chr(10) || 'Gold answer: ' || coalesce(gold_answer, '') || chr(10) || 'Predicted answer: ' || coalesce(answer_text, '') prompt, "
    "case when starts_with(lower(trim(coalesce(answer_text, ''))), 'y') then 1.0::double else 0.0::double end verdict from p join q using (qid)"
)
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model judge is given for each prediction, and how the prediction itself would be read as a judge's reply."""
    p = first_delivery(table(spark, d, "predictions"), "pred_id", "predicted_at").join(questions(spark, d).select("qid", "question", "gold_answer"), "qid")
    return p.select("pred_id", judge_prompt(F.col("question"), F.col("gold_answer"), F.col("answer_text")).alias("prompt"), verdict(F.col("answer_text")).alias("verdict"))


@query(
    f"with {_PRED} select p.pred_id, q.conv_id, p.category, q.question, p.gold_answer gold, p.answer_text answer, p.judge_label correct, p.judge_score, array_to_string(p.evidence, ' ') gold_ids, "
    "array_to_string(list_filter(list_transform(range(len(p.retrieved)), lambda i: case when list_position(p.retrieved, p.retrieved[i + 1]) = i + 1 then p.retrieved[i + 1] end), lambda v: v is not null), ' ') retrieved_ids from p join q using (qid)"
)
def question_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the JSON Lines sink, written and read back."""
    p = _scored(spark, d).join(questions(spark, d).select("qid", "question", "conv_id"), "qid")
    one = F.transform("retrieved", lambda x: F.struct(F.lit("").alias("text"), x.alias("source_dia_ids")))
    records = report.question_records(p.withColumn("retrieved_memories", one), "pred_id")
    back = materialize(records, "records", file_format="json", ignoreNullFields="false")
    ids = lambda c: F.array_join(F.filter(c, lambda x: x.isNotNull()), " ")
    return back.select("pred_id", "conv_id", "category", "question", "gold", "answer", "correct", "judge_score", ids("gold_evidence_dia_ids").alias("gold_ids"), ids("retrieved_dia_ids").alias("retrieved_ids"))


# ---------------------------------------------------------------- metrics


def _bare(c: str) -> str:
    once = f"translate(lower(coalesce({c}, '')), '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
    for _ in range(2):
        once = f"regexp_replace({once}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    return f"list_filter(regexp_split_to_array({once}, '{_SPACES}'), lambda w: w <> '')"


_SCORED = (
    f"{_PRED}, b as (select *, {_bare('answer_text')} pt, {_bare('gold_answer')} gt, list_distinct(list_filter(retrieved, lambda x: x is not null)) ids, list_distinct(evidence) gold from p), "
    "o as (select *, coalesce(list_sum(list_transform(list_distinct(pt), lambda w: least(len(list_filter(pt, lambda x: x = w)), len(list_filter(gt, lambda x: x = w))))), 0) common, len(list_intersect(gold, ids))::double hits, "
    "list_position(list_transform(retrieved, lambda x: coalesce(list_contains(gold, x), false)), true) first_hit from b), "
    "s as (select pred_id, qid, config, with_timestamp, category, judge_label::double qa_accuracy, judge_score, (array_to_string(pt, ' ') = array_to_string(gt, ' '))::int::double exact_match, "
    "case when len(pt) = 0 or len(gt) = 0 then (len(pt) = len(gt))::int::double when common = 0 then 0.0 else 2.0 * common / (len(pt) + len(gt)) end token_f1, len(evidence) > 0 has_evidence, len(retrieved)::double n_retrieved, "
    "(hits > 0)::int::double evidence_hit_at_k, case when len(ids) > 0 then hits / len(ids) else 0.0 end evidence_precision_at_k, case when len(gold) > 0 then hits / len(gold) else 0.0 end evidence_recall_at_k, "
    "(len(gold) > 0 and hits = len(gold))::int::double evidence_full_recall_at_k, case when coalesce(first_hit, 0) > 0 then 1.0 / first_hit else 0.0 end mrr from o)"
)
_MEANS = "count(*) n, " + ", ".join(f"round(coalesce(avg({m}), 0.0) + 1e-11, 6) {m}" for m in ANSWER_METRICS) + (
    ", round(avg(n_retrieved) + 1e-11, 6) avg_memories_retrieved, round(avg((n_retrieved = 0)::int) + 1e-11, 6) empty_retrieval_rate, count(*) filter (has_evidence) n_with_evidence, "
) + ", ".join(f"round(coalesce(avg({m}) filter (has_evidence), 0.0) + 1e-11, 6) {m}" for m in EVIDENCE_METRICS)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_predictions(predictions(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    """Means to six digits; the little that is added keeps exact halves from depending on the order of summation."""
    return df.withColumns({m: F.round(F.col(m) + 1e-11, 6) for m in (*ANSWER_METRICS, "avg_memories_retrieved", "empty_retrieval_rate", *EVIDENCE_METRICS)})


@query(f"with {_PRED} select pred_id, array_to_string({_bare('answer_text')}, ' ') answer, array_to_string({_bare('gold_answer')}, ' ') gold from p")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("pred_id", T.normalize_answer(F.col("answer_text")).alias("answer"), T.normalize_answer(F.col("gold_answer")).alias("gold"))


@query(f"with {_SCORED} select pred_id, exact_match from s")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("pred_id", "exact_match")


@query(f"with {_SCORED} select pred_id, round(token_f1, 6) token_f1 from s")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("pred_id", F.round("token_f1", 6).alias("token_f1"))


@query(f"with {_SCORED} select pred_id, " + ", ".join(f"round({m}, 6) {m}" for m in EVIDENCE_METRICS) + " from s")
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("pred_id", *[F.round(m, 6).alias(m) for m in EVIDENCE_METRICS])


@query(f"with {_PRED}, u as (select pred_id, unnest(retrieved) x, unnest(range(len(retrieved))) i from p), f as (select pred_id, x, min(i) i from u where x is not null group by all) "
       "select p.pred_id, coalesce(string_agg(x, ' ' order by i), '') ids from p left join f using (pred_id) group by all")
def source_ids_dedup(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_distinct(F.filter(F.flatten("retrieved"), lambda x: x.isNotNull()))
    return predictions(spark, d).select("pred_id", F.array_join(ids, " ").alias("ids"))


@query(f"with {_SCORED} select config, with_timestamp, {_MEANS} from s group by all")
def summary_overall_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary_overall(_scored(spark, d), ["config", "with_timestamp"]))


@query(f"with {_SCORED} select config, with_timestamp, category, {_MEANS} from s group by all")
def summary_by_category_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary_by_category(_scored(spark, d), ["config", "with_timestamp"]))


_SETS = f"select config, with_timestamp, category, case when grouping(category) = 1 then 'overall' else 'category' end level, {_MEANS} from s group by grouping sets ((config, with_timestamp), (config, with_timestamp, category))"


@query(f"with {_SCORED} {_SETS}")
def summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary(_scored(spark, d), ["config", "with_timestamp"]))


# ---------------------------------------------------------------- grid and pivots

_GRID = (
    "ex as (select unnest(['no_memory', 'append_all', 'regex', 'regex_v2', 'ner']) extractor), rt as (select unnest(['no_retrieval', 'tfidf', 'bm25', 'word2vec', 'word2vec_tfidf', 'sentence_emb', 'sentence_emb_e5']) retriever), "
    "vr as (select unnest(['base', 'timestamp']) variant), g as (select variant, extractor, retriever, extractor || '+' || retriever combo from vr, ex, rt "
    "where (extractor = 'no_memory') = (retriever = 'no_retrieval') and not (variant = 'timestamp' and extractor = 'no_memory'))"
)


@query(f"with {_GRID} select variant, combo, extractor, retriever from g")
def combo_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.combo_grid(spark).drop("config_pos")


@query(f"with {_SCORED}, {_GRID}, r as (select distinct config, with_timestamp from s) select g.variant, g.combo, r.config is not null was_run from g left join r on r.config = g.combo and r.with_timestamp = (g.variant = 'timestamp')")
def variant_union(spark: SparkSession, d: str) -> DataFrame:
    """The planned configurations of both variants, and whether predictions of them exist."""
    ran = predictions(spark, d).select(F.col("config").alias("combo"), F.when(F.col("with_timestamp"), "timestamp").otherwise("base").alias("variant")).distinct().withColumn("r", F.lit(True))
    return grid.combo_grid(spark).join(ran, ["variant", "combo"], "left").select("variant", "combo", F.coalesce("r", F.lit(False)).alias("was_run"))


def _base_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(_scored(spark, d).filter("not with_timestamp"), ["config"])


_OVER = f"{_SCORED}, su as (select config, case when grouping(category) = 1 then 'overall' else 'category' end level, category, avg(qa_accuracy) qa_accuracy, coalesce(avg(evidence_recall_at_k) filter (has_evidence), 0.0) recall from s where not with_timestamp group by grouping sets ((config), (config, category))), ov as (select config, split_part(config, '+', 1) extractor, split_part(config, '+', 2) retriever, coalesce(qa_accuracy, 0.0) acc, recall from su where level = 'overall')"
_COLS = ", ".join(f"round(any_value(acc) filter (retriever = '{r}'), 6) {r}" for r in ("tfidf", "bm25", "word2vec", "word2vec_tfidf", "sentence_emb", "sentence_emb_e5"))


@query(f"with {_OVER} select extractor, {_COLS} from ov where config <> 'no_memory+no_retrieval' group by extractor")
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    m = analyze.matrix_pivot(_base_summary(spark, d))
    return m.withColumns({r: F.round(r, 6) for r in m.columns if r != "extractor"})


@query(f"with {_OVER} select config combo, " + ", ".join(f"round(any_value(coalesce(qa_accuracy, 0.0)) filter (category = {c}), 6) c{c}" for c in (1, 2, 3, 4)) + " from su where level = 'category' group by config")
def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    return analyze.category_pivot(_base_summary(spark, d)).withColumns({f"c{c}": F.round(f"c{c}", 6) for c in (1, 2, 3, 4)})


@query(
    f"with {_OVER}, ab as (select 'regex_v1_v2' ablation, a.retriever setting, a.acc first_value, b.acc second_value from ov a join ov b using (retriever) where a.extractor = 'regex' and b.extractor = 'regex_v2' "
    "union all select 'word2vec_pooling', a.extractor, a.acc, b.acc from ov a join ov b using (extractor) where a.retriever = 'word2vec' and b.retriever = 'word2vec_tfidf') "
    "select ablation, setting, round(first_value, 6) first_value, round(second_value, 6) second_value, round(second_value - first_value, 6) delta from ab"
)
def ablation_deltas(spark: SparkSession, d: str) -> DataFrame:
    return analyze.ablation_deltas(_base_summary(spark, d)).withColumns({c: F.round(c, 6) for c in ("first_value", "second_value", "delta")})


@query(f"with {_OVER}, r as (select *, row_number() over (partition by extractor order by acc desc, retriever desc) rn from ov where config <> 'no_memory+no_retrieval') select extractor, retriever, round(acc, 6) best_value from r where rn = 1")
def best_retriever(spark: SparkSession, d: str) -> DataFrame:
    return analyze.best_retriever(_base_summary(spark, d)).withColumn("best_value", F.round("best_value", 6))


@query(f"with {_OVER} select config combo, extractor, retriever, round(recall, 6) evidence_recall_at_k, round(acc, 6) qa_accuracy from ov where retriever <> 'no_retrieval'")
def recall_accuracy_scatter(spark: SparkSession, d: str) -> DataFrame:
    return analyze.scatter(_base_summary(spark, d)).withColumns({c: F.round(c, 6) for c in ("evidence_recall_at_k", "qa_accuracy")})


def digest_encoder(model_name: str) -> dense.Encoder:
    """Stand-in for a trained sentence encoder: mean of vectors of eight dimensions derived from the digests of model and word."""

    def encode(texts: list[str]) -> list[list[float]]:
        import hashlib
        import re

        import numpy as np

        known: dict[str, int] = {}
        words = [re.findall(r"\w+", text.lower()) for text in texts]
        at = np.array([known.setdefault(w, len(known)) for own in words for w in own], np.int64)
        digests = np.frombuffer(b"".join(hashlib.md5(f"{model_name} {w}".encode()).digest()[:8] for w in known), np.uint8).reshape(-1, 8)
        vectors = (digests.astype(float) - 127.5) / 127.5
        n = np.array([len(own) for own in words], np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        # Sums in the order of the words.
        sums = np.stack([np.bincount(owner, vectors[at, i], minlength=len(n)) for i in range(8)], axis=1)
        return (sums / np.maximum(n, 1)[:, None]).tolist()

    return encode


@query()
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline on the tables: extract from all turns, retrieve by each retriever in both variants, read, judge, summarise.

    Word vectors and sentence encoders are stand-ins derived from digests.
    """
    t = materialize(turns(spark, d), "turns")
    said = t.select(memory_text(True).alias("text"))
    encoders = {name: (model, digest_encoder(model)) for name, model in (("sentence_emb", "bge-stand-in"), ("sentence_emb_e5", "e5-stand-in"))}
    resources = registry.Resources(materialize(word_vectors(spark, d, said), "vectors"), encoders, keep_texts=False)
    return _rounded(pl.summarize(pl.run_grid(t, questions(spark, d), grid.plan(), resources=resources)))
