"""Queries of the nested-record and orphan-reference operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.operators.nested import NODE_COLUMNS, node_fields, shred
from memloom.operators.orphans import orphan_references, orphan_report
from memloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(table(spark, sf_dir, "locomo10")).select(*NODE_COLUMNS)


def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_fields(shred(table(spark, sf_dir, "locomo10"), fields=True))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, "qa_items"), table(spark, sf_dir, "turns"), table(spark, sf_dir, "sessions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p4_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_fields": p2_fields, "p4_found": p4_found, "p4_orphan_report": p4_orphan_report}

_P4 = r"""
with qa as (
  select 'qa_items' src_table, qid row_id, conv_id, unnest(evidence_dia_ids) e, ingested_at t from qa_items
), qa_ids as (
  select src_table, row_id, conv_id, t, unnest(regexp_extract_all(e, 'D:?(\d+):(\d+)')) x from qa
), turn_ids as (
  select 'turns' src_table, turn_id row_id, conv_id, ingested_at t, deleted_at, unnest(regexp_extract_all(dia_id, 'D:?(\d+):(\d+)')) x from turns
), ids as (
  select *, cast(regexp_extract(x, 'D:?(\d+):(\d+)', 1) as bigint) n, cast(regexp_extract(x, 'D:?(\d+):(\d+)', 2) as bigint) m
  from (select src_table, row_id, conv_id, t, null::timestamp deleted_at, x from qa_ids union all select src_table, row_id, conv_id, t, deleted_at, x from turn_ids)
), refs as (
  select src_table, row_id, conv_id, n, m, min(t) t from ids group by all
), seen as (
  select r.src_table, r.row_id, r.n, r.m, r.t, p.conv_id is not null found, p.t arrived, p.deleted_at
  from refs r left join (select * from ids where src_table = 'turns') p on r.src_table = 'qa_items' and p.conv_id = r.conv_id and p.n = r.n and p.m = r.m
  where r.src_table = 'qa_items'
  union all
  select r.src_table, r.row_id, r.n, r.m, r.t, p.conv_id is not null, p.ingested_at, p.deleted_at
  from refs r left join sessions p on p.conv_id = r.conv_id and p.session_no = r.n
  where r.src_table = 'turns'
), judged as (
  select src_table, row_id, 'D' || n || ':' || m dia_id, strftime(t, '%Y-%m') period_month,
    case when not bool_or(found) then 'missing'
         when bool_or(arrived <= t and (deleted_at is null or deleted_at > t)) then 'there'
         when min(arrived) > t then 'late' else 'deleted' end status
  from seen group by src_table, row_id, n, m, t
)
"""



def _document(column: str) -> str:
    """SQL for the JSON of a text that is wholly valid, unwrapped if it holds its JSON as one string."""
    unwrapped = f"case when json_valid({column}) then case when json_type({column}) = 'VARCHAR' then json_extract_string({column}, '$') else {column} end end"
    return f"(select record_id, case when json_valid(t) then t::json end c from (select record_id, {unwrapped} t from locomo10))"


def _listed(v: str) -> str:
    """SQL for an array's elements; a lone value is an array of one, null or missing an empty one."""
    return f"case when {v} is null or json_type({v}) = 'NULL' then []::json[] when json_type({v}) = 'ARRAY' then {v}::json[] else [{v}] end"


_P2_PARTS = f"""
with k as (select record_id, c, unnest(json_keys(c)) sid from {_document('conversation')} where json_type(c) = 'OBJECT'),
s as (select record_id, sid, json_extract(c, '$."' || sid || '"') v from k where regexp_full_match(sid, 'session_[0-9]+')),
s1 as (select * from s where json_type(v) <> 'NULL'),
t as (select record_id, sid, unnest({_listed('v')}) t, unnest(range(len({_listed('v')}))) i from s1),
t1 as (select *, {_listed("json_extract(t, '$.img_url')")} urls from t where json_type(t) <> 'NULL'),
u as (select record_id, sid, i, unnest(urls) url, unnest(range(len(urls))) j from t1),
q as (select record_id, unnest({_listed('c')}) q, unnest(range(len({_listed('c')}))) i from {_document('qa')}),
q1 as (select *, {_listed("json_extract(q, '$.evidence')")} entries from q where json_type(q) <> 'NULL'),
e as (select record_id, i, flatten(list_transform(entries, lambda x: regexp_extract_all(coalesce(json_extract_string(x, '$'), ''), 'D:?(\\d+):(\\d+)'))) ids from q1),
e1 as (select record_id, i, unnest(ids) id, unnest(range(len(ids))) j from e)
"""

_P2 = _P2_PARTS + r"""
select record_id, 'session' node_kind, 'conversation/' || sid node_path, 'conversation' parent_path, sid node_key from s1
union all select record_id, 'turn', 'conversation/' || sid || '/' || i, 'conversation/' || sid, coalesce(json_extract_string(t, '$.dia_id'), '') from t1
union all select record_id, 'image', 'conversation/' || sid || '/' || i || '/img_url/' || j, 'conversation/' || sid || '/' || i, json_extract_string(url, '$') from u where json_type(url) <> 'NULL'
union all select record_id, 'qa', 'qa/' || i, 'qa', coalesce(json_extract_string(q, '$.category'), '') from q1
union all select record_id, 'evidence', 'qa/' || i || '/evidence/' || j, 'qa/' || i, 'D' || regexp_extract(id, 'D:?(\d+):(\d+)', 1)::bigint || ':' || regexp_extract(id, 'D:?(\d+):(\d+)', 2)::bigint from e1
"""

_P2_FIELDS = _P2_PARTS + r""",
o as (select distinct record_id, 'conversation' node_kind, 'conversation' node_path, c o, 'c' w from k
  union all select record_id, 'turn', 'conversation/' || sid || '/' || i, t, 't' from t1 where json_type(t) = 'OBJECT'
  union all select record_id, 'qa', 'qa/' || i, q, 'q' from q1 where json_type(q) = 'OBJECT'),
f as (select record_id, node_kind, node_path, o, unnest(json_keys(o)) field from o),
named as (
  select record_id, node_kind, node_path, field, json_extract(o, '$."' || field || '"') v from f
  where not (node_kind = 'conversation' and regexp_full_match(field, 'session_[0-9]+(_.*)?')) and field not in ('img_url', 'evidence')
  union all
  select s1.record_id, 'session', 'conversation/' || s1.sid, substr(x.sid, length(s1.sid) + 2), json_extract(x.c, '$."' || x.sid || '"')
  from s1 join k x on x.record_id = s1.record_id and starts_with(x.sid, s1.sid || '_')
)
select record_id, node_kind, node_path, field, json_extract_string(v, '$') as value from named where json_type(v) not in ('NULL', 'OBJECT', 'ARRAY')
"""

ORACLES = {
    "p2_found": _P2,
    "p2_fields": _P2_FIELDS,
    "p4_found": _P4 + "select * from judged where status <> 'there'",
    "p4_orphan_report": _P4 + "select src_table, period_month, status, count(*) n_orphans from judged where status <> 'there' group by all",
}
