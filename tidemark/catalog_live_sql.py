"""DuckDB SQL for the queries of catalog_live, written apart from the Spark code."""

from __future__ import annotations

from tidemark.catalog_sql import _HOW, _LAG, _LOCAL, _d, _reads, _with

_LEVELS = 8


def _tree(name: str, rows: str) -> str:
    """CTEs that build the digest tree over rows (k, row)."""
    out = [f"{name}_0 as (select k // 256 as node, count(*) as n, sha256(string_agg(d, '' order by k, d)) as digest from (select k, sha256(row) as d from ({rows})) group by 1)"]
    for i in range(1, _LEVELS + 1):
        out.append(f"{name}_{i} as (select node // 16 as node, sum(n)::BIGINT as n, sha256(string_agg(digest, '' order by node)) as digest from {name}_{i - 1} group by node // 16)")
    union = " union all ".join(f"select {i} as level, node, n, digest from {name}_{i}" for i in range(_LEVELS + 1))
    return ",\n".join([*out, f"{name} as ({union})"])


_RECS = "select id as k, '=' || id || '|=' || owner || '|=' || stage || '|=' || last_modified::BIGINT as row from rec"
_MUTS = "select seq as k, '=' || seq || '|=' || kind || '|=' || record_id || '|' || coalesce('=' || merged_into, '-') as row from mut"
_SIDE = "select id as k, '=' || id || '|=' || version as row from "

_RANGES = """ranges as (select (rn - 1) // greatest(2000, n // 1000) as range, id from (select id, row_number() over (order by last_modified, id) as rn from rec), size),
sized as (select range, count(*) as n from ranges group by range),
tries as (select range, n, case when range < 2 then 1 when range = 2 then 2 else 3 end as attempt from sized)"""

ORACLES: dict[str, str] = {
    "vendor_modified_since": _with("""select 'atlas' as vendor, id, version, last_modified, tombstone from final where not tombstone and last_modified >= 14400
  union all select 'beacon', id, version, last_modified, tombstone from archive where valid_from <= 28800 and (valid_to is null or valid_to > 28800) and last_modified >= 14400""", _HOW),
    "vendor_stream_reads": _with("""select id, seq, version, last_modified from parts left join tops using (part) where top is null or last_modified > top""",
        """parts as (select *, least(3, floor(valid_from / 7200)) as part from ver where valid_from >= 0 and not tombstone),
tops as (select part, max(m) over (order by part rows between unbounded preceding and 1 preceding) as top from (select part, max(last_modified) as m from parts group by part))"""),
    "backfill_resumed": _with("""select range, n, 1 + (range = 2)::BIGINT as n_reads, attempt::BIGINT as attempt, case when attempt = (select max(attempt) from tries) then 0.0::DOUBLE end as watermark from tries""", _RANGES),
    "backfill_copy": _with("select * from rec"),
    "manifest_digest": _with(f"select 'records' as part, n, digest from r where level = {_LEVELS} union all select 'changes', n, digest from m where level = {_LEVELS}", _tree("r", _RECS), _tree("m", _MUTS)),
    "tree_reconcile": _with("""select copy, t.level, count(distinct t.node) as n_nodes, coalesce(any_value(n_asked), 0) as n_asked, coalesce(any_value(n_differing), 0) as n_differing
  from t cross join (values ('passes'), ('rare')) s(copy) left join (
    select copy, level, count(*) as n_asked, count(*) filter (differs) as n_differing from both_ b
    where level = 8 or exists (select 1 from both_ p where p.differs and p.copy = b.copy and p.level = b.level + 1 and p.node = b.node // 16) group by all) a using (copy, level) group by all""",
        _reads("one"), _LOCAL, _tree("t", _SIDE + "truth"), _tree("c", _SIDE + "copy"), _tree("r", _SIDE + "truth where id % 911 <> 5"),
        """others as (select 'passes' as copy, * from c union all select 'rare', * from r),
both_ as (select coalesce(o.copy, t.copy) as copy, coalesce(t.level, o.level) as level, coalesce(t.node, o.node) as node, t.digest is distinct from o.digest as differs
  from (select * from t, (values ('passes'), ('rare')) s(copy)) t full join others o on t.copy = o.copy and t.level = o.level and t.node = o.node)"""),
    "merge_survivors": _with("""select w.record_id, w.at as survivor, w.hops::BIGINT as hops, d.record_id is not null as dead from walk w
  left join merged m on m.record_id = w.at left join dead d on d.record_id = w.at where m.record_id is null""",
        """merged as (select m.record_id, merged_into from mut m left join dead d on d.record_id = m.merged_into where kind = 'MERGE' and (d.death is null or seq < d.death)),
walk as (select record_id, merged_into as at, 1 as hops from merged union all select w.record_id, m.merged_into, hops + 1 from walk w join merged m on m.record_id = w.at)"""),
    "deliveries_as_of": _with("""select event_id, copy, arrival, h.record_id as id, version, tombstone from hooks h join ver v on v.id = h.record_id
  where valid_from <= arrival and (valid_to is null or arrival < valid_to)"""),
    "stream_failure_runs": _with("""select subscription, seq, case when seq >= off then 25 else run end::BIGINT as run, coalesce(seq >= off, false) as disabled
  from runs left join (select subscription, min(seq) as off from runs where run = 25 group by subscription) using (subscription)""", f"""tried as (
  select record_id % 4 as subscription, seq, event_at + {_LAG} between 7200 and 10800 as down from mut),
isles as (select *, sum((not down)::INT) over (partition by subscription order by seq) as island from tried),
runs as (select *, sum(down::INT) over (partition by subscription, island order by seq) as run from isles)"""),
    "stream_first_arrivals": _with("select event_id, seq, arrival from hooks where copy = 0"),
    "stream_hinted_changes": _with("""select m.seq, min(h.us) as hinted_us from (select seq, record_id, round(event_at * 1000000)::BIGINT as us from mut) m left join
  (select record_id, round(arrival * 1000000)::BIGINT as us from hooks where copy = 0) h on h.record_id = m.record_id and h.us between m.us and m.us + 60000000 group by m.seq"""),
    "stream_hint_rereads": _with("""select record_id, event_id, arrival, version, tombstone from hooks join ver on id = record_id
  where copy = 0 and valid_from <= arrival and (valid_to is null or arrival < valid_to)"""),
    "stream_late_rows": _with("""select count(*) as n_sent, count(*) filter (us <= closed) as n_missing, count(*) filter (us <= closed) as n_dropped from given join (
  select part, (max(m) over (order by part rows between unbounded preceding and 1 preceding) // 1000 - 20000) * 1000 as closed
  from (select part, max(us) as m from given group by part)) using (part)""",
        f"""given as (select round(event_at * 1000000)::BIGINT as us, least(2, floor((arrival + case when {_d('held', 'seq')} % 50 = 0 then 9600 else 0 end) / 9600)) as part
  from hooks where copy = 0)"""),
    "store_versions": f"""with e as (select user_id, event_id % 3 as part, {_d('store', 'user_id')} % 64 as b from events),
kept as (select * from e where b < case part when 0 then 64 when 1 then 16 else 4 end),
v as (select distinct part from (values (0), (1), (2)) t(part))
select part + 1 as version, (select count(distinct b) from kept k where k.part = v.part) as n_buckets,
  (select count(distinct user_id) from kept k where k.part <= v.part and b in (select b from kept x where x.part = v.part)) as n_written,
  (select count(distinct user_id) from kept k where k.part <= v.part) as n_rows from v""",
    "result_json_read": _with("""select arm, accuracy, state, n from (select arm, accuracy, unnest(['correct', 'stale', 'missing', 'ghost']) as state, unnest([correct, stale, missing, ghost]) as n from score)""", _reads("sweep")),
    "kind_sentences": _with("""select kind, hour, format('{:,}', n) || ' change' || case when n = 1 then '' else 's' end as said
  from (select kind, floor(event_at / 3600)::BIGINT as hour, count(*) as n from mut group by all)"""),
    "vendor_costs": _with("""select vendor, n as scannable, ceil(n / page::DOUBLE)::BIGINT + 1 as backfill, ceil(m / batch::DOUBLE)::BIGINT as reread,
  ceil(n / bulk::DOUBLE)::BIGINT as bulk_jobs, case when n is not null then greatest(0, case when ceiling is null then 0 else n - ceiling end) end as beyond_search from (
    select vendor, page, batch, ceiling, bulk, count(*) filter (not tombstone or keeps) as n, count(*) filter (not tombstone and valid_from >= 0) as m
    from final, (values ('atlas', 200, 200, null::BIGINT, 100000, false), ('beacon', 100, 100, 10000, null, true)) v(vendor, page, batch, ceiling, bulk, keeps) group by all)"""),
    "score_over_time": _with("""select up_to, count(*) filter (t.version = l.version) as correct, count(*) filter (t.version <> l.version) as stale, count(*) filter (t.version is null) as ghost,
  round_even(count(*) filter (t.version = l.version) / count(t.version)::DOUBLE, 6) as accuracy from (
    select up_to, rec.id, coalesce(arg_max(r.version, pass_no), 1) as version from rec cross join times left join reads r on r.id = rec.id and 300 * pass_no <= up_to group by all) l
  left join (select up_to, id, version from ver, times where valid_from <= up_to and (valid_to is null or valid_to > up_to) and not tombstone) t using (up_to, id) group by up_to""",
        _reads("one"), "times as (select unnest([7200, 14400, 21600, 28800])::BIGINT as up_to)"),
}
