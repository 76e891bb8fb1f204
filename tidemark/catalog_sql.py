"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations


def _d(tag: str, key: str) -> str:
    return f"(('0x' || substr(md5('{tag}|' || {key}), 1, 8))::BIGINT)"


_LAG = f"(2.0::DOUBLE + ({_d('wd', 'seq')} % 8000) / 1000.0::DOUBLE)"
BASE = f"""
size as (select count(*) as n, min(o_orderkey) as low from orders),
rec as (select o_orderkey as id, o_orderpriority as owner, o_orderstatus as stage, o_totalprice as amount,
  (-({_d('lm', 'o_orderkey')} % 864000))::DOUBLE as last_modified from orders),
raw0 as (select event_id + 1 as seq, n, low, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1e6::DOUBLE / 90 as event_at from events, size),
raw1 as (select seq, event_at, {_d('k', 'seq')} % 100 as k, low + {_d('r1', 'seq')} % (1 + {_d('r2', 'seq')} % n) as record_id,
  low + {_d('mg', 'seq')} % n as partner from raw0),
raw2 as (select *, case when k < 60 then 'UPDATE' when k < 68 then 'SILENT_UPDATE' when k < 78 then 'IN_FLIGHT_UPDATE'
  when k < 85 then 'LATE_CLOCK_UPDATE' when k < 96 then 'DELETE' when partner = record_id then 'UPDATE' else 'MERGE' end as kind from raw1),
dead as (select record_id, min(seq) as death from raw2 where kind in ('DELETE', 'MERGE') group by record_id),
mut as (select seq, event_at, kind, r.record_id, case kind when 'UPDATE' then event_at
    when 'IN_FLIGHT_UPDATE' then event_at - ({_d('bk', 'seq')} % 120)::DOUBLE when 'LATE_CLOCK_UPDATE' then event_at - 11.0::DOUBLE end as stamp,
  case when kind = 'MERGE' then partner end as merged_into, death
  from raw2 r left join dead d on d.record_id = r.record_id where death is null or seq <= death
  union all select m.seq, event_at, 'UPDATE', moved_to, event_at, null, e.death from (
    select seq, event_at, low + (seq * 7 + r.record_id) % n as moved_to from raw2 r join dead d using (record_id), size where seq > death) m
  left join dead e on e.record_id = m.moved_to where e.death is null or m.seq < e.death),
eff as (
  select id, 0::BIGINT as seq, -1.0::DOUBLE as event_at, last_modified as stamp, 0 as bump, false as kill from rec
  union all select record_id, seq, event_at, stamp, (kind not in ('DELETE', 'MERGE'))::INT, kind in ('DELETE', 'MERGE') from mut
  union all select merged_into, seq, event_at, event_at, 1, false from mut m left join dead d on d.record_id = m.merged_into
    where kind = 'MERGE' and (d.death is null or seq < d.death)),
ver as (select id, seq, event_at as valid_from, lead(event_at) over w as valid_to, (1 + sum(bump) over w)::BIGINT as version,
  max(stamp) over w as last_modified, kill as tombstone from eff window w as (partition by id order by seq)),
final as (select * from ver where valid_from <= 28800 and (valid_to is null or valid_to > 28800)),
truth as (select id, version from final where not tombstone),
pass as (select unnest(range(1, 97)) as pass_no),
held as (select pass_no, v.* from pass, ver v where valid_from <= 300 * pass_no and (valid_to is null or valid_to > 300 * pass_no)
  and not tombstone and last_modified >= -1800),
marks0 as (select pass_no, max(last_modified) filter (last_modified >= 0) as pass_max from held group by pass_no),
marks1 as (select pass_no, pass_max, greatest(0.0::DOUBLE, coalesce(max(pass_max) over (order by pass_no), 0.0::DOUBLE)) as watermark
  from pass left join marks0 using (pass_no)),
marks as (select *, coalesce(lag(watermark) over (order by pass_no), 0.0::DOUBLE) as lower from marks1),
ladder as (select * from (values ('0 naive', 0.0::DOUBLE, false), ('1 inclusive', 0.0::DOUBLE, true), ('2 overlap_60', 60.0::DOUBLE, true),
  ('3 overlap_300', 300.0::DOUBLE, true)) t(arm, overlap, inclusive)),
sweep as (select printf('overlap_%04d', o) as arm, o::DOUBLE as overlap, true as inclusive from (values (0), (30), (60), (120), (300), (600), (1800)) t(o)),
one as (select 'a' as arm, 120.0::DOUBLE as overlap, true as inclusive),
deep as (select 'a' as arm, 1800.0::DOUBLE as overlap, true as inclusive),
sent as (select event_at + {_LAG} + (case when {_d('wr', 'seq')} % 100 < 4 then 30.0::DOUBLE else 0.0::DOUBLE end) as first, *
  from mut where {_d('wl', 'seq')} % 100 >= 3),
hooks as (select first + copy as arrival, 'evt-' || seq as event_id, record_id, event_at, seq, copy::INT as copy
  from sent, (values (0), (1)) c(copy) where copy = 0 or {_d('w2', 'seq')} % 100 < 5)
"""


def _reads(arms: str) -> str:
    return f"""reads as (select arm, pass_no, id, version, last_modified from held join marks using (pass_no), {arms}
  where last_modified >= lower - overlap + case when inclusive then 0.0::DOUBLE else 1e-9::DOUBLE end),
local as (select a.arm, rec.id, coalesce(l.version, 1) as version from rec cross join {arms} a
  left join (select arm, id, arg_max(version, pass_no) as version from reads group by arm, id) l on l.arm = a.arm and l.id = rec.id),
compared as (select l.arm, l.id, case when t.id is null then 'ghost' when t.version = l.version then 'correct' else 'stale' end as state
  from local l left join truth t on t.id = l.id),
score as (select arm, count(*) filter (state = 'correct') as correct, count(*) filter (state = 'stale') as stale, 0::BIGINT as missing,
  count(*) filter (state = 'ghost') as ghost, count(*) filter (state <> 'correct') as wrong,
  round_even(count(*) filter (state = 'correct') / count(*) filter (state <> 'ghost')::DOUBLE, 6) as accuracy,
  round_even(count(*) filter (state = 'correct') / count(*)::DOUBLE, 6) as held_accuracy from compared group by arm)"""


_LOCAL = """copy as (select l.id, l.version from local l join final f on f.id = l.id
  where not (f.tombstone and l.id % 7 <> 0) and l.id % 911 <> 5),
drift as (select coalesce(t.id, c.id) as id, case when c.id is null then 'missing' when t.id is null then 'ghost' else 'wrong' end as drift_kind
  from truth t full join copy c on t.id = c.id where c.id is null or t.id is null or t.version <> c.version)"""


def _with(select: str, *more: str) -> str:
    return "with recursive " + ",\n".join([BASE, *more]) + "\n" + select


_PAGED = "paged as (select o_orderkey, o_orderdate, o_totalprice, (row_number() over (order by o_orderdate, o_orderkey) - 1) // 200 as page_no from orders)"


def _sums(bits: int, side: str, n: int) -> str:
    return f"""select {_d('part', 'id')} % {n} as bucket, count(*) as n, sum({_d('sum1', 'id')} % 2147483648) as a,
  sum({_d('sum2', 'id')} % 2147483648) as b from {side} group by 1"""


_DIFFER = f"""differ as (select coalesce(t.bucket, c.bucket) as bucket, coalesce(t.n, 0) as upstream_n, coalesce(c.n, 0) as local_n
  from ({_sums(31, 'truth', '{n}')}) t full join ({_sums(31, 'copy', '{n}')}) c on t.bucket = c.bucket
  where t.n is distinct from c.n or t.a is distinct from c.a or t.b is distinct from c.b)"""

_MATRIX = f"""matrix as (select strategy, calls::BIGINT as calls, present, detected, present - detected as missed,
  round_even(coalesce(detected / nullif(present, 0)::DOUBLE, 0), 6) as rate, round_even(1000 * calls / n::DOUBLE, 6) as calls_per_1k
  from (select count(*) as n from truth), (select count(*) as bad from differ),
    (select count(*) as present, count(*) filter (drift_kind <> 'wrong') as by_id,
      count(*) filter (drift_kind <> 'wrong' and {_d('part', 'id')} % 40 in (select bucket from differ)) as in_bad from drift),
    lateral (values ('none', 0, 0), ('count_check', 1, 0), ('partitioned_checksum', 40 + bad, in_bad),
      ('full_id_inventory', n // 1000 + 1, by_id), ('full_field_compare', ceil(n / 200.0)::BIGINT, present)) s(strategy, calls, detected))"""

_ARRIVALS = f"""arrivals as (select user_id, value, event_id as version, (event_id + {_d('late', 'event_id')} % 50) * 1000000000 + event_id as arrival_no from events)"""


_CALLS = """calls as (select user_id, event_id + 1 as seq, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1e6::DOUBLE / 90 as t from events),
numbered as (select *, row_number() over (partition by user_id order by t, seq) as call_no from calls)"""


ORACLES: dict[str, str] = {
    "modified_since_scan": "select o_orderkey, o_orderdate, o_totalprice from orders where o_orderdate >= '2000-01-01' order by o_orderdate, o_orderkey limit 200",
    "modified_since_cursor_page": """select o_orderkey, o_orderdate, o_totalprice from orders where o_orderdate >= '2000-01-01'
  and (o_orderdate, o_orderkey) > (timestamp '2000-03-01', 7500) order by o_orderdate, o_orderkey limit 200""",
    "page_assignment": f"with {_PAGED} select * from paged",
    "tie_group_boundaries": f"""with {_PAGED} select o_orderdate, min(page_no) as first_page, max(page_no) as last_page, count(*) as n_rows
  from paged group by 1 having min(page_no) < max(page_no)""",
    "strict_vs_inclusive": """select count(*) filter (o_orderdate >= '2000-03-01') as inclusive, count(*) filter (o_orderdate > '2000-03-01') as strict,
  count(*) filter (o_orderdate = '2000-03-01') as lost from orders""",
    "search_ceiling": "select least(count(*), 10000) as reachable, greatest(count(*) - 10000, 0) as beyond from orders",
    "search_offset_page": """select * from (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as rn from orders)
  where rn > 1200 and rn <= 1300""",
    "world_records": _with("select * from rec"),
    "world_mutations": _with("select seq, event_at, kind, record_id, stamp, merged_into from mut"),
    "mutation_kind_counts": _with("select kind, count(*) as n, count(distinct record_id) as n_records from mut group by kind"),
    "future_stamp_violations": _with("select kind, count(*) filter (stamp > event_at) as n_future from mut group by kind"),
    "scd2_versions": _with("select * from ver"),
    "snapshot_as_of": _with("""select t, count(*) filter (not tombstone) as n_live, count(*) filter (tombstone) as n_dead,
  sum(version)::BIGINT as sum_version, max(last_modified) as max_stamp
  from ver, (values (0.0::DOUBLE), (7200.0), (14400.0), (28800.0)) x(t) where valid_from <= t and (valid_to is null or valid_to > t) group by t"""),
    "live_count": _with("select count(*) as n_live from truth"),
    "scannable_vs_live": _with("select count(*) as n_scannable, count(*) filter (not tombstone) as n_live from final"),
    "id_inventory_page": _with("select id from truth order by id limit 1000 offset 2000"),
    "get_by_ids": _with("select id, version from truth where id < 400 and id % 2 = 0"),
    "bulk_export": _with("""select count(*) as n_rows, sum(version)::BIGINT as sum_version from (select version from ver
  where valid_from <= 900.05::DOUBLE and (valid_to is null or valid_to > 900.05::DOUBLE) and not tombstone order by id limit 100000)"""),
    "deletes_window": _with("""select greatest(1, ceil(event_at / 300))::BIGINT as pass_no, count(*) as n_deletes from mut
  where kind in ('DELETE', 'MERGE') group by 1 having pass_no <= 96"""),
    "deletes_forgotten": _with("""select count(*) filter (event_at < 21600) as n_forgotten, count(*) filter (event_at >= 21600) as n_visible
  from mut where kind in ('DELETE', 'MERGE')"""),
    "manifest_checksum": _with("select " + ", ".join(f"""sum({_d(f'row{i}', "(id || '|' || owner || '|' || stage || '|' || last_modified::BIGINT)")})::BIGINT as sum{i}""" for i in range(4)) + ", count(*) as n from rec"),
    "pass_watermarks": _with("select * from marks"),
    "overlap_reads": _with("select arm, pass_no, count(*) as n_read from reads group by all", _reads("sweep")),
    "timestamp_only_page_loss": _with("""select pass_no, count(*) filter (rn > 200) as n_lost, count(*) as n_rows
  from (select *, row_number() over (partition by pass_no order by last_modified, id) as rn from reads) group by pass_no""", _reads("deep")),
    "redundant_reads": _with("""select arm, count(*) filter (version = was) as n_redundant
  from (select *, coalesce(lag(version) over (partition by arm, id order by pass_no), 1) as was from reads) group by arm""", _reads("sweep")),
    "mitigation_ladder": _with("select *, coalesce(lag(wrong) over (order by arm) - wrong, 0) as gain from score", _reads("ladder")),
    "overlap_sweep": _with("select arm, stale, ghost, wrong, accuracy from score", _reads("sweep")),
    "overlap_knee": _with("select min(arm) as knee, min(best) as best from score, (select min(wrong) as best from score) where wrong <= best + 1", _reads("sweep")),
    "attribute_wrong": _with("""select coalesce(cause, 'unattributed') as cause, count(*) as n from (select id from compared where state <> 'correct')
  left join (select record_id, arg_max(kind, seq) as cause from mut group by 1) on record_id = id group by 1""", _reads("one")),
    "drift_report": _with("select * from drift", _reads("one"), _LOCAL),
    "count_check": _with("select *, upstream_n <> local_n as differs from (select count(*) as upstream_n from truth), (select count(*) as local_n from copy)", _reads("one"), _LOCAL),
    "partitioned_checksum": _with("select * from differ", _reads("one"), _LOCAL, _DIFFER.replace("{n}", "400")),
    "full_id_inventory": _with("select * from drift where drift_kind <> 'wrong'", _reads("one"), _LOCAL),
    "recon_matrix": _with("select strategy, calls, present, detected, missed, rate, calls_per_1k from matrix", _reads("one"), _LOCAL, _DIFFER.replace("{n}", "40"), _MATRIX),
    "recon_cost": _with("select strategy, calls, detected, calls_per_1k, round_even(detected / nullif(calls, 0)::DOUBLE, 6) as detected_per_call from matrix",
        _reads("one"), _LOCAL, _DIFFER.replace("{n}", "40"), _MATRIX),
    "webhook_deliveries": _with("select * from hooks"),
    "webhook_dedup": _with("select event_id, arrival, record_id, event_at, seq from hooks where copy = 0"),
    "channel_stats": _with(f"""select count(*) as emitted, count(*) filter (not sent) as lost,
  count(*) filter (sent and {_d('w2', 'seq')} % 100 < 5) as duplicated, count(*) filter (sent and {_d('wr', 'seq')} % 100 < 4) as reordered
  from (select *, {_d('wl', 'seq')} % 100 >= 3 as sent from mut)"""),
    "subscription_disable": _with("""select min(seq) filter (down and run = 25) as disabled_seq, arg_min(arrival, seq) filter (down and run = 25) as disabled_at,
  max(run)::BIGINT as longest_run, count(*) filter (down) as n_failed from runs""", f"""tried as (select seq, event_at + {_LAG} as arrival from mut),
flagged as (select *, arrival between 7200 and 10800 as down from tried),
isles as (select *, sum((not down)::INT) over (order by seq) as island from flagged),
runs as (select *, sum(down::INT) over (partition by island order by seq) as run from isles)"""),
    "upsert_latest": "select user_id, max(event_id) as version, arg_max(value, event_id) as value from events group by user_id",
    "out_of_order_rejects": f"""with {_ARRIVALS} select user_id, count(*) filter (version < was) as n_rejected, count(*) as n_writes
  from (select *, max(version) over (partition by user_id order by arrival_no rows between unbounded preceding and 1 preceding) as was from arrivals) group by 1""",
    "redundant_upserts": _with("select record_id, count(*) - count(distinct seq) as n_redundant from hooks group by 1 having count(*) > count(distinct seq)"),
    "resurrections": """select user_id, count(*) as n_back from (select user_id, event_type = 'error' as mark,
  lag(event_type = 'error') over (partition by user_id order by event_id) as was from events) where was and not mark group by 1""",
    "access_pattern_cost": """select page_size::BIGINT as page_size, ceil(n / page_size)::BIGINT + 1 as paged, ceil(n / page_size)::BIGINT + 1 + n as detail, 1::BIGINT as bulk
  from (select count(*)::DOUBLE as f, count(*) as n from orders), (values (20), (100), (200)) t(page_size)""",
    "fixed_sleep_schedule": f"""with {_CALLS} select user_id, seq, call_no, greatest(t, call_no * 300.0::DOUBLE
  + max(t - call_no * 300.0::DOUBLE) over (partition by user_id order by t, seq)) as start from numbered""",
    "token_bucket_schedule": f"""with {_CALLS}, full_at as (select *, call_no / {1 / 300!r}::DOUBLE + max(t - call_no / {1 / 300!r}::DOUBLE) over (
    partition by user_id order by t, seq rows between unbounded preceding and 1 preceding) as f from numbered)
select user_id, seq, call_no, coalesce(greatest(t, f - {2 / (1 / 300)!r}::DOUBLE), t) as start from full_at""",
    "rate_window_admission": f"""with {_CALLS}, fine as (select *, round(t * 1000000)::BIGINT as us from calls)
select user_id, seq, n as in_window, n > 3 as over from (
  select *, count(*) over (partition by user_id order by us range between 899999999 preceding and current row) as n from fine)""",
    "score": _with("select * from score", _reads("one")),
    "local_live": _with("select * from copy", _reads("one"), _LOCAL),
    "store_state": f"""with log as (select user_id, event_type = 'error' as mark, event_id as version,
  (event_id + {_d('late', 'event_id')} % 50) * 1000000000 + event_id as arrival_no from events),
sent as (select *, max(version) over (partition by user_id order by arrival_no rows between unbounded preceding and 1 preceding) as was from log where not mark),
kept as (select user_id, max(version) as version, max(arrival_no) as written from sent where was is null or version >= was group by 1),
gone as (select user_id, max(arrival_no) as marked from log where mark group by 1)
select user_id, version, coalesce(marked > written, false) as deleted from kept left join gone using (user_id)""",
    "bar_chart_kinds": _with("""select kind as label, rpad(kind, wide::INT, ' ') || '  ' || rpad(repeat('#', case when n = 0 then 0 else greatest(1, round_even(44 * n / top::DOUBLE, 0)::INT) end), 44, ' ') || ' ' || n as line
  from (select *, max(n) over () as top, max(length(kind)) over () as wide from (select kind, count(*) as n from mut group by kind))"""),
    "ext_loss_rollup": _with("""select kind, hour, count(*) as n, grouping(kind, hour)::BIGINT as level
  from (select kind, floor(event_at / 3600)::BIGINT as hour from mut) group by rollup (kind, hour)"""),
    "ext_change_rate_window": _with("select (floor(event_at / 300) * 300)::BIGINT as window_start, count(*) as n, count(distinct record_id) as n_records from mut group by 1"),
    "ext_record_sessions": _with("""select record_id, session::BIGINT as session, count(*) as n, min(event_at) as first_at, max(event_at) as last_at
  from (select *, sum((gap is null or gap > 600)::INT) over (partition by record_id order by seq) as session
        from (select *, event_at - lag(event_at) over (partition by record_id order by seq) as gap from mut)) group by 1, 2"""),
}

_HOW = f"""archive as (
  select id, seq, event_at as valid_from, lead(event_at) over w as valid_to, (1 + sum(bump) over w)::BIGINT as version,
    max(case when kill then event_at else stamp end) over w as last_modified, kill as tombstone from eff window w as (partition by id order by seq)),
held2 as (select pass_no, v.* from pass, archive v where valid_from <= 300 * pass_no and (valid_to is null or valid_to > 300 * pass_no) and last_modified >= -1800),
marks2 as (select pass_no, coalesce(lag(watermark) over (order by pass_no), 0.0::DOUBLE) as lower from (
  select pass_no, greatest(0.0::DOUBLE, coalesce(max(m) over (order by pass_no), 0.0::DOUBLE)) as watermark from pass left join
    (select pass_no, max(last_modified) filter (last_modified >= 0) as m from held2 group by pass_no) using (pass_no))),
rungs as (select * from (values ('0 naive', 0.0::DOUBLE, false, false), ('1 inclusive', 0.0::DOUBLE, true, false), ('2 overlap_60', 60.0::DOUBLE, true, false),
  ('3 overlap_300', 300.0::DOUBLE, true, false), ('4 deletions', 300.0::DOUBLE, true, true), ('5 deletions, outage', 300.0::DOUBLE, true, true)) t(arm, overlap, inclusive, deletes)),
marks3 as (select arm, pass_no, greatest(0.0::DOUBLE, coalesce(max(pass_max) filter (not (arm[1] = '5' and pass_no between 25 and 60))
    over (partition by arm order by pass_no rows between unbounded preceding and 1 preceding), 0.0::DOUBLE)) as lower from marks, rungs),
told as (select distinct arm, id from rungs join marks3 using (arm), (select record_id as id, event_at from mut where seq = death)
  where deletes and not (arm[1] = '5' and pass_no between 25 and 60) and event_at between lower - overlap and 300 * pass_no and event_at >= 300 * pass_no - 7200),
seen as (
  select 'atlas' as vendor, arm, pass_no, id, version, tombstone from held join marks3 using (pass_no) join rungs using (arm)
    where last_modified >= lower - overlap + case when inclusive then 0.0::DOUBLE else 1e-9::DOUBLE end
  union all select 'beacon', arm, pass_no, id, version, tombstone from held2 join marks2 using (pass_no), rungs
    where last_modified >= lower - overlap + case when inclusive then 0.0::DOUBLE else 1e-9::DOUBLE end),
latest as (select vendor, arm, id, arg_max(version, pass_no) as version, arg_max(tombstone, pass_no) as gone from seen group by all),
copies as (select v.vendor, r.arm, rec.id, coalesce(l.version, 1) as version from rec cross join rungs r cross join (values ('atlas'), ('beacon')) v(vendor)
  left join latest l on l.vendor = v.vendor and l.arm = r.arm and l.id = rec.id left join told d on d.arm = r.arm and d.id = rec.id
  where not (r.deletes and case v.vendor when 'atlas' then d.id is not null else coalesce(l.gone, false) end)),
judged as (select c.vendor, c.arm, c.id, case when t.id is null then 'ghost' when t.version = c.version then 'correct' else 'stale' end as state
  from copies c left join truth t on t.id = c.id),
lost as (select vendor, arm, (select count(*) from truth) - count(*) filter (state <> 'ghost') as missing from judged group by all),
ladders as (select vendor, arm, count(*) filter (state = 'stale') as stale, any_value(missing) as missing, count(*) filter (state = 'ghost') as ghost,
  count(*) filter (state <> 'correct') + any_value(missing) as wrong from judged join lost using (vendor, arm) group by all)"""

_READ = f"""polls as (select id as record_id, (300 * pass_no)::DOUBLE as t from held join marks using (pass_no) where last_modified >= lower - 120),
tells as (select record_id, min(300 * pass_no)::DOUBLE as t from mut, marks where seq = death and event_at between lower - 120 and 300 * pass_no
  and event_at >= 300 * pass_no - 7200 group by record_id),
tried as (select seq, event_at + {_LAG} as arrival from mut),
flagged as (select *, arrival between 7200 and 10800 as down from tried),
isles as (select *, sum((not down)::INT) over (order by seq) as island from flagged),
runs as (select *, sum(down::INT) over (partition by island order by seq) as run from isles),
disabled as (select min(seq) as s from runs where down and run = 25),
hints as (select record_id, arrival as t, false as out, seq from hooks where copy = 0
  union all select record_id, arrival, true, seq from hooks, disabled where copy = 0 and not arrival between 7200 and 10800 and (s is null or seq < s)),
asked as (select false as end_, seq, kind, record_id, event_at as t from mut
  union all select true, seq, case when tombstone then 'DELETE' else 'UPDATE' end, id, valid_from from final where valid_from >= 0),
log as (select o.out, end_, record_id, t, 0 as what, seq, kind, null::DOUBLE as hook, null::DOUBLE as poll, null::DOUBLE as tell from asked, (values (false), (true)) o(out)
  union all select out, e.end_, record_id, t, 1, null, null, t, null, null from hints, (values (false), (true)) e(end_)
  union all select o.out, e.end_, record_id, t, 1, null, null, null, t, null from polls, (values (false), (true)) o(out), (values (false), (true)) e(end_)
  union all select o.out, e.end_, record_id, t, 1, null, null, null, null, t from tells, (values (false), (true)) o(out), (values (false), (true)) e(end_)),
found as (select *, min(hook) over w as hook_at, min(poll) over w as poll_at, min(tell) over w as tell_at from log
  window w as (partition by out, end_, record_id order by t, what rows between current row and unbounded following)),
sides as (select out, end_, seq, kind, t as event_at, hook_at, case when kind in ('DELETE', 'MERGE') then tell_at else poll_at end as poll_at from found where what = 0),
ways as (select * from (values ('both', false, true, true), ('both_outage', true, true, true), ('poll', false, false, true), ('webhook', false, true, false)) w(arm, out, hook, poll)),
timed2 as (select arm, end_, seq, kind, event_at, case when hook and hook_at <= 28800 then hook_at end as h, case when poll and poll_at <= 28800 then poll_at end as p
  from sides join ways using (out)),
verdicts as (select arm, end_, seq, kind, least(h, p) - event_at as latency,
  case when h is not null and h = least(h, p) then 'webhook' when least(h, p) is not null then 'poll' end as source from timed2),
credit as (select arm, seq, kind, latency, source from verdicts where not end_),
detected as (select seq, kind, latency, source from credit where arm = 'both'),
ranked2 as (select *, row_number() over (partition by arm order by latency) - 1 as i, count(*) over (partition by arm) as n from credit where latency is not null),
middle as (select arm, max(latency) filter (i = least(n - 1, greatest(0, round_even(0.5 * n + 0.5, 0)::BIGINT - 1))) as p50,
  max(latency) filter (i = least(n - 1, greatest(0, round_even(0.95 * n::DOUBLE + 0.5, 0)::BIGINT - 1))) as p95 from ranked2 group by arm)"""

_STORE = f"""{_ARRIVALS},
writes as (select arrivals.user_id, version, arrival_no, event_type = 'error' as mark from arrivals join events on event_id = version),
stored as (select * from writes union all select user_id, version, arrival_no + 500000000, mark from writes where {_d('again', 'version')} % 20 = 0)"""


def _bars(rows: str) -> str:
    return f"""select label, rpad(label, wide::INT, ' ') || '  ' || rpad(repeat('#', case when n = 0 or top = 0 then 0 else greatest(1, round_even(44 * n / top::DOUBLE, 0)::INT) end), 44, ' ') || ' ' || n as line
  from (select *, max(n) over () as top, max(length(label)) over () as wide from ({rows}))"""


_FAIL = f"""bad as (select pass_no from pass where pass_no = 1 or {_d('fail', 'pass_no')} % 10 = 0),
guarded as (select pass_no, max(case when pass_no not in (select pass_no from bad) then greatest(0.0::DOUBLE, coalesce(pass_max, 0.0::DOUBLE)) end)
  over (order by pass_no rows between unbounded preceding and 1 preceding) as lower from marks),
live as (select pass_no, last_modified from pass, ver where valid_from <= 300 * pass_no and (valid_to is null or valid_to > 300 * pass_no) and not tombstone)"""

ORACLES |= {
    "detection_latency": _with("select * from detected", _READ),
    "latency_percentiles": _with("""select source, n, max(latency) filter (i = least(n - 1, greatest(0, round_even(0.5 * n + 0.5, 0)::BIGINT - 1))) as p50,
  max(latency) filter (i = least(n - 1, greatest(0, round_even(0.95 * n::DOUBLE + 0.5, 0)::BIGINT - 1))) as p95,
  max(latency) filter (i = least(n - 1, greatest(0, round_even(n::DOUBLE + 0.5, 0)::BIGINT - 1))) as p100
  from (select *, row_number() over (partition by source order by latency) - 1 as i, count(*) over (partition by source) as n
        from detected where latency is not null) group by source, n""", _READ),
    "webhook_poll_delta": _with("""select kind, count(*) filter (source = 'webhook') as by_webhook, count(*) filter (source = 'poll') as by_poll,
  count(*) filter (source is null) as undetected from detected group by kind""", _READ),
    "deletion_ladder": _with("select vendor, arm, stale, missing, ghost, wrong from ladders", _HOW),
    "prediction_tally": _with("""select verdict, count(*) as n from (select case when wrong <= was then 'HELD' else 'REFUTED' end as verdict
  from (select *, lag(wrong) over (partition by vendor order by arm) as was from ladders) where was is not null) group by 1""", _HOW),
    "bar_chart_ghosts": _with(_bars("select vendor || ' ' || arm as label, ghost as n from ladders"), _HOW),
    "score_by_kind": _with("""select kind, count(*) as happened, count(*) filter (kind not in ('DELETE', 'MERGE') and death is null and state = 'correct') as reflected,
  count(*) filter (kind not in ('DELETE', 'MERGE') and death is not null) as superseded,
  count(*) filter (kind in ('DELETE', 'MERGE') or death is null and state <> 'correct') as missed from mut left join compared on id = record_id group by kind""", _reads("one")),
    "score_by_kind_arms": _with("""select arm, kind, count(*) as happened,
  count(*) filter (case when kind in ('DELETE', 'MERGE') then deletes else death is null and state = 'correct' end) as reflected,
  count(*) filter (kind not in ('DELETE', 'MERGE') and death is not null) as superseded,
  count(*) filter (case when kind in ('DELETE', 'MERGE') then not deletes else death is null and state <> 'correct' end) as missed
  from mut cross join (values ('deletes', true), ('plain', false)) a(arm, deletes)
    left join (select id, state from compared) c on c.id = record_id group by all""", _reads("one")),
    "channel_arms": _with("""select arm, n_changes, n_detected, n_changes - n_detected as n_missed, by_webhook, by_poll, max_latency, p50, p95, wrong,
    (poll::INT * (select sum(n // 200) + 192 from (select count(*) as n from polls group by t)) + hook::INT * (select count(*) from hints h where h.out = ways.out))::BIGINT as calls,
    hook::INT * (select count(*) from hooks where copy = 1 and seq in (select seq from hints h where h.out = ways.out)) as absorbed
  from (select arm, count(*) as n_changes, count(latency) as n_detected, count(*) filter (source = 'webhook') as by_webhook,
    count(*) filter (source = 'poll') as by_poll, max(latency) as max_latency from credit group by arm) left join middle using (arm) join ways using (arm)
    left join (select arm, count(*) filter (latency is null) as wrong from verdicts where end_ group by arm) using (arm)""", _READ),
    "detection_by_read": _with("select seq, kind, latency, source from credit where arm = 'both'", _READ),
    "deletion_accounting": _with("""select arm, kind, count(*) as happened, count(latency) as detected, count(*) - count(latency) as undetected
  from credit where kind in ('DELETE', 'MERGE') group by all""", _READ),
    "frozen_watermarks": _with("""select g.pass_no, any_value(lower) as lower, count(*) as n_read from guarded g join live l
  on l.pass_no = g.pass_no and last_modified >= coalesce(lower - 120, -1e18::DOUBLE) group by g.pass_no""", _FAIL),
    "store_stats": f"""with {_STORE}, held as (select *, max(version) filter (not mark) over w as was from stored
    window w as (partition by user_id order by arrival_no rows between unbounded preceding and 1 preceding)),
  taken as (select *, not mark and (was is null or version >= was) as ok from held),
  state as (select *, coalesce(last_value(case when ok then false when mark then true end ignore nulls) over
    (partition by user_id order by arrival_no rows between unbounded preceding and 1 preceding), false) as marked from taken)
select count(*) filter (not mark) as upserts, count(*) filter (not mark and not ok) as rejected, count(*) filter (not mark and version = was) as redundant,
  count(*) filter (mark and was is not null and not marked) as delete_marks from state""",
    "unversioned_state": f"with {_STORE} select user_id, arg_max(version, arrival_no) as version from stored where not mark group by 1",
    "endpoint_usage": _with("""select endpoint, calls, round_even(calls / sum(calls) over ()::DOUBLE, 6) as share from (
  select 'backfill' as endpoint, (ceil(count(*) / 200.0) + 1)::BIGINT as calls from rec
  union all select 'query_modified_since', (sum(n // 200 + 1) + 96 - count(*))::BIGINT from (select pass_no, count(*) as n from reads group by 1)
  union all select 'get_deleted', 96 union all select 'get_many', count(*) from hooks where copy = 0)""", _reads("one")),
    "short_page_loss": _with("""select cap::BIGINT as cap, pass_no, n as n_rows, case when cap < 200 then greatest(n - cap, 0) else 0 end as n_lost
  from (select pass_no, count(*) as n from reads group by 1), (values (100), (200)) c(cap)""", _reads("one")),
    "world_field_changes": _with(f"""select seq, record_id, ['name', 'owner', 'stage', 'amount', 'region'][{_d('fd', 'seq')} % 5 + 1] as field,
  ({_d('fv', 'seq')} % 1000)::VARCHAR as value from mut where kind not in ('DELETE', 'MERGE')"""),
    "full_field_compare": _with(f"""select field, count(*) as n_values, count(*) filter (t is distinct from l) as n_wrong from (
  select f.record_id, field, arg_max(value, f.seq) as t, arg_max(value, f.seq) filter (v.version <= c.version) as l from (
      select seq, record_id, ['name', 'owner', 'stage', 'amount', 'region'][{_d('fd', 'seq')} % 5 + 1] as field, ({_d('fv', 'seq')} % 1000)::VARCHAR as value
      from mut where kind not in ('DELETE', 'MERGE')) f
    join ver v on v.id = f.record_id and v.seq = f.seq join truth on truth.id = f.record_id join copy c on c.id = f.record_id group by 1, 2) group by 1""", _reads("one"), _LOCAL),
    "world_redirects": _with("""select seq, event_at, r.record_id, low + (seq * 7 + r.record_id) % n as moved_to from raw2 r join dead d using (record_id), size
  where seq > death and not exists (select 1 from dead e where e.record_id = low + (r.seq * 7 + r.record_id) % n and e.death <= r.seq)"""),
    "accuracy_both_denominators": _with("select arm, accuracy, held_accuracy from score", _reads("one")),
    "result_json": _with("""select to_json(struct_pack(accuracy := accuracy, arm := arm, correct := correct, ghost := ghost, stale := stale))::VARCHAR as document from score""", _reads("sweep")),
    "bar_chart_calls": _bars("""select unnest(['bulk export', 'one fetch a row', 'paged scan']) as label,
  unnest([1, (ceil(count(*) / 200.0) + 1)::BIGINT + count(*), (ceil(count(*) / 200.0) + 1)::BIGINT]) as n from orders"""),
    "bar_chart_detection": _with(_bars("select strategy as label, detected as n from matrix"), _reads("one"), _LOCAL, _DIFFER.replace("{n}", "40"), _MATRIX),
    "stream_dedup_equals_batch": _with("select event_id, seq from hooks where copy = 0"),
    "stream_upsert_equals_batch": "select user_id, max(event_id) as version, arg_max(value, event_id) as value from events group by user_id",
    "stream_windowed_counts": """with e as (select floor(epoch_us(ts) / 1e6)::BIGINT as s from events)
select d * 86400 as window_start, count(*) as n from (select s // 86400 as d from e) group by d having (d + 1) * 86400 <= (select max(s) from e)""",
}
