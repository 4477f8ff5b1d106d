"""SQL of the results that SQL can state."""

from tidelot.plans.streams import MESSAGES_SQL

_RULES = """select source, max_repeats, source in (select source from documents where text <> '' and source is not null) as has_records, true as cap_kept, true as wanted_fits
from (select source, min(max_repeats) as max_repeats from mix_targets where source is not null group by source)"""

ORACLES = {
    "p7_found": f"""with {MESSAGES_SQL},
m as (select lot_id, sensor_id, slot_id, kind, st, ts, kafka_offset from messages
  where lot_id is not null and sensor_id is not null and ts is not null and slot_id is not null and kind is not null),
f as (select *, case when slot_id = lag(slot_id) over w and kind = lag(kind) over w and st is not distinct from lag(st) over w
    and ts - lag(ts) over w <= 1200000000 then 0 else 1 end as fresh
  from m window w as (partition by lot_id, sensor_id order by ts, kafka_offset)),
g as (select *, sum(fresh) over (partition by lot_id, sensor_id order by ts, kafka_offset rows unbounded preceding) as island from f)
select lot_id, sensor_id, min(ts) as start_us, max(ts) as end_us, count(*) as n_events from g group by lot_id, sensor_id, island having count(*) > 1""",
    "p2_bounds_hold": """with m as (select lot_id, min(personality) as personality from lot_metadata where lot_id is not null group by lot_id),
e as (select cast(event_ts as date) as dy, e.lot_id, coalesce(personality, '') as kind from parking_events e left join m using (lot_id) where vehicle_token is not null and ltrim(translate(lower(vehicle_token), ' {}-', ''), '') <> '')
select 'all' as grouping, count(*) as n_groups, count(*) as n_within from (select 1 from e limit 1)
union all select 'day', count(distinct dy), count(distinct dy) from e
union all select 'lot_id', count(distinct lot_id), count(distinct lot_id) from e
union all select 'personality', count(distinct kind), count(distinct kind) from e where lot_id is not null
union all select 'day+lot_id', count(distinct (dy, lot_id)), count(distinct (dy, lot_id)) from e where dy is not null and lot_id is not null
union all select 'day+personality', count(distinct (dy, kind)), count(distinct (dy, kind)) from e where dy is not null and lot_id is not null
union all select 'lot_id+personality', count(distinct lot_id), count(distinct lot_id) from e
union all select 'day+lot_id+personality', count(distinct (dy, lot_id)), count(distinct (dy, lot_id)) from e where dy is not null and lot_id is not null""",
    "p7_near_cost": f"""with {MESSAGES_SQL},
m as (select lot_id, sensor_id, slot_id, kind, coalesce(st, '') as st, ts, kafka_offset from messages
  where lot_id is not null and sensor_id is not null and ts is not null and slot_id is not null and kind is not null),
f as (select *, case when ts - lag(ts) over w <= 1200000000 then 0 else 1 end as fresh from m window w as (partition by lot_id, sensor_id order by ts, kafka_offset)),
g as (select *, sum(fresh) over (partition by lot_id, sensor_id order by ts, kafka_offset rows unbounded preceding) as island from f),
e as (select dense_rank() over (order by lot_id, sensor_id, island) as s, row_number() over (partition by lot_id, sensor_id, island order by ts, kafka_offset) as i, * from g),
p as (select b.s, a.i as j, b.i, count(*) over (partition by b.s, a.i, b.slot_id order by b.i) as c1, count(*) over (partition by b.s, a.i, b.kind order by b.i) as c2,
  count(*) over (partition by b.s, a.i, b.st order by b.i) as c3 from e a join e b on a.s = b.s and a.i <= b.i),
q as (select s, j, i, 3 * (i - j + 1) - max(c1) over w - max(c2) over w - max(c3) over w as off from p window w as (partition by s, j order by i)),
c as (select s, i, list(off::double order by j) as offs from q group by s, i),
r as (select s, count(*) as n, list_reduce(list_prepend([0.0::double], list(offs order by i)), lambda best, offs: list_append(best, list_min([best[j] + offs[j] + 1.5 for j in range(1, len(offs) + 1)])))[-1] as cost from c group by s),
n as (select s, any_value(lot_id) as lot_id, any_value(sensor_id) as sensor_id from e group by s)
select lot_id, sensor_id, sum(cost) as total_cost, cast(sum(n) as bigint) as n_events from r join n using (s) group by lot_id, sensor_id""",
    "p8_offsets": "select true as covers, count(*) as n_docs from documents",
    "p9_rules_kept": _RULES,
    "p9_whole_budget": _RULES,
    "p8_round_trip": "select true as same, count(*) as n_docs from documents",
}
