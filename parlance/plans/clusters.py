"""Named queries for robust centroids and threshold clustering over three recordings, with SQL that merges step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import speakers
from parlance.plans.adapters import MEETINGS, meetings
from parlance.plans.catalogue import query

RECORDING = ["recording_id"]
SIZE = 64


def _normed(source: str, keys: str, vector: str, name: str) -> str:
    """SQL of the normalised mean vectors of ``source`` by ``keys``."""
    return f"""{name}_d as (select {keys}, i, avg({vector}[i]) as x from (select *, unnest(range(1, {SIZE + 1})) as i from {source}) group by all),
 {name}_l as (select {keys}, list(x order by i) as l from {name}_d group by all), {name} as (select {keys}, list_transform(l, lambda x: x / greatest(sqrt(list_dot_product(l, l)), 1e-12)) as c from {name}_l)"""


def _round(before: str, after: str) -> str:
    """SQL of one round: those of ``before`` near to its medoid and far from the part's crowd."""
    g = "recording_id, part, speaker"
    return f"""{after}_d as (select {g}, i, sum(e[i]) as x from (select *, unnest(range(1, {SIZE + 1})) as i from {before}) group by all), {after}_t as (select {g}, list(x order by i) as t from {after}_d group by all),
 {after}_m as (select {g}, e as medoid from (select *, row_number() over (partition by {g} order by list_dot_product(e, t) desc, vec_id) as rn from {before} join {after}_t using ({g})) where rn = 1),
 {after}_s as (select v.*, row_number() over (partition by {g} order by list_dot_product(e, medoid) - coalesce(list_dot_product(e, w.c), 0) desc, vec_id) as rn, count(*) over (partition by {g}) as n from {before} v join {after}_m using ({g}) left join crowds w using (recording_id, part)),
 {after} as (select {g}, vec_id, e from {after}_s where rn <= least(n, greatest(3, round_even(0.5 * n, 0))))"""


ROBUST = f"""{MEETINGS}, {_normed("voices", "recording_id, part", "e", "every")}, crowds as (select * from every where (recording_id, part) in (select (recording_id, part) from voices group by recording_id, part having count(distinct speaker) > 1)),
 {_round("voices", "once")}, {_round("once", "kept")}, {_normed("kept", "recording_id, part, speaker", "e", "centre")},
 g as (select *, cast(row_number() over (partition by recording_id order by part, speaker) - 1 as integer) as k from centre), b as (select recording_id, k, e from kept join g using (recording_id, part, speaker))"""


@query(f"with {ROBUST}, n as (select recording_id, part, speaker, count(*) as n_total from voices group by all) select recording_id, part, speaker, n_total, count(*) as n_kept, string_agg(vec_id, ',' order by vec_id) as kept from kept join n using (recording_id, part, speaker) group by all")
def robust_centroid_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = speakers.robust_centroids(meetings(spark, sf_dir), RECORDING)
    return r.select(*RECORDING, "part", "speaker", "n_total", "n_kept", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


#: One row a recording and step: ``home`` has each group's cluster, by its least group.
MERGED = f"""with recursive {ROBUST}, u(recording_id, step, home, a, b, affinity, margin) as (select recording_id, cast(-1 as bigint), cast(list(k order by k) as integer[]), -1, -1, cast(0 as double), cast(0 as double) from g group by recording_id
 union all (with x as (select recording_id, step, g.k, u.home[g.k + 1] as h, g.part, g.c from u join g using (recording_id)),
 d as (select recording_id, h, i, avg(c[i]) as v from (select *, unnest(range(1, {SIZE + 1})) as i from x) group by all), l as (select recording_id, h, list(v order by i) as l from d group by all),
 t as (select l.recording_id, l.h, list_transform(l, lambda v: v / greatest(sqrt(list_dot_product(l, l)), 1e-12)) as c, p.ps from l join (select recording_id, h, list(part) as ps from x group by all) p using (recording_id, h)),
 q as (select m.recording_id, m.h, t.h as target, row_number() over (partition by m.recording_id, m.k, m.rn order by list_dot_product(m.e, t.c) desc, t.h) as place
 from (select b.recording_id, b.k, b.e, x.h, own.ps, row_number() over () as rn from b join x using (recording_id, k) join t own on own.recording_id = x.recording_id and own.h = x.h) m join t on t.recording_id = m.recording_id and t.h <> m.h and not list_has_any(t.ps, m.ps)),
 n as (select x.recording_id, x.h, count(*) as n from b join x using (recording_id, k) group by all), s as (select q.recording_id, q.h, q.target, count(*) / any_value(n.n) as share from q join n on n.recording_id = q.recording_id and n.h = q.h where place = 1 group by all),
 y as (select o.recording_id, o.h as a, w.h as b, least(coalesce(f.share, 0), coalesce(r.share, 0)) as v from t o join t w on w.recording_id = o.recording_id and o.h < w.h and not list_has_any(o.ps, w.ps)
 left join s f on f.recording_id = o.recording_id and f.h = o.h and f.target = w.h left join s r on r.recording_id = o.recording_id and r.h = w.h and r.target = o.h),
 best as (select * from (select *, row_number() over (partition by recording_id order by v desc, a, b) as rn from y) where rn = 1),
 rival as (select e.recording_id, max(y.v) as v from best e join y on y.recording_id = e.recording_id and (y.a, y.b) <> (e.a, e.b) and (y.a in (e.a, e.b) or y.b in (e.a, e.b)) group by all), left_ as (select recording_id, count(*) as n from t group by all)
 select u.recording_id, u.step + 1, list_transform(u.home, lambda h: case when h = e.b then e.a else h end), e.a, e.b, e.v, case when o.n > 2 then e.v - coalesce(z.v, 0) else 1.0 end
 from u join best e using (recording_id) join left_ o using (recording_id) left join rival z using (recording_id)))"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = meetings(spark, sf_dir)
    return speakers.merge_log(v, speakers.robust_centroids(v, RECORDING), RECORDING)


@query(f"{MERGED} select recording_id, cast(step as integer) as step, a, b, round(affinity, 6) as affinity, round(margin, 6) + 0.0 as margin, margin < 0.05 as low_margin from u where step >= 0")
def cluster_merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of each recording merged to exhaustion."""
    log = _log(spark, sf_dir).where("step >= 0")
    return log.select(*RECORDING, "step", "a", "b", F.round("affinity", 6).alias("affinity"), (F.round("margin", 6) + 0.0).alias("margin"), (F.col("margin") < speakers.LOW_MARGIN).alias("low_margin"))


#: For every threshold the state before the first merge that doesn't pass it, and its pairs of groups.
CURVE = f"""{MERGED}, taus as (select unnest(range(13)) as i), tau as (select i, round(0.1 + 0.05 * i, 2) as tau from taus), stop as (select recording_id, i, tau, coalesce(min(step) filter (affinity <= tau and step >= 0), max(step) + 1) as stop from u, tau group by all),
 cuts as (select s.recording_id, i, tau, u.home, s.stop as n_merges from stop s join u on u.recording_id = s.recording_id and u.step = s.stop - 1),
 pr as (select recording_id, i, coalesce(list(a || '-' || b) filter (home[a + 1] = home[b + 1]), []) as pairs from (select *, unnest(range(len(home))) as a from cuts), (select unnest(range((select max(len(home)) from cuts))) as b) where a < b and b < len(home) group by all),
 mm as (select s.recording_id, s.i, min(margin) as m from stop s join u on u.recording_id = s.recording_id and u.step >= 0 and u.step < s.stop group by all),
 curve as (select a.recording_id, a.i, a.tau, len(a.home) - a.n_merges as n_clusters, a.n_merges, mm.m as min_margin, case when o.i is not null then 1 - (len(p.pairs) + len(o.pairs) - 2 * len(list_intersect(p.pairs, o.pairs))) / greatest(len(p.pairs) + len(o.pairs) - len(list_intersect(p.pairs, o.pairs)), 1) end as stability
 from cuts a join pr p on p.recording_id = a.recording_id and p.i = a.i left join mm on mm.recording_id = a.recording_id and mm.i = a.i left join pr o on o.recording_id = a.recording_id and o.i = a.i - 1)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.stabilities(speakers.tau_curve(_log(spark, sf_dir), RECORDING), RECORDING)


@query(f"{CURVE} select recording_id, tau, cast(n_clusters as integer) as n_clusters, cast(n_merges as integer) as n_merges, round(min_margin, 6) + 0.0 as min_margin, round(stability, 6) as stability from curve")
def tau_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select(*RECORDING, "tau", "n_clusters", "n_merges", (F.round("min_margin", 6) + 0.0).alias("min_margin"), F.round("stability", 6).alias("stability"))


@query(f"""{CURVE}, r as (select *, sum(case when stability = 1.0 then 0 else 1 end) over (partition by recording_id order by i) as run from curve), w as (select recording_id, run, min(tau) as low, max(tau) as high, count(*) as n, min(i) as i from r group by all),
 f as (select *, row_number() over (partition by recording_id order by n desc, i) as rn from w where n > 1) select recording_id, low, high, round((low + high) / 2, 3) as auto_tau from f where rn = 1""")
def auto_tau_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's threshold from its own curve."""
    return speakers.auto_tau(_curve(spark, sf_dir), RECORDING)


@query(f"""{CURVE}, own as (select recording_id, home from cuts where i = 4), m as (select g.recording_id, g.part, g.speaker, own.home[g.k + 1] as cluster from g join own using (recording_id)),
 f as (select recording_id, part, speaker, min(vec_id) as first_ms from voices group by all), c as (select recording_id, cluster, min(first_ms) as a from m join f using (recording_id, part, speaker) group by all),
 n as (select recording_id, cluster, 'G' || lpad(cast(row_number() over (partition by recording_id order by a, cluster) as varchar), 2, '0') as gid from c)
 select recording_id, part, speaker, gid, true as resolved from m join n using (recording_id, cluster)""")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global speakers of the partition that the merge log has at the threshold 0.3."""
    v = meetings(spark, sf_dir)
    groups = v.groupBy(*RECORDING, "part", "speaker").agg(F.min("vec_id").alias("first_ms"))
    clusters = speakers.clusters_at(_log(spark, sf_dir), speakers.robust_centroids(v, RECORDING), RECORDING, 0.3)
    return speakers.labels(clusters, groups, RECORDING)
