"""Named SQL views (DuckDB dialect) from which the check queries are composed.

They restate the definitions relationally, with windows and self-joins, and
share no code with the operators. `compose` adds the views a query refers to.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def compose(final: str, extra: dict[str, str] | None = None) -> str:
    """`with` clause of every view reachable from `final`, in dependency order, then `final`."""
    views = {**VIEWS, **(extra or {})}
    done: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if name in views and name not in done and name not in busy:
                busy.append(name)
                visit(views[name])
                done.append(name)

    busy: list[str] = []
    visit(final)
    if not done:
        return final
    return "with " + ",\n".join(f"{n} as materialized ({views[n]})" for n in done) + "\n" + final


def r(expr: str, digits: int = 6) -> str:
    """Rounded value without negative zero; the small shift keeps exact halves off the rounding edge."""
    shifted = f"round(({expr}) + 1.2345e-9, {digits})"
    return f"(case when {shifted} = 0 then cast(0 as double) else {shifted} end)"


VIEWS["tsteps"] = "select range as timestep from range(110)"
VIEWS["frames"] = """with trk as (select c_custkey k, cast(floor(c_custkey/12) as bigint) sc, c_acctbal b from customer),
p as (select k, sc, concat('s', cast(sc as string)) scenario_id, concat('city', cast(sc % 5 as string)) city,
  concat('t', cast(k as string)) track_id,
  case when k % 11 = 0 then 'pedestrian' when k % 13 = 0 then 'bus' else 'vehicle' end object_type,
  cast((k*37) % 101 - 50 as double) + b*cast(0.001 as double) x0, cast(k % 4 as double)*cast(3.5 as double) y0,
  case when k % 4 >= 2 then cast(-1 as double) else cast(1 as double) end dir,
  cast((k*13) % 23 as double)*cast(0.6 as double) v, cast((k*7) % 9 - 4 as double)*cast(0.25 as double) a from trk),
f as (select p.*, t.timestep, cast(t.timestep as double)*cast(0.1 as double) tt from p cross join tsteps t)
select scenario_id, city, track_id, k, object_type, timestep, timestep < 50 observed,
  x0 + dir*(v*tt + cast(0.5 as double)*a*tt*tt)
     + case when k % 29 = 0 and timestep >= 20 then cast(60 as double) else cast(0 as double) end position_x,
  y0 position_y, dir*(v + a*tt) velocity_x, cast(0 as double) velocity_y,
  case when dir < 0 then cast(3.141592653589793 as double) else cast(0 as double) end heading
from f where not (k % 19 = 0 and timestep between 10 and 35) and ((k*31 + timestep*17) % 97) <> 0"""
VIEWS["lane_view"] = """with s as (select distinct cast(floor(c_custkey/12) as bigint) sc from customer)
select concat('s', cast(sc as string)) scenario_id, sc*10+l lane_id, l, l % 4 = 3 is_intersection, p.timestep pt,
  cast(p.timestep*10-200 as double) x, cast(l as double)*cast(3.5 as double) y,
  case when l > 0 then sc*10+l-1 end left_neighbor_id, case when l < 3 then sc*10+l+1 end right_neighbor_id
from s cross join (select timestep l from tsteps where timestep < 4) q
       cross join (select timestep from tsteps where timestep < 41) p"""
VIEWS["av_frames"] = """with r as (select distinct cast(floor(c_custkey/10) as bigint) r from customer),
w as (select r, w from r cross join (select timestep w from tsteps where timestep < 3) x where w <= r % 3),
s as (select r, w, w * case when r % 7 = 0 then 200 else 40 end sh,
  concat('a', cast(r as string), '_', cast(w as string)) scenario_id, concat('city', cast(r % 5 as string)) city from w)
select scenario_id, city, r, w, 'AV' track_id, timestep,
  cast(r as double)*cast(1.7 as double) + cast(0.83 as double)*cast(sh+timestep as double) position_x,
  cast(((sh+timestep)*(sh+timestep)) % 17 as double)*cast(0.1 as double) position_y,
  (r*1000+sh)*100000000 start_timestamp from s cross join tsteps"""
VIEWS["group_meta"] = """select distinct scenario_id, city,
  case when r % 5 = 0 then concat('rec', cast(r as string))
       else concat('rec', cast(r as string), '_', cast(w as string)) end recording_group_id_v2,
  case when r % 10 in (0,5) then sha1(concat('dup', cast(cast(floor(r/10) as bigint) as string)))
       else sha1(scenario_id) end content_sha1,
  sha1(concat('f', scenario_id)) focal_trajectory_hash_0p1m, 'derived' recording_group_source_v2,
  start_timestamp, start_timestamp + 10900000000 end_timestamp from av_frames"""
VIEWS["edge_scores"] = """with c as (select c_custkey k, cast(floor(c_custkey/12) as bigint) sc from customer),
p as (select a.sc, a.k i, b.k j, case when (a.k+b.k) % 7 = 0 then 1 else 0 end y
      from c a join c b on a.sc = b.sc and a.k <> b.k),
q as (select *, cast(((i*7919+j*104729) % 1000) as double)*cast(0.0007 as double)
             + cast(0.3 as double)*cast(y as double) pc from p)
select concat('s', cast(sc as string)) scenario_id, concat('city', cast(sc % 5 as string)) city, i src, j dst, y label,
  pc clean_probability,
  case when (i+j) % 3 = 0 then least(cast(1 as double), pc + cast(0.25 as double)) else pc end perturbed_probability,
  (i+j) % 11 <> 0 supervised from q"""

# Tracks.
VIEWS["obs"] = """select scenario_id, city, track_id, object_type, timestep t, position_x x, position_y y,
  velocity_x vx, velocity_y vy, heading h from frames where observed and timestep between 0 and 49"""
VIEWS["fut"] = """select scenario_id, track_id, timestep t, position_x x, position_y y from frames
  where not observed and timestep between 50 and 109"""
VIEWS["tracks"] = "select scenario_id, track_id, min(city) city, min(object_type) object_type from frames group by 1, 2"
VIEWS["unw"] = """select * exclude (d, m0, m, corr),
    h + sum(corr) over (partition by scenario_id, track_id order by t rows unbounded preceding) u
  from (select *, case when d is null or abs(d) < pi() then 0 else m - d end corr
    from (select *, case when m0 = -pi() and d > 0 then pi() else m0 end m
      from (select *, (d + pi()) - floor((d + pi()) / (2*pi())) * (2*pi()) - pi() m0
        from (select *, h - lag(h) over (partition by scenario_id, track_id order by t) d from obs))))"""
VIEWS["filled_all"] = """select scenario_id, track_id, t, x is not null ok,
    {x} x, {y} y, {vx} vx, {vy} vy, atan2(sin({u}), cos({u})) h
  from (select g.scenario_id, g.track_id, g.t, o.x, o.y, o.vx, o.vy, o.u, {cols}
    from (select scenario_id, track_id, timestep t from tracks cross join tsteps where timestep < 50) g
    left join unw o on o.scenario_id = g.scenario_id and o.track_id = g.track_id and o.t = g.t
    window p as (partition by g.scenario_id, g.track_id order by g.t rows between unbounded preceding and current row),
           n as (partition by g.scenario_id, g.track_id order by g.t rows between current row and unbounded following))""".format(
    cols=", ".join(
        [f"last_value(o.{k} ignore nulls) over p p{k}, first_value(o.{k} ignore nulls) over n n{k}" for k in ("t", "x", "y", "vx", "vy", "u")]),
    **{k: f"(case when {k} is not null then {k} when pt is null and nt is null then 0.0 when pt is null then n{k}"
          f" when nt is null then p{k} else p{k} + (n{k} - p{k}) * ((t - pt) / (nt - pt)) end)" for k in ("x", "y", "vx", "vy", "u")})
VIEWS["accel"] = """select scenario_id, track_id, t, sqrt(ax*ax + ay*ay) norm, ay*cos(h) - ax*sin(h) lat_acc, (u - pu)/g rate
  from (select *, (vx - pvx)/g ax, (vy - pvy)/g ay from (select *, greatest((t - pt)*0.1, 1e-6) g
    from (select *, lag(t) over w pt, lag(vx) over w pvx, lag(vy) over w pvy, lag(u) over w pu
      from unw window w as (partition by scenario_id, track_id order by t))) where pt is not null)"""
VIEWS["series"] = " union all ".join(
    f"select scenario_id, track_id, '{k}' name, t, {k} v from unw" for k in ("x", "y", "vx", "vy", "u"))
VIEWS["dif"] = """select scenario_id, track_id, name,
  abs(v - lag(v) over (partition by scenario_id, track_id, name order by t)) d from series"""
VIEWS["dif1"] = """select scenario_id, track_id, name, quantile_cont(d, 0.5) c, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) iqr,
  count(d) n from dif group by 1, 2, 3"""
VIEWS["dif2"] = """select scenario_id, track_id, name, quantile_cont(abs(d - c), 0.5) mad
  from dif join dif1 using (scenario_id, track_id, name) group by 1, 2, 3"""
VIEWS["jumps"] = """select scenario_id, track_id, name, cast(case when max(n) < 2 then 0 else
  count(*) filter (d > c + 5 * greatest(1.4826*mad, iqr/1.349, 1e-3)) end as bigint) j
  from dif join dif1 using (scenario_id, track_id, name) join dif2 using (scenario_id, track_id, name) group by 1, 2, 3"""
VIEWS["quality"] = """select *, case when object_type not in ('vehicle','bus') then 'non_vehicle'
    when num_observed < 40 then 'obs_too_short' when last_observed < 48 then 'no_last_obs'
    when pos_jumps > 2 then 'pos_jumps' when vel_jumps > 2 then 'vel_jumps' when heading_jumps > 3 then 'heading_jumps'
    when max_speed > 40 then 'speed_extreme' when max_acc > 10 then 'acc_extreme' end skip_reason
  from (select k.scenario_id, k.track_id, k.city, k.object_type, coalesce(o.n, 0) num_observed, coalesce(o.last_t, -1) last_observed,
      coalesce(j.pos, 0) pos_jumps, coalesce(j.vel, 0) vel_jumps, coalesce(j.head, 0) heading_jumps,
      coalesce(o.ms, 0) max_speed, coalesce(a.ma, 0) max_acc
    from tracks k
    left join (select scenario_id, track_id, count(*) n, max(t) last_t, max(sqrt(vx*vx + vy*vy)) ms from obs group by 1, 2) o
      using (scenario_id, track_id)
    left join (select scenario_id, track_id, cast(sum(j) filter (name in ('x','y')) as bigint) pos,
        cast(sum(j) filter (name in ('vx','vy')) as bigint) vel, cast(sum(j) filter (name = 'u') as bigint) head
      from jumps group by 1, 2) j using (scenario_id, track_id)
    left join (select scenario_id, track_id, max(norm) ma from accel group by 1, 2) a using (scenario_id, track_id))"""
VIEWS["summary"] = """select k.scenario_id, k.track_id, k.city, k.object_type,
    sqrt(f.vx*f.vx + f.vy*f.vy) speed_current, o.speed_mean, o.speed_std, coalesce(a.acc_std, 0) acc_std,
    coalesce(a.lateral_acc_std, 0) lateral_acc_std, coalesce(a.heading_rate_std, 0) heading_rate_std, o.n / 50.0 observed_fraction,
    f.x cur_x, f.y cur_y, f.vx cur_vx, f.vy cur_vy, f.h cur_h, f.ok cur_ok
  from quality k join filled_all f on f.scenario_id = k.scenario_id and f.track_id = k.track_id and f.t = 49
  left join (select scenario_id, track_id, avg(sqrt(vx*vx + vy*vy)) speed_mean, stddev_pop(sqrt(vx*vx + vy*vy)) speed_std,
    count(*) n from obs group by 1, 2) o on o.scenario_id = k.scenario_id and o.track_id = k.track_id
  left join (select scenario_id, track_id, stddev_pop(norm) acc_std, stddev_pop(lat_acc) lateral_acc_std,
    stddev_pop(rate) heading_rate_std from accel group by 1, 2) a on a.scenario_id = k.scenario_id and a.track_id = k.track_id"""
VIEWS["kept"] = """select s.*, row_number() over (partition by s.scenario_id order by s.track_id) - 1 node_id
  from summary s join quality q using (scenario_id, track_id) where q.skip_reason is null"""
VIEWS["filled"] = """select f.* from filled_all f join quality q using (scenario_id, track_id) where q.skip_reason is null"""
VIEWS["lane_pts"] = """select scenario_id, lane_id, is_intersection, pt, x, y,
  coalesce(atan2(lead(y) over w - y, lead(x) over w - x), atan2(y - lag(y) over w, x - lag(x) over w)) heading
  from lane_view window w as (partition by scenario_id, lane_id order by pt)"""
VIEWS["nearest"] = """select scenario_id, track_id, lane_id, dist lane_distance, heading lane_heading, is_intersection lane_is_intersection
  from (select n.scenario_id, n.track_id, p.lane_id, p.pt, p.heading, p.is_intersection,
    sqrt((p.x-n.cur_x)*(p.x-n.cur_x) + (p.y-n.cur_y)*(p.y-n.cur_y)) dist from kept n join lane_pts p using (scenario_id))
  qualify row_number() over (partition by scenario_id, track_id order by dist, lane_id, pt) = 1"""
VIEWS["nodes"] = """select k.*, l.lane_id, l.lane_distance, coalesce(l.lane_heading, 0) lane_heading,
  coalesce(l.lane_is_intersection, false) lane_is_intersection from kept k left join nearest l using (scenario_id, track_id)"""
VIEWS["lane_links"] = """select distinct scenario_id, lane_id src, unnest([left_neighbor_id, right_neighbor_id]) dst
  from lane_view where pt = 0"""

# Pairs. `pair_ids` are directed edges; all histories are per direction.
VIEWS["pair_ids"] = """select a.scenario_id, a.city, a.track_id src, b.track_id dst, cast(-1 as double) variant
  from nodes a join nodes b on a.scenario_id = b.scenario_id and a.track_id <> b.track_id
  where sqrt((b.cur_x-a.cur_x)*(b.cur_x-a.cur_x) + (b.cur_y-a.cur_y)*(b.cur_y-a.cur_y)) <= 60"""
VIEWS["filled_k"] = "select *, cast(-1 as double) variant from filled"
VIEWS["nodes_k"] = "select *, cast(-1 as double) variant from nodes"


def pair_views(tag: str, ids: str, filled: str, nodes: str) -> dict[str, str]:
    """Views of the edge features for given edge ids, dense paths and node summaries."""
    key = "scenario_id, variant, src, dst"
    return {
        f"hist{tag}": f"""select *, row_number() over (partition by {key} order by t desc) rn from (
  select *, -(rvx*(rx/greatest(d, 1e-6)) + rvy*(ry/greatest(d, 1e-6))) c from (select *, sqrt(rx*rx + ry*ry) d from (
    select e.scenario_id, e.variant, e.src, e.dst, p.t, q.x - p.x rx, q.y - p.y ry, q.vx - p.vx rvx, q.vy - p.vy rvy
    from {ids} e join {filled} p on p.scenario_id = e.scenario_id and p.variant = e.variant and p.track_id = e.src
    join {filled} q on q.scenario_id = e.scenario_id and q.variant = e.variant and q.track_id = e.dst and q.t = p.t
    where p.ok and q.ok)))""",
        f"hsum{tag}": f"""select {key}, count(*) n, min(d) d_min, avg(d) d_mean, stddev_pop(d) d_std,
  coalesce(regr_slope(d, t), 0) d_trend, coalesce(regr_slope(d, t) filter (t < 25), 0) d_early,
  coalesce(regr_slope(d, t) filter (rn <= 20), 0) d_late, avg(c) c_mean, max(c) c_max, stddev_pop(c) c_std,
  avg(c) filter (rn <= 20) c_late, coalesce(regr_slope(c, t), 0) c_trend from hist{tag} group by all""",
        f"fitx{tag}": f"""select {key}, count(*) n, regr_slope(rx, tt) sx, regr_intercept(rx, tt) ix, regr_slope(ry, tt) sy,
  regr_intercept(ry, tt) iy, max(rx) filter (t = 49) lx, max(ry) filter (t = 49) ly, max(rvx) filter (t = 49) lvx,
  max(rvy) filter (t = 49) lvy from (select *, (t - 49) * 0.1 tt from hist{tag} where t >= 39) group by all
  having count(*) = 11 and sqrt(lx*lx + ly*ly) > 1e-8""",
        f"resid{tag}": f"""select {key}, {', '.join(
            f"sum(({e}) * sqrt(2.0/11) * cos(pi()*{k}*(t - 39 + 0.5)/11)) {n}{k}"
            for n, e, ks in (("los", "ex*ux + ey*uy", (1, 2, 3)), ("tan", "ey*ux - ex*uy", (1, 2))) for k in ks)},
  max((lvx - sx)*ux + (lvy - sy)*uy) vlos, max((lvy - sy)*ux - (lvx - sx)*uy) vtan
  from (select {key}, t, rx - (ix + sx*(t-49)*0.1) ex, ry - (iy + sy*(t-49)*0.1) ey, lx/sqrt(lx*lx+ly*ly) ux,
    ly/sqrt(lx*lx+ly*ly) uy, lvx, lvy, sx, sy from hist{tag} join fitx{tag} using ({key}) where t >= 39) group by all""",
        f"feat{tag}": f"""select e.scenario_id, e.variant, e.src src_track_id, e.dst dst_track_id, a.city,
  rel_x rel_x_current, rel_y rel_y_current, d_current, rvx rel_vx_current, rvy rel_vy_current,
  -(rvx*(rel_x/greatest(d_current, 1e-6)) + rvy*(rel_y/greatest(d_current, 1e-6))) closing_speed_current,
  case when n >= 2 then d_min else d_current end d_min_obs, case when n >= 2 then d_mean else d_current end d_mean_obs,
  case when n >= 2 then d_std else 0 end d_std_obs, case when n >= 2 then h.d_trend else 0 end d_trend,
  case when n >= 2 then d_early else 0 end d_trend_early, case when n >= 2 then d_late else 0 end d_trend_late,
  case when n >= 2 then c_mean else 0 end closing_speed_mean, case when n >= 2 then c_max else 0 end closing_speed_max,
  case when n >= 2 then c_std else 0 end closing_speed_std, case when n >= 2 then c_late else 0 end closing_speed_late,
  case when n >= 2 then c_trend else 0 end closing_speed_trend,
  sin(b.cur_h - a.cur_h) heading_diff_sin, cos(b.cur_h - a.cur_h) heading_diff_cos,
  sin(atan2(rel_y, rel_x) - a.cur_h) src_heading_to_dst_sin, cos(atan2(rel_y, rel_x) - a.cur_h) src_heading_to_dst_cos,
  sin(atan2(-rel_y, -rel_x) - b.cur_h) dst_heading_to_src_sin, cos(atan2(-rel_y, -rel_x) - b.cur_h) dst_heading_to_src_cos,
  a.cur_vx*rel_x/greatest(d_current, 1e-6) + a.cur_vy*rel_y/greatest(d_current, 1e-6) src_velocity_toward_dst,
  -(b.cur_vx*rel_x/greatest(d_current, 1e-6) + b.cur_vy*rel_y/greatest(d_current, 1e-6)) dst_velocity_toward_src,
  a.speed_current - b.speed_current speed_delta_src_minus_dst, a.speed_current src_speed_current,
  b.speed_current dst_speed_current, a.speed_mean src_speed_mean, b.speed_mean dst_speed_mean, a.acc_std src_acc_std,
  b.acc_std dst_acc_std, a.lateral_acc_std src_lateral_acc_std, b.lateral_acc_std dst_lateral_acc_std,
  coalesce(los1, 0) relative_residual_los_dct1, coalesce(los2, 0) relative_residual_los_dct2,
  coalesce(los3, 0) relative_residual_los_dct3, coalesce(tan1, 0) relative_residual_tangent_dct1,
  coalesce(tan2, 0) relative_residual_tangent_dct2, coalesce(vlos, 0) terminal_relative_velocity_residual_los,
  coalesce(vtan, 0) terminal_relative_velocity_residual_tangent,
  case when los1 is null then cast(0 as double) else cast(1 as double) end relative_motion_window_valid
  from (select e.*, rx rel_x, ry rel_y, sqrt(rx*rx + ry*ry) d_current from (select e.*, b.cur_x - a.cur_x rx, b.cur_y - a.cur_y ry,
      b.cur_vx - a.cur_vx rvx, b.cur_vy - a.cur_vy rvy from {ids} e
      join {nodes} a on a.scenario_id = e.scenario_id and a.variant = e.variant and a.track_id = e.src
      join {nodes} b on b.scenario_id = e.scenario_id and b.variant = e.variant and b.track_id = e.dst) e) e
  join {nodes} a on a.scenario_id = e.scenario_id and a.variant = e.variant and a.track_id = e.src
  join {nodes} b on b.scenario_id = e.scenario_id and b.variant = e.variant and b.track_id = e.dst
  left join hsum{tag} h on h.scenario_id = e.scenario_id and h.variant = e.variant and h.src = e.src and h.dst = e.dst
  left join resid{tag} z on z.scenario_id = e.scenario_id and z.variant = e.variant and z.src = e.src and z.dst = e.dst""",
    }


VIEWS.update(pair_views("", "pair_ids", "filled_k", "nodes_k"))
VIEWS["futd"] = """select e.scenario_id, e.src, e.dst, p.t, sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)) d
  from pair_ids e join fut p on p.scenario_id = e.scenario_id and p.track_id = e.src
  join fut q on q.scenario_id = e.scenario_id and q.track_id = e.dst and q.t = p.t"""
VIEWS["futmin"] = """select e.scenario_id, e.src src_track_id, e.dst dst_track_id, min(d) future_min_distance, arg_min(t, {k}) future_min_timestep,
  count(d) pair_future_count, min(t) future_first_valid_timestep, max(t) future_last_valid_timestep,
  coalesce(max(t) - min(t) + 1, 0) future_valid_span, count(d)/60.0 future_valid_fraction
  from pair_ids e left join futd f using (scenario_id, src, dst) group by all""".format(k="struct_pack(d := d, t := t)")

# Dynamic risk: islands of consecutive frames, centred regression, islands of violations.
VIEWS["risk_islands"] = "select *, t - row_number() over (partition by scenario_id, src, dst order by t) island from futd"
VIEWS["risk_speed"] = """select scenario_id, src, dst, t, d, island, case when count(*) over w = 5 then
    greatest(0.0, -regr_slope(d, t * 0.1) over w) end c
  from risk_islands window w as (partition by scenario_id, src, dst, island order by t rows between 2 preceding and 2 following)"""
VIEWS["risk_params"] = """select * from (values (5.0::double, 1.0::double, 4.0::double)) v(base, reaction, decel)"""
VIEWS["risk_margin"] = """select *, base + reaction*c + c*c/(2*decel) lim, d - (base + reaction*c + c*c/(2*decel)) m
  from risk_speed cross join risk_params where c is not null"""
VIEWS["risk_runs"] = """select *, count(*) over (partition by scenario_id, src, dst, base, reaction, decel, bad, g) len,
    count(*) over (partition by scenario_id, src, dst, base, reaction, decel, vg) vlen
  from (select *, m <= 0 bad, t - row_number() over (partition by scenario_id, src, dst, base, reaction, decel, m <= 0 order by t) g,
    t - row_number() over (partition by scenario_id, src, dst, base, reaction, decel order by t) vg from risk_margin)"""
VIEWS["risk_edge"] = """select scenario_id, src, dst, base, reaction, decel, max(vlen) vbest, coalesce(max(len) filter (bad), 0) bbest,
    arg_min(struct_pack(m := m, t := t, c := c, lim := lim), struct_pack(m := m, t := t)) every,
    arg_min(struct_pack(m := m, t := t, c := c, lim := lim), struct_pack(m := m, t := t)) filter (bad and len >= 3) qual
  from risk_runs group by all"""
VIEWS["risk"] = """select scenario_id, src src_track_id, dst dst_track_id, base, reaction, decel,
    cast(coalesce(vbest >= 3 and bbest >= 3, false) as integer) label_dynamic_risk, coalesce(vbest >= 3, false) dynamic_computable,
    case when vbest >= 3 then (case when bbest >= 3 then qual else every end).m end dynamic_margin_min,
    case when vbest >= 3 then (case when bbest >= 3 then qual else every end).t - 50 end dynamic_risk_step,
    case when vbest >= 3 then (case when bbest >= 3 then qual else every end).c end closing_speed_at_risk,
    case when vbest >= 3 then (case when bbest >= 3 then qual else every end).lim end threshold_at_risk,
    case when vbest >= 3 then bbest else 0 end violation_run_max
  from (select e.scenario_id, e.src, e.dst, p.base, p.reaction, p.decel from pair_ids e cross join risk_params p) e
  left join risk_edge r using (scenario_id, src, dst, base, reaction, decel)"""
VIEWS["lane_rel"] = """select f.scenario_id, f.src_track_id, f.dst_track_id, f.d_current, known map_known, known and a_lane = b_lane same_lane,
    known and lat lateral_neighbor_lane, false connected_lane, hd lane_heading_diff, a_int or b_int either_intersection
  from (select f.*, coalesce(a.lane_distance <= 8, false) and coalesce(b.lane_distance <= 8, false) known, a.lane_id a_lane, b.lane_id b_lane,
      a.lane_is_intersection a_int, b.lane_is_intersection b_int,
      abs(atan2(sin(a.lane_heading - b.lane_heading), cos(a.lane_heading - b.lane_heading))) hd,
      exists (select 1 from lane_links l where l.scenario_id = f.scenario_id
        and ((l.src = a.lane_id and l.dst = b.lane_id) or (l.src = b.lane_id and l.dst = a.lane_id))) lat
    from feat f join nodes a on a.scenario_id = f.scenario_id and a.track_id = f.src_track_id
    join nodes b on b.scenario_id = f.scenario_id and b.track_id = f.dst_track_id) f"""
VIEWS["lane_edge"] = """select *, relation map_relation_type, relation <> 6 map_candidate, not map_known map_unknown, relation = 6 map_blocked
  from (select *, case when not map_known then 0 when same_lane then 1 when lateral_neighbor_lane then 2 when connected_lane then 3
    when either_intersection then 4 when lane_heading_diff between radians(45) and radians(135) and d_current > 15 then 6 else 5 end relation
    from lane_rel)"""
VIEWS["gate"] = """select scenario_id, src_track_id, dst_track_id, near kinematic_near, dyn kinematic_dynamic, away kinematic_far_receding,
    (near or dyn) and not away kinematic_candidate
  from (select *, d_current <= 35 or d_min_obs <= 30 near,
    d_current <= 50 and (d_trend <= -0.02 or d_trend_late <= -0.02 or closing_speed_current >= 0.5 or closing_speed_max >= 1.5) dyn,
    d_current > 40 and d_trend_late > 0.03 and closing_speed_current < -0.2 and closing_speed_max < 0.5 away from feat)"""
VIEWS["edges"] = """select f.*, u.* exclude (scenario_id, src_track_id, dst_track_id),
    k.* exclude (scenario_id, src_track_id, dst_track_id, base, reaction, decel),
    l.* exclude (scenario_id, src_track_id, dst_track_id, d_current, relation), g.* exclude (scenario_id, src_track_id, dst_track_id),
    true raw_edge, map_candidate physical_possible, map_candidate message_passing, map_candidate and kinematic_candidate task_candidate,
    not map_candidate hard_pruned, map_candidate and not kinematic_candidate soft_task_excluded,
    pair_future_count >= 30 label_computable,
    coalesce(pair_future_count >= 50 and future_last_valid_timestep >= 100, false) label_strict,
    map_candidate and kinematic_candidate and pair_future_count >= 30 supervision,
    cast(coalesce(pair_future_count >= 30 and future_min_distance <= 10, false) as integer) label_proximity,
    cast(coalesce(pair_future_count >= 30 and future_min_distance <= 10 and map_candidate and kinematic_candidate, false) as integer) label_risk,
    row_number() over (partition by f.scenario_id order by f.src_track_id, f.dst_track_id) - 1 edge_id,
    a.node_id src_node_id, b.node_id dst_node_id, a.cur_ok src_cur_ok, b.cur_ok dst_cur_ok
  from feat f join futmin u using (scenario_id, src_track_id, dst_track_id) join risk k using (scenario_id, src_track_id, dst_track_id)
  join lane_edge l using (scenario_id, src_track_id, dst_track_id) join gate g using (scenario_id, src_track_id, dst_track_id)
  join nodes a on a.scenario_id = f.scenario_id and a.track_id = f.src_track_id
  join nodes b on b.scenario_id = f.scenario_id and b.track_id = f.dst_track_id"""
