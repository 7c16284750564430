"""SQL of the derived tables, for the checks: the same integer arithmetic as the Spark side."""

from __future__ import annotations

_U = {
    "u2": "((31*({k}%1000003)*({k}%1000003) + 7919*({k}%1000003)) % 1000003) / 1000003e0",
    "u3": "((({k}%1000003)*({k}%1000003)%1000003*17*({k}%1000003) + 104729*({k}%1000003)) % 1000003) / 1000003e0",
    "u4": "(((({k}%1000003)*({k}%1000003)%1000003)*({k}%1000003)%1000003*13*({k}%1000003)"
          " + 611953*({k}%1000003)) % 1000003) / 1000003e0",
}


def u(which: str, key: str) -> str:
    return _U[which].format(k=f"({key})")


_R = "(0.015e0 + 0.0005e0*p_size)"
_BASE = ("SELECT p_partkey//100 AS sample_id, p_partkey%100 AS particle_id, "
         "CASE WHEN p_size%3=0 THEN '2' ELSE '1' END AS phase, "
         f"{u('u2', 'p_partkey')} AS cx, {u('u3', 'p_partkey')} AS cy, {u('u4', 'p_partkey')} AS cz, "
         f"{_R} AS r0, p_size AS size, p_partkey AS key FROM part")

VIEWS = {
    "samples": "samples AS (SELECT DISTINCT p_partkey//100 AS sample_id FROM part)",
    "disks": f"disks AS (SELECT sample_id, particle_id, phase, cx, cy, r0 AS r FROM ({_BASE}))",
    "spheres": f"spheres AS (SELECT sample_id, particle_id, phase, cx, cy, cz, r0*2 AS r FROM ({_BASE}))",
    "crowd2": "crowd2 AS (SELECT sample_id, particle_id, CASE WHEN particle_id%2=0 THEN 0.25e0+cx/32 ELSE cx END AS cx, "
              f"CASE WHEN particle_id%2=0 THEN 0.25e0+cy/32 ELSE cy END AS cy FROM ({_BASE}))",
    "crowd3": "crowd3 AS (SELECT sample_id, particle_id, CASE WHEN particle_id%2=0 THEN 0.25e0+cx/8 ELSE cx END AS cx, "
              "CASE WHEN particle_id%2=0 THEN 0.25e0+cy/8 ELSE cy END AS cy, "
              f"CASE WHEN particle_id%2=0 THEN 0.25e0+cz/8 ELSE cz END AS cz FROM ({_BASE}))",
    "mixed2": "mixed2 AS (SELECT sample_id, particle_id, phase, cx, cy, "
              "CASE key%3 WHEN 0 THEN 'Disk' WHEN 1 THEN 'Square' ELSE 'Ellipse' END AS shape, "
              "CASE WHEN key%3=0 THEN r0 END AS r, CASE WHEN key%3=1 THEN 2*r0 END AS side, "
              "CASE WHEN key%3=2 THEN 3*r0 END AS major_axis, CASE WHEN key%3=2 THEN 2*r0 END AS minor_axis, "
              f"CASE WHEN key%3=2 THEN 2*pi()*cz END AS angle FROM ({_BASE}))",
    "mixed3": "mixed3 AS (SELECT sample_id, particle_id, phase, cx, cy, cz, "
              "CASE key%3 WHEN 0 THEN 'Sphere' WHEN 1 THEN 'Ellipsoid' ELSE 'Cylinder' END AS shape, "
              "CASE WHEN key%3=0 THEN 2*r0 END AS r, "
              "CASE WHEN key%3=1 THEN 3*(r0*2) END AS axis_1, CASE WHEN key%3=1 THEN 2*(r0*2) END AS axis_2, "
              "CASE WHEN key%3=1 THEN 1.5e0*(r0*2) END AS axis_3, CASE WHEN key%3=1 THEN cx+0.5e0 END AS rot_x, "
              "CASE WHEN key%3=1 THEN cy+0.5e0 END AS rot_y, CASE WHEN key%3=1 THEN cz+0.5e0 END AS rot_z, "
              "CASE WHEN key%3=1 THEN 2*pi()*cx END AS angle, CASE WHEN key%3=2 THEN 2*r0 END AS r_cyl, "
              "CASE WHEN key%3=2 THEN 3*(2*r0) END AS length, CASE WHEN key%3=2 THEN 2*pi()*cx END AS azimuth_angle, "
              f"CASE WHEN key%3=2 THEN pi()*cy END AS polar_angle FROM ({_BASE}))",
    "fibers": "fibers AS (SELECT sample_id, particle_id, phase, cx, cy, r0 AS r, sample_id%3 AS direction "
              f"FROM ({_BASE}))",
    "one": "one AS (SELECT 0::BIGINT AS sample_id, key AS particle_id, phase, cx, cy, "
           f"r0*sqrt(100e0/(SELECT count(*) FROM part)) AS r FROM ({_BASE}))",
    "points": "points AS (SELECT k % (SELECT max(p_partkey)//100+1 FROM part) AS sample_id, k AS point_id, "
              f"{u('u2', 'k')} AS x, {u('u3', 'k')} AS y, {u('u4', 'k')} AS z "
              "FROM (SELECT DISTINCT l_orderkey*8+l_linenumber AS k FROM lineitem))",
    "pairs": "pairs AS (SELECT *, sqrt(dx*dx+dy*dy) AS d FROM (SELECT a.sample_id, a.particle_id AS i, "
             "b.particle_id AS j, a.r AS ri, b.r AS rj, (b.cx-a.cx)-round_even(b.cx-a.cx,0) AS dx, "
             "(b.cy-a.cy)-round_even(b.cy-a.cy,0) AS dy FROM disks a JOIN disks b "
             "ON a.sample_id=b.sample_id AND a.particle_id<b.particle_id))",
    "pairs3": "pairs3 AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS d FROM (SELECT a.sample_id, a.particle_id AS i, "
              "b.particle_id AS j, a.r AS ri, b.r AS rj, (b.cx-a.cx)-round_even(b.cx-a.cx,0) AS dx, "
              "(b.cy-a.cy)-round_even(b.cy-a.cy,0) AS dy, (b.cz-a.cz)-round_even(b.cz-a.cz,0) AS dz "
              "FROM spheres a JOIN spheres b ON a.sample_id=b.sample_id AND a.particle_id<b.particle_id))",
    "directed": "directed AS (SELECT sample_id, i, j, ri, rj, dx, dy, d FROM pairs "
                "UNION ALL SELECT sample_id, j, i, rj, ri, -dx, -dy, d FROM pairs)",
    "steps": "steps AS (SELECT sample_id, step, ts, total_overlap, total_overlap*0.5e0 AS kinetic, "
             "CASE WHEN step>0 THEN total_overlap*0.25e0+1 END AS thermic, 1e0/(1+step%7) AS dt FROM ("
             "SELECT user_id AS sample_id, ts, value AS total_overlap, "
             "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS step FROM events))",
    "longsteps": "longsteps AS (SELECT sample_id, step, ts, total_overlap, total_overlap*0.5e0 AS kinetic, "
                 "CASE WHEN step>0 THEN total_overlap*0.25e0+1 END AS thermic, 1e0/(1+step%7) AS dt FROM ("
                 "SELECT event_type AS sample_id, ts, value AS total_overlap, "
                 "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)-1 AS step FROM events))",
    "paths": "paths AS (SELECT sample_id%10 AS sample_id, sample_id AS particle_id, step, "
             f"{u('u2', 'sample_id*1000+step')} AS x, {u('u3', 'sample_id*1000+step')} AS y, dt FROM steps)",
    "pair_overlaps": "pair_overlaps AS (SELECT sample_id%5 AS sample_id, sample_id//5 AS i, "
                     "sample_id//5+1+sample_id%3 AS j, step, total_overlap AS overlap FROM steps WHERE step%4<>2)",
}
_NEEDS = {"pairs": ["disks"], "pairs3": ["spheres"], "directed": ["disks", "pairs"],
          "paths": ["steps"], "pair_overlaps": ["steps"]}


def sql(text: str, *views: str, **extra: str) -> str:
    """``WITH`` the named derived tables, any extra ones, then the query."""
    wanted: list[str] = []
    for v in views:
        for need in [*_NEEDS.get(v, []), v]:
            if need not in wanted:
                wanted.append(need)
    parts = [VIEWS[v] for v in wanted] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + text
