"""Small tables from plain tracks: {agent: [(t, x, y, vx, vy, heading_deg, valid), ...]}."""

import math

from lanewise.schema import TRACK_POINTS


def points(spark, tracks, types=None, scenario=1, hz=10.0, length=1.0, z=0.0):
    rows = []
    for a, steps in tracks.items():
        for t, x, y, vx, vy, h, ok in steps:
            rows.append((scenario, a, t, (types or {}).get(a, 1), t / hz, float(x), float(y), float(z), length, 1.0, 1.0,
                         math.radians(h), float(vx), float(vy), bool(ok)))
    return spark.createDataFrame(rows, TRACK_POINTS)


def scenarios(spark, ego=0, now=0, hz=10.0, n=10, ids=(1,), **limits):
    rows = [(i, "test", ego, now, hz, n, *limits.values()) for i in ids]
    kinds = ", ".join(f"{k} double" for k in limits)
    return spark.createDataFrame(
        rows, "scenario_id long, dataset string, ego_idx long, current_time_index int, frequency_hz double, n_steps int"
        + (", " + kinds if kinds else ""))


def agents(spark, types, scenario=1, **extra):
    rows = [(scenario, a, a + 100, t, *[v.get(a) for v in extra.values()]) for a, t in types.items()]
    cols = "scenario_id long, agent_idx long, agent_id long, agent_type int" + "".join(f", {k} double" for k in extra)
    return spark.createDataFrame(rows, cols)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}
