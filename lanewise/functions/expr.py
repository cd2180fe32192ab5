"""Column-expression builders shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.schema import EPS, AgentType, PairType, TrackShape

INF = float("inf")
NAN = float("nan")


def lit_d(v: float) -> Column:
    return F.lit(float(v))


def ieee_div(num: Column, den: Column) -> Column:
    """Division by zero gives NaN or a signed infinity instead of an ANSI error."""
    return (
        F.when(den != 0.0, num / den)
        .when((num == 0.0) | F.isnan(num), lit_d(NAN))
        .when(num.isNotNull() & den.isNotNull(), F.signum(num) * lit_d(INF))
    )


def norm2(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def norm3(a: Column, b: Column, c: Column) -> Column:
    return F.sqrt(a * a + b * b + c * c)


def wrap_degrees(delta: Column) -> Column:
    """Signed angle in [-180, 180)."""
    return F.pmod(delta + 540.0, lit_d(360.0)) - 180.0


def is_valid(valid: Column) -> Column:
    """Null and NaN validity counts as not valid."""
    num = valid.cast("double")
    return F.coalesce(F.nanvl(num, lit_d(0.0)), lit_d(0.0)) > 0


def moving_average(df: DataFrame, value: str, out: str, w, width: int = 5) -> DataFrame:
    """Centred mean over `width` rows of `w`; beyond either end the end value repeats."""
    half = width // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = {"_first": F.first(value).over(whole), "_last": F.last(value).over(whole)}
    for k in range(1, half + 1):
        parts[f"_back{k}"], parts[f"_ahead{k}"] = F.lag(value, k).over(w), F.lead(value, k).over(w)
    total = F.col(value)
    for k in range(1, half + 1):
        total = total + F.coalesce(f"_back{k}", "_first") + F.coalesce(f"_ahead{k}", "_last")
    return df.withColumns(parts).withColumn(out, total / float(2 * half + 1)).drop(*parts)


def gradient(df: DataFrame, value: str, at: str, out: str, w) -> DataFrame:
    """Second-order derivative estimate on an uneven grid, one-sided at both ends."""
    parts = {
        "_prev": F.lag(value).over(w), "_next": F.lead(value).over(w),
        "_back": F.col(at) - F.lag(at).over(w), "_ahead": F.lead(at).over(w) - F.col(at),
    }
    v, prev, nxt, back, ahead = (F.col(c) for c in (value, "_prev", "_next", "_back", "_ahead"))
    inner = ieee_div(
        back * back * nxt + (ahead * ahead - back * back) * v - ahead * ahead * prev, back * ahead * (back + ahead))
    slope = (
        F.when(back.isNull(), ieee_div(nxt - v, ahead)).when(ahead.isNull(), ieee_div(v - prev, back)).otherwise(inner)
    )
    return df.withColumns(parts).withColumn(out, slope).drop(*parts)


def category(value: Column, thresholds: Column) -> Column:
    """1-based interval index of `value` among ascending `thresholds`; intervals are closed on the right."""
    below = F.filter(thresholds, lambda t: t < value)
    return (F.size(below) + 1).cast("double")


def fold_ego(agent_type: Column) -> Column:
    return F.when(agent_type == int(AgentType.EGO_AGENT), int(AgentType.VEHICLE)).otherwise(agent_type)


def pair_type(a: Column, b: Column) -> Column:
    lo, hi = F.least(fold_ego(a), fold_ego(b)), F.greatest(fold_ego(a), fold_ego(b))
    veh, ped, cyc = int(AgentType.VEHICLE), int(AgentType.PEDESTRIAN), int(AgentType.CYCLIST)
    both_ego = (a == int(AgentType.EGO_AGENT)) & (b == int(AgentType.EGO_AGENT))
    table = [
        (veh, veh, PairType.VEHICLE_VEHICLE), (veh, ped, PairType.VEHICLE_PEDESTRIAN),
        (veh, cyc, PairType.VEHICLE_CYCLIST), (ped, ped, PairType.PEDESTRIAN_PEDESTRIAN),
        (ped, cyc, PairType.PEDESTRIAN_CYCLIST), (cyc, cyc, PairType.CYCLIST_CYCLIST),
    ]
    out = F.when(both_ego, int(PairType.OTHER))
    for x, y, code in table:
        out = out.when((lo == x) & (hi == y), int(code))
    return out.otherwise(int(PairType.OTHER)).cast("int")


def pair_type_name(code: Column) -> Column:
    out = None
    for p in PairType:
        out = F.when(code == int(p), p.name) if out is None else out.when(code == int(p), p.name)
    return out


def agent_type_name(code: Column) -> Column:
    out = None
    for a in AgentType:
        out = F.when(code == int(a), a.name) if out is None else out.when(code == int(a), a.name)
    return out


def threshold_group(agent_type: Column) -> Column:
    """Threshold set an agent type reads; ego uses the vehicle set, other types have none."""
    return (
        F.when(agent_type.isin(int(AgentType.VEHICLE), int(AgentType.EGO_AGENT)), "VEHICLE")
        .when(agent_type == int(AgentType.CYCLIST), "CYCLIST")
        .when(agent_type == int(AgentType.PEDESTRIAN), "PEDESTRIAN")
    )


def track_shape(dx, dy, heading0_deg, heading1_deg, speed0, speed1, lim) -> Column:
    """Manoeuvre class from the end-to-end displacement seen in the starting heading."""
    h = F.radians(heading0_deg)
    along = dx * F.cos(h) + dy * F.sin(h)
    side = dy * F.cos(h) - dx * F.sin(h)
    turn = heading1_deg - heading0_deg
    slow = F.greatest(speed0, speed1) < lim["max_stationary_speed"]
    near = norm2(dx, dy) < lim["max_stationary_displacement"]
    max_turn = lim["max_straight_absolute_heading_diff"]
    back = along < lim["min_uturn_longitudinal_displacement"]
    straight = (
        F.when(F.abs(side) < lim["max_straight_lateral_displacement"], int(TrackShape.STRAIGHT))
        .when(side < 0, int(TrackShape.STRAIGHT_RIGHT))
        .otherwise(int(TrackShape.STRAIGHT_LEFT))
    )
    right = F.when(back, int(TrackShape.RIGHT_U_TURN)).otherwise(int(TrackShape.RIGHT_TURN))
    left = F.when(back, int(TrackShape.LEFT_U_TURN)).otherwise(int(TrackShape.LEFT_TURN))
    return (
        F.when(slow & near, int(TrackShape.STATIONARY))
        .when(F.abs(turn) < max_turn, straight)
        .when((turn < -max_turn) & (side < 0), right)
        .otherwise(left)
        .cast("int")
    )


def segments_touch(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Closed planar segments AB and CD share at least one point (zero-length segments included)."""

    def cross(ox, oy, px, py, qx, qy):
        return (px - ox) * (qy - oy) - (py - oy) * (qx - ox)

    boxes = (
        (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx))
        & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    )
    c_side, d_side = cross(ax, ay, bx, by, cx, cy), cross(ax, ay, bx, by, dx, dy)
    a_side, b_side = cross(cx, cy, dx, dy, ax, ay), cross(cx, cy, dx, dy, bx, by)
    # With overlapping boxes, "neither segment lies strictly on one side of the other" is exact.
    apart = ((c_side > 0) & (d_side > 0)) | ((c_side < 0) & (d_side < 0)) \
        | ((a_side > 0) & (b_side > 0)) | ((a_side < 0) & (b_side < 0))
    return boxes & ~apart


def i_leads(xi, yi, heading_i_deg, xj, yj) -> Column:
    """True when j lies behind i, i.e. more than 90 degrees off i's heading."""
    bearing = F.degrees(F.atan2(yj - yi, xj - xi))
    return F.abs(wrap_degrees(bearing - heading_i_deg)) > 90.0


def gap_and_closing(sep, len_i, len_j, v_i, v_j, lead_i):
    """(gap to the leader, follower speed, follower speed minus leader speed)."""
    gap = sep - F.when(lead_i, len_i).otherwise(len_j)
    follower = F.when(lead_i, v_j).otherwise(v_i)
    closing = F.when(lead_i, v_j - v_i).otherwise(v_i - v_j)
    return gap, follower, closing


def headway(gap, follower) -> Column:
    return F.abs(gap / (follower + EPS))


def time_to_collision(gap, closing) -> Column:
    return F.when(closing > 0, F.abs(gap / (closing + EPS))).otherwise(lit_d(INF))


def required_deceleration(gap, closing, cap) -> Column:
    raw = F.when(closing > 0, closing * closing / (2.0 * F.abs(gap) + EPS)).otherwise(lit_d(0.0))
    return F.least(F.greatest(raw, lit_d(0.0)), cap)


def inverse_capped(value: Column, cap: float = 10.0) -> Column:
    return F.least(ieee_div(lit_d(1.0), value + EPS), lit_d(cap))


def yaw_from_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def case_map(key: Column, mapping: dict, default=None) -> Column:
    """A small fixed lookup as a literal map, so no join is planned."""
    entries = [F.lit(v) for kv in mapping.items() for v in (kv[0], int(kv[1]) if hasattr(kv[1], "value") else kv[1])]
    hit = F.try_element_at(F.create_map(*entries), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def round_half_even(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def unpivot_features(features: Sequence[str]) -> Column:
    """One struct(feature, value) per feature, to be exploded."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
