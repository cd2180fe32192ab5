"""Table schemas, code lists, limits and scoring presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from enum import IntEnum

from pyspark.sql import types as T

EPS = 1e-6
LARGE = 1e6
MPH_TO_MS = 0.44704
MIN_VALID = 2


class AgentType(IntEnum):
    UNSET = 0
    VEHICLE = 1
    PEDESTRIAN = 2
    CYCLIST = 3
    OTHER = 4
    EGO_AGENT = 5
    RELEVANT = 6


class PairType(IntEnum):
    UNSET = 0
    VEHICLE_VEHICLE = 1
    VEHICLE_PEDESTRIAN = 2
    VEHICLE_CYCLIST = 3
    PEDESTRIAN_PEDESTRIAN = 4
    PEDESTRIAN_CYCLIST = 5
    CYCLIST_CYCLIST = 6
    OTHER = 10


# Codes of pair statuses.
class PairStatus(IntEnum):
    UNKNOWN = -1
    OK = 0
    PARTIAL_HEADING = 1
    MASK_NOT_VALID = 2
    TOO_FAR = 3
    STATIONARY = 4
    OUT_OF_SCOPE = 5


SCORED_STATUSES = (int(PairStatus.OK), int(PairStatus.PARTIAL_HEADING))


class TrackShape(IntEnum):
    UNSET = -1
    STATIONARY = 0
    STRAIGHT = 1
    STRAIGHT_RIGHT = 2
    STRAIGHT_LEFT = 3
    RIGHT_U_TURN = 4
    RIGHT_TURN = 5
    LEFT_U_TURN = 6
    LEFT_TURN = 7


# Score contribution of each track shape.
TRACK_SHAPE_WEIGHTS = {
    TrackShape.UNSET: 0.0,
    TrackShape.STATIONARY: 9.0,
    TrackShape.STRAIGHT: 5.0,
    TrackShape.STRAIGHT_RIGHT: 9.0,
    TrackShape.STRAIGHT_LEFT: 9.0,
    TrackShape.RIGHT_U_TURN: 9.0,
    TrackShape.RIGHT_TURN: 8.0,
    TrackShape.LEFT_U_TURN: 9.0,
    TrackShape.LEFT_TURN: 8.0,
}


# Codes of map polylines.
class PolylineType(IntEnum):
    UNDEFINED = -1
    FREEWAY = 1
    SURFACE_STREET = 2
    BIKE_LANE = 3
    BROKEN_SINGLE_WHITE = 6
    SOLID_SINGLE_WHITE = 7
    SOLID_DOUBLE_WHITE = 8
    BROKEN_SINGLE_YELLOW = 9
    BROKEN_DOUBLE_YELLOW = 10
    SOLID_SINGLE_YELLOW = 11
    SOLID_DOUBLE_YELLOW = 12
    PASSING_DOUBLE_YELLOW = 13
    ROAD_EDGE_BOUNDARY = 15
    ROAD_EDGE_MEDIAN = 16
    STOP_SIGN = 17
    CROSSWALK = 18
    SPEED_BUMP = 19


# Codes of signal states.
class SignalState(IntEnum):
    UNKNOWN = 0
    ARROW_STOP = 1
    ARROW_CAUTION = 2
    ARROW_GO = 3
    STOP = 4
    CAUTION = 5
    GO = 6
    FLASHING_STOP = 7
    FLASHING_CAUTION = 8


# Source category -> agent type.
CATEGORY_TO_AGENT_TYPE = {
    "vehicle.car": AgentType.VEHICLE,
    "vehicle.truck": AgentType.VEHICLE,
    "vehicle.bus.bendy": AgentType.VEHICLE,
    "vehicle.bus.rigid": AgentType.VEHICLE,
    "vehicle.trailer": AgentType.VEHICLE,
    "vehicle.construction": AgentType.VEHICLE,
    "vehicle.emergency.ambulance": AgentType.VEHICLE,
    "vehicle.emergency.police": AgentType.VEHICLE,
    "vehicle.bicycle": AgentType.CYCLIST,
    "vehicle.motorcycle": AgentType.VEHICLE,
    "vehicle": AgentType.VEHICLE,
    "bus": AgentType.VEHICLE,
    "motorcyclist": AgentType.VEHICLE,
    "riderless_bicycle": AgentType.CYCLIST,
    "bicycle": AgentType.CYCLIST,
    "cyclist": AgentType.CYCLIST,
    "pedestrian": AgentType.PEDESTRIAN,
    "static": AgentType.OTHER,
    "background": AgentType.OTHER,
    "construction": AgentType.OTHER,
    "unknown": AgentType.OTHER,
}
PEDESTRIAN_CATEGORY_PREFIX = "human.pedestrian"

# Fixed values: (length, width, height) in metres when the source has no boxes.
DEFAULT_BOX = {
    "vehicle": (4.5, 2.0, 1.7),
    "bus": (12.0, 2.9, 3.5),
    "motorcyclist": (2.3, 0.9, 1.3),
    "riderless_bicycle": (1.8, 0.6, 1.2),
    "pedestrian": (0.8, 0.8, 1.8),
    "cyclist": (2.0, 0.8, 1.6),
    "static": (0.5, 0.5, 0.5),
    "background": (0.5, 0.5, 0.5),
    "construction": (1.0, 1.0, 1.5),
    "unknown": (0.5, 0.5, 0.5),
}
FALLBACK_BOX = (0.5, 0.5, 0.5)

# Painted lane mark -> polyline type; marks not listed are dropped.
LANE_MARK_TO_POLYLINE = {
    "SOLID_WHITE": PolylineType.SOLID_SINGLE_WHITE,
    "SOLID_YELLOW": PolylineType.SOLID_SINGLE_YELLOW,
    "DOUBLE_SOLID_WHITE": PolylineType.SOLID_DOUBLE_WHITE,
    "DOUBLE_SOLID_YELLOW": PolylineType.SOLID_DOUBLE_YELLOW,
    "DASHED_WHITE": PolylineType.BROKEN_SINGLE_WHITE,
    "DASHED_YELLOW": PolylineType.BROKEN_SINGLE_YELLOW,
    "DOUBLE_DASH_WHITE": PolylineType.BROKEN_SINGLE_WHITE,
    "DOUBLE_DASH_YELLOW": PolylineType.BROKEN_DOUBLE_YELLOW,
    "SOLID_DASH_WHITE": PolylineType.SOLID_SINGLE_WHITE,
    "SOLID_DASH_YELLOW": PolylineType.SOLID_SINGLE_YELLOW,
    "DASH_SOLID_WHITE": PolylineType.SOLID_SINGLE_WHITE,
    "DASH_SOLID_YELLOW": PolylineType.SOLID_SINGLE_YELLOW,
}

# Agent relevance by target difficulty.
DIFFICULTY_RELEVANCE = {0: 0.8, 1: 0.9, 2: 1.0}


# Default thresholds of a scene.
@dataclass(frozen=True)
class Limits:
    """Scenario thresholds. A column of the same name on the scenarios table overrides a value per scenario."""

    max_stationary_speed: float = 2.0
    max_stationary_displacement: float = 5.0
    max_straight_lateral_displacement: float = 5.0
    min_uturn_longitudinal_displacement: float = -5.0
    max_straight_absolute_heading_diff: float = 30.0
    agent_to_agent_max_distance: float = 100.0
    agent_to_conflict_point_max_distance: float = 10.0
    agent_to_agent_distance_breach: float = 0.5
    heading_threshold: float = 45.0
    agent_max_deceleration: float = 20.0


def _known(cls, values: dict | None):
    names = {f.name for f in fields(cls)}
    return {k: float(v) for k, v in (values or {}).items() if k in names}


# Caps of scored features.
@dataclass(frozen=True)
class Caps:
    """Feature value at which the score contribution saturates."""

    speed: float = 13.0
    speed_limit_diff: float = 5.0
    acceleration: float = 10.0
    deceleration: float = 5.0
    jerk: float = 1.5
    waiting_period: float = 4.0
    kalman_difficulty: float = 50.0
    mttcp: float = 4.0
    thw: float = 2.0
    ttc: float = 2.0
    drac: float = 3.0
    collision: float = 1.0

    @classmethod
    def from_dict(cls, values: dict | None) -> Caps:
        return cls(**_known(cls, values))


# Weights of scored features.
@dataclass(frozen=True)
class Weights:
    speed: float = 1.0
    speed_limit_diff: float = 1.0
    acceleration: float = 1.0
    deceleration: float = 1.0
    jerk: float = 0.1
    waiting_period: float = 1.0
    kalman_difficulty: float = 1.0
    trajectory_type: float = 1.0
    collision: float = 1.0
    mttcp: float = 1.0
    thw: float = 1.0
    ttc: float = 1.0
    drac: float = 1.0

    @classmethod
    def from_dict(cls, values: dict | None) -> Weights:
        return cls(**_known(cls, values))


@dataclass(frozen=True)
class ScoreConfig:
    weights: Weights = field(default_factory=Weights)
    caps: Caps = field(default_factory=Caps)
    clip: tuple[float, float] = (0.0, 200.0)
    weighting: str = "uniform"  # uniform | ego_distance | relevant_distance
    vru_weight: float = 1.0
    max_critical_distance: float = 0.5
    sqrt_distance: float | bool = False
    combine_weight: float = 0.5
    individual_function: str = "simple"
    pair_function: str = "simple"

    def with_(self, **changes) -> ScoreConfig:
        return replace(self, **changes)


# Scoring presets.
_PIPELINE_WEIGHTS = dict(
    speed=1, speed_limit_diff=1, acceleration=1, deceleration=1, jerk=0.1, waiting_period=1,
    kalman_difficulty=1, trajectory_type=0.1, collision=4, mttcp=2, thw=2, ttc=2, drac=2,
)
_PIPELINE_CAPS = dict(
    speed=18, speed_limit_diff=19, acceleration=5, deceleration=5, jerk=60, waiting_period=5,
    kalman_difficulty=23, collision=1, mttcp=2, thw=2, ttc=2, drac=5,
)
_INDIVIDUAL_EIGHT = dict(
    speed=8, speed_limit_diff=8, acceleration=8, deceleration=8, jerk=8, waiting_period=8, kalman_difficulty=8,
)
_INDIVIDUAL_ONE = dict(
    speed=1, speed_limit_diff=1, acceleration=1, deceleration=1, jerk=1, waiting_period=1,
    kalman_difficulty=1, trajectory_type=0.1,
)
_PAIR_EIGHT = dict(collision=1, mttcp=8, thw=8, ttc=8, drac=8)
_JOB = dict(weighting="ego_distance", vru_weight=2.0, sqrt_distance=True)
PRESETS = {
    "code_default": ScoreConfig(),
    "pipeline_default": ScoreConfig(Weights.from_dict(_PIPELINE_WEIGHTS), Caps.from_dict(_PIPELINE_CAPS), **_JOB),
    "individual_categorical": ScoreConfig(
        Weights.from_dict({**_PIPELINE_WEIGHTS, **_INDIVIDUAL_ONE}),
        Caps.from_dict({**_PIPELINE_CAPS, **_INDIVIDUAL_EIGHT}), (0.0, 60.0), **_JOB),
    "interaction_categorical": ScoreConfig(
        Weights.from_dict({**_PIPELINE_WEIGHTS, "collision": 4, "mttcp": 2, "thw": 2, "ttc": 2, "drac": 2}),
        Caps.from_dict({**_PIPELINE_CAPS, **_PAIR_EIGHT}), (0.0, 70.0), **_JOB),
    "combined_categorical": ScoreConfig(
        Weights.from_dict({**_INDIVIDUAL_ONE, "collision": 4, "mttcp": 3, "thw": 1, "ttc": 2, "drac": 2}),
        Caps.from_dict({**_INDIVIDUAL_EIGHT, **_PAIR_EIGHT}), (0.0, 16.0), **_JOB),
    "probe": ScoreConfig(
        Weights.from_dict({**_PIPELINE_WEIGHTS, "collision": 5, "mttcp": 2, "thw": 2, "ttc": 2, "drac": 2}),
        Caps.from_dict({**_PIPELINE_CAPS, "collision": 1, "mttcp": 2, "thw": 2, "ttc": 2, "drac": 5}),
        weighting="ego_distance"),
    "probe_collision": ScoreConfig(
        Weights.from_dict({**_PIPELINE_WEIGHTS, "collision": 5, "mttcp": 0, "thw": 0, "ttc": 0, "drac": 0}),
        Caps.from_dict({**_PIPELINE_CAPS, "collision": 1, "mttcp": 2, "thw": 2, "ttc": 2, "drac": 5}),
        weighting="ego_distance"),
}

# Default category boundaries, (name, upper percentile).
CATEGORIES = (("LOW", 25.0), ("MEDIUM", 75.0), ("HIGH", 90.0), ("CRITICAL", 100.0))

INDIVIDUAL_FEATURES = (
    "speed", "speed_limit_diff", "acceleration", "deceleration", "jerk", "waiting_period", "kalman_difficulty",
)
PAIR_FEATURES = (
    "separation", "intersection", "collision", "mttcp", "inv_mttcp", "thw", "inv_thw", "ttc", "inv_ttc", "drac",
)


def _s(*cols):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


_L, _I, _D, _B, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.StringType()

SCENARIOS = _s(
    ("scenario_id", _L, False), ("dataset", _S, False), ("ego_idx", _L, False), ("current_time_index", _I, False),
    ("frequency_hz", _D, False), ("n_steps", _I, False), ("objects_of_interest", T.ArrayType(_L), True),
)
AGENTS = _s(
    ("scenario_id", _L, False), ("agent_idx", _L, False), ("agent_id", _L, False), ("agent_type", _I, False),
    ("relevance", _D, True), ("difficulty", _I, True),
)
TRACK_POINTS = _s(
    ("scenario_id", _L, False), ("agent_idx", _L, False), ("t", _I, False), ("agent_type", _I, False),
    ("ts_s", _D, False), ("x", _D, True), ("y", _D, True), ("z", _D, True), ("length", _D, True), ("width", _D, True),
    ("height", _D, True), ("heading", _D, True), ("vx", _D, True), ("vy", _D, True), ("valid", _B, True),
)
MAP_POINTS = _s(
    ("scenario_id", _L, False), ("feature_class", _S, False), ("feature_idx", _L, False), ("point_idx", _L, False),
    ("x", _D, False), ("y", _D, False), ("z", _D, False), ("polyline_type", _I, True),
)
LANES = _s(
    ("scenario_id", _L, False), ("lane_idx", _L, False), ("lane_id", _L, True), ("speed_limit_mph", _D, True),
)
SIGNALS = _s(
    ("scenario_id", _L, False), ("t", _I, False), ("lane_id", _L, False), ("state", _I, True),
    ("x", _D, False), ("y", _D, False), ("z", _D, False),
)
THRESHOLDS = _s(("type", _S, False), ("feature", _S, False), ("ord", _I, False), ("label", _S, False), ("value", _D, False))
TABLES = {
    "scenarios": SCENARIOS, "agents": AGENTS, "track_points": TRACK_POINTS, "map_points": MAP_POINTS,
    "lanes": LANES, "signals": SIGNALS,
}
