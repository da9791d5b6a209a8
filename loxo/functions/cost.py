"""Edge costs as SQL expressions; the routing kernel reads the same tables."""

from __future__ import annotations

from .tags import BIKE, DESIGNATED, MTB, NETWORK

# Multipliers by class and surface code, metres per metre of descent by surface code.
CLASS_COST = {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.05, 4: 1.15, 5: 1.4, 6: 1.35, 7: 2.6, 8: 1.0, 9: 1.0}
TRACK_WITH_MTB, PATH_WITH_BOTH, PATH_MTB_ONLY = 1.0, 1.1, 1.0
SURFACE_COST = {0: 1.0, 1: 1.12, 2: 2.2, 3: 1.85, 4: 1.35, 5: 1.0}
DESCENT = {0: 0.0, 1: 1.0, 2: 25.0, 3: 8.0, 4: 4.0, 5: 0.0}
DESIGNATED_FACTOR, NETWORK_FACTOR, FOOT_ONLY_FACTOR, TURN = 0.98, 0.99, 4.0, 100.0
HINGE, CLIMB, CLIMB_MTB = 0.04, 80.0, 45.0


def rough(modes: int) -> float:
    """How much of the surface penalties counts."""
    return 1.0 if not modes & MTB else 0.5 if modes & BIKE else 0.25


def class_table(modes: int) -> dict[int, float]:
    t = dict(CLASS_COST)
    if modes & MTB:
        t[6], t[7] = TRACK_WITH_MTB, PATH_WITH_BOTH if modes & BIKE else PATH_MTB_ONLY
    return t


def surface_table(modes: int) -> dict[int, float]:
    return {k: 1 + (v - 1) * rough(modes) for k, v in SURFACE_COST.items()}


def descent_table(modes: int) -> dict[int, float]:
    return {k: v * rough(modes) for k, v in DESCENT.items()}


def _lookup(x: str, table: dict[int, float], rest: float) -> str:
    return f"(case {x} " + " ".join(f"when {k} then cast({v!r} as double)" for k, v in table.items()) + f" else cast({rest!r} as double) end)"


def weight(dev: str, half: str, alpha: str) -> str:
    rel = f"({dev} / greatest({half}, cast(1 as double)))"
    return f"(1 + {alpha} * {rel} * {rel})"


def admissible(edge_modes: str, modes: int, dev: str, corridor: str, half: str) -> str:
    return f"(({edge_modes} & {modes}) <> 0 and {dev} <= greatest({corridor}, {half}, cast(1 as double)))"


def bike_factor(attrs: str, surface: str, edge_modes: str, modes: int) -> str:
    """Multiplier of class, bonuses, surface and foot-only edges; 1 unless a bike mode is asked for."""
    if not modes & (BIKE | MTB):
        return "cast(1 as double)"
    c = _lookup(f"({attrs} & 15)", class_table(modes), 1.0)
    bonus = f"(case when ({attrs} & {DESIGNATED}) <> 0 then cast({DESIGNATED_FACTOR} as double) else 1 end) * (case when ({attrs} & {NETWORK}) <> 0 then cast({NETWORK_FACTOR} as double) else 1 end)"
    foot = f" * (case when ({edge_modes} & {BIKE}) = 0 then cast({FOOT_ONLY_FACTOR} as double) else 1 end)" if modes & BIKE and not modes & MTB else ""
    return f"({c} * {bonus} * {_lookup(surface, surface_table(modes), 1.0)}{foot})"


def climb(length: str, z0: str, z1: str, surface: str, modes: int) -> str:
    """Metres for going down and up; 0 where an elevation is missing."""
    if not modes & (BIKE | MTB):
        return "cast(0 as double)"
    drop = f"(cast({z0} as double) - cast({z1} as double))"
    k = CLIMB_MTB if modes & MTB and not modes & BIKE else CLIMB
    over = f"greatest(cast(0 as double), -{drop} / {length} - cast({HINGE} as double))"
    return f"(case when {z0} is null or {z1} is null then cast(0 as double) when {drop} > 1 then {drop} * {_lookup(surface, descent_table(modes), 0.0)} when {drop} < -1 and {length} > 1 then {length} * cast({k} as double) * {over} * {over} else cast(0 as double) end)"
