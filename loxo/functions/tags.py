"""Way tags, modes and messages, as SQL expressions."""

from __future__ import annotations

# Bits of modes and of bike attributes, codes of surfaces and classes.
FOOT, BIKE, MTB, FERRY = 1, 2, 4, 8
SURFACES = ("paved", "gravel", "path", "unpaved", "other", "ferry")
PAVED, GRAVEL, PATH, UNPAVED, OTHER, FERRY_SURFACE = range(6)
CLASSES = ("cycleway", "residential", "tertiary", "service", "secondary", "primary", "track", "path", "ferry", "other")
DESIGNATED, NETWORK = 16, 32

# Tag values by the surface they mean.
SURFACE_TAGS = {
    PAVED: "asphalt paved concrete concrete:plates concrete:lanes paving_stones chipseal metal sett cobblestone unhewn_cobblestone",
    GRAVEL: "gravel fine_gravel compacted pebblestone",
    UNPAVED: "unpaved dirt ground earth mud grass sand woodchips bark_chips",
}
HIGHWAY_SURFACE = {PATH: "path footway bridleway steps", PAVED: "cycleway service residential unclassified tertiary secondary primary living_street pedestrian"}
TRACK_SURFACE = {PAVED: "grade1", UNPAVED: "grade3 grade4 grade5"}
# Which highways a mode may use without a tag of its own.
FOOT_WAYS = "path footway track residential unclassified tertiary secondary pedestrian living_street service cycleway steps bridleway"
BIKE_WAYS = "path track residential unclassified tertiary secondary primary cycleway living_street service"
MTB_WAYS = "path track footway cycleway bridleway"
# Bike class of a highway.
CLASS_WAYS = {
    "cycleway": "cycleway",
    "residential": "residential living_street",
    "tertiary": "tertiary tertiary_link unclassified",
    "service": "service",
    "secondary": "secondary secondary_link",
    "primary": "primary primary_link trunk trunk_link",
    "track": "track bridleway",
    "path": "path footway pedestrian steps",
}


def one_of(x: str, words: str) -> str:
    return f"{x} in ({', '.join(repr(w) for w in words.split())})"


def surface(explicit: str, highway: str, tracktype: str) -> str:
    by = lambda x, table, rest: "case " + " ".join(f"when {one_of(x, w)} then {k}" for k, w in table.items()) + f" else {rest} end"
    inferred = f"case when {highway} = 'track' then {by(tracktype, TRACK_SURFACE, GRAVEL)} else {by(highway, HIGHWAY_SURFACE, OTHER)} end"
    return f"(case when {explicit} is not null then {by(explicit, SURFACE_TAGS, OTHER)} else {inferred} end)"


def _allowed(highway: str, ways: str, tag: str) -> str:
    return f"(case when {one_of(tag, 'yes designated permissive destination')} then true when {one_of(tag, 'no private dismount')} then false else {one_of(highway, ways)} end)"


def modes(t: dict[str, str], want: int) -> str:
    """Mode bits of a way; t names the columns of tags."""
    bit = lambda b, ways, tag: f"(case when {_allowed(t['highway'], ways, t[tag])} then {b} else 0 end)" if want & b else "0"
    road = " + ".join((bit(FOOT, FOOT_WAYS, "foot"), bit(BIKE, BIKE_WAYS, "bicycle"), bit(MTB, MTB_WAYS, "bicycle")))
    shut = f"{t['highway']} is null or {one_of(t['highway'], 'motorway motorway_link')} or coalesce({one_of(t['access'], 'no private')}, false)"
    return f"(case when {t['route']} = 'ferry' then {(FOOT | BIKE | FERRY) & (want | FERRY)} when {shut} then 0 else {road} end)"


def _open(t: dict[str, str]) -> str:
    return f"{t['highway']} is not null and not {one_of(t['highway'], 'motorway motorway_link')} and not coalesce({one_of(t['access'], 'no private')}, false)"


def way_surface(t: dict[str, str]) -> str:
    return f"(case when {t['route']} = 'ferry' then {FERRY_SURFACE} when {_open(t)} then {surface(t['surface'], t['highway'], t['tracktype'])} else {OTHER} end)"


def bike_class(highway: str) -> str:
    return "(case " + " ".join(f"when {one_of(highway, w)} then {CLASSES.index(k)}" for k, w in CLASS_WAYS.items()) + f" else {CLASSES.index('other')} end)"


def bike_attrs(t: dict[str, str]) -> str:
    extra = f"(case when {t['bicycle']} = 'designated' then {DESIGNATED} else 0 end) + (case when {t['lcn']} = 'yes' or {t['rcn']} = 'yes' or {t['ncn']} = 'yes' then {NETWORK} else 0 end)"
    return f"(case when {t['route']} = 'ferry' then {CLASSES.index('ferry')} when {_open(t)} then {bike_class(t['highway'])} + {extra} else {CLASSES.index('other')} end)"


#: Buckets of reject messages, tested in order (substring, or start where marked ^).
BUCKETS = (
    ("snap_too_far", ("endpoint too far from graph", "snap displacement")),
    ("corridor_violated", ("exceeds corridor half-width",)),
    ("no_go", ("^no-go", ": no-go")),
    ("too_short", ("below minimum",)),
    ("too_long", ("above maximum",)),
    ("no_route", ("no route", "graph empty")),
)


def reject_bucket(message: str) -> str:
    test = lambda s: f"lower({message}) like '{s[1:]}%'" if s[0] == "^" else f"lower({message}) like '%{s}%'"
    return "(case " + " ".join(f"when {' or '.join(map(test, tests))} then '{name}'" for name, tests in BUCKETS) + " else 'other' end)"


#: Names of modes and their bits.
MODE_NAMES = {FOOT: "foot walk hike", BIKE: "bike cycle bicycle", MTB: "mtb gravel"}


def mode_bit(token: str) -> str:
    """The bit of one token; null for an unknown one, 0 for an empty one."""
    return "(case " + " ".join(f"when {one_of(token, w)} then {b}" for b, w in MODE_NAMES.items()) + f" when {token} = '' then 0 end)"


#: Strictness sweeps of one to four routes.
ALPHAS = {1: (4.0,), 2: (1.0, 8.0), 3: (0.5, 4.0, 12.0), 4: (0.0, 2.0, 6.0, 14.0)}


def alpha(n: str, i: str) -> str:
    """The i-th (from 0) of n strictness values; from 5 on spaced geometrically from 1/4 to 16."""
    fixed = " ".join(f"when {n} = {k} then case {i} " + " ".join(f"when {j} then cast({a} as double)" for j, a in enumerate(v)) + " end" for k, v in ALPHAS.items())
    return f"(case {fixed} else cast(0.25 as double) * power(cast(64 as double), cast({i} as double) / ({n} - 1)) end)"
