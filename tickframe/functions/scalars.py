"""Column functions for ticks, angles, vectors and boxes. Arguments are columns or names; angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def ticks(seconds: C, rate: C) -> Column:
    """Ticks that cover so many seconds."""
    return F.ceil(_c(seconds) * _c(rate)).cast("long")


def seconds(tick_count: C, rate: C) -> Column:
    return F.try_divide(_c(tick_count), _c(rate))


def wrap(angle: C) -> Column:
    """To [0, 360)."""
    return F.pmod(_c(angle), F.lit(360.0))


def wrap_half(angle: C) -> Column:
    """To [-180, 180)."""
    return F.pmod(_c(angle) + 180.0, F.lit(360.0)) - 180.0


def angle_delta(a: C, b: C) -> Column:
    """The turn from b to a, the short way."""
    return wrap_half(_c(a) - _c(b))


def clamp_pitch(pitch: C) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), _c(pitch)))


def direction(yaw: C, pitch: C) -> tuple[Column, Column, Column]:
    """The unit vector of a view; positive pitch looks down."""
    y, p = F.radians(_c(yaw)), F.radians(_c(pitch))
    return F.cos(p) * F.cos(y), F.cos(p) * F.sin(y), -F.sin(p)


def view_of(dx: C, dy: C, dz: C) -> tuple[Column, Column]:
    """(yaw, pitch) along a vector."""
    return F.degrees(F.atan2(_c(dy), _c(dx))), -F.degrees(F.atan2(_c(dz), F.hypot(_c(dx), _c(dy))))


def distance(*pairs: tuple[C, C]) -> Column:
    """Euclidean distance over coordinate pairs."""
    return F.sqrt(sum(((_c(a) - _c(b)) * (_c(a) - _c(b)) for a, b in pairs), F.lit(0.0)))


def magnitude(*parts: C) -> Column:
    return F.sqrt(sum((_c(p) * _c(p) for p in parts), F.lit(0.0)))


def cosine(a: list[C], b: list[C]) -> Column:
    """Null where one is no direction."""
    dot = sum((_c(x) * _c(y) for x, y in zip(a, b)), F.lit(0.0))
    return F.try_divide(dot, magnitude(*a) * magnitude(*b))


def angle_between(a: list[C], b: list[C]) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))


def rotate(x: C, y: C, angle: C, cx: C = 0.0, cy: C = 0.0) -> tuple[Column, Column]:
    """A point moved so that the centre is the origin, then turned."""
    dx, dy, r = _c(x) - _c(cx), _c(y) - _c(cy), F.radians(_c(angle))
    return dx * F.cos(r) - dy * F.sin(r), dx * F.sin(r) + dy * F.cos(r)


def move_angle(dx: C, dy: C, yaw: C, fold: float = 360.0) -> Column:
    """The angle of a movement against the view, in [0, fold)."""
    return F.pmod(F.degrees(F.atan2(_c(dy), _c(dx))) - _c(yaw), F.lit(fold))


def scaled_speed(dx: C, dy: C, most: C) -> Column:
    """Speed as a share of the most possible, at most 1."""
    return F.least(F.lit(1.0), F.try_divide(magnitude(dx, dy), _c(most)))


def map_pixels(x: C, y: C, left: float, top: float, scale: float) -> tuple[Column, Column]:
    return (_c(x) - left) / scale, (top - _c(y)) / scale


def safe_div(a: C, b: C) -> Column:
    return F.try_divide(_c(a), _c(b))


def text_to_map(text: C, pair: str = "_", between: str = ",") -> Column:
    """`a_b,c_d` to {a: b, c: d}."""
    return F.str_to_map(_c(text), F.lit(between), F.lit(pair))


def map_to_text(m: C, pair: str = "_", between: str = ",") -> Column:
    entries = F.array_sort(F.map_entries(_c(m)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(pair, e["key"], e["value"])), between)


def log_distance(value: C, most: float = 2000.0) -> Column:
    """10^(value * log10 most), at most `most`."""
    return F.least(F.lit(most), F.pow(F.lit(10.0), _c(value) * F.log10(F.lit(most))))


def eye(x: C, y: C, z: C, crouch: C) -> tuple[Column, Column, Column]:
    """The eye of a player standing (64 units up) to crouching (46), by crouch amount 0 to 1."""
    return _c(x), _c(y), _c(z) + 64.0 - 18.0 * _c(crouch)


def player_box(x: C, y: C, z: C, crouch: C) -> Column:
    """The box of a player, 32 wide and 72 to 54 high."""
    x, y, z = _c(x), _c(y), _c(z)
    named = [(x - 16.0).alias("x0"), (y - 16.0).alias("y0"), z.alias("z0"), (x + 16.0).alias("x1"), (y + 16.0).alias("y1"), (z + 72.0 - 18.0 * _c(crouch)).alias("z1")]
    return F.struct(*named)


def in_box(point: list[C], low: list[C], high: list[C], mode: str = "closed", margin: float = 0.0) -> Column:
    """mode: closed, open, or upper (above the low edges, up to the high ones). As many axes as are given."""
    out = F.lit(True)
    for p, a, b in zip(point, low, high):
        p, a, b = _c(p), _c(a) - margin, _c(b) + margin
        out = out & {"closed": (p >= a) & (p <= b), "open": (p > a) & (p < b), "upper": (p > a) & (p <= b)}[mode]
    return out


def boxes_overlap(low_a: list[C], high_a: list[C], low_b: list[C], high_b: list[C], closed: bool = True) -> Column:
    out = F.lit(True)
    for a, b, c, d in zip(low_a, high_a, low_b, high_b):
        a, b, c, d = _c(a), _c(b), _c(c), _c(d)
        out = out & ((a <= d) & (c <= b) if closed else (a < d) & (c < b))
    return out


def box_distance(point: list[C], low: list[C], high: list[C]) -> Column:
    """From a point to a box, 0 inside."""
    gaps = [F.greatest(_c(a) - _c(p), F.lit(0.0), _c(p) - _c(b)) for p, a, b in zip(point, low, high)]
    return magnitude(*gaps)


def ray_box(origin: list[C], way: list[C], low: list[C], high: list[C]) -> tuple[Column, Column, Column]:
    """(hits, entry, exit) of a ray and a box, in lengths of the way. A way of zero along an axis must lie inside it."""
    near, far, inside = F.lit(float("-inf")), F.lit(float("inf")), F.lit(True)
    for o, w, a, b in zip(origin, way, low, high):
        o, w, a, b = _c(o), _c(w), _c(a), _c(b)
        t, u = F.try_divide(a - o, w), F.try_divide(b - o, w)
        inside = inside & ((w != 0) | ((o >= a) & (o <= b)))
        near, far = F.greatest(near, F.when(w != 0, F.least(t, u)).otherwise(F.lit(float("-inf")))), F.least(far, F.when(w != 0, F.greatest(t, u)).otherwise(F.lit(float("inf"))))
    return inside & (near <= far) & (far >= 0), near, far


def line_distance(point: list[C], a: list[C], b: list[C]) -> Column:
    """From a point to the line through a and b (three axes)."""
    p, a, b = ([_c(x) for x in v] for v in (point, a, b))
    u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, p)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.try_divide(magnitude(*cross), magnitude(*u))


def move_bin(dx: C, dy: C, yaw: C, stance: C, still: float = 1.0, bins: int = 8) -> Column:
    """0 for standing still, else 1 + direction bin, times stances (0, 1, 2 ...)."""
    at = F.floor(F.pmod(move_angle(dx, dy, yaw) + 180.0 / bins, F.lit(360.0)) / (360.0 / bins))
    return (F.when(magnitude(dx, dy) < still, F.lit(0)).otherwise(1 + at) + _c(stance) * (bins + 1)).cast("int")
