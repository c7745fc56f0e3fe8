"""Hierarchical cells on the cube-projected sphere, and space-time codes, as Column expressions.

A cell id has three face bits and 61 position bits along a Hilbert curve, ended by a marker bit; its level (0 to 30) follows
from the lowest set bit. Ids are signed BIGINT; compare them in unsigned order with ``unsigned``.
A space-time code keeps the face bits, a 16-bit time slot and the upper 45 position bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import xyz

MAX_LEVEL = 30
CODE_LEVEL = 22  # finest level that a code can keep
# Fixed values of the curve: for each orientation, the place on the curve of quadrant (i, j), and how it turns.
POSITION = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
TURN = (1, 0, 0, 3)
SIGN = -(1 << 63)


def bits(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)).cast("long"))


def _face(x: Column, y: Column, z: Column) -> Column:
    """The largest component decides, ties prefer x, then y."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    lead = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    return (axis + F.when(lead < 0, 3).otherwise(0)).cast("long")


def _uv(face: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    u = F.when(face == 0, y / x).when(face == 1, -x / y).when(face == 2, -x / z).when(face == 3, z / x).when(face == 4, z / y).otherwise(-y / z)
    v = F.when(face == 0, z / x).when(face == 1, z / y).when(face == 2, -y / z).when(face == 3, y / x).when(face == 4, -x / y).otherwise(-x / z)
    return u, v


def face_uv(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Cube face and face coordinates of a direction."""
    face = _face(x, y, z)
    return (face, *_uv(face, x, y, z))


def st(u: Column) -> Column:
    """Quadratic projection to [0, 1]."""
    return F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * u)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * u))


def ij(s: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << 30) - 1), F.floor(s * (1 << 30)))).cast("long")


CHUNK = 3  # bits of i and j that one look-up follows


def _walks() -> tuple[list[int], list[int]]:
    """By rule from the tables above: for each orientation and ``CHUNK`` bits of i and of j their place on the curve and the
    orientation after it (place << 2 | orientation); and back (i << 32 | j << 2 | orientation)."""
    side = 1 << CHUNK
    there, back = [0] * (4 * side * side), [0] * (4 * side * side)
    for start in range(4):
        for i in range(side):
            for j in range(side):
                o, place = start, 0
                for k in range(CHUNK - 1, -1, -1):
                    at = POSITION[o][2 * (i >> k & 1) + (j >> k & 1)]
                    place, o = place * 4 + at, o ^ TURN[at]
                there[(start * side + i) * side + j] = place << 2 | o
                back[start * side * side + place] = i << 32 | j << 2 | o
    return there, back


_THERE, _BACK = _walks()


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def hilbert(face: Column, i: Column, j: Column, level: int = MAX_LEVEL) -> Column:
    """Id of the cell of ``level`` at (face, i, j): one look-up for each ``CHUNK`` bits, from the top."""
    table = F.array(*[F.lit(t) for t in _THERE])
    steps, side = -(-level // CHUNK), (1 << CHUNK) - 1

    def walk(at: Column) -> Column:
        def step(state: Column, k: Column) -> Column:  # place on the curve << 2 | orientation
            bit = lambda c: F.call_function("shiftright", c, k).bitwiseAND(_long(side))
            place = state.bitwiseAND(_long(3)) * (1 << 2 * CHUNK) + bit(at["i"]) * (1 << CHUNK) + bit(at["j"])
            return F.shiftleft(state.bitwiseAND(_long(-4)), 2 * CHUNK).bitwiseOR(F.get(table, place.cast("int")).cast("long"))

        start = at["face"].bitwiseAND(_long(1))
        end = F.aggregate(F.sequence(F.lit(MAX_LEVEL - CHUNK), F.lit(MAX_LEVEL - CHUNK * steps), F.lit(-CHUNK)), start, step) if steps else start
        place = F.shiftright(end, 2 + 2 * (CHUNK * steps - level))
        marked = F.shiftleft(F.shiftleft(place, 1).bitwiseOR(_long(1)), 2 * (MAX_LEVEL - level))
        return F.shiftleft(at["face"], 61).bitwiseOR(marked)

    return _bound(F.struct(face.cast("long").alias("face"), i.alias("i"), j.alias("j")), walk)


def cell_id(lat: Column, lng: Column, level: int = MAX_LEVEL) -> Column:
    """The cell of ``level`` at a position. Each step is bound to a name, so that none is evaluated twice."""
    named = lambda **columns: F.struct(*[c.alias(k) for k, c in columns.items()])

    def on_face(p: Column) -> Column:
        return _bound(named(x=p["x"], y=p["y"], z=p["z"], face=_face(p["x"], p["y"], p["z"])), on_plane)

    def on_plane(p: Column) -> Column:
        u, v = _uv(p["face"], p["x"], p["y"], p["z"])
        return _bound(named(face=p["face"], u=u, v=v), lambda q: hilbert(q["face"], ij(st(q["u"])), ij(st(q["v"])), level))

    x, y, z = xyz(lat, lng)
    return _bound(named(x=x, y=y, z=z), on_face)


def cell_ids(lat: np.ndarray, lng: np.ndarray, level: int = MAX_LEVEL) -> np.ndarray:
    """``cell_id`` on arrays, for steps that hold positions in Python anyway."""
    a, b = np.radians(lat), np.radians(lng)
    p = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
    x, y, z = p
    far = np.abs(p)
    axis = np.where((far[0] >= far[1]) & (far[0] >= far[2]), 0, np.where(far[1] >= far[2], 1, 2))
    face = axis + np.where(np.take_along_axis(p, axis[None], 0)[0] < 0, 3, 0)
    out = np.empty(len(x), np.int64)
    uv = (lambda x, y, z: (y / x, z / x)), (lambda x, y, z: (-x / y, z / y)), (lambda x, y, z: (-x / z, -y / z)), (lambda x, y, z: (z / x, y / x)), (lambda x, y, z: (z / y, -x / y)), (lambda x, y, z: (-y / z, -x / z))
    steps, side, table = -(-level // CHUNK), (1 << CHUNK) - 1, np.array(_THERE, np.int64)
    for f in np.unique(face).tolist():
        at = np.flatnonzero(face == f)
        s = [np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u))) for u in uv[f](x[at], y[at], z[at])]
        i, j = (np.clip(np.floor(v * (1 << 30)), 0, (1 << 30) - 1).astype(np.int64) for v in s)
        state = np.full(len(at), f & 1, np.int64)
        for k in range(MAX_LEVEL - CHUNK, MAX_LEVEL - CHUNK * steps - 1, -CHUNK):
            state = (state & -4) << 2 * CHUNK | table[(state & 3) << 2 * CHUNK | (i >> k & side) << CHUNK | j >> k & side]
        place = state >> 2 + 2 * (CHUNK * steps - level)
        out[at] = np.int64(f - 8 if f > 3 else f) << np.int64(61) | (place << 1 | 1) << 2 * (MAX_LEVEL - level)
    return out


def cell_center(cell: Column) -> Column:
    """struct<lat, lng>: the centre of a cell, by the inverse look-ups."""
    return _bound(cell, _center)


def _center(cell: Column) -> Column:
    level = level_of(cell)
    table, bits_a_step = F.array(*[_long(t) for t in _BACK]), 2 * CHUNK
    face = F.shiftrightunsigned(cell, 61)
    start = face.bitwiseAND(_long(1))  # i << 32 | j << 2 | orientation

    def step(state: Column, k: Column) -> Column:
        place = F.call_function("shiftrightunsigned", cell, k).bitwiseAND(_long((1 << bits_a_step) - 1))
        return F.shiftleft(state.bitwiseAND(_long(-4)), CHUNK).bitwiseOR(F.get(table, (state.bitwiseAND(_long(3)) * (1 << bits_a_step) + place).cast("int")))

    steps = F.ceil(level / CHUNK).cast("int")
    end = F.when(level > 0, F.aggregate(F.sequence(F.lit(61 - bits_a_step), 61 - bits_a_step * F.greatest(steps, F.lit(1)), F.lit(-bits_a_step)), start, step)).otherwise(start)
    over = CHUNK * steps - level  # bits of the last step below the level
    down = lambda c: F.call_function("shiftright", c, over.cast("int"))
    return _bound(F.struct(down(F.shiftright(end, 32)).alias("i"), down(F.shiftright(end, 2).bitwiseAND(_long((1 << 30) - 1))).alias("j")), lambda at: _lat_lng(face, level, at))


def _lat_lng(face: Column, level: Column, at: Column) -> Column:
    size = F.pow(F.lit(2.0), level)
    uv = lambda s: F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)
    # leaf centres lie between the half steps of the finest grid
    u, v = uv((at["i"] + 0.5) / size), uv((at["j"] + 0.5) / size)
    x = F.when(face == 0, 1.0).when(face == 1, -u).when(face == 2, -u).when(face == 3, -1.0).when(face == 4, v).otherwise(v)
    y = F.when(face == 0, u).when(face == 1, 1.0).when(face == 2, -v).when(face == 3, -v).when(face == 4, -1.0).otherwise(u)
    z = F.when(face == 0, v).when(face == 1, v).when(face == 2, 1.0).when(face == 3, -u).when(face == 4, -u).otherwise(-1.0)
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lng"))


def lowest_bit(cell: Column) -> Column:
    return cell.bitwiseAND(F.bitwise_not(cell) + F.lit(1).cast("long"))


def level_of(cell: Column) -> Column:
    return (F.lit(MAX_LEVEL) - F.floor(F.bit_count(lowest_bit(cell) - F.lit(1).cast("long")) / 2)).cast("int")


def _lsb(level: Column | int) -> Column:
    return F.lit(1 << (2 * (MAX_LEVEL - level))).cast("long") if isinstance(level, int) else F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (MAX_LEVEL - level)).cast("int"))


def parent(cell: Column, level: Column | int) -> Column:
    lsb = _lsb(level)
    return cell.bitwiseAND(-lsb).bitwiseOR(lsb)


def face_of(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 61).cast("int")


def position_of(cell: Column) -> Column:
    return bits(cell, (1 << 61) - 1)


def is_valid(cell: Column) -> Column:
    return (face_of(cell) < 6) & (bits(lowest_bit(cell), 0x1555555555555555) != 0)


def range_min(cell: Column) -> Column:
    return cell - (lowest_bit(cell) - F.lit(1).cast("long"))


def range_max(cell: Column) -> Column:
    return cell + (lowest_bit(cell) - F.lit(1).cast("long"))


def unsigned(cell: Column) -> Column:
    """A BIGINT that orders signed as the id does unsigned."""
    return cell.bitwiseXOR(F.lit(SIGN).cast("long"))


def contains(a: Column, b: Column) -> Column:
    return unsigned(b).between(unsigned(range_min(a)), unsigned(range_max(a)))


def intersects(a: Column, b: Column) -> Column:
    return (unsigned(range_min(a)) <= unsigned(range_max(b))) & (unsigned(range_min(b)) <= unsigned(range_max(a)))


def child(cell: Column, k: Column | int) -> Column:
    lsb = F.shiftrightunsigned(lowest_bit(cell), 2)
    return cell + (2 * (F.lit(k) if isinstance(k, int) else k) + 1 - 4) * lsb


def children(cell: Column) -> Column:
    return F.array(*[child(cell, k) for k in range(4)])


def children_at_level(cell: Column, level: int) -> Column:
    """Array of the descendants at ``level``, along the curve; of a cell that is finer than that, null."""
    count = F.call_function("shiftleft", _long(1), 2 * (F.lit(level) - level_of(cell)))
    first = parent(range_min(cell), level)
    made = F.transform(F.sequence(_long(0), count - 1), lambda k: first + k * _long(2 << 2 * (MAX_LEVEL - level)))
    return F.when(level_of(cell) <= level, made)


def _along(cell: Column, move) -> Column:
    """The cell of the same level whose place among all of them along the curve is ``move(place, their number)``."""
    rest = (2 * (F.lit(MAX_LEVEL) - level_of(cell))).cast("int")
    place = F.call_function("shiftrightunsigned", cell, rest + 1)
    many = 6 * F.call_function("shiftleft", _long(1), (2 * level_of(cell)).cast("int"))
    return F.call_function("shiftleft", 2 * move(place, many) + 1, rest)


def advance(cell: Column, steps: Column | int) -> Column:
    """``steps`` cells further along the curve (back, if negative), no further than the first cell or one past the last."""
    n = F.lit(steps).cast("long") if isinstance(steps, int) else steps.cast("long")
    return _along(cell, lambda place, many: F.greatest(_long(0), F.least(many, place + n)))


def advance_wrap(cell: Column, steps: Column | int) -> Column:
    """``steps`` cells along the curve, going on at its other end."""
    n = F.lit(steps).cast("long") if isinstance(steps, int) else steps.cast("long")
    return _along(cell, lambda place, many: F.pmod(place + n, many))


# Fixed values of the quadratic projection: sizes of a level-0 cell on the unit sphere, and how many dimensions they have.
METRICS = {"min_width": (2 * 2**0.5 / 3, 1), "avg_width": (1.434523672886099389, 1), "avg_edge": (1.459213746386106062, 1), "avg_diag": (2.060422738998471683, 1), "avg_area": (4 * 3.141592653589793 / 6, 2)}


def closest_level(value: Column, metric: str = "avg_edge") -> Column:
    """Level whose cells come nearest to ``value`` (radians, or steradians for areas), by ratio."""
    size, dimensions = METRICS[metric]
    level = F.round(F.log2(F.lit(size) / value) / dimensions).cast("int")
    return F.when(value > 0, F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), level))).otherwise(MAX_LEVEL)


def next_cell(cell: Column) -> Column:
    return cell + F.shiftleft(lowest_bit(cell), 1)


def prev_cell(cell: Column) -> Column:
    return cell - F.shiftleft(lowest_bit(cell), 1)


def common_level(a: Column, b: Column) -> Column:
    """Level of the deepest common ancestor, -1 on different faces."""
    differ = F.greatest(unsigned(a.bitwiseXOR(b)), unsigned(lowest_bit(a)), unsigned(lowest_bit(b)))
    spread = unsigned(differ)
    for k in (1, 2, 4, 8, 16, 32):
        spread = spread.bitwiseOR(F.shiftrightunsigned(spread, k))
    top = F.bit_count(spread) - 1  # highest differing bit
    return F.when(top > 60, -1).otherwise(F.floor((60 - top) / 2)).cast("int")


def token(cell: Column) -> Column:
    return F.when(cell == 0, "X").otherwise(F.regexp_replace(F.lpad(F.lower(F.hex(cell)), 16, "0"), "0+$", ""))


def from_token(text: Column) -> Column:
    return F.when((text == "X") | (F.length(text) > 16), F.lit(0).cast("long")).otherwise(F.conv(F.rpad(text, 16, "0"), 16, -10).cast("long"))


def leaves(cell: Column) -> Column:
    """How many leaf cells it covers."""
    return lowest_bit(cell)


# ---------------------------------------------------------------- space-time codes


def encode(slot: Column, cell: Column) -> Column:
    """Code of a slot (0 to 65535, else an error) and a cell."""
    ok = F.when(slot.between(0, 65535), slot.cast("long")).otherwise(F.raise_error(F.concat(F.lit("slot out of range: "), slot.cast("string"))).cast("long"))
    return bits(cell, 7 << 61).bitwiseOR(F.shiftleft(ok, 45)).bitwiseOR(F.shiftrightunsigned(bits(cell, (1 << 61) - 1), 16))


def code_slot(code: Column) -> Column:
    return F.shiftrightunsigned(bits(code, (1 << 61) - 1), 45)


def code_cell(code: Column) -> Column:
    return bits(code, 7 << 61).bitwiseOR(F.shiftleft(bits(code, (1 << 45) - 1), 16))


def code_at_level(code: Column, level: int) -> Column:
    """The code of the parent cell; levels beyond 22 count as 22."""
    return encode(code_slot(code), parent(code_cell(code), min(level, CODE_LEVEL)))


def code_text(code: Column) -> Column:
    return F.concat_ws("|", code_slot(code).cast("string"), code_cell(code).cast("string"))
