"""Wind, current, sea state and manoeuvres as columns. Knots unless said otherwise.

Wind direction is where it comes from, a current's set where it goes to, wave direction
where waves come from; heading and boat speed are through the water.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import MPS_TO_KNOTS, angular_difference, c, let, normalize_degrees


def wind_speed(u, v) -> Column:
    """From components in m/s."""
    return F.sqrt(c(u) * c(u) + c(v) * c(v)) * MPS_TO_KNOTS


def wind_from(u, v) -> Column:
    """Direction the wind comes from; 0 in a calm."""
    return F.when((c(u) == 0) & (c(v) == 0), 0.0).otherwise(normalize_degrees(F.degrees(F.atan2(-c(u), -c(v)))))


def within_envelope(speed, maximum) -> Column:
    """Whether a wind speed is allowed; a null maximum allows all."""
    return F.coalesce(c(speed) <= maximum, F.lit(True)) if isinstance(maximum, Column) else (c(speed) <= maximum if maximum is not None else F.lit(True))


def board(heading, wind_direction) -> Column:
    """-1, 0 or 1: the side the wind is on."""
    d = normalize_degrees(c(heading) - c(wind_direction))
    return F.when((d == 0) | (d == 180), 0).when(d < 180, 1).otherwise(-1)


def maneuver_delay(board_before, board_after, angle_before, angle_after, tack_s, gybe_s, threshold: float = 90.0) -> Column:
    """Seconds lost: none without a change of side; a gybe from a mean wind angle at the threshold on, else a tack."""
    changed = (c(board_before) != 0) & (c(board_after) != 0) & (c(board_before) != c(board_after))
    mean = (c(angle_before) + c(angle_after)) / 2
    return F.when(~changed, 0).when(mean >= threshold, c(gybe_s)).otherwise(c(tack_s)).cast("long")


def sailing_midpoint_offset(step, lost) -> Column:
    """Seconds from a leg's start to the middle of the part of it that is sailed, after a manoeuvre."""
    return (c(lost) + F.floor((c(step) - c(lost)) / 2)).cast("long")


def usable_speed(speed, minimum, above_range: Column | None = None) -> Column:
    """Boat speed, or null where it can't be used: above the table, not positive, under the minimum."""
    ok = (c(speed) > 0) & (c(speed) >= c(minimum))
    return F.when(ok & ~above_range if above_range is not None else ok, c(speed))


def relative_wave_angle(heading, wave_from) -> Column:
    """0 in a following, 180 in a head sea."""
    return 180.0 - angular_difference(heading, wave_from)


#: The defaults of the derating model.
def derated_speed(flat, height_m, relative_angle, period_s, height_gain: float = 0.03, power: float = 1.5, head: float = 1.6, following: float = 0.35, most: float = 0.6, period_gain: float = 0.0, reference_period: float = 8.0, least_period: float = 2.0) -> Column:
    """Flat-water speed less the share that waves take, 0 to `most`; unchanged without waves.

    The share grows as height**power; it is scaled towards `head` in a head sea and
    `following` in a following sea, and by steepness where period_gain is not 0.
    """
    run = F.cos(F.radians(c(relative_angle)))
    side = 1 + F.abs(run) * (F.when(run >= 0, following).otherwise(head) - 1)
    steep = reference_period / F.greatest(c(period_s), F.lit(least_period))
    loss = height_gain * F.pow(c(height_m), F.lit(power)) * side * (1 + period_gain * (steep - 1))
    return F.when(c(height_m) > 0, c(flat) * (1 - F.greatest(F.lit(0.0), F.least(F.lit(most), loss)))).otherwise(c(flat))


def checked_derating(derated, flat) -> Column:
    """The derated speed; an error where it isn't finite, is negative or exceeds the flat-water speed."""
    d = c(derated)
    bad = d.isNull() | F.isnan(d) | (d < 0) | (d > c(flat) + 1e-9)
    return F.when(bad, F.raise_error(F.lit("invalid derated speed")).cast("double")).otherwise(d)


def ground_velocity(heading, speed, current_east, current_north) -> Column:
    """struct(sog, cog): water velocity plus current."""
    e = c(speed) * F.sin(F.radians(c(heading))) + c(current_east)
    n = c(speed) * F.cos(F.radians(c(heading))) + c(current_north)
    return F.struct(F.sqrt(e * e + n * n).alias("sog"), F.when((e == 0) & (n == 0), normalize_degrees(heading)).otherwise(normalize_degrees(F.degrees(F.atan2(e, n)))).alias("cog"))


def current_speed(east, north) -> Column:
    return F.sqrt(c(east) * c(east) + c(north) * c(north))


def current_set(east, north) -> Column:
    return F.when((c(east) == 0) & (c(north) == 0), 0.0).otherwise(normalize_degrees(F.degrees(F.atan2(c(east), c(north)))))


def course_to_steer_offset(track, speed, current_east, current_north) -> Column:
    """Degrees to add to a ground track so that the current is met; null where the track can't be held."""
    t = F.radians(c(track))
    across = c(current_east) * F.cos(t) - c(current_north) * F.sin(t)
    share = -across / c(speed)
    return F.when((c(speed) > 0) & (F.abs(share) <= 1), F.degrees(F.asin(share)))


def solve_heading(track, speed_at, current_east, current_north, rounds: int = 12, tolerance: float = 1e-10) -> Column:
    """Water heading that makes good a ground track where boat speed depends on the heading.

    speed_at: function of a heading column giving a speed column. Fixed-point iteration; it
    stands still once two headings differ by less than the tolerance.
    """

    def step(h, _):
        nxt = let(speed_at(h), lambda v: normalize_degrees(c(track) + course_to_steer_offset(track, v, current_east, current_north)))
        pick = lambda x: F.when(h.isNull() | x.isNull(), F.lit(None).cast("double")).when(angular_difference(x, h) < tolerance, h).otherwise(x)
        return let(nxt, pick)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), normalize_degrees(track), step)


def step_seconds(elapsed: Column, tiers: list[tuple[int, int | None]], cutoff: int | None = None) -> Column:
    """Length of the step that starts at `elapsed` seconds under tiers (interval, until), clipped to the tier's end and the cutoff."""
    out = F.lit(None).cast("long")
    for interval, until in reversed(tiers):
        step = F.lit(interval).cast("long") if until is None else F.least(F.lit(interval).cast("long"), F.lit(until) - elapsed)
        out = step if until is None else F.when(elapsed < until, step).otherwise(out)
    return F.least(out, F.lit(cutoff) - elapsed) if cutoff is not None else out
