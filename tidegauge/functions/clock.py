"""Arithmetic on wrapping counters, clocks and rates. Modular differences never use plain subtraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 27 MHz clock references wrap at 2**33 * 300, 90 kHz time stamps at 2**33.
PCR_WRAP = (1 << 33) * 300
PTS_WRAP = 1 << 33


def wrapped_delta(now: Column, before: Column, wrap: int) -> Column:
    """now - before on a counter that wraps, in [-wrap/2, wrap/2)."""
    return F.pmod(now - before + wrap // 2, F.lit(wrap)) - wrap // 2


def forward_gap(now: Column, before: Column, wrap: int) -> Column:
    """now - before on a counter that only goes forward, in [0, wrap)."""
    return F.pmod(now - before, F.lit(wrap))


def toward_zero(x: Column, by: int) -> Column:
    return F.when(x < 0, -F.floor(-x / by)).otherwise(F.floor(x / by)).cast("long")


def pts_delta_ms(now: Column, before: Column) -> Column:
    """Signed milliseconds between 90 kHz stamps, cut toward zero."""
    return toward_zero(wrapped_delta(now, before, PTS_WRAP), 90)


def signed_pcr_delta(now: Column, before: Column) -> Column:
    return wrapped_delta(now, before, PCR_WRAP)


def pcr_from_unix_ns(ns: Column, offset: Column) -> Column:
    """27 MHz ticks (modulo the wrap) of a wall time in ns plus an offset in ticks. The product
    needs more than 64 bits."""
    ticks = F.floor(ns.cast("decimal(38,0)") * 27 / 1000).cast("decimal(38,0)") + offset.cast("decimal(38,0)")
    return (ticks % F.lit(PCR_WRAP).cast("decimal(38,0)")).cast("long")


def unix_ns_from_pcr(pcr: Column, near_ns: Column, offset: Column) -> Column:
    """W18, back: the wall time closest to ``near_ns`` with that reference."""
    here = pcr_from_unix_ns(near_ns, offset)
    return near_ns + F.floor(wrapped_delta(pcr, here, PCR_WRAP) * 1000 / 27).cast("long")


def vblank_hold(n: Column, ratio: Column) -> Column:
    """Display periods that frame n (from 1) stays up, the remainder carried from 0.5. A frame stays
    up for one at least: below a ratio of one all do, and the debt only grows."""
    return F.when(ratio < 1, 1).otherwise(F.floor(0.5 + n * ratio) - F.floor(0.5 + (n - 1) * ratio)).cast("long")


def source_index(out: str, in_num: int, in_den: int, out_num: int, out_den: int) -> Column:
    """The source frame shown at output frame ``out``; exact rational arithmetic."""
    return F.expr(f"({out} * {in_num * out_den}L) div {in_den * out_num}L")


def output_length(length: str, in_num: int, in_den: int, out_num: int, out_den: int) -> Column:
    """Output frames that cover ``length`` source frames, rounded up."""
    return F.expr(f"({length} * {out_num * in_den}L + {out_den * in_num - 1}L) div {out_den * in_num}L")


def output_delay_ms(mode: Column, amount: Column, fps: Column, fallback: int = 0) -> Column:
    """Q11: fixed or target milliseconds, or frames at the measured rate, kept in 1..10000."""
    frames = F.when(fps > 0, F.least(F.greatest(F.round(amount * 1000 / fps), F.lit(1)), F.lit(10000)).cast("long"))
    return F.when(mode == "frames", F.coalesce(frames, F.lit(fallback))).otherwise(amount.cast("long"))


def version_after(version: Column, by: int = 1) -> Column:
    """A table version, five bits."""
    return F.pmod(version + by, F.lit(32))


def pq_eotf(x: Column) -> Column:
    """SMPTE ST 2084 EOTF, normalised to 10,000 cd/m2."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    root = F.pow(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)), F.lit(1 / m2))
    return F.pow(F.greatest(root - c1, F.lit(0.0)) / (c2 - c3 * root), F.lit(1 / m1))


def srgb_oetf(x: Column) -> Column:
    """Linear light to sRGB."""
    v = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def duration_ms(in_pts: Column, out_pts: Column) -> Column:
    """Length of a clip."""
    return F.floor(F.greatest(out_pts - in_pts, F.lit(0)) / 90).cast("long")


def clamp_chunk(wanted: Column, largest: int = 3 << 20, cell: int = 188) -> Column:
    """Bytes of one read: whole cells, one at least."""
    return F.greatest(F.floor(F.least(wanted, F.lit(largest)) / cell) * cell, F.lit(cell)).cast("long")
