"""Column expressions: everything here stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "[ \t\n\r\f]+"  # fixed value: the five separators of the tokeniser


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tokens(text) -> Column:
    """Whitespace tokens of a text, without empty ones."""
    return F.filter(F.split(_c(text), WHITESPACE), lambda t: t != "")


def patch_name(image_id, x, y) -> Column:
    """``"id x y"`` of a patch."""
    return F.concat_ws(" ", *(_c(v).cast("string") for v in (image_id, x, y)))


def parse_patch_name(name) -> Column:
    """Struct (image_id, x, y) from ``"id x y"``; coordinates round half up by truncation."""
    parts = F.split(_c(name), " ")
    rounded = lambda p: (p.cast("double") + 0.5).cast("int")
    return F.struct(
        parts[0].cast("int").alias("image_id"),
        rounded(parts[1]).alias("x"),
        rounded(parts[2]).alias("y"),
    )


def label_from_probability(log_phi, cutoff: float = 0.9) -> Column:
    """First topic (from 1) whose probability reaches ``cutoff``, else 0."""
    reached = F.transform(_c(log_phi), lambda p: p >= F.log(F.lit(float(cutoff))))
    return F.array_position(reached, True).cast("int")


def rgb_channels(rgb) -> Column:
    """Struct (r, g, b) of a packed colour."""
    channel = lambda bits: F.shiftright(_c(rgb), bits).bitwiseAND(255)
    return F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b"))


def pack_rgb(r, g, b) -> Column:
    return F.shiftleft(_c(r), 16).bitwiseOR(F.shiftleft(_c(g), 8)).bitwiseOR(_c(b))


def luma(rgb) -> Column:
    """Grey value of a packed colour."""
    ch = rgb_channels(rgb)
    return ch["r"] * 0.3 + ch["g"] * 0.6 + ch["b"] * 0.1


def color_code(r, g, b) -> Column:
    """Scalar code that keeps palette colours apart."""
    return _c(r) * (129 * 129) + _c(g) * 129 + _c(b)


def mirror_index(a, n) -> Column:
    """Index reflected into ``[0, n)``, edge samples repeated."""
    m = F.pmod(_c(a), _c(n) * 2)
    return F.when(m < _c(n), m).otherwise(_c(n) * 2 - 1 - m)


def mirror_inner_index(a, n) -> Column:
    """Index reflected into ``[0, n)`` about the edge samples, which are not repeated."""
    last = _c(n) - 1
    period = F.greatest(last * 2, F.lit(1))
    m = F.pmod(_c(a), period)
    return F.when(m <= last, m).otherwise(last * 2 - m)


def log_add(a, b) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(_c(a), _c(b)) + F.log1p(F.exp(-F.abs(_c(a) - _c(b))))


def euclidean(a, b) -> Column:
    """Distance of two equally long arrays."""
    squares = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def normalize_l2(desc) -> Column:
    """Divide by the L2 norm, cap at 1; a vanishing vector becomes uniform."""
    v = _c(desc)
    total = F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
    return F.when(
        total >= 1e-9, F.transform(v, lambda e: F.least(F.lit(1.0), e / F.sqrt(total)))
    ).otherwise(F.transform(v, lambda _: 1.0 / F.sqrt(F.size(v).cast("double"))))


def normalize_max(desc) -> Column:
    """Divide by five times the maximum, cap at 1; a zero vector stays zero."""
    v = _c(desc)
    top = F.array_max(v) / 0.2
    return F.when(top != 0.0, F.transform(v, lambda e: F.least(F.lit(1.0), e / top))).otherwise(v)


def unit_hash(*columns) -> Column:
    """Number in (0, 1) that depends only on the given columns."""
    buckets = 1 << 24
    return (F.pmod(F.xxhash64(*columns), F.lit(buckets)) + 0.5) / float(buckets)


def draw(*keys) -> Column:
    """Pseudo-random 32-bit number from the given keys (leading md5 digits).

    Portable: any engine with md5 gives the same draw, so runs can be compared.
    """
    text = F.concat_ws(":", *(_c(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
