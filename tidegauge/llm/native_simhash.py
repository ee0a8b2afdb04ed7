"""SimHash and multi-index Hamming blocks as column expressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ones(width: int) -> int:
    return sum(1 << k for k in range(0, 64, width))


def lane_bits(h: Column, j: int, width: int) -> Column:
    """Bits j, j + width, j + 2 width, ... of ``h``, each alone in a lane of ``width`` bits."""
    return (F.shiftrightunsigned(h, j) if j else h).bitwiseAND(F.lit(_ones(width)))


def _sums(hashes: Column, width: int) -> Column:
    """Sums in lanes: field j holds, one to a lane of ``width`` bits, how many hashes have bit j,
    j + width, j + 2 width, ... So a hash costs ``width`` additions, not 64."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(width)])
    return F.aggregate(hashes, zero, lambda s, h: F.struct(*[(s[f"s{j}"] + lane_bits(h, j, width)).alias(f"s{j}") for j in range(width)]))


def majority(sums: Column, n: Column, width: int) -> Column:
    """SimHash of ``n`` hashes, fewer than 2 ** (width - 2), from their sums."""
    half, out = 1 << width - 2, F.lit(0).cast("long")
    for j in range(width):
        # a lane reaches its bit ``half`` if its count is over half of n
        over = (sums[f"s{j}"] + (F.lit(half - 1) - F.floor(n.cast("long") / 2)) * F.lit(_ones(width))).bitwiseAND(F.lit(_ones(width) * half))
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(over, width - 2), j))
    return out


def once(value: Column, then) -> Column:
    """``then`` of ``value``, evaluated once though ``then`` uses it often."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _small(hashes: Column) -> Column:
    return once(_sums(hashes, 8), lambda s: majority(s, F.size(hashes), 8))


def _large(hashes: Column) -> Column:
    """Sums of 63 hashes at a time fit lanes of 8 bits; those sums are spread to lanes of 32."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 63).cast("int")), lambda i: _sums(F.slice(hashes, i * 63 + 1, 63), 8))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(32)])
    # bit j + 8 q of a lane sum becomes, for 32 bits, field (j + 8 q) % 32 in the upper or lower lane
    spread = lambda p, j: F.shiftrightunsigned(p[f"s{j % 8}"], j // 8 * 8).bitwiseAND(F.lit(255 | 255 << 32))
    sums = F.aggregate(pieces, zero, lambda s, p: F.struct(*[(s[f"s{j}"] + spread(p, j)).alias(f"s{j}") for j in range(32)]))
    return once(sums, lambda s: majority(s, F.size(hashes), 32))


def simhash(hashes: Column) -> Column:
    """Signed 64-bit SimHash of an array of fewer than 2 ** 30 feature hashes of 64 bits: a bit is
    set if over half of them have it. An empty array gives 0, null gives null."""
    return F.when(F.size(hashes) < 64, _small(hashes)).otherwise(_large(hashes))


def _edges(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def near_block_keys(fingerprint: Column, blocks: int) -> Column:
    """Array of the fingerprint's blocks, each with its number."""
    part = lambda at, width: F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("i"), part(at, width).alias("v")) for i, (at, width) in enumerate(_edges(blocks))])


def nearby_block_keys(fingerprint: Column, blocks: int, bits: int) -> Column:
    """Array of all values that differ from one of the fingerprint's blocks in ``bits`` bits at most:
    two fingerprints within blocks * (bits + 1) - 1 bits have one of these and one of
    ``near_block_keys`` in common, as not every block can have more."""
    masks = [[sum(1 << k for k in chosen) for n in range(bits + 1) for chosen in combinations(range(width), n)] for _, width in _edges(blocks)]
    moved = lambda i, m: F.transform(F.lit(m).cast("array<bigint>"), lambda x: F.struct(F.lit(i).alias("i"), F.get(near_block_keys(fingerprint, blocks), i)["v"].bitwiseXOR(x).alias("v")))
    return F.flatten(F.array(*[moved(i, m) for i, m in enumerate(masks)]))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
