"""Vector scalar functions as Catalyst expressions.

Each takes column names (or SQL text) and gives a ``Column``. Nothing that costs a pass over
the vector stands inside a lambda: the optimizer inlines projected expressions, and a lambda
would repeat them for every element, so per-vector values enter by ``array_repeat``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
CODE_LIMIT = {"int8": 127, "int16": 32767}
MIN_POSITIVE = "1.17549435E-38D"
MAX_LEVEL = 8
LEVEL_M = 16
HASH_FACTOR = 0x9E3779B97F4A7C15
HASH_STEP = 0x2545F4914F6CDD1D


def dot(a: str, b: str) -> Column:
    """Inner product in double precision."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)")


def dot_exact(a: str, b: str) -> Column:
    """Inner product of integer codes, exact in 64 bits."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bigint(x) * bigint(y)), 0L, (s, x) -> s + x)")


def inv_magnitude(v: str) -> Column:
    """1 / length; a zero vector's is huge, so that its product with a zero dot stays zero."""
    return F.expr(f"1 / greatest(sqrt(aggregate({v}, 0D, (s, x) -> s + double(x) * double(x))), {MIN_POSITIVE})")


def scale(v: str, precision: str) -> Column:
    """Float step of the symmetric codec: largest component over the code limit, 1 for zeros."""
    top = f"array_max(transform({v}, x -> abs(x)))"
    return F.expr(f"CAST(CASE WHEN {top} = 0 THEN 1 ELSE {top} / {CODE_LIMIT[precision]} END AS FLOAT)")


def codes(v: str, step: str, precision: str) -> Column:
    """Components times the float reciprocal of ``step``, rounded half away from zero, clamped."""
    top = CODE_LIMIT[precision]
    kind = "TINYINT" if precision == "int8" else "SMALLINT"
    return F.expr(f"zip_with({v}, array_repeat(CAST(1 / {step} AS FLOAT), size({v})), (x, r) -> CAST(greatest(least(round(CAST(x AS FLOAT) * r), {top}), -{top}) AS {kind}))")


def decoded(code: str, step: str) -> Column:
    return F.expr(f"zip_with({code}, array_repeat(double({step}), size({code})), (c, s) -> c * s)")


def is_finite(v: str) -> Column:
    """No NaN and no infinity among the components."""
    return F.expr(f"NOT exists({v}, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf'))")


def in_domain(code: str) -> Column:
    """A 16-bit code never holds the value without a negative."""
    return F.expr(f"NOT exists({code}, c -> c = -32768)")


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine of two vectors in double precision; 1 if either is zero."""
    return F.lit(1.0) - dot(a, b) * inv_magnitude(a) * inv_magnitude(b)


def level(node_id: str, m: int = LEVEL_M) -> Column:
    """Graph level of a node by a hash of its id, geometric with base ``m``."""
    spun = f"pmod(CAST({node_id} AS DECIMAL(20,0)) * {HASH_FACTOR}BD + {HASH_STEP}BD, 18446744073709551616BD)"
    signed = f"CAST(IF({spun} >= 9223372036854775808BD, {spun} - 18446744073709551616BD, {spun}) AS BIGINT)"
    mixed = f"({signed} ^ shiftrightunsigned({signed}, 33))"
    unit = f"(IF({mixed} < 0, double({mixed}) + 18446744073709551616D, double({mixed})) / 18446744073709551616D)"
    return F.expr(f"CAST(least({MAX_LEVEL}, floor(-ln(greatest({unit}, 2.2250738585072014E-308D)) / ln({m}D))) AS INT)")


def bit_set(bits: str, node_id: str) -> Column:
    """Whether bit ``id % 8`` of byte ``id div 8`` is set; ids beyond the end are not."""
    byte = f"int(conv(hex(substring({bits}, int({node_id} div 8) + 1, 1)), 16, 10))"
    return F.expr(f"{node_id} >= 0 AND {node_id} < 8L * octet_length({bits}) AND (shiftright({byte}, int({node_id} % 8)) & 1) = 1")


def slot_geometry(dims: str, cap: str, key_cap: str, precision: str) -> dict[str, Column]:
    """Bytes of one record slot and slots in a page: ``raw``, ``slot_size``, ``slots_per_page``."""
    width = f"(CASE {precision} WHEN 'int16' THEN 2 ELSE 1 END)"
    raw = f"(20 + 4 * (({dims} * {width} + 3) div 4) + 4 * {cap} + IF({key_cap} > 0, 4 + {key_cap}, 0))"
    slot = f"(64 * (({raw} + 63) div 64))"
    fits = f"(4096 div {slot})"
    return {
        "raw": F.expr(f"CAST({raw} AS BIGINT)"),
        "slot_size": F.expr(f"CAST({slot} AS BIGINT)"),
        "slots_per_page": F.expr(f"CAST(IF({slot} <= 4096 AND 4096 - {fits} * {slot} <= 128, {fits}, 0) AS BIGINT)"),
    }
