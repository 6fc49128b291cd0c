"""Deterministic hash-uniforms: the same value for the same key on every
engine and every task retry (``rand()`` would resample on recompute).

u = first 48 bits of md5("seed:stream:k1:k2:…") / 2^48, in [0, 1).
``uniform_open0`` gives (0, 1] for logarithms.  ``uniform_vector`` draws n
uniforms for one key from SHA-256 digests, five 48-bit values per digest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO48 = float(1 << 48)


def _key(seed, stream: str, *keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(stream)] + [k.cast("string") if isinstance(k, Column)
                                                  else F.lit(str(k)) for k in keys]
    return F.concat_ws(":", *parts)


def hash48(seed, stream: str, *keys) -> Column:
    return F.conv(F.substring(F.md5(_key(seed, stream, *keys)), 1, 12), 16, 10).cast("bigint")


def uniform(seed, stream: str, *keys) -> Column:
    """u in [0, 1)."""
    return hash48(seed, stream, *keys).cast("double") / F.lit(TWO48)


def uniform_open0(seed, stream: str, *keys) -> Column:
    """u in (0, 1] — safe for ln(u)."""
    return (hash48(seed, stream, *keys) + F.lit(1)).cast("double") / F.lit(TWO48)


def sql_uniform(seed, stream: str, *keys: str, open0: bool = False) -> str:
    """DuckDB twin of :func:`uniform` (keys are SQL expressions)."""
    parts = ", ".join([f"'{seed}'", f"'{stream}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    h = f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 12))::BIGINT"
    return f"(({h} + 1)::DOUBLE / 281474976710656.0)" if open0 else f"({h}::DOUBLE / 281474976710656.0)"


PER_DIGEST = 5


def uniform_vector(seed, stream: str, n: int, *keys) -> Column:
    """array of n uniforms in [0, 1): digest g = sha256("seed:stream:k…:g") holds
    components 5g … 5g+4 as consecutive 12-hex-digit groups (each digest is
    computed once, then split)."""
    groups = (n + PER_DIGEST - 1) // PER_DIGEST
    digests = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)),
                          lambda g: F.sha2(_key(seed, stream, *keys, g), 256))
    parts = F.transform(digests, lambda d: F.transform(
        F.sequence(F.lit(0), F.lit(PER_DIGEST - 1)),
        lambda s: F.conv(d.substr(s * 12 + 1, F.lit(12)), 16, 10).cast("bigint").cast("double") / F.lit(TWO48)))
    return F.slice(F.flatten(parts), 1, n)


def uniform_rows(seed, stream: str, n: int, keys: list) -> np.ndarray:
    """Numpy twin of :func:`uniform_vector`: a row of n uniforms per key."""
    from hashlib import sha256
    groups = (n + PER_DIGEST - 1) // PER_DIGEST
    raw = b"".join(sha256(f"{seed}:{stream}:{k}:{g}".encode()).digest()[:6 * PER_DIGEST] for k in keys for g in range(groups))
    lanes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6).astype(np.float64)
    return (lanes @ (256.0 ** np.arange(5, -1, -1)) / TWO48).reshape(len(keys), groups * PER_DIGEST)[:, :n]     # whole numbers below 2^48: exact


def sql_uniform_vector(seed, stream: str, n: int, *keys: str) -> str:
    """DuckDB twin of :func:`uniform_vector` (keys are SQL expressions)."""
    groups = (n + PER_DIGEST - 1) // PER_DIGEST
    parts = ", ".join([f"'{seed}'", f"'{stream}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    digests = (f"list_transform(range(0, {groups}), lambda g: "
               f"sha256(concat_ws(':', {parts}, CAST(g AS VARCHAR))))")
    return (f"list_transform(range(0, {n}), lambda j: "
            f"('0x' || substr(({digests})[j // {PER_DIGEST} + 1], (j % {PER_DIGEST}) * 12 + 1, 12))::BIGINT::DOUBLE"
            f" / 281474976710656.0)")


# --- counter-based draws: one integer formula for numpy, Spark columns and DuckDB ----------
#
# Two 32-bit lanes; every product stays below 2^62, so signed 64-bit arithmetic never overflows.
# A lane's key is mixed from (seed, stream) and whole numbers of at most 63 bits; draw number j of
# a key is one more mixing round per lane; 32 + 20 bits of the two lanes make a uniform in [0, 1).

MASK32 = (1 << 32) - 1
MIX_1, MIX_2 = 0x21F0AAAD, 0x735A2D97           # a published two-round 32-bit finaliser
LANES = ((0x6A09E667, 0x9E3779B1), (0xBB67AE85, 0x85EBCA77))       # (start, step) per lane
TWO52 = float(1 << 52)
STREAMS = {"unigram": 1, "tdnd1": 2, "tdnd2": 3, "tdnd3": 4}


def _start(lane: int, seed: int, stream: int) -> int:
    return LANES[lane][0] ^ ((seed * 64 + stream) & MASK32)


def mix32(x):
    """32-bit finaliser of uint64 arrays below 2^32."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(MIX_1)) & np.uint64(MASK32)
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(MIX_2)) & np.uint64(MASK32)
    return x ^ (x >> np.uint64(15))


def draw_keys(seed: int, stream: int, *keys) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes' keys of whole-number arrays (which broadcast)."""
    out = []
    for lane in (0, 1):
        h = mix32(np.asarray(_start(lane, seed, stream), dtype=np.uint64))
        for k in keys:
            k = np.asarray(k).astype(np.uint64)
            h = mix32(((h ^ (k & np.uint64(MASK32))) + (k >> np.uint64(32))) & np.uint64(MASK32))
        out.append(h)
    return out[0], out[1]


def draw_bits(keys: tuple[np.ndarray, np.ndarray], number) -> np.ndarray:
    """52 random bits of draw ``number`` of each key."""
    n = np.asarray(number).astype(np.uint64)
    shape = np.broadcast_shapes(np.shape(keys[0]), n.shape)
    lanes = []
    for h, (_, step) in zip(keys, LANES):
        x = np.atleast_1d(h).astype(np.uint32) + np.atleast_1d((n * np.uint64(step)) & np.uint64(MASK32)).astype(np.uint32)
        for shift, factor in ((16, MIX_1), (15, MIX_2)):        # mix32 in place: 32-bit products wrap by themselves
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(15)
        lanes.append(x)
    a = lanes[0].astype(np.uint64)
    a <<= np.uint64(20)
    a |= lanes[1] >> np.uint32(12)
    return a.reshape(shape)


def draw_u(keys, number) -> np.ndarray:
    """Uniforms in [0, 1)."""
    return draw_bits(keys, number).astype(np.float64) / TWO52


def draw_u_open0(keys, number) -> np.ndarray:
    """Uniforms in (0, 1]."""
    return (draw_bits(keys, number) + np.uint64(1)).astype(np.float64) / TWO52


def draw_column(seed: int, stream: str, *keys: Column, number: Column, open0: bool = False) -> Column:
    """The same draw as a column expression; keys and ``number`` are whole numbers."""
    lanes = []
    for lane, (_, step) in enumerate(LANES):
        # each round's input is bound once by a one-element transform: substituting it would double the expression
        h = F.array(F.lit(int(mix32(np.asarray(_start(lane, seed, STREAMS[stream]), dtype=np.uint64)))).cast("bigint"))
        for k in keys:
            k = k.cast("bigint")
            h = _mixed(_folded(h, k))
        lanes.append(_mixed(_stepped(h, number, step))[0])
    bits = F.shiftleft(lanes[0], 20).bitwiseOR(F.shiftright(lanes[1], 12))
    return (bits + F.lit(int(open0))).cast("double") / F.lit(TWO52)


def _folded(h: Column, k: Column) -> Column:
    return F.transform(h, lambda x: (x.bitwiseXOR(k.bitwiseAND(F.lit(MASK32))) + F.shiftright(k, 32)).bitwiseAND(F.lit(MASK32)))


def _stepped(h: Column, number: Column, step: int) -> Column:
    return F.transform(h, lambda x: (x + number.cast("bigint") * F.lit(step)).bitwiseAND(F.lit(MASK32)))


def _round(h: Column, shift: int, factor: int) -> Column:
    return F.transform(h, lambda x: (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(MASK32)))


def _mixed(h: Column) -> Column:
    h = _round(_round(h, 16, MIX_1), 15, MIX_2)
    return F.transform(h, lambda x: x.bitwiseXOR(F.shiftright(x, 15)))


def sql_draw(seed: int, stream: str, *keys: str, number: str, open0: bool = False) -> str:
    """DuckDB twin of :func:`draw_column`."""
    def bind(body: str, x: str) -> str:
        return f"list_transform({x}, lambda x: {body})"

    def mixed(x: str) -> str:
        for shift, factor in ((16, MIX_1), (15, MIX_2)):
            x = bind(f"(xor(x, x >> {shift}) * {factor}) & {MASK32}", x)
        return bind("xor(x, x >> 15)", x)

    lanes = []
    for lane, (_, step) in enumerate(LANES):
        h = f"[{int(mix32(np.asarray(_start(lane, seed, STREAMS[stream]), dtype=np.uint64)))}::BIGINT]"
        for k in keys:
            h = mixed(bind(f"(xor(x, ({k})::BIGINT & {MASK32}) + (({k})::BIGINT >> 32)) & {MASK32}", h))
        lanes.append(mixed(bind(f"(x + ({number})::BIGINT * {step}) & {MASK32}", h)) + "[1]")
    return f"((({lanes[0]} << 20) | ({lanes[1]} >> 12)) + {int(open0)})::DOUBLE / 4503599627370496.0::DOUBLE"
