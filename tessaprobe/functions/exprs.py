"""Column expressions: everything that one row can answer stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaprobe.functions.constants import BLOCKS, EARLY_SAMPLES, REPORT_BINS, RT60_BINS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names and labels ---------------------------------------------------------------------------------------------


def layer_rank(layer: Column | str, order: Sequence[str]) -> Column:
    """Position of the first entry of ``order`` that the name contains, else the number of entries."""
    out = F.lit(len(order))
    for i in range(len(order) - 1, -1, -1):
        out = F.when(col(layer).contains(order[i]), i).otherwise(out)
    return out


def block_of(layer: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for b in reversed(BLOCKS):
        out = F.when(col(layer).contains(b), b).otherwise(out)
    return out


def is_norm1(layer: Column | str) -> Column:
    return col(layer).endswith(".norm1")


def layer_type(layer: Column | str) -> Column:
    return F.regexp_extract(col(layer), "[^.]+$", 0)


def probe_layer(model: Column | str, layer: Column | str) -> Column:
    """All layers of Demucs, the norm1 layers of other models."""
    return (col(model) == "demucs") | is_norm1(layer)


def side_of(layer: Column | str) -> Column:
    """encoder, decoder_level2, decoder_level1 or null, by the lower-cased name."""
    name = F.lower(col(layer))
    out = F.lit(None).cast("string")
    for part in ("decoder_level1", "decoder_level2", "encoder"):
        out = F.when(name.contains(part), part).otherwise(out)
    return out


def contains_any(name: Column | str, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | col(name).contains(p)
    return out


def rir_filename(path: Column | str, family: Column | str) -> Column:
    stem = F.regexp_replace(F.regexp_extract(col(path), "[^/]+$", 0), "[.][^.]+$", "")
    return F.concat(F.when(col(family) == "circular", "circ_").otherwise("lin_"), stem)


def family_guess(path: Column | str) -> Column:
    """From the top folder of a relative path."""
    return F.when(F.lower(F.regexp_extract(col(path), "^[^/]+", 0)).contains("circ"), "circular").otherwise("linear")


# --- bins and splits ----------------------------------------------------------------------------------------------


def rt60_bin(rt60: Column | str) -> Column:
    """Index of the stratification bin; what fits none is in the last."""
    out = F.lit(len(RT60_BINS) - 1)
    for i in range(len(RT60_BINS) - 2, -1, -1):
        low, high = RT60_BINS[i]
        out = F.when((col(rt60) >= low) & (col(rt60) < high), i).otherwise(out)
    return out


def report_bin(rt60: Column | str) -> Column:
    """Label of the report bin, null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high in reversed(REPORT_BINS):
        out = F.when((col(rt60) >= low) & (col(rt60) < high), f"{low}-{high}").otherwise(out)
    return out


def official_split(name: Column | str) -> Column:
    """test stays test, anything else trains."""
    return F.when(F.lower(F.trim(col(name))) == "test", "test").otherwise("train")


def portable_key(ident: Column | str, seed: int) -> Column:
    """A shuffle key that any SQL engine computes alike (ties are broken by the id itself)."""
    return (col(ident).cast("bigint") * 1103515245 + seed) % 2147483647


# --- numbers ------------------------------------------------------------------------------------------------------


def clean_number(x: Column | str) -> Column:
    """NaN becomes null; aggregates skip only nulls."""
    return F.when(F.isnan(col(x)), None).otherwise(col(x))


def clamp01(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def decibel(a: Column, b: Column, eps: float) -> Column:
    return 10 * F.log10((a + eps) / (b + eps))


def polynomial(x: Column | str, coefficients: Sequence[float]) -> Column:
    """Horner's scheme, the highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * col(x) + c
    return out


def pesq_unit(pesq: Column | str, lowest_of_batch: Column) -> Column:
    """PESQ in [0, 1]; null for a whole batch in which one score failed (-1)."""
    return F.when(lowest_of_batch == -1, None).otherwise((col(pesq) - 1) / 3.5)


def fixed_text(x: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(x))


# --- vectors ------------------------------------------------------------------------------------------------------


def clean_vector(v: Column | str) -> Column:
    """NaN and null entries become 0, infinities the largest finite number of their sign."""
    top = 1.7976931348623157e308
    return F.transform(col(v), lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, also where ``fn`` uses it inside a lambda over an array."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def total(v: Column | str) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x)


def energy(v: Column | str) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x * x)


def dot(v: Column | str, w: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(v), col(w), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def l2(v: Column | str, w: Column | str) -> Column:
    """Euclidean distance; the shorter vector counts as padded with zeros; null if one is missing."""
    gap = F.zip_with(clean_vector(v), clean_vector(w), lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return F.sqrt(energy(gap))


def squared_distance(v: Column | str, w: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(v), col(w), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)


def fold_columns(names: Sequence[str], prefix: str = "psi_") -> Column:
    """One vector of all columns with the prefix, in stored order."""
    return F.array(*[F.col(c).cast("double") for c in names if c.startswith(prefix)])


# --- signals (arrays of samples) ------------------------------------------------------------------------------------


def peak_index(x: Column | str) -> Column:
    """0-based place of the first largest absolute sample."""
    size = F.transform(col(x), F.abs)
    return F.array_position(size, F.array_max(size)) - 1


def onset_aligned(x: Column | str) -> Column:
    return F.slice(col(x), (peak_index(x) + 1).cast("int"), F.size(col(x)))


def cut(x: Column | str, start: Column, stop: Column) -> Column:
    """Samples start..stop-1, both limits clipped to the signal."""
    a, b = F.greatest(F.lit(0), start).cast("int"), F.least(F.size(col(x)), stop).cast("int")
    return F.when(b > a, F.slice(col(x), a + 1, b - a)).otherwise(F.slice(col(x), 1, 0))


def channel(channels: Column | str, wanted: int) -> Column:
    return F.element_at(col(channels), F.least(F.lit(wanted), F.size(col(channels)) - 1) + 1)


def tiled(x: Column | str, n: Column) -> Column:
    """The signal repeated to ``n`` samples."""
    times = F.ceil(n / F.size(col(x))).cast("int")
    return F.slice(F.flatten(F.array_repeat(col(x), times)), F.lit(1), n.cast("int"))


def noise_scale(signal: Column | str, noise: Column, snr: Column) -> Column:
    """What a noise of the signal's length is multiplied with for the wanted SNR."""
    power = energy(signal) / F.size(col(signal))
    return F.sqrt((power / F.pow(F.lit(10.0), snr / 10)) / (energy(noise) / F.size(noise) + 1e-12))


def mix_at_snr(signal: Column | str, noise: Column | str, snr: Column) -> Column:
    fitted = tiled(noise, F.size(col(signal)))
    return let(noise_scale(signal, fitted, snr), lambda scale: F.zip_with(col(signal), fitted, lambda s, n: s + n * scale))


def c50_from_peak(x: Column | str, rate: int, early_ms: float = 50.0) -> Column:
    """Early over late energy from the peak on, in dB; what stands before the peak is ignored."""
    early = int(early_ms / 1000 * rate)
    p = peak_index(x)
    return decibel(energy(cut(x, p, p + early)), energy(cut(x, p + early, F.size(col(x)))), 1e-10)


def drr_centered(x: Column | str, rate: int) -> Column:
    """Energy of a window of 1.5 ms round the peak over all the rest."""
    half = int(0.0015 * rate) // 2
    p = peak_index(x)
    direct = energy(cut(x, p - half, p + half))
    return decibel(direct, energy(x) - direct, 1e-10)


def _clipped_ratio(x: Column | str, first: int) -> Column:
    early, late = energy(cut(x, F.lit(0), F.lit(first))), energy(cut(x, F.lit(first), F.size(col(x))))
    return F.when(late < 1e-12, 100.0).otherwise(10 * F.log10(early / F.greatest(late, F.lit(1e-300)) + 1e-12))


def drr_onset(x: Column | str, rate: int, direct_ms: float = 2.5) -> Column:
    """On a response that starts at its peak: the first samples over the rest."""
    return _clipped_ratio(x, max(1, int(rate * direct_ms / 1000)))


def clarity(x: Column | str, rate: int, t_ms: float) -> Column:
    return _clipped_ratio(x, int(rate * t_ms / 1000))


def target_c50_ratio(x: Column | str, target: Column, early: int = EARLY_SAMPLES) -> Column:
    """Factor on the late part of an aligned response for a wanted C50."""
    e, late = energy(cut(x, F.lit(0), F.lit(early))), energy(cut(x, F.lit(early), F.size(col(x))))
    ratio = F.sqrt(e / (F.pow(F.lit(10.0), target / 10) * late + 1e-10))
    clipped = F.greatest(F.lit(1e-10), F.least(F.lit(1e6), ratio))
    return F.when(late < 1e-10, 1e-10).when(e < 1e-10, 1e6).otherwise(clipped)


def rms_gain(x: Column | str) -> Column:
    """sqrt(N / energy): makes the mean square 1."""
    return F.sqrt(F.size(col(x)) / energy(x))


def peak_normalised(x: Column | str) -> Column:
    top = F.greatest(F.array_max(F.transform(col(x), F.abs)), F.lit(1e-8))
    return let(top, lambda t: F.transform(col(x), lambda v: v / t))


def chunk_starts(n: Column, segment: int) -> Column:
    """Starts of fixed-length chunks: whole ones, then one that ends with the signal."""
    whole = F.floor(n / segment).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), lambda i: i * segment)
    tail = F.when((n > segment) & (n % segment != 0), F.array((n - segment).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(starts, tail)


def chunk(x: Column | str, start: Column, segment: int) -> Column:
    """``segment`` samples from ``start``; a shorter signal is padded with zeros."""
    got = F.slice(col(x), (start + 1).cast("int"), segment)
    return F.concat(got, F.array_repeat(F.lit(0.0), segment - F.size(got)))


def crop_start(n: Column, segment: int, seed: int, *keys: Column | str) -> Column:
    """Start of a random crop, the same in every run: 2 % start at 0."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *[col(k) for k in keys]), F.lit(1 << 40))
    return F.when((n <= segment) | (draw % 100 < 2), 0).otherwise(F.floor(draw / 100) % (n - segment + 1))


def loop_padded(x: Column | str, n: int) -> Column:
    """Repeated to ``n`` samples if shorter, else as it is."""
    return F.when(F.size(col(x)) >= n, col(x)).otherwise(tiled(x, F.lit(n)))


def same_length(x: Column | str, *others: Column | str) -> list[Column]:
    n = F.least(F.size(col(x)), *[F.size(col(o)) for o in others])
    return [F.slice(col(c), F.lit(1), n) for c in (x, *others)]


def si_sdr(reference: Column | str, estimate: Column | str, zero_mean: bool = False, eps: float = 1e-10) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB, higher is better; null without samples.

    zero_mean: both means are removed, eps stands in denominators only, and a zero target gives null.
    """
    r, e = same_length(reference, estimate)

    def less_mean(v: Column) -> Column:
        return let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))

    def ratio(p: Column) -> Column:
        r, e = p["r"], p["e"]

        def parts(scale: Column) -> Column:
            target, rest = scale * scale * energy(r), energy(F.zip_with(e, r, lambda y, x: y - x * scale))
            return 10 * F.log10(target / (rest + eps)) if zero_mean else 10 * F.log10((target + eps) / (rest + eps))

        return let(dot(e, r) / (energy(r) + eps), parts)

    both = F.struct((less_mean(r) if zero_mean else r).alias("r"), (less_mean(e) if zero_mean else e).alias("e"))
    return F.when(F.size(r) > 0, let(both, ratio))
