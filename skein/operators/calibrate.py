"""Linear calibration of a base score by features of the user's and item's profiles.

Features are built by rule from a few symbols of the pair: the base score, and for either side its count, mean, median,
variance, range and so on. Names are part of the interface. All scales, powers and thresholds in this file are fixed values.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.models import clip
from skein.operators.ratings import profile

#: Terms in one expression of a sum, so that generated methods stay small.
CHUNK = 60


def joined_profiles(scored: DataFrame, ratings: DataFrame) -> DataFrame:
    """``scored`` (``u, i, score``) with both profiles; unknown sides get the mean, and no spread."""
    out = scored
    for side in ("u", "i"):
        p = profile(ratings, side)
        out = out.join(p.select(side, *[F.col(c).alias(f"{side}_{c}") for c in p.columns[1:]]), side, "left")
    return out


def _symbols(mean: float) -> dict[str, Column]:
    """Values of either side by short name (``u``/``i`` in front), unknown sides filled."""
    s: dict[str, Column] = {}
    for x in "ui":
        n = F.coalesce(F.col(f"{x}_n"), F.lit(0))
        central = {"mean": "mean", "med": "median", "min": "low", "max": "high"}
        for short, column in central.items():
            s[x + short] = F.coalesce(F.col(f"{x}_{column}"), F.lit(mean))
            s[f"{x}{short}_g"] = s[x + short] - mean
        for short, column in {"var": "variance", "iqr": "iqr", "skew": "skewness"}.items():
            s[x + short] = F.coalesce(F.col(f"{x}_{column}"), F.lit(0.0))
        s[x + "std"] = F.sqrt(s[x + "var"])
        s[x + "range"] = F.coalesce(F.col(f"{x}_high") - F.col(f"{x}_low"), F.lit(0.0))
        s[f"abs_{x}g"] = F.abs(s[x + "mean_g"])
        s[x + "c"], s[f"log_{x}c"] = n, F.log1p(n.cast("double"))
        s[f"inv_{x}c"], s[f"sqrt_{x}c"] = 1 / F.sqrt(n + 1.0), F.sqrt(n + 1.0)
    return s


def features(mean: float) -> dict[str, Column]:
    """All features by name, as columns over :func:`joined_profiles`."""
    s, base = _symbols(mean), F.col("score")
    sides, power = "ui", {2: 100.0, 3: 10000.0, 4: 1000000.0}
    flag = lambda c: c.cast("double")
    out: dict[str, Column] = {"pred": base}
    # Symbols that are features themselves, and their powers.
    for x in sides:
        for name in ("mean", "med", "mean_g", "med_g", "min_g", "max_g", "var", "std", "iqr", "range", "skew"):
            out[x + name] = s[x + name]
        for name in (f"log_{x}c", f"inv_{x}c", f"sqrt_{x}c", f"abs_{x}g"):
            out[name] = s[name]
        for name, k in product((f"log_{x}c", f"inv_{x}c"), (2, 3)):
            if (name[:3], k) != ("inv", 3):
                out[f"{name}{k}"] = s[name] ** k
        for name in ("mean_g", "med_g"):
            out[f"{x}{name}2"] = s[x + name] ** 2 / 100.0
        out[f"mean_med_{'user' if x == 'u' else 'item'}_gap"] = s[x + "mean"] - s[x + "med"]
        out[f"abs_mean_med_{'user' if x == 'u' else 'item'}_gap"] = F.abs(s[x + "mean"] - s[x + "med"])
        out[f"{x}var_log_{x}c"] = s[x + "var"] * s[f"log_{x}c"] / 100.0
        out[f"{x}std_log_{x}c"] = s[x + "std"] * s[f"log_{x}c"] / 10.0
        out[f"abs_{x}g_log_{x}c"] = s[f"abs_{x}g"] * s[f"log_{x}c"] / 10.0
        out[f"abs_{x}g_inv_{x}c"] = s[f"abs_{x}g"] * s[f"inv_{x}c"]
    # One side against the other.
    for name in ("std", "var", "iqr"):
        out[f"{name}_sum"], out[f"{name}_diff"] = s["u" + name] + s["i" + name], s["u" + name] - s["i" + name]
    out["range_sum"], out["mean_sum_g"] = s["urange"] + s["irange"], s["umean_g"] + s["imean_g"]
    for name in ("std", "var", "iqr", "range", "skew"):
        out[f"{name}_abs_diff"] = F.abs(s["u" + name] - s["i" + name])
    for name, scale in {"std": 100.0, "var": 1000.0, "iqr": 100.0, "range": 100.0, "skew": 1.0}.items():
        out[f"u{name}_i{name}"] = s["u" + name] * s["i" + name] / scale
    for name, word in {"mean": "mean", "med": "median"}.items():
        gap = s["u" + name] - s["i" + name]
        out[f"{name}_diff"], out[f"{word}_abs_diff"], out[f"{word}_diff2"] = gap, F.abs(gap), gap**2 / 100.0
        out[f"{name}_inter"] = s[f"u{name}_g"] * s[f"i{name}_g"] / 100.0
        out[f"pred_{word}_abs_diff"] = base * F.abs(gap) / 100.0
        out[f"base_{word}_gap_inter"] = (base - s["u" + name]) * (base - s["i" + name]) / 100.0
        for x in sides:
            own = base - s[x + name]
            out[f"base_minus_{x}{name}"], out[f"abs_base_minus_{x}{name}"], out[f"base_{x}{name}_gap2"] = own / 100.0, F.abs(own) / 100.0, own * own / 100.0
    for a, b in product(("mean", "med"), repeat=2):
        out[f"u{a}_i{b}"] = s["u" + a] * s["i" + b] / 100.0
    out["abs_ug_abs_ig"] = s["abs_ug"] * s["abs_ig"] / 100.0
    # Counts.
    lu, li, ru, ri = s["log_uc"], s["log_ic"], s["inv_uc"], s["inv_ic"]
    out |= {"log_ratio": lu - li, "log_prod": lu * li, "log_count_sum": lu + li, "log_count_abs_diff": F.abs(lu - li)}
    out |= {"log_uc_log_ic2": lu * li**2, "log_ic_log_uc2": li * lu**2, "inv_uc_inv_ic": ru * ri, "sqrt_uc_sqrt_ic": s["sqrt_uc"] * s["sqrt_ic"]}
    for a, b in product(sides, repeat=2):
        out[f"log_{a}c_inv_{b}c"] = s[f"log_{a}c"] * s[f"inv_{b}c"]
        out[f"log_{a}c_{b}mean_g"] = s[f"log_{a}c"] * s[f"{b}mean_g"] / 10.0
        out[f"inv_{a}c_{b}mean_g"] = s[f"inv_{a}c"] * s[f"{b}mean_g"]
    # Count thresholds. Fixed values.
    below = {"u": (1, 2, 3, 5, 10, 15, 20, 30, 50, 75), "i": (1, 2, 3, 4, 5, 8, 10, 15, 20, 30)}
    above = {"u": (50, 100, 150), "i": (20, 50, 100)}
    le = {f"{x}c_le_{k}": s[x + "c"] <= k for x in sides for k in below[x]}
    gt = {f"{x}c_gt_{k}": s[x + "c"] > k for x in sides for k in above[x]}
    mid = {"u_mid": (s["uc"] > 5) & (s["uc"] <= 30), "i_mid": (s["ic"] > 2) & (s["ic"] <= 10)}
    out |= {k: flag(c) for k, c in {**le, **gt, **mid}.items()}
    out |= {"uc0": flag(s["uc"] == 0), "ic0": flag(s["ic"] == 0), "u_low": flag(s["uc"] <= 5), "i_low": flag(s["ic"] <= 2)}
    for a, b in ((2, 2), (5, 4), (10, 10), (15, 8), (20, 5), (30, 15), (50, 20), (75, 30)):
        out[f"uc{a}_ic{b}"] = flag((s["uc"] <= a) & (s["ic"] <= b))
    for a, b in ((50, 20), (100, 50), (150, 100)):
        out[f"ucgt{a}_icgt{b}"] = flag((s["uc"] > a) & (s["ic"] > b))
    out["u_mid_i_mid"] = flag(mid["u_mid"] & mid["i_mid"])
    out["uc_low_ic_high"], out["uc_high_ic_low"] = flag((s["uc"] <= 10) & (s["ic"] > 20)), flag((s["uc"] > 50) & (s["ic"] <= 10))
    scaled = [f"{x}c_le_{k}" for x, ks in {"u": (2, 5, 10, 15, 30, 75), "i": (2, 4, 8, 10, 15, 30)}.items() for k in ks]
    for name in [*scaled, "uc_gt_50", "ic_gt_20", "u_mid", "i_mid"]:
        out[f"pred_{name}"] = out[name] * base / 100.0
    # The base score by itself and times the symbols.
    center = base - mean
    out |= {f"pred{k}": base**k / d for k, d in power.items()}
    out |= {"pred_center2": center**2 / 100.0, "pred_center3": center**3 / 1000.0, "pred_center4": center**4 / 10000.0, "pred_abs_err_center": F.abs(center) / 100.0}
    for name, scale in {"log_uc": 100.0, "log_ic": 100.0, "log_ratio": 100.0, "log_prod": 100.0, "inv_uc": 100.0, "inv_ic": 100.0, "umean_g": 100.0, "imean_g": 100.0, "abs_ug": 100.0, "abs_ig": 100.0, "uvar": 1000.0, "ivar": 1000.0, "std_diff": 100.0, "std_abs_diff": 100.0, "iqr_diff": 100.0}.items():
        out[f"pred_{name}"] = base * out[name] / scale
    for name in ("range", "skew"):
        out[f"pred_{name}_diff"] = base * (s["u" + name] - s["i" + name]) / 100.0
    out |= {f"pred_low_{k}": flag(base < k) for k in (20, 40)} | {f"pred_high_{k}": flag(base >= k) for k in (60, 80, 90)}
    out["pred_mid_40_60"] = flag((base >= 40) & (base < 60))
    out |= {f"pred_bin_{k}": flag(F.greatest(F.lit(0), F.least(F.lit(9), F.floor(base / 10))) == k) for k in range(10)}
    return out


def calibrate(scored: DataFrame, ratings: DataFrame, coefficients: dict[str, float], intercept: float, ends: tuple[float, float, float]) -> DataFrame:
    """``u, i, score``: intercept plus the weighted features, clipped. ``pred`` must be among the coefficients."""
    if "pred" not in coefficients:
        raise ValueError("the base score needs a coefficient")
    mean, low, high = ends
    known = features(mean)
    if unknown := set(coefficients) - set(known):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    rows, names = joined_profiles(scored, ratings), list(coefficients)
    parts = []
    for at in range(0, len(names), CHUNK):
        part = F.lit(0.0)
        for name in names[at : at + CHUNK]:
            part = part + known[name] * coefficients[name]
        parts.append(part.alias(f"_part{at}"))
    rows = rows.select("u", "i", *parts)
    total = F.lit(intercept)
    for at in range(0, len(names), CHUNK):
        total = total + F.col(f"_part{at}")
    return rows.select("u", "i", clip(total, low, high).alias("score"))
