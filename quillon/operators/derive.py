"""Derived columns of events with two muons and a recoil."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, fill_nan, min_horizontal, safe_div
from .selection import EVENT_KEYS, one_candidate

# Shares of the electron score's inputs.
ELECTRON = {"E_over_p": 0.3, "shower_shape": 0.2, "track_match": 0.3, "dE_dx": 0.2}
MUON_COLUMNS = [f"mu{i}{c}" for i in (1, 2) for c in ("P", "Theta", "Phi", "clusterTheta", "clusterPhi")]
RECOIL_COLUMNS = ["pRecoil", "pRecoilTheta", "pRecoilPhi"]


def phi_distance(a: Column, b: Column) -> Column:
    """Distance of two azimuths, at most pi."""
    d = F.abs(a - b)
    return F.when(d > math.pi, F.lit(2 * math.pi) - d).otherwise(d)


def _vector(p: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return p * F.sin(theta) * F.cos(phi), p * F.sin(theta) * F.sin(phi), p * F.cos(theta)


def angle(p1: Column, theta1: Column, phi1: Column, p2: Column, theta2: Column, phi2: Column) -> Column:
    """Angle between two momenta; null if one is zero."""
    dot = sum((a * b for a, b in zip(_vector(p1, theta1, phi1), _vector(p2, theta2, phi2))), F.lit(0.0))
    return F.acos(clip(safe_div(dot, F.abs(p1) * F.abs(p2)), -1.0, 1.0))


def delta_columns(df: DataFrame) -> DataFrame:
    """Adds the 18 angular and transverse columns of the muons against the recoil.

    Sines and cosines, then products of directions, then what uses them each have a
    projection of their own, so that each is computed once. An angle only depends
    on directions and on the momenta's signs; it is null where one is zero.
    """
    col = lambda n: F.col(n).cast("double")
    turned = [f"mu{i}{c}" for i in (1, 2) for c in ("Theta", "Phi", "clusterPhi")] + ["pRecoilTheta", "pRecoilPhi"]
    trig = {f"_{f}_{n}": getattr(F, f)(col(n)) for n in turned for f in ("sin", "cos")}
    sin, cos = (lambda n: F.col(f"_sin_{n}")), (lambda n: F.col(f"_cos_{n}"))

    def direction(theta: str, phi: str) -> tuple[Column, Column, Column]:
        return sin(theta) * cos(phi), sin(theta) * sin(phi), cos(theta)

    recoil, pt_recoil = direction("pRecoilTheta", "pRecoilPhi"), col("pRecoil") * sin("pRecoilTheta")
    step: dict[str, Column] = {"absdPhi": phi_distance(col("mu1Phi"), col("mu2Phi")), "pTRecoil": pt_recoil}
    out: dict[str, Column] = {"absdPhi": F.col("absdPhi"), "pTRecoil": F.col("pTRecoil")}
    for i in ("1", "2"):
        mu = f"mu{i}"
        step[f"absdPhiMu{i}"] = phi_distance(col(f"{mu}clusterPhi"), col("pRecoilPhi"))
        step[f"absdThetaMu{i}"] = F.abs(col(f"{mu}clusterTheta") - col("pRecoilTheta"))
        step[f"{mu}Pt"] = col(f"{mu}P") * sin(f"{mu}Theta")
        step[f"_track{i}"] = sum((a * b for a, b in zip(direction(f"{mu}Theta", f"{mu}Phi"), recoil)), F.lit(0.0))
        # The track's polar angle with the cluster's azimuth, as the analysis defines it.
        step[f"_cluster{i}"] = sum((a * b for a, b in zip(direction(f"{mu}Theta", f"{mu}clusterPhi"), recoil)), F.lit(0.0))
        step[f"_sign{i}"] = F.signum(col(f"{mu}P") * col("pRecoil"))
        step[f"_sign_t{i}"] = F.signum(col(f"{mu}P") * sin(f"{mu}Theta") * pt_recoil)
        angle_of = lambda dot, sign: F.when(F.col(sign) != 0, F.acos(clip(F.col(dot) * F.col(sign), -1.0, 1.0)))
        out |= {c: F.col(c) for c in (f"absdPhiMu{i}", f"absdThetaMu{i}", f"{mu}Pt")}
        out[f"dRMu{i}"] = F.sqrt(F.col(f"absdPhiMu{i}") * F.col(f"absdPhiMu{i}") + F.col(f"absdThetaMu{i}") * F.col(f"absdThetaMu{i}"))
        out[f"absdAlpha{i}"] = angle_of(f"_track{i}", f"_sign{i}")
        out[f"deltaMu{i}PRecoil"] = angle_of(f"_track{i}", f"_sign_t{i}")
        out[f"deltaMu{i}ClusterPRecoil"] = angle_of(f"_cluster{i}", f"_sign_t{i}")
    least = {f"min_deltaMu{k}PRecoil": min_horizontal(F.col(f"deltaMu1{k}PRecoil"), F.col(f"deltaMu2{k}PRecoil")) for k in ("", "Cluster")}
    kept = [c for c in df.columns if c not in out]
    done = df.withColumns(trig).withColumns(step).withColumns({n: c for n, c in out.items() if n not in step}).withColumns(least)
    return done.select(*[c for c in df.columns if c in kept or c in out], *[c for c in (*out, *least) if c not in df.columns])


def delta_simple(df: DataFrame, base: str, targets: Sequence[str]) -> DataFrame:
    """Adds delta_{base}_{t} = t - base."""
    return df.withColumns({f"delta_{base}_{t}": F.col(t) - F.col(base) for t in targets})


def angular_separation(p: Column, p_theta: Column, p_phi: Column, e: Column, theta: Column, phi: Column) -> Column:
    """Angle of a photon to the recoil; NaN where rounding leaves [-1, 1].

    Products go from left to right, as in SQL: for a photon along the recoil another order decides otherwise between 0 and NaN.
    """
    x = p * F.sin(p_theta) * F.cos(p_phi) * e * F.sin(theta) * F.cos(phi)
    y = p * F.sin(p_theta) * F.sin(p_phi) * e * F.sin(theta) * F.sin(phi)
    dot = x + y + p * F.cos(p_theta) * e * F.cos(theta)
    return F.acos(safe_div(dot, p * e))


def best_photon(df: DataFrame, keys: Sequence[str] | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Per event the photon nearest to the recoil, with E over the recoil's momentum; soft ones go, missing energies stay."""
    apart = angular_separation(*[F.col(c) for c in ("pRecoil", "pRecoilTheta", "pRecoilPhi", "E", "theta", "phi")])
    near = df.withColumn("angularSeparation", F.coalesce(fill_nan(apart, 4.0), F.lit(4.0)))
    keys = list(keys or [k for k in EVENT_KEYS if k in df.columns])
    best = one_candidate(near, keys, "angularSeparation", ascending=True, tiebreak=tiebreak)
    share = F.coalesce(fill_nan(safe_div(F.col("E"), F.col("pRecoil")), 0.0), F.lit(0.0))
    return best.withColumn("EoPRecoil", share).where(hard_enough())


def hard_enough(energy: str = "E") -> Column:
    """Whether a photon isn't too soft; missing energies stay."""
    return (F.col(energy) > 0.075) | F.col(energy).isNull()


def recoil_properties(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "pTRecoil": F.col("pRecoil") * F.sin("pRecoilTheta"),
            "sqrtERecoil": F.sqrt("eRecoil"),
            "m2_over_m_recoil": safe_div(F.col("m2Recoil"), F.col("mRecoil")),
        },
    )


def electron_id(df: DataFrame, weights: Mapping[str, float] = ELECTRON) -> DataFrame:
    """Adds electron_id, the weighted sum of the inputs that the table has; none is an error."""
    parts = [F.col(c) * w for c, w in weights.items() if c in df.columns]
    if not parts:
        raise ValueError(f"none of {sorted(weights)} in the table")
    return df.withColumn("electron_id", sum(parts[1:], parts[0]))


def muon_id(df: DataFrame) -> DataFrame:
    """Adds muon_id from the depth in the muon detector and the momenta."""
    pair = {"mu1P", "mu2P"} <= set(df.columns)
    momentum = (F.col("mu1P") + F.col("mu2P")) / 20 if pair else F.col("momentum") / 10
    return df.withColumn("muon_id", F.col("klm") / 14 * 0.5 + momentum * 0.5)


def add_weight(df: DataFrame, weight: float, name: str = "lumi_weight") -> DataFrame:
    return df.withColumn(name, F.lit(float(weight)))


def invariant_mass(df: DataFrame, particles: Sequence[str], name: str = "invariant_mass") -> DataFrame:
    """Adds the mass of particles p with columns pE, pP, pTheta and pPhi; NaN for a spacelike sum."""
    e = sum((F.col(f"{p}E") for p in particles), F.lit(0.0))
    parts = [_vector(F.col(f"{p}P"), F.col(f"{p}Theta"), F.col(f"{p}Phi")) for p in particles]
    p2 = sum((F.pow(sum((v[k] for v in parts), F.lit(0.0)), 2) for k in range(3)), F.lit(0.0))
    return df.withColumn(name, F.sqrt(e * e - p2))
