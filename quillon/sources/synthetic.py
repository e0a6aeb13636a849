"""Synthetic muon-pair events, distributed and seeded."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events of each process at scale 1.
EVENTS = {"mumu": 50_000, "taupair": 20_000, "ccbar": 30_000, "data": 10_000}


def generate(spark: SparkSession, process: str, events: int, seed: int = 42, beam: float = 10.87) -> DataFrame:
    """Events with a muon pair, clusters, a photon, the event's shape and a recoil that balances the pair.

    Draws come from the hash of event, column and seed, so rows don't depend on partitions.
    """
    def u(name: str) -> Column:
        h = F.xxhash64(F.lit(process), F.col("__event__"), F.lit(name), F.lit(seed))
        return (F.pmod(h, F.lit(1 << 53)) + 0.5) / float(1 << 53)

    def normal(name: str) -> Column:
        return F.sqrt(-2 * F.ln(u(name + "a"))) * F.cos(2 * math.pi * u(name + "b"))

    def exponential(name: str, mean: float) -> Column:
        return -F.ln(u(name)) * mean

    def poisson(name: str, mean: float) -> Column:
        """How many steps of the distribution function a draw is above."""
        steps, p, total = [], math.exp(-mean), 0.0
        for k in range(int(mean + 10 * math.sqrt(mean)) + 5):
            total += p
            steps.append(total)
            p *= mean / (k + 1)
        drawn = u(name)
        return sum(((drawn > c).cast("long") for c in steps[1:]), (drawn > steps[0]).cast("long"))

    df = spark.range(events).withColumnRenamed("id", "__event__")
    base: dict[str, Column] = {
        "__experiment__": F.lit(31),
        "__run__": F.pmod(F.xxhash64("__event__"), F.lit(999)) + 1,
        "__production__": F.lit(16),
        "__candidate__": F.lit(0),
        "__ncandidates__": F.lit(1),
        "process": F.lit(process),
    }
    for i in "12":
        base |= {
            f"mu{i}P": 0.5 + 4.5 * u(f"p{i}"),
            f"mu{i}Theta": 0.3 + 2.5 * u(f"t{i}"),
            f"mu{i}Phi": (2 * u(f"f{i}") - 1) * math.pi,
            f"mu{i}nCDCHits": F.floor(4 + 50 * u(f"h{i}")).cast("long"),
        }
        base |= {f"mu{i}clusterE": F.abs(0.2 + 0.05 * normal(f"e{i}"))}
    df = df.withColumns(base)
    near = {}
    for i in "12":
        p, t, f = (F.col(f"mu{i}{c}") for c in ("P", "Theta", "Phi"))
        near |= {
            f"mu{i}clusterTheta": t + 0.02 * normal(f"ct{i}"),
            f"mu{i}clusterPhi": f + 0.02 * normal(f"cf{i}"),
            f"mu{i}clusterEoP": F.col(f"mu{i}clusterE") / p,
            f"mu{i}E": F.sqrt(p * p + 0.10566**2),
            f"mu{i}Pt": p * F.sin(t),
        }
        near |= {f"_x{i}": p * F.sin(t) * F.cos(f), f"_y{i}": p * F.sin(t) * F.sin(f), f"_z{i}": p * F.cos(t)}
    df = df.withColumns(near)
    x, y, z = (-(F.col(f"_{a}1") + F.col(f"_{a}2")) for a in "xyz")
    p = F.sqrt(x * x + y * y + z * z)
    e = F.lit(beam) - F.col("mu1E") - F.col("mu2E")
    df = df.withColumns({"vpho_px": -x, "vpho_py": -y, "vpho_pz": -z, "vpho_E": F.col("mu1E") + F.col("mu2E")})
    shape = {"nTracksROE": poisson("tr", 4 if "data" in process else 5), "nGammaROE": poisson("ga", 3), "nPhotonCands": poisson("ph", 2.5), "sumE_offcone": exponential("oc", 0.5)}
    # The tenth of eleven uniform draws in order is distributed as beta(10, 2).
    shape |= {
        "E": exponential("ge", 0.4),
        "theta": 0.3 + 2.5 * u("gt"),
        "phi": (2 * u("gf") - 1) * math.pi,
        "psnm_ffo": F.sort_array(F.array(*[u(f"ff{k}") for k in range(11)]))[9],
    }
    df = df.withColumns(shape).withColumns({"nTracks": F.col("nTracksROE") + 2, "sumE_offcone_barrel": F.col("sumE_offcone") * 0.7})
    df = df.withColumns(
        {
            "pRecoil": p,
            "pRecoilTheta": F.acos(z / p),
            "pRecoilPhi": F.atan2(y, x),
            "eRecoil": e,
            "m2Recoil": e * e - p * p,
            "totalMuonMomentum": F.col("mu1P") + F.col("mu2P"),
            "beamE": F.lit(beam),
        },
    )
    return df.withColumn("mRecoil", F.sqrt(F.greatest("m2Recoil", F.lit(0.0)))).drop(*[f"_{a}{i}" for a in "xyz" for i in "12"])


def generate_all(spark: SparkSession, scale: float = 1.0, events: Mapping[str, int] = EVENTS, seed: int = 42) -> DataFrame:
    out = None
    for process, n in events.items():
        one = generate(spark, process, max(1, int(n * scale)), seed)
        out = one if out is None else out.unionByName(one)
    return out
