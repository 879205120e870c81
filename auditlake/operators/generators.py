"""Generators with one life cycle: train on rows, save, load in any session, generate.

A fitted generator is a few tables and a few parameters, with MLlib models where it has any. The tables are of the size of types
and genes; what is generated is drawn where it is written. The same model and seed draw the same rows.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from typing import ClassVar

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import factors, marginals, membership
from auditlake.sources.scratch import stored

REGISTRY: dict[str, type[GeneratorModel]] = {}


class GeneratorModel(ABC):
    """A trained generator; type_col is the name of the rows' type."""

    name: ClassVar[str]

    def __init__(self, tables: dict[str, DataFrame], stages: dict[str, PipelineModel], params: dict):
        self.tables, self.stages, self.params = tables, stages, params

    def __init_subclass__(cls):
        REGISTRY[cls.name] = cls

    @classmethod
    @abstractmethod
    def train(cls, rows: DataFrame, key: str, type_col: str, vector: str = "v", **params) -> GeneratorModel:
        """Fitted to rows of key, type and vector (array<double>)."""

    @abstractmethod
    def generate(self, seed: int | None = None) -> DataFrame:
        """type, draw (long), v: as many rows as were trained on; without a seed the trained one's."""

    def save(self, path: str) -> None:
        """Tables, models and parameters under a folder that the cluster shares; what lay there is replaced."""
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        for name, m in self.stages.items():
            m.write().overwrite().save(f"{path}/stages/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        about = {"name": self.name, "params": self.params, "tables": sorted(self.tables), "stages": sorted(self.stages)}
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @property
    def type_col(self) -> str:
        return self.params["type_col"]

    @property
    def seed(self) -> int:
        return self.params["seed"]


def train(name: str, rows: DataFrame, key: str, type_col: str, **params) -> GeneratorModel:
    return REGISTRY[name].train(rows, key, type_col, **params)


def load(spark: SparkSession, path: str) -> GeneratorModel:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    tables = {t: spark.read.parquet(f"{path}/tables/{t}") for t in about["tables"]}
    return REGISTRY[about["name"]](tables, {s: PipelineModel.load(f"{path}/stages/{s}") for s in about["stages"]}, about["params"])


class Gaussian(GeneratorModel):
    """Each type's mean and covariance."""

    name = "gaussian"

    @classmethod
    def train(cls, rows, key, type_col, vector="v", noise=0.1, seed=1):
        model = membership.mvn_model(rows.select(type_col, F.col(vector).alias("v")), type_col)
        return cls({"model": model}, {}, {"type_col": type_col, "noise": noise, "seed": seed})

    def generate(self, seed=None):
        return membership.draw_mvn(self.tables["model"], self.type_col, self.params["noise"], seed=self.seed if seed is None else seed)


class Copula(GeneratorModel):
    """Each type's count marginals by moments, and the correlation of their normal scores."""

    name = "copula"

    @classmethod
    def train(cls, rows, key, type_col, vector="v", seed=1):
        long = rows.select(F.col(key).alias("cell_id"), type_col, F.posexplode(vector).alias("gene", "x")).select("cell_id", type_col, "gene", F.col("x").cast("int").alias("cnt"))
        fitted = marginals.moment_marginals(long, [type_col])
        model = marginals.copula_model(fitted, marginals.gaussian_copula(long, fitted, [type_col]), type_col)
        sizes = rows.groupBy(type_col).agg(F.count("*").alias("n"))
        return cls({"model": model, "sizes": sizes}, {}, {"type_col": type_col, "seed": seed})

    def generate(self, seed=None):
        drawn = marginals.draw_copula(self.tables["model"], self.tables["sizes"], self.type_col, seed=self.seed if seed is None else seed)
        return drawn.select(self.type_col, F.col("cell").alias("draw"), "v")


class Factors(GeneratorModel):
    """Nonnegative factors, clusters in their space, the clusters' summaries, and a forest that gives draws their types."""

    name = "factors"

    @classmethod
    def train(cls, rows, key, type_col, vector="v", rank=4, passes=4, clusters=5, noise=0.0, epsilon_centres=None, epsilon_summaries=None, method="poisson", seed=1):
        basis = factors.fit_factors(rows, key, rank, passes, seed=seed, vector=vector).noised(noise, seed)
        weights = stored(basis.weights(rows, key, vector, keep=(type_col,)))
        dealt = factors.cluster_weights(weights, key, clusters, seed, epsilon_centres)
        long = rows.select(key, F.posexplode(vector).alias("gene", "cnt")).join(dealt, key)
        tables = {
            "summaries": factors.cluster_summaries(long, "cluster", epsilon=epsilon_summaries, seed=seed),
            "basis": rows.sparkSession.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(basis.basis)], "component int, basis array<double>"),
        }
        params = {"type_col": type_col, "n": rows.count(), "method": method, "seed": seed}
        return cls(tables, {"labels": factors.fit_labels(weights, type_col, seed=seed)}, params)

    def generate(self, seed=None):
        seed = self.seed if seed is None else seed
        spark = self.tables["basis"].sparkSession
        basis = factors.FactorModel.of(self.tables["basis"])
        drawn = factors.draw_cells(spark, self.tables["summaries"], self.params["n"], seed, self.params["method"])
        placed = basis.weights(drawn.withColumn("x", F.col("v")), "draw", "x", keep=("v",))
        return factors.draw_labels(self.stages["labels"], placed, "draw", self.type_col, seed).select(self.type_col, "draw", "v")
