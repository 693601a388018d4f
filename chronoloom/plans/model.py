"""A fitted analogue model: scaling, training rows, calibrator; saved and loaded as Parquet and JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import calibrate as cal
from chronoloom.operators import neighbours as nb
from chronoloom.operators import scan
from chronoloom.operators.vote import signal
from chronoloom.plans.analogue import PAYLOAD, AnalogueConfig, answered
from chronoloom.session import staged

VERSION = 1


@dataclass(frozen=True)
class AnalogueModel:
    """``train``: tid, vec (scaled), ticker, sector, regime, label, fwd_return, as a table written by ``scan.filed`` (or ``save``)."""

    features: list[str]
    scaling: dict[str, tuple[float, float]]
    config: AnalogueConfig
    train: DataFrame
    calibrator: dict = field(default_factory=lambda: {"kind": "none", "params": []})

    def scaled(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of id, ticker, sector, regime and features (label and fwd_return if they have them) as a side of a query."""
        vec = nb.scaled_columns(self.scaling, self.config.feature_weights)
        known = [c for c in ("label", "fwd_return") if c in rows.columns]
        return rows.select(F.col("id").alias(key), "ticker", "sector", "regime", *known, vec.alias("vec"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``qid, raw_prob, prob, mean_return, n_matches, ensemble, signal, reason``; signals follow the calibrated probability."""
        asked = self.scaled(rows, "qid").select("qid", "ticker", "sector", "regime", "vec")
        if self.config.cells:
            centres = nb.centres(self.train, self.config.cells)
            points = scan.filed(nb.in_cells(self.train.select("tid", "vec", *PAYLOAD), centres, 1).withColumn("cell", F.element_at("cells", 1)).drop("cells"), "cells")
            won = answered(nb.in_cells(asked.where(scan.usable()), centres, self.config.cell_probes).unionByName(asked.where(~scan.usable()), allowMissingColumns=True), points, self.config, cells=True)
        else:
            won = answered(asked, self.train, self.config)
        out = won.select("qid", "raw_prob", "mean_return", "n_matches", "ensemble").withColumn("prob", cal.apply(self.calibrator, F.col("raw_prob")))
        side, why = signal(F.col("prob"), F.col("n_matches"), self.config.threshold, self.config.spread, self.config.min_matches)
        return out.withColumns({"signal": side, "reason": why})

    def save(self, path: str) -> None:
        """Parquet of the training side and one JSON document of the rest."""
        spark = self.train.sparkSession
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        doc = {"version": VERSION, "features": self.features, "scaling": self.scaling, "config": asdict(self.config), "calibrator": self.calibrator}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load(spark: SparkSession, path: str) -> AnalogueModel:
    """A saved model; one of another version is an error."""
    doc = json.loads(spark.read.text(f"{path}/model").first()[0])
    if doc.get("version") != VERSION:
        raise ValueError(f"model has version {doc.get('version')}, expected {VERSION}")
    scaling = {c: tuple(v) for c, v in doc["scaling"].items()}
    return AnalogueModel(doc["features"], scaling, AnalogueConfig(**doc["config"]), spark.read.parquet(f"{path}/train"), doc["calibrator"])


def fit(rows: DataFrame, features: list[str], config: AnalogueConfig, kind: str = "none") -> AnalogueModel:
    """Fit on rows of id, ticker, sector, regime, label, fwd_return and features.

    With a calibrator kind a second pass asks the model about all of its own training rows and fits the calibrator to
    what it answers; same-ticker analogues are left out there as in any query. Answers are as many as the rows: they are not broadcast.
    """
    plain = AnalogueModel(features, nb.standardise(rows, features), config, rows)
    model = replace(plain, train=scan.filed(plain.scaled(rows, "tid"), "model"))
    if kind == "none":
        return model
    asked = model.predict(rows).select("qid", "raw_prob").hint("merge").join(rows.select(F.col("id").alias("qid"), F.col("label").alias("y")), "qid")
    return replace(model, calibrator=cal.calibrator(kind, staged(asked, "calibration")))


def compare(rows: DataFrame, queries: DataFrame, features: list[str], config: AnalogueConfig, matrix, names: str = "z") -> DataFrame:
    """Brier skill with the plain features and with their projection by ``matrix``: ``space, n, bss``."""
    from chronoloom.operators.metrics import brier_skill
    from chronoloom.operators.vectors import project

    def projected(df: DataFrame) -> DataFrame:
        z = project(features, matrix)
        return df.withColumn("__z", z).withColumns({f"{names}{i}": F.col("__z")[i] for i in range(matrix.shape[1])}).drop("__z")

    out = None
    for space, train, asked, columns in (("plain", rows, queries, features), ("compressed", projected(rows), projected(queries), [f"{names}{i}" for i in range(matrix.shape[1])])):
        got = fit(train, columns, config).predict(asked).join(asked.select(F.col("id").alias("qid"), F.col("label").alias("y")), "qid")
        row = got.agg(F.count(F.lit(1)).alias("n"), brier_skill(F.col("raw_prob"), F.col("y")).alias("bss")).select(F.lit(space).alias("space"), "n", "bss")
        out = row if out is None else out.unionByName(row)
    return out
