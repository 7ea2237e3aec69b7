"""Prediction of molecular formulas: one DataFrame plan from spectra to ranked candidates."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ionflow.config import EngineConfig
from ionflow.operators import candidates as cand, features as feat, ranking, spectra as S
from ionflow.sources import files, tables


def _failures(norm: DataFrame) -> DataFrame:
    """The first failure of each molecule that has one: in input order, id conflicts after the row's own checks."""
    key = [c for c in ("precursor_mz", "adduct", "ms2_mzs", "ms2_normalized_intensities", "collision_energy_ev", "base_peak_intensity", "instrument_type")]
    by_id = W.partitionBy("molecule_id", "spectrum_id").orderBy("row_ord").rowsBetween(W.unboundedPreceding, 0)
    first = F.first(F.struct(*key)).over(by_id)
    x = norm.withColumn("clash", ~first.eqNullSafe(F.struct(*key)))
    bad = x.where("status is not null or clash")
    status = F.coalesce("status", F.lit("invalid_input"))
    message = F.coalesce("message", F.lit("Conflicting duplicate spectrum_id"))
    return bad.groupBy("molecule_id").agg(F.min_by(F.struct(status.alias("status"), message.alias("message")), "row_ord").alias("f")).select("molecule_id", "f.status", "f.message")


class FormulaEngine:
    """Spectra in, predictions out. Without a model candidates are ranked by the baseline."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, model: ranking.Ranker | None = None, model_version: str = "baseline", search=cand.search_kernel):
        self.spark, self.config, self.model, self.model_version, self.search = spark, config or EngineConfig(), model, model_version, search

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: EngineConfig | None = None) -> FormulaEngine:
        """A trained model: its version, feature names, number of features and settings must fit."""
        text = open(f"{path}/model.json", encoding="utf-8").read()
        data, meta = json.loads(text), files.read_json(f"{path}/metadata.json")
        own = EngineConfig.from_dict(meta["config"])
        if data["artifact_version"] != 1:
            raise ValueError("unknown artifact version")
        if data["features"] != feat.FEATURES or any(max(t["feature"], default=0) >= len(feat.FEATURES) for t in data["trees"]):
            raise ValueError("the model has other features")
        if own.version != meta["config_version"] or (config is not None and config.version != own.version):
            raise ValueError("the model was made with other settings")
        return cls(spark, own, ranking.Ranker.from_dict(data), "ranker-" + hashlib.sha256(text.encode()).hexdigest()[:16])

    def normalized(self, rows: DataFrame) -> DataFrame:
        if "row_ord" not in rows.columns:
            rows = rows.withColumn("row_ord", F.monotonically_increasing_id())
        return S.normalize(S.with_ids(files.complete(rows)), self.config)

    def used(self, norm: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Spectra that count, and the molecules that fail before any search."""
        failed = _failures(norm)
        good = S.drop_repeats(norm.join(failed.select("molecule_id"), "molecule_id", "left_anti"))
        return good, failed

    def _molecules(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Molecules with candidates and evidence, spectra that count, failed molecules, and those over a search limit."""
        # read by the searches, the support and each spectrum's evidence
        spectra, failed = self.used(tables.materialize(self.normalized(rows), "spectra"))
        own, lists, over = cand.lists(spectra, self.config, self.search)
        return feat.of_lists(own, lists, spectra, self.config), spectra, failed, over

    def _limited(self, ids: DataFrame) -> DataFrame:
        return ids.select("molecule_id", F.lit("resource_limit").alias("status"), F.lit(f"search exceeds {self.config.max_search_results} results").alias("message"))

    def candidate_features(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Candidates with features, spectra that count, and failed molecules (molecule_id, status, message)."""
        x, spectra, failed, over = self._molecules(rows)
        x = feat.rows_of(x).withColumn("mass_errors_ppm", cand.mass_errors(F.col("mass"), F.col("masses"))).drop("masses")
        x = tables.materialize(x, "features")
        late = x.where("exceeded").select("molecule_id").union(over).distinct()
        return x.where("not exceeded").drop("exceeded").join(late, "molecule_id", "left_anti"), spectra, failed.unionByName(self._limited(late))

    def _best(self, rows: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(molecule_id, candidates: the best, total, any_full), spectra that count, and failed molecules."""
        if self.model is not None:
            x, spectra, failed = self.candidate_features(rows)
            item = F.struct(F.col("rank").cast("int").alias("rank"), "formula", F.col("mass").alias("exact_mass"), "score", "mass_errors_ppm", F.col("support").cast("int").alias("supporting_spectra"))
            per = self.ranked(x).where(F.col("rank") <= top_k).groupBy("molecule_id").agg(
                F.array_sort(F.collect_list(item), lambda a, b: a["rank"] - b["rank"]).alias("candidates"), F.max("total").alias("total"), F.max("any_full").alias("any_full")
            )
            return per, spectra, failed
        x, spectra, failed, over = self._molecules(rows)
        x = ranking.baseline_lists(x)
        n, first = F.size("ranked"), F.col("ranked")[0]["cand"]

        def item(c, k):
            mass = c["cand"]["mass"]
            return F.struct((k + 1).alias("rank"), c["formula"].alias("formula"), mass.alias("exact_mass"), (n - k).cast("double").alias("score"), cand.mass_errors(mass, F.col("masses")).alias("mass_errors_ppm"), c["cand"]["support"].cast("int").alias("supporting_spectra"))

        # a row a molecule: the rows of candidates are never made
        x = x.select("molecule_id", "exceeded", F.transform(F.slice("ranked", 1, top_k), item).alias("candidates"), first["total"].alias("total"), first["any_full"].alias("any_full"))
        x = tables.materialize(x, "best")
        late = x.where("exceeded").select("molecule_id").union(over).distinct()
        return x.where("not exceeded").drop("exceeded"), spectra, failed.unionByName(self._limited(late))

    def ranked(self, x: DataFrame) -> DataFrame:
        return ranking.baseline(x) if self.model is None else ranking.by_score(ranking.scored(x, self.model))

    def predict(self, rows: DataFrame, top_k: int = 25) -> DataFrame:
        """One prediction a molecule, failed ones too."""
        if type(top_k) is not int or top_k < 1:
            raise ValueError("top_k must be a positive integer")
        per, spectra, failed = self._best(rows, top_k)
        few = F.transform(F.array_sort(F.collect_list(F.when(F.size("peaks") < 5, F.struct("row_ord", "spectrum_id")))), lambda s: F.concat(s["spectrum_id"], F.lit(": insufficient fragment evidence")))
        base = spectra.groupBy("molecule_id").agg(F.count("*").alias("spectra_used"), few.alias("few")).join(failed.select("molecule_id"), "molecule_id", "left_anti")
        total = F.coalesce("total", F.lit(0))
        cap = self.config.max_candidates
        kept = F.least(total, F.lit(cap))
        notes = F.concat(
            "few",
            F.when((F.col("spectra_used") > 1) & (total > 0) & ~F.col("any_full"), F.array(F.lit("inconsistent precursor masses: candidate union retained"))).otherwise(F.array().cast("array<string>")),
            F.when(total > cap, F.array(F.format_string("candidate list truncated from %d to %d", total, kept))).otherwise(F.array().cast("array<string>")),
        )
        kinds = "array<struct<rank:int,formula:string,exact_mass:double,score:double,mass_errors_ppm:map<string,double>,supporting_spectra:int>>"
        ok = base.join(per, "molecule_id", "left").select(
            "molecule_id",
            F.when(total > cap, "truncated").when(total > 0, "ok").otherwise("no_candidates").alias("status"),
            F.coalesce("candidates", F.array().cast(kinds)).alias("candidates"),
            notes.alias("warnings"),
            F.struct(kept.cast("long").alias("candidate_count"), total.cast("long").alias("total_candidates"), F.col("spectra_used").cast("long").alias("spectra_used")).alias("diagnostics"),
        )
        broken = failed.select("molecule_id", "status", F.array().cast(kinds).alias("candidates"), F.array("message").alias("warnings"), F.lit(None).cast("struct<candidate_count:bigint,total_candidates:bigint,spectra_used:bigint>").alias("diagnostics"))
        return ok.unionByName(broken).withColumn("model_version", F.lit(self.model_version)).withColumn("config_version", F.lit(self.config.version))

    def predict_one(self, spectra: Iterable[Mapping], molecule_id: str | None = None, top_k: int = 25) -> dict:
        """The prediction of one molecule given as mappings."""
        spectra = list(spectra)
        first = spectra[0] if spectra and isinstance(spectra[0], Mapping) else {}
        name = str(molecule_id if molecule_id is not None else first.get("molecule_id", "molecule"))
        problem = None
        if not spectra:
            problem = "At least one spectrum is required"
        elif not all(isinstance(s, Mapping) for s in spectra):
            problem = "Each spectrum must be a mapping"
        elif len({s["molecule_id"] for s in spectra if s.get("molecule_id") is not None}) > 1:
            problem = "All spectra must belong to one molecule"
        elif any(s.get("instrument_type") is not None and not isinstance(s["instrument_type"], str) for s in spectra):
            problem = "instrument_type must be a string or null"
        if problem is None:
            try:
                rows = files.from_mappings(self.spark, spectra, name)
            except (TypeError, ValueError) as e:
                problem = str(e)
        if problem is not None:
            return {"molecule_id": name, "status": "invalid_input", "candidates": [], "warnings": [problem], "diagnostics": None, "model_version": self.model_version, "config_version": self.config.version}
        return self.predict(rows, top_k).first().asDict(recursive=True)

    def predict_parquet(self, path: str, output: str | None = None, top_k: int = 25, overwrite: bool = False) -> DataFrame | int:
        """Predictions by molecule_id; with output they go to a JSON lines file, and their number is returned."""
        out = self.predict(files.read_spectra(self.spark, path), top_k).orderBy("molecule_id")
        if output is None:
            return out
        files.require_other(path, output)
        return files.write_jsonl(out, output, overwrite)

    def iter_predict_parquet(self, path: str, top_k: int = 25) -> Iterator[dict]:
        for row in self.predict_parquet(path, top_k=top_k).toLocalIterator():
            yield row.asDict(recursive=True)

    def model_info(self) -> dict:
        return {"model_version": self.model_version, "config_version": self.config.version, "learned": self.model is not None, "trees": len(self.model.trees) if self.model else 0}


def model_directory(model: str, presets: Mapping[str, str] = {}, base: str = ".") -> str:
    """A preset's or a given folder, relative to base; both files must be there."""
    path = presets.get(model, model)
    path = path if os.path.isabs(path) else os.path.join(base, path)
    missing = [n for n in ("model.json", "metadata.json") if not os.path.isfile(os.path.join(path, n))]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    return path


def predict_formula(spark: SparkSession, spectra: Iterable[Mapping], model: str | None = None, config: EngineConfig | None = None, top_k: int = 25) -> dict:
    engine = FormulaEngine.load(spark, model_directory(model), config) if model else FormulaEngine(spark, config)
    return engine.predict_one(spectra, top_k=top_k)
