"""The facade for programs: a model that is loaded once, and settings whose nearest statement wins."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ionflow.engine import FormulaEngine, model_directory
from ionflow.sources import files

#: What holds where neither the constructor nor the call says otherwise. model: a preset, a folder, or None for the baseline.
CONFIG = {"model": None, "top_k": 25, "workers": 1}
#: Folders of models by name.
PRESETS: dict[str, str] = {}


def _positive(name: str, value) -> int:
    if type(value) is not int or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


class FormulaAdapter:
    """Predictions by one model. top_k and workers: of the call, else of the constructor, else of CONFIG.

    workers is the number of tasks that a Parquet file's molecules are dealt to at
    least; results do not depend on it.
    """

    def __init__(self, model: str | None = None, *, top_k: int | None = None, workers: int | None = None, spark: SparkSession | None = None):
        self.top_k = _positive("top_k", CONFIG["top_k"] if top_k is None else top_k)
        self.workers = _positive("workers", CONFIG["workers"] if workers is None else workers)
        self.model = CONFIG["model"] if model is None else model
        if self.model is not None and (not isinstance(self.model, (str, os.PathLike)) or not str(self.model).strip()):
            raise TypeError("model must be a preset or a path")
        spark = spark or SparkSession.builder.getOrCreate()
        if self.model is None:
            self.model_path, self.engine = None, FormulaEngine(spark)
        else:
            path = str(self.model)
            path = os.path.dirname(path) or "." if os.path.basename(path) == "model.json" and path not in PRESETS else path
            self.model_path = os.path.realpath(model_directory(os.path.expanduser(path), PRESETS, os.path.dirname(os.path.abspath(__file__))))
            self.engine = FormulaEngine.load(spark, self.model_path)

    @property
    def model_info(self) -> dict:
        """The model that was loaded."""
        return {"model": None if self.model is None else str(self.model), "model_path": self.model_path, **self.engine.model_info(), "parameters": dict(self.engine.model.meta) if self.engine.model else {}, "formula_config": self.engine.config.to_dict()}

    def predict(self, spectra: Iterable[Mapping], *, molecule_id: str | None = None, top_k: int | None = None) -> dict:
        """The prediction of one molecule's spectra."""
        return self.engine.predict_one(spectra, molecule_id, self.top_k if top_k is None else _positive("top_k", top_k))

    def predict_table(self, rows: DataFrame, *, top_k: int | None = None, workers: int | None = None) -> DataFrame:
        """Predictions of all molecules of a DataFrame, as one."""
        workers = self.workers if workers is None else _positive("workers", workers)
        rows = rows if workers == 1 else rows.repartition(workers, "molecule_id")
        return self.engine.predict(rows, self.top_k if top_k is None else _positive("top_k", top_k))

    def predict_parquet(self, path: str, *, output: str | None = None, top_k: int | None = None, workers: int | None = None) -> list[dict]:
        """Predictions by molecule_id, for files whose results fit into the driver (else predict_table); output must not exist."""
        if output is not None:
            files.require_other(path, output)
            files.require_new_file(output)
        rows = files.read_spectra(self.engine.spark, path)
        out = [r.asDict(recursive=True) for r in self.predict_table(rows, top_k=top_k, workers=workers).orderBy("molecule_id").toLocalIterator()]
        if output is not None:
            files.write_lines(out, output)
        return out


def predict_formula(spectra: Iterable[Mapping], *, model: str | None = None, molecule_id: str | None = None, top_k: int | None = None) -> dict:
    """One prediction; for several, keep a FormulaAdapter."""
    return FormulaAdapter(model, top_k=top_k).predict(spectra, molecule_id=molecule_id)
