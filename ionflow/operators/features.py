"""The 74 features of a candidate: composition, and evidence of each spectrum as mean, max and min."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ionflow.config import EngineConfig
from ionflow.constants import ELEMENTS
from ionflow.functions import chemistry as C
from ionflow.operators import kernel
from ionflow.sources import tables

# Names of the evidence of one spectrum, in order.
PER_SPECTRUM = (
    "abs_ppm", "supported", "peak_fraction", "intensity_fraction", "fragment_error_fraction",
    "water_loss_fraction", "co_loss_fraction", "co2_loss_fraction", "ammonia_loss_fraction",
    "log_peak_count", "positive", "ce_mean", "ce_min", "ce_max", "ce_missing", "log_base_peak", "base_missing",
    "timsTOF", "orbitrap", "instrument_missing",
)
FEATURES = [f"count_{e}" for e in ELEMENTS] + ["dbe", "h_c", "hetero_c", "mass"] + [f"{n}_{a}" for a in ("mean", "max", "min") for n in PER_SPECTRUM]
_EVIDENCE = PER_SPECTRUM[2:9]


_OWN = PER_SPECTRUM[:9]
_SUMMED = [f"{n}_{a}" for a in ("mean", "max", "min") for n in _OWN]
_OF_SPECTRA = [f"{n}_{a}" for a in ("mean", "max", "min") for n in PER_SPECTRUM[9:]]
#: Candidates times spectra whose numbers are held at once.
_CELLS = 1 << 17
#: Molecules with the same vectors that are taken together.
_ALIKE = 1 << 14


def _listed(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(molecule_id, like, deal) and (like, cands): each molecule's candidates as one array, its own."""
    by = cands.groupBy("molecule_id").agg(F.collect_list(F.struct(*(c for c in cands.columns if c != "molecule_id"))).alias("cands"))
    return cands.select("molecule_id").distinct().withColumns({"like": F.col("molecule_id"), "deal": F.lit(0)}), by.withColumnRenamed("molecule_id", "like")


def _met(rows: DataFrame, own: DataFrame, lists: DataFrame, grouped=lambda x: x) -> DataFrame:
    """rows, which have like and deal, grouped and with the lists; alike ones stand in one task, and as many tasks as there are partitions work on them."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lists.join(own.select("like", "deal").distinct(), "like")
    return grouped(rows.repartition(parts, "like", "deal")).join(dealt.repartition(parts, "like", "deal"), ["like", "deal"]).drop("deal")


def evidence(cands: DataFrame, spectra: DataFrame, config: EngineConfig) -> DataFrame:
    """As evidence_of_lists, for candidates in rows (molecule_id, vector)."""
    return evidence_of_lists(*_listed(cands.select("molecule_id", "vector")), spectra, config)


def evidence_of_lists(own: DataFrame, lists: DataFrame, spectra: DataFrame, config: EngineConfig) -> DataFrame:
    """(molecule_id, spectrum_id, vector, feasible, the seven evidence columns, exceeded) for each candidate and spectrum.

    own, lists: as candidates.lists gives them. A unit of work is a molecule's
    candidates (capped) with one of its spectra, so that a molecule with many
    spectra spreads over tasks. feasible: whether no count of the ion is negative.
    """
    tables.ship(spectra.sparkSession)
    da, ppm, most = config.fragment_da, config.fragment_ppm, config.max_search_results

    rows = spectra.select("molecule_id", "spectrum_id", "charge", "delta", F.transform("peaks", lambda p: p["mz"]).alias("mzs"), F.transform("peaks", lambda p: p["intensity"]).alias("powers"))
    # lists of the same vectors are one, in one order
    vectors = lists.select(F.col("like").alias("of"), F.array_sort(F.transform("cands", lambda c: c["vector"])).alias("vectors"))
    same = tables.materialize(vectors.groupBy("vectors").agg(F.min("of").alias("like"), F.collect_list("of").alias("of")), "vectors")
    own = own.select("molecule_id", F.col("like").alias("of")).join(same.select("like", F.explode("of").alias("of")), "of")
    own = own.join(own.groupBy("like").agg(F.ceil(F.count("*") / _ALIKE).alias("hands")), "like")
    own = own.select("molecule_id", "like", F.pmod(F.xxhash64("molecule_id"), "hands").cast("int").alias("deal"))
    both = _met(rows.join(own, "molecule_id"), own, same.select("like", "vectors"))
    names = ["molecule_id", "spectrum_id", "vector", "feasible", *_EVIDENCE, "exceeded"]

    def kernel_rows(batches):
        for b in batches:
            column = {c: b.column(c) for c in b.schema.names}
            # the numbers as they lie in the batch, without Python lists
            delta, charge = column["delta"].flatten().to_numpy().reshape(-1, 12).astype(np.int64), column["charge"].to_numpy()
            peaks, mzs, powers = column["mzs"].offsets.to_numpy().astype(np.int64), column["mzs"].values.to_numpy(), column["powers"].values.to_numpy()
            alike: dict = {}
            for i, like in enumerate(column["like"].to_pylist()):
                alike.setdefault((like, charge[i], delta[i].tobytes()), []).append(i)
            for rows in alike.values():
                v = column["vectors"].slice(rows[0], 1).flatten().flatten().to_numpy().reshape(-1, 10).astype(np.int64)
                ions = np.concatenate([v, np.zeros((len(v), 2), np.int64)], axis=1) + delta[rows[0]]
                known, step = kernel.fragments(ions, int(charge[rows[0]]), da, ppm, most), max(1, _CELLS // len(v))
                for lo in range(0, len(rows), step):
                    some = np.array(rows[lo : lo + step])
                    sizes = np.diff(peaks)[some]
                    at = _ranges(peaks[some], sizes)
                    x, over = known.evidence(mzs[at], powers[at], sizes)
                    x, n, m = x.reshape(-1, 7), len(v), len(some)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(n * m + 1) * 10, pa.int32()), pa.array(np.tile(v.astype(np.int32).ravel(), m)))
                    ids = (column[c].take(pa.array(np.repeat(some, n))) for c in ("molecule_id", "spectrum_id"))
                    ok = np.tile((ions >= 0).all(axis=1), m)
                    yield pa.record_batch([*ids, vec, pa.array(ok), *(pa.array(x[:, k]) for k in range(7)), pa.array(np.repeat(over, n))], names=names)

    shape = "molecule_id string, spectrum_id string, vector array<int>, feasible boolean, " + ", ".join(f"{c} double" for c in _EVIDENCE) + ", exceeded boolean"
    return both.mapInArrow(kernel_rows, shape)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Numbers:
    """The nested arrays of an Arrow batch of groups of alike molecules as flat numpy arrays."""

    def __init__(self, b: pa.RecordBatch):
        cands, molecules = b.column("cands"), b.column("molecules")
        self.cands, self.molecules = cands.offsets.to_numpy().astype(np.int64), molecules.offsets.to_numpy().astype(np.int64)
        self.each, self.of = cands.values, molecules.values
        self.vector, self.mass = self.each.field("vector").flatten().to_numpy().reshape(-1, 10).astype(np.int64), self.each.field("mass").to_numpy(zero_copy_only=False)
        own = self.of.field("own")
        self.spectra = own.offsets.to_numpy().astype(np.int64)
        of = {c: own.values.field(c) for c in ("precursor_mz", "shift", "charge", "delta", "mzs", "powers")}
        self.precursor, self.shift, self.charge = (of[c].to_numpy(zero_copy_only=False) for c in ("precursor_mz", "shift", "charge"))
        self.delta = of["delta"].flatten().to_numpy().reshape(-1, 12).astype(np.int64)
        self.peaks = of["mzs"].offsets.to_numpy().astype(np.int64)
        self.mzs, self.powers = of["mzs"].values.to_numpy(zero_copy_only=False), of["powers"].values.to_numpy(zero_copy_only=False)


def _summaries(x: _Numbers, cands: slice, molecules: slice, config: EngineConfig) -> tuple[np.ndarray, np.ndarray]:
    """(27 x molecules x candidates, exceeded) of molecules with the same candidates: mean, max and min of nine numbers over their spectra."""
    vector, mass = np.concatenate([x.vector[cands], np.zeros((cands.stop - cands.start, 2), np.int64)], axis=1), x.mass[cands]
    # in one order, so that others with the same vectors find them known
    order = np.lexsort(vector.T)
    vector, mass = vector[order], mass[order]
    n, ends = len(mass), x.spectra[molecules.start : molecules.stop + 1]
    counts = np.diff(ends)
    total, most, least = np.zeros((9, len(counts), n)), np.full((9, len(counts), n), -np.inf), np.full((9, len(counts), n), np.inf)
    exceeded = np.zeros(len(counts), bool)
    step = max(1, _CELLS // max(1, n))
    for lo in range(int(ends[0]), int(ends[-1]), step):
        some = np.arange(lo, min(lo + step, int(ends[-1])))
        own, out = np.empty((9, len(some), n)), np.zeros(len(some), bool)
        expected = mass + x.shift[some, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.abs((x.precursor[some, None] - expected) / expected * 1e6)
        np.fmin(error, 1e6, out=own[0])
        kinds, kind = np.unique(np.concatenate([x.charge[some, None], x.delta[some]], axis=1).astype(np.int64), axis=0, return_inverse=True)
        for k in range(len(kinds)):
            here = np.flatnonzero(kind.ravel() == k)
            ions = vector + kinds[k, 1:]
            own[1, here] = (error[here] <= config.precursor_ppm + 1e-6) & (ions >= 0).all(axis=1)
            at = x.peaks[some[here]]
            sizes = x.peaks[some[here] + 1] - at
            peaks = _ranges(at, sizes)
            known = kernel.fragments(ions, int(kinds[k, 0]), config.fragment_da, config.fragment_ppm, config.max_search_results)
            found, out[here] = known.evidence(x.mzs[peaks], x.powers[peaks], sizes)
            own[2:, here] = np.moveaxis(found, 2, 0)
        # the first spectrum of each molecule, then the second of those that have one, and so on
        first, last = np.maximum(ends[:-1], lo) - lo, np.minimum(ends[1:], lo + len(some)) - lo
        for j in range(int((last - first).max())):
            to = np.flatnonzero(last - first > j)
            to = slice(None) if len(to) == len(counts) else to
            now = own[:, first[to] + j]
            total[:, to] += now
            most[:, to], least[:, to] = np.maximum(most[:, to], now), np.minimum(least[:, to], now)
            exceeded[to] |= out[first[to] + j]
    back = np.argsort(order)
    return np.concatenate([total / counts[:, None], most, least]).take(back, axis=2), exceeded


def _grouped(own: DataFrame, lists: DataFrame, spectra: DataFrame, digits: int | None = None) -> DataFrame:
    """A row a group of alike molecules: cands, and molecules (what own has of each, 33 numbers of its spectra, rounded if digits says so, and own, its spectra)."""
    tables.ship(spectra.sparkSession)
    meta = spectra.select(
        "molecule_id",
        F.struct("precursor_mz", "shift", "charge", "delta", F.transform("peaks", lambda p: p["mz"]).alias("mzs"), F.transform("peaks", lambda p: p["intensity"]).alias("powers")).alias("own"),
        F.log1p(F.size("peaks").cast("double")).alias("log_peak_count"),
        (F.col("charge") > 0).cast("double").alias("positive"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ce_mean", "ce_min", "ce_max")),
        F.col("ce_mean").isNull().cast("double").alias("ce_missing"),
        F.log1p(F.coalesce("base_peak_intensity", F.lit(0.0))).alias("log_base_peak"),
        F.col("base_peak_intensity").isNull().cast("double").alias("base_missing"),
        F.coalesce(F.lower("instrument_type").contains("timstof"), F.lit(False)).cast("double").alias("timsTOF"),
        F.coalesce(F.lower("instrument_type").contains("orbitrap"), F.lit(False)).cast("double").alias("orbitrap"),
        (F.coalesce("instrument_type", F.lit("")) == "").cast("double").alias("instrument_missing"),
    )
    aggs = [f(c).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min)) for c in PER_SPECTRUM[9:]]
    each = meta.groupBy("molecule_id").agg(*aggs, F.collect_list("own").alias("own"))
    if digits is not None:
        each = each.withColumns({c: F.round(c, digits) for c in _OF_SPECTRA})
    rows = own.join(each, "molecule_id")
    item = F.struct(*(c for c in rows.columns if c not in ("like", "deal")))
    return _met(rows, own, lists, lambda x: x.groupBy("like", "deal").agg(F.collect_list(item).alias("molecules")))


def _parts(b: pa.RecordBatch, config: EngineConfig):
    """Of each group of a batch, some molecules at a time: the numbers, the candidates, the molecules, and their _summaries."""
    x = _Numbers(b)
    for k in range(b.num_rows):
        cands = slice(int(x.cands[k]), int(x.cands[k + 1]))
        step = max(1, _CELLS // max(1, cands.stop - cands.start))
        for lo in range(int(x.molecules[k]), int(x.molecules[k + 1]), step):
            molecules = slice(lo, min(lo + step, int(x.molecules[k + 1])))
            yield x, cands, molecules, *_summaries(x, cands, molecules, config)


def of_lists(own: DataFrame, lists: DataFrame, spectra: DataFrame, config: EngineConfig) -> DataFrame:
    """A row a molecule: what own has of it, cands, evidence (27 numbers of each of cands, in their order), exceeded, and 33 numbers of its spectra.

    own, lists: as candidates.lists gives them. Only spectra are shuffled: the
    candidates of alike molecules meet them once, and nothing is joined by candidate.
    """
    x = _grouped(own, lists, spectra)
    fields = [f for f in x.schema["molecules"].dataType.elementType if f.name != "own"]

    def run(batches):
        for b in batches:
            for x, cands, at, numbers, over in _parts(b, config):
                m, n = at.stop - at.start, cands.stop - cands.start
                ends, of = pa.array(np.arange(m + 1) * n, pa.int32()), x.of.slice(at.start, m)
                each = x.each.take(pa.array(np.tile(np.arange(cands.start, cands.stop), m)))
                evidence = pa.StructArray.from_arrays([pa.array(c.ravel()) for c in numbers], names=_SUMMED)
                yield pa.record_batch([*(of.field(f.name) for f in fields), *(pa.ListArray.from_arrays(ends, c) for c in (each, evidence)), pa.array(over)], names=[*(f.name for f in fields), "cands", "evidence", "exceeded"])

    shape = T.StructType([*fields, x.schema["cands"], T.StructField("evidence", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in _SUMMED]))), T.StructField("exceeded", T.BooleanType())])
    return x.mapInArrow(run, shape)


def table_of_lists(own: DataFrame, lists: DataFrame, spectra: DataFrame, config: EngineConfig, digits: int) -> DataFrame:
    """(molecule_id, formula, the 74 features rounded): as rows_of(of_lists(...)), for tables in which all features of all candidates are wanted.

    What depends on a molecule or on a list is rounded once for it, and rows come
    from the tasks as columns: nothing is unnested by the row.
    """
    def item(c):
        own = _composition(c["vector"]) | {"mass": c["mass"]}
        rounded = F.struct(*(F.round(own[n], digits).alias(n) for n in FEATURES[:14]))
        return F.struct(*(c[n].alias(n) for n in ("formula", "vector", "mass")), rounded.alias("of"))

    x = _grouped(own.select("molecule_id", "like", "deal"), lists.select("like", F.transform("cands", item).alias("cands")), spectra, digits)

    def run(batches):
        for b in batches:
            for x, cands, at, numbers, _ in _parts(b, config):
                m, n = at.stop - at.start, cands.stop - cands.start
                by_molecule, by_cand = pa.array(np.repeat(np.arange(at.start, at.stop), n)), pa.array(np.tile(np.arange(cands.start, cands.stop), m))
                of = dict(zip(_SUMMED, (pa.array(c.ravel()) for c in kernel.half_up(numbers, digits))))
                of |= {c: x.of.field(c).take(by_molecule) for c in ("molecule_id", *_OF_SPECTRA)}
                own = x.each.field("of")
                of |= {"formula": x.each.field("formula").take(by_cand)} | {c: own.field(c).take(by_cand) for c in FEATURES[:14]}
                yield pa.record_batch([of[c] for c in ("molecule_id", "formula", *FEATURES)], names=["molecule_id", "formula", *FEATURES])

    return x.mapInArrow(run, "molecule_id string, formula string, " + ", ".join(f"`{c}` double" for c in FEATURES))


def _composition(vector: Column) -> dict[str, Column]:
    h_c, hetero = C.ratios(vector)
    return {f"count_{e}": F.element_at(vector, k + 1).cast("double") for k, e in enumerate(ELEMENTS)} | {"dbe": C.dbe(vector), "h_c": h_c, "hetero_c": hetero}


def rows_of(molecules: DataFrame) -> DataFrame:
    """What of_lists gives as a row a candidate, with 74 feature columns and exceeded."""
    rest = [c for c in molecules.columns if c not in ("cands", "evidence")]
    out = molecules.select(*rest, F.inline(F.arrays_zip("cands", "evidence"))).select(*rest, "cands.*", "evidence.*")
    return out.withColumns(_composition(F.col("vector")))


def extract(cands: DataFrame, spectra: DataFrame, config: EngineConfig) -> DataFrame:
    """cands with 74 feature columns and exceeded: whether a fragment search passed its limit."""
    return rows_of(of_lists(*_listed(cands), spectra, config))
