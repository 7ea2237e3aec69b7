"""The jobs as queries: each runs twice into one new folder and returns the output as it then stands; their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ionflow.constants import ELEMENTS, MASS
from ionflow.plans import catalog
from ionflow.sources.tables import shared_folder
from jobs import formula_mentions, prepare_library


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/jobs/{name}-{uuid.uuid4().hex[:12]}"


def job1_formula_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "formula_mentions")
    for _ in range(2):
        out = formula_mentions.run(spark, f"{sf_dir}/documents.parquet", f"{base}/output", f"{base}/checkpoint")
    return out


def job2_prepare_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "prepare_library")
    for _ in range(2):
        out = prepare_library.run(spark, sf_dir, f"{base}/output")
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_formula_mentions": job1_formula_mentions, "job2_prepare_library": job2_prepare_library}


def _count(element: str) -> str:
    """Atoms of an element in a token: each time its symbol's count, or 1."""
    return f"list_sum(list_transform(regexp_extract_all(token, '{element}([0-9]*)', 1), lambda n: CASE WHEN n = '' THEN 1 ELSE n::BIGINT END))"


def _formula(order: tuple[str, ...]) -> str:
    return " || ".join(f"CASE n_{e} WHEN 0 THEN '' WHEN 1 THEN '{e}' ELSE '{e}' || n_{e} END" for e in order)


#: Two-letter symbols become one letter first, so that no symbol is the beginning of another.
_SIGN = {"Cl": "X", "Br": "Y"}
_FORMULA_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents),
m AS (SELECT doc_id, replace(replace(word, 'Cl', 'X'), 'Br', 'Y') AS token FROM t WHERE regexp_full_match(word, '(?:(?:Br|Cl|[CHNOPSFI])(?:[1-9][0-9]{{0,4}})?)+')),
a AS (SELECT doc_id, {", ".join(f"coalesce({_count(_SIGN.get(e, e))}, 0)::BIGINT AS n_{e}" for e in ELEMENTS)} FROM m),
k AS (SELECT *, {" + ".join(f"(n_{e} > 0)::INTEGER" for e in ELEMENTS)} AS kinds, {" + ".join(f"n_{e} * {MASS[e]!r}::DOUBLE" for e in ELEMENTS)} AS mass,
  CASE WHEN n_C > 0 THEN {_formula(("C", "H", "Br", "Cl", "F", "I", "N", "O", "P", "S"))} ELSE {_formula(("Br", "C", "Cl", "F", "H", "I", "N", "O", "P", "S"))} END AS formula,
  1 + n_C + (n_N + n_P - n_H - n_F - n_Cl - n_Br - n_I) / 2.0::DOUBLE AS dbe FROM a)
SELECT formula, min(mass) AS mass, min(dbe) AS dbe, count(DISTINCT doc_id) AS documents, count(*) AS mentions, min(doc_id) AS first_doc_id,
  CASE WHEN min(mass) < 300 THEN '<300' WHEN min(mass) < 600 THEN '300-600' ELSE '>=600' END AS mass_bin
FROM k WHERE kinds >= 2 GROUP BY formula
"""

_LIBRARY_SQL = catalog.JUDGED + """, n AS (SELECT row_ord, count(*) AS peaks FROM peak GROUP BY row_ord)
SELECT j.row_ord, source, CASE WHEN f <> 4 THEN molecular_formula END AS formula, coalesce(n.peaks, 0)::INTEGER AS peaks,
  CASE WHEN reason IS NULL THEN CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END END AS split,
  CASE WHEN reason IS NULL THEN (('0x' || substr(sha256(inchikey14), 1, 8))::BIGINT % 32)::INTEGER END AS bucket, reason
FROM j LEFT JOIN n USING (row_ord)
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_formula_mentions": _FORMULA_SQL, "job2_prepare_library": _LIBRARY_SQL}
