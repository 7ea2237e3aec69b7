"""Command line: ionflow [formula] {audit,prepare,train,evaluate,predict}."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from ionflow.config import EngineConfig
from ionflow.operators import evaluate as ev, quality
from ionflow.sources import files

ACTIONS = ("audit", "prepare", "train", "evaluate", "predict")
#: What a configuration file may have beside the engine's settings.
PATHS = ("input", "output", "model")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ionflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ACTIONS:
        s = sub.add_parser(name)
        s.add_argument("path", nargs="?", help="the input; --input says the same")
        s.add_argument("--input")
        s.add_argument("--output")
        s.add_argument("--config", help="JSON: the engine's settings, flat or under formula, and input, output and model")
        if name in ("predict", "evaluate"):
            s.add_argument("--model")
        if name == "predict":
            s.add_argument("--top-k", type=int, default=25)
            s.add_argument("--workers", type=int, default=1)
        if name == "prepare":
            s.add_argument("--buckets", type=int, default=32)
        if name == "evaluate":
            s.add_argument("--split", choices=["train", "validation", "test"], default="test")
            s.add_argument("--max-molecules", type=int)
        if name == "train":
            s.add_argument("--max-molecules", "--train-molecules", dest="train_molecules", type=int, default=3000)
            s.add_argument("--max-validation-molecules", "--validation-molecules", dest="validation_molecules", type=int, default=500)
            s.add_argument("--n-estimators", "--rounds", dest="rounds", type=int, default=1000)
    return p


def settings(path: str | None) -> tuple[dict, EngineConfig | None]:
    """Paths of a configuration file, and the engine's settings if it has some; a name that is neither is an error."""
    if path is None:
        return {}, None
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    own = {f.name for f in dataclasses.fields(EngineConfig)}
    if unknown := set(data) - own - {"formula", *PATHS}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    paths = {k: data[k] for k in PATHS if k in data}
    flat = {k: v for k, v in data.items() if k in own}
    if "formula" in data:
        return paths, EngineConfig.from_dict(data)
    return paths, EngineConfig.from_dict(flat) if flat else None


def run(argv: list[str] | None = None) -> int:
    """0, or 2 and a line on stderr where something is wrong."""
    argv = list(sys.argv[1:] if argv is None else argv)
    args = _parser().parse_args(argv[1:] if argv[:1] == ["formula"] else argv)
    try:
        paths, config = settings(args.config)
        # the command line wins over the file
        source = args.input or args.path or paths.get("input")
        output = args.output or paths.get("output")
        model = getattr(args, "model", None) or paths.get("model")
        if not source:
            raise ValueError("an input is required: --input, or input in the configuration")
        if output is None and args.command != "audit":
            raise ValueError("an output is required: --output, or output in the configuration")
        if output:
            files.require_other(source, output)
        for name in ("top_k", "workers", "buckets", "max_molecules", "train_molecules", "validation_molecules", "rounds"):
            value = getattr(args, name, None)
            if value is not None and value < 1:
                raise ValueError(f"{name} must be a positive integer")
        print(json.dumps(_act(args, source, output, model, config), ensure_ascii=False, default=str))
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _act(args, source: str, output: str | None, model: str | None, config: EngineConfig | None) -> dict:
    from pyspark.sql import SparkSession

    from ionflow.adapter import FormulaAdapter
    from ionflow.engine import FormulaEngine, model_directory

    spark = SparkSession.builder.appName("ionflow").getOrCreate()
    if args.command == "audit":
        report = quality.audit(files.with_row_index(spark, source).drop("row_ord"))
    elif args.command == "prepare":
        return quality.prepare(spark, source, output, config or EngineConfig(), args.buckets)
    elif args.command == "train":
        return ev.train(spark, source, output, args.train_molecules, args.validation_molecules, args.rounds)
    elif args.command == "evaluate":
        engine = FormulaEngine.load(spark, model_directory(model), config) if model else FormulaEngine(spark, config or EngineConfig.load(f"{source}/config.json"))
        report = ev.evaluate(engine, source, args.split, args.max_molecules)
    else:
        adapter = FormulaAdapter(top_k=args.top_k, workers=args.workers, spark=spark)
        adapter.engine = FormulaEngine.load(spark, model_directory(model), config) if model else FormulaEngine(spark, config)
        n = files.write_jsonl(adapter.predict_table(files.read_spectra(spark, source)).orderBy("molecule_id"), output)
        return {"molecules": n, "output": output}
    if output:
        files.write_json(output, report)
    return report


if __name__ == "__main__":
    sys.exit(run())
