"""python -m orrery: list names, show plans, cells and reports, run a query or a whole pipeline, validate features."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from orrery.functions.vectors import FUSIONS
from orrery.operators import reports
from orrery.operators.recommenders import MODELS, ONLINE
from orrery.plans import catalog, experiment, pipeline
from orrery.sources.providers import REGISTRY, source


def main(argv: list[str] | None = None) -> int:
    """Exit code of the command."""
    parser = argparse.ArgumentParser(prog="orrery", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of a kind").add_argument("kind", choices=["queries", "recommenders", "fusions", "sources", "steps"])
    plan = sub.add_parser("plan", help="the steps of a run")
    cells = sub.add_parser("cells", help="the cells of a run over the feature tables of its folder")
    pending = sub.add_parser("pending", help="open cells per step, data set and model, and their projected cost")
    whole = sub.add_parser("pipeline", help="run the plan over folders with interactions.csv or interactions.parquet")
    for p in (plan, cells, pending, whole):
        p.add_argument("--config", help="folder of JSON files")
        p.add_argument("--set", nargs="*", default=[], metavar="KEY=JSON", help="settings laid over the files, such as common.epochs=5")
        p.add_argument("--condition", choices=["frozen", "finetuned", "both"])
        p.add_argument("--seeds", type=int, nargs="*")
    for p in (plan, whole):
        p.add_argument("--only", nargs="*")
        p.add_argument("--start")
        p.add_argument("--stop")
    for p in (cells, pending, whole):
        p.add_argument("folder", help="folder of the run")
    whole.add_argument("sources", nargs="+", metavar="NAME=KIND:FOLDER", help="data sets, such as shop=csv:/data/shop")
    sub.add_parser("report", help="the report of a finished run").add_argument("folder")
    run = sub.add_parser("run", help="run one query and show or write its rows")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out")
    check = sub.add_parser("validate", help="gate of the feature tables; exit 1 if one fails")
    check.add_argument("folder")
    a = parser.parse_args(argv)
    if a.command == "list":
        kinds = {"queries": catalog.queries(), "recommenders": sorted(MODELS, key=lambda m: MODELS[m].priority), "fusions": [*FUSIONS, *(f"{f} (learned)" for f in ONLINE), "pca", "pca_per_model"], "sources": REGISTRY, "steps": experiment.STEPS}
        print("\n".join(kinds[a.kind]))
        return 0
    if a.command == "report":
        print(Path(f"{a.folder}/report.md").read_text())
        return 0
    if a.command in ("plan", "cells", "pending", "pipeline"):
        config = experiment.load_config(a.config, **experiment.overrides(a.set), **{k: v for k, v in (("condition", a.condition), ("seeds", a.seeds)) if v})
    if a.command == "plan":
        print("\n".join(" ".join(filter(None, s)) for s in experiment.step_plan(config, a.only, a.start, a.stop)))
        return 0
    from orrery.session import local_session

    spark = local_session()
    if a.command in ("cells", "pending", "pipeline"):
        sources = {}
        for entry in getattr(a, "sources", []):
            name, _, where = entry.partition("=")
            kind, _, path = where.partition(":")
            sources[name] = source(kind, path=path) if path else source(kind)
        config["datasets"] = list(sources) or config["datasets"]
        p = pipeline.Pipeline(spark, a.folder, config, sources)
        if a.command == "pipeline":
            print(json.dumps(p.run(only=a.only, start=a.start, stop=a.stop).document["slowest"]))
        elif a.command == "cells":
            print("\n".join(r["cell_key"] for r in p.cells().select("cell_key").orderBy("cell_key").collect()))
        else:
            states = p.status()
            states.where("state <> 'done'").groupBy("step", "dataset", "model", "state").count().orderBy("step", "dataset", "model").show(1000, truncate=False)
            reports.remaining_cost(states).show()
        return 0
    if a.command == "validate":
        rows = catalog.queries()["feature_norm_gate"](spark, a.folder).collect()
        for r in rows:
            print(r.asDict())
        return int(any(r[c] for r in rows for c in ("n_null", "n_bad_dim", "n_not_finite", "n_zero")))
    df = catalog.queries()[a.query](spark, a.folder)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
