"""Command line: python -m ohmgraph -i graph.mtx -o out.mtx -e 0.5"""

from __future__ import annotations

import argparse
import os
import tomllib

from pyspark.sql import SparkSession

from .operators import graph as G
from .params import command_line_defaults
from .plans import experiments as X
from .plans.sparsify import Timer, sparsify_dataset
from .plans.stages import write_stages
from .sources import matrix_market as MM
from .sources.text import edge_list_to_matrix_market

EXPERIMENTS = ("basic", "jl_scaling", "jl_dim", "space", "space_simple")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ohmgraph", description="Spectral sparsification of weighted graphs")
    p.add_argument("-i", "--input", action="append", default=[], help="Matrix Market graph; may be repeated")
    p.add_argument("-o", "--output", default="", help="where the sparse Laplacian is written; a folder for several inputs")
    p.add_argument("-e", "--epsilon", type=float, default=0.5)
    p.add_argument("--sketch", choices=("uniform", "discrete", "gaussian"), default="discrete")
    p.add_argument("--sketch-seed", type=int, default=0)
    p.add_argument("--sampling-seed", type=int, default=0)
    p.add_argument("--jl-factor", type=float, default=4.0)
    p.add_argument("--reweight", choices=("sqrt", "inverse"), default="sqrt")
    p.add_argument("-b", "--benchmark", action="store_true", help="time the stages")
    p.add_argument("-t", "--test", action="store_true", help="check components and probes")
    p.add_argument("-r", "--run-experiment", choices=EXPERIMENTS)
    p.add_argument("--convert-edge-list", action="store_true", help="turn an edge list into Matrix Market")
    p.add_argument("--stages", default="", help="folder for the files of all stages, one folder in it for each input")
    p.add_argument("--config", help="TOML file with defaults, by the long names of these options")
    return p


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    """Options given on the command line, over those of the configuration file, over the defaults."""
    p = parser()
    first = p.parse_args(argv)
    if first.config:
        with open(first.config, "rb") as f:
            found = {k.replace("-", "_"): v for k, v in tomllib.load(f).items()}
        unknown = set(found) - set(vars(first))
        if unknown:
            p.error(f"{first.config} has unknown options: {', '.join(sorted(unknown))}")
        p.set_defaults(**found)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(argv)
    spark = spark or SparkSession.builder.appName("ohmgraph").getOrCreate()
    p = command_line_defaults(epsilon=a.epsilon, sketch=a.sketch, sketch_seed=a.sketch_seed, sampling_seed=a.sampling_seed, jl_factor=a.jl_factor, reweight=a.reweight)
    for path in a.input:
        name = os.path.basename(path.rstrip("/")).partition(".")[0]
        target = f"{a.output.rstrip('/')}/{name}.mtx" if a.output and len(a.input) > 1 else a.output
        if a.convert_edge_list:
            edge_list_to_matrix_market(spark, path, target)
            continue
        if a.run_experiment:
            matrix, n, _ = MM.read_matrix(spark, path)
            edges = G.upper_triangle(matrix)
            grid = {"basic": X.basic_grid, "jl_scaling": lambda: X.jl_scaling_grid(n), "jl_dim": lambda: X.jl_dim_grid(n), "space": X.space_grid}.get(a.run_experiment)
            if grid is None:
                X.space_use_simple(edges, n).show()
            else:
                X.run_grid(spark, name, edges, n, grid(), results=f"{target}/{a.run_experiment}" if target else None).show(truncate=False)
            continue
        if a.stages:
            matrix, n, _ = MM.read_matrix(spark, path)
            write_stages(G.upper_triangle(matrix), n, p, f"{a.stages.rstrip('/')}/{name}")
        timer = Timer(active=a.benchmark)
        out = sparsify_dataset(spark, path, output=target or None, params=p, timer=timer)
        s = out.stats.first()
        print(f"{name}: {s['original_num_edges']} edges, {s['final_num_edges']} kept, {100 * s['sparsification_rate']:.2f} %")
        if a.benchmark:
            print(", ".join(f"{k} {v:.2f} s" for k, v in timer.seconds.items()))
        if a.test:
            matrix, n, _ = MM.read_matrix(spark, path)
            row, _ = X.run_point(name, G.upper_triangle(matrix), n, p)
            print(row)
    return 0
