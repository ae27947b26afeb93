"""Command line: ``python -m errbound array|particles|md ...`` on raw binary files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errbound import api
from errbound.config import Algorithm, Config, ErrorBoundMode, strides
from errbound.plans import md_codec
from errbound.sources import container, raw


def cells_of(flat: DataFrame, dims: list[int]) -> DataFrame:
    return flat.select(*[(F.floor(F.col("idx") / s) % d).alias(f"i{a}")
                         for a, (s, d) in enumerate(zip(strides(dims), dims))], "v")


def flat_of(cells: DataFrame, dims: list[int]) -> DataFrame:
    idx = sum((F.col(f"i{a}") * s for a, s in enumerate(strides(dims))), F.lit(0))
    return cells.select(idx.cast("bigint").alias("idx"), "v")


def run_array(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compress ``-i`` to ``-z``, decompress ``-z`` to ``-o``, report with ``-a``."""
    if a.input and a.packed:
        dims = a.dims
        base = Config.from_ini(a.config, tuple(dims)) if a.config else Config(dims=tuple(dims), algorithm=Algorithm(a.algorithm))
        conf = base if a.config else base.with_(
            mode=ErrorBoundMode(a.mode), abs_bound=base.abs_bound if a.abs is None else a.abs, rel_bound=base.rel_bound if a.rel is None else a.rel,
            psnr_bound=a.psnr or 0.0, l2norm_bound=a.norm or 0.0, element_type=a.type)
        cells = cells_of(raw.read_raw(spark, a.input, conf.element_type), dims)
        container.write_container(api.compress(cells, dims, conf), a.packed, conf.with_(dims=tuple(dims)))
    if a.packed and (a.output or a.analyse):
        table, conf = container.read_container(spark, a.packed)
        dims = a.dims or list(conf.dims)
        back = api.decompress(table, conf, len(dims))
        if a.output:
            raw.write_raw(flat_of(back, dims), a.output, conf.element_type)
        if a.analyse:
            original = cells_of(raw.read_raw(spark, a.input, conf.element_type), dims)
            api.verify(original, back, len(dims)).show(truncate=False, vertical=True)


def write_axes(rows: DataFrame, paths: list[str], dtype: str) -> None:
    """``idx`` and one column per axis to one raw file each."""
    for axis, path in zip("xyz", paths):
        raw.write_raw(rows.select("idx", F.col(axis).alias("v")), path, dtype)


def run_particles(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compress three files ``-i`` to ``-z``, decompress ``-z`` to three files ``-o`` (or the inputs' names with ``.out``), report with ``-a``.

    With frames and a batch size prediction runs along time.  Output files are in input order if ``-O`` kept it.
    """
    def rows() -> DataFrame:
        axes = raw.read_raw_columns(spark, dict(zip("xyz", a.input)), a.type)
        placed = axes.select(F.floor(F.col("idx") / a.shape[1]).alias("frame"), (F.col("idx") % a.shape[1]).alias("pid"), "x", "y", "z")
        return placed.select("frame", "pid", *[F.col(c).cast("double").alias(c) for c in "xyz"])

    if a.input and a.bound:
        if not a.shape:
            raise ValueError("-s frames particles is needed to compress")
        api.compress_particles(rows(), a.packed, a.bound, tuple(a.shape), a.batch, a.edge, a.order or 0)
    outputs = a.output or ([f"{path}.out" for path in a.input] if a.same_name and a.input else None)
    if not outputs and not a.analyse:
        return
    facts, _, order = container.read_particles(spark, a.packed)
    back = api.decompress_particles(spark, a.packed)
    if outputs:
        write_axes(back.select((F.col("frame") * facts["particles"] + F.col("place")).alias("idx"), "x", "y", "z"), outputs, a.type)
    if a.analyse:
        if order is None or not a.input:
            raise ValueError("a report needs the input files and a container with its permutation (-O)")
        a.shape = a.shape or [facts["frames"], facts["particles"]]
        api.verify_particles(rows(), back).show(truncate=False, vertical=True)


def run_md(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compress one file, or one per axis, ``-i`` to ``-z``, decompress ``-z`` to as many files ``-o``, report with ``-a``."""
    def rows(atoms: int) -> DataFrame:
        names = "xyz"[:len(a.input)]
        flat = raw.read_raw_columns(spark, dict(zip(names, a.input)), a.type)
        axes = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).cast("double").alias("v")) for n in names]))
        placed = flat.select(F.floor(F.col("idx") / atoms).alias("frame"), (F.col("idx") % atoms).alias("slot"), axes.alias("e"))
        return placed.select("e.axis", "frame", "slot", "e.v")

    if a.input and (a.abs or a.rel):
        if not a.shape:
            raise ValueError("-s frames atoms is needed to compress")
        mode = ErrorBoundMode.REL if a.rel else ErrorBoundMode.ABS
        conf = Config(dims=tuple(a.shape), mode=mode, abs_bound=a.abs or 0.0, rel_bound=a.rel or 0.0, quant_bins=a.bins)
        api.compress_md(rows(a.shape[1]), a.packed, conf, a.batch, a.method)
    if not a.output and not a.analyse:
        return
    atoms = list(container.read_container(spark, a.packed)[1].dims)[1]
    back = api.decompress_md(spark, a.packed)
    for axis, path in zip("xyz", a.output or []):
        raw.write_raw(back.where(F.col("axis") == axis).select((F.col("frame") * atoms + F.col("slot")).alias("idx"), "v"), path, a.type)
    if a.analyse:
        if not a.input:
            raise ValueError("a report needs the input files")
        api.verify_md(rows(atoms), back).show(truncate=False, vertical=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="errbound")
    sub = top.add_subparsers(required=True)
    arr = sub.add_parser("array")
    arr.add_argument("-i", dest="input")
    arr.add_argument("-z", dest="packed")
    arr.add_argument("-o", dest="output")
    arr.add_argument("-d", dest="dims", type=int, nargs="+")
    arr.add_argument("-c", dest="config")
    arr.add_argument("-t", dest="type", default="float32")
    arr.add_argument("-m", dest="algorithm", default=Algorithm.INTERP_LORENZO.value)
    arr.add_argument("-M", dest="mode", default="ABS")
    arr.add_argument("-A", dest="abs", type=float)
    arr.add_argument("-R", dest="rel", type=float)
    arr.add_argument("-S", dest="psnr", type=float)
    arr.add_argument("-N", dest="norm", type=float)
    arr.add_argument("-a", dest="analyse", action="store_true")
    arr.set_defaults(run=run_array)
    par = sub.add_parser("particles")
    par.add_argument("-i", dest="input", nargs=3)
    par.add_argument("-z", dest="packed", required=True)
    par.add_argument("-o", dest="output", nargs=3)
    par.add_argument("-osn", dest="same_name", action="store_true")
    par.add_argument("-s", dest="shape", type=int, nargs=2, metavar=("FRAMES", "PARTICLES"))
    par.add_argument("-e", dest="bound", type=float)
    par.add_argument("-b", dest="batch", type=int, default=0)
    par.add_argument("-E", dest="edge", type=int)
    par.add_argument("-t", dest="type", default="float32")
    par.add_argument("-a", dest="analyse", action="store_true")
    par.add_argument("-O", dest="order", type=int, choices=(32, 64))
    par.set_defaults(run=run_particles)
    mol = sub.add_parser("md")
    mol.add_argument("-i", dest="input", nargs="+")
    mol.add_argument("-z", dest="packed", required=True)
    mol.add_argument("-o", dest="output", nargs="+")
    mol.add_argument("-s", dest="shape", type=int, nargs=2, metavar=("FRAMES", "ATOMS"))
    mol.add_argument("-t", dest="type", default="float32")
    mol.add_argument("-a", dest="analyse", action="store_true")
    mol.add_argument("-A", dest="abs", type=float)
    mol.add_argument("-R", dest="rel", type=float)
    mol.add_argument("-b", dest="batch", type=int, default=10)
    mol.add_argument("-m", dest="method", type=int, default=md_codec.ADAPTIVE)
    mol.add_argument("-q", dest="bins", type=int, default=1024)
    mol.set_defaults(run=run_md)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("errbound").getOrCreate(), args)


if __name__ == "__main__":
    main()
