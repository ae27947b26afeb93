"""Run configuration: error-bound modes, algorithms, dimension helpers and INI loading."""

from __future__ import annotations

import configparser
import math
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T


class ErrorBoundMode(str, Enum):
    ABS = "ABS"
    REL = "REL"
    PSNR = "PSNR"
    NORM = "NORM"
    ABS_AND_REL = "ABS_AND_REL"
    ABS_OR_REL = "ABS_OR_REL"


class Algorithm(str, Enum):
    LORENZO_REG = "ALGO_LORENZO_REG"
    INTERP_LORENZO = "ALGO_INTERP_LORENZO"
    INTERP = "ALGO_INTERP"
    TRUNCATE = "ALGO_TRUNCATE"
    LOSSLESS = "ALGO_LOSSLESS"


class Interpolator(str, Enum):
    LINEAR = "INTERP_ALGO_LINEAR"
    CUBIC = "INTERP_ALGO_CUBIC"


# Mode numbers of the library interface and of the C interface differ.
LIBRARY_MODE_NUMBERS = {
    0: ErrorBoundMode.ABS, 1: ErrorBoundMode.REL, 2: ErrorBoundMode.PSNR,
    3: ErrorBoundMode.NORM, 4: ErrorBoundMode.ABS_AND_REL, 5: ErrorBoundMode.ABS_OR_REL,
}
C_MODE_NUMBERS = {
    0: ErrorBoundMode.ABS, 1: ErrorBoundMode.REL, 2: ErrorBoundMode.ABS_AND_REL,
    3: ErrorBoundMode.ABS_OR_REL, 4: ErrorBoundMode.PSNR, 5: ErrorBoundMode.NORM,
}

# Default block edge by rank (1-D, 2-D, 3-D and above).
DEFAULT_BLOCK_SIZE = {1: 128, 2: 16, 3: 6, 4: 6}

# Element types and their Spark column types; unsigned types widen.
ELEMENT_TYPES = {
    "float32": T.FloatType(), "float64": T.DoubleType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
}


def squeeze_dims(dims: list[int]) -> list[int]:
    """Drop dimensions of extent one; an all-ones array keeps one."""
    kept = [d for d in dims if d != 1]
    return kept or [1]


def fold_dims(dims: list[int]) -> list[int]:
    """Fold the two slowest dimensions together until the rank is at most four."""
    dims = list(dims)
    while len(dims) > 4:
        dims[:2] = [dims[0] * dims[1]]
    return dims


def data_length(dims: list[int]) -> int:
    return math.prod(dims)


def strides(dims: list[int]) -> list[int]:
    """Row-major strides, last dimension fastest."""
    return [math.prod(dims[i + 1:]) for i in range(len(dims))]


@dataclass(frozen=True)
class Config:
    dims: tuple[int, ...] = (1,)
    algorithm: Algorithm = Algorithm.INTERP_LORENZO
    mode: ErrorBoundMode = ErrorBoundMode.ABS
    abs_bound: float = 1e-3
    rel_bound: float = math.inf
    psnr_bound: float = 0.0
    l2norm_bound: float = 0.0
    lorenzo: bool = True
    lorenzo2: bool = False
    regression: bool = True
    regression2: bool = False
    parallel: bool = False
    lossless: str = "zstd"
    encoder: str = "huffman"
    interpolator: Interpolator = Interpolator.CUBIC
    interp_direction: int = 0
    interp_block_size: int = 32
    quant_bins: int = 65536
    block_size: int = 0
    pred_dim: int = 0
    element_type: str = "float64"
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        dims = tuple(fold_dims(squeeze_dims(list(self.dims))))
        if not all(d >= 1 for d in dims):
            raise ValueError(f"dimensions must be positive: {self.dims}")
        object.__setattr__(self, "dims", dims)
        if not self.block_size:
            object.__setattr__(self, "block_size", DEFAULT_BLOCK_SIZE[len(dims)])
        if not self.pred_dim:
            object.__setattr__(self, "pred_dim", len(dims))

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def num(self) -> int:
        return data_length(list(self.dims))

    @property
    def radius(self) -> int:
        return self.quant_bins // 2

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    def to_row(self) -> dict:
        row = asdict(self)
        row["extra"] = {k: int(v) for k, v in self.extra.items()}
        return {k: (v.value if isinstance(v, Enum) else list(v) if isinstance(v, tuple) else v)
                for k, v in row.items()}

    @staticmethod
    def from_row(row: dict) -> "Config":
        row = dict(row)
        row["dims"] = tuple(row["dims"])
        row["algorithm"] = Algorithm(row["algorithm"])
        row["mode"] = ErrorBoundMode(row["mode"])
        row["interpolator"] = Interpolator(row["interpolator"])
        row["extra"] = dict(row.get("extra") or {})
        return Config(**row)

    @staticmethod
    def from_ini(path: str, dims: tuple[int, ...]) -> "Config":
        ini = configparser.ConfigParser(inline_comment_prefixes=(";",))
        if not ini.read(path):
            raise FileNotFoundError(path)
        top = ini["GlobalSettings"] if ini.has_section("GlobalSettings") else {}
        algo = ini["AlgoSettings"] if ini.has_section("AlgoSettings") else {}

        def flag(section, key, default):
            value = section.get(key)
            return default if value is None else value.strip().lower() in ("yes", "true", "on", "1")

        base = Config(dims=dims)
        return Config(
            dims=dims,
            algorithm=Algorithm(top.get("CmprAlgo", base.algorithm.value)),
            mode=ErrorBoundMode(top.get("ErrorBoundMode", base.mode.value)),
            abs_bound=float(top.get("AbsErrorBound", base.abs_bound)),
            rel_bound=float(top.get("RelErrorBound", base.rel_bound)),
            psnr_bound=float(top.get("PSNRErrorBound", base.psnr_bound)),
            l2norm_bound=float(top.get("L2NormErrorBound", base.l2norm_bound)),
            parallel=flag(top, "OpenMP", base.parallel),
            lorenzo=flag(algo, "Lorenzo", base.lorenzo),
            lorenzo2=flag(algo, "Lorenzo2ndOrder", base.lorenzo2),
            regression=flag(algo, "Regression", base.regression),
            regression2=flag(algo, "Regression2ndOrder", base.regression2),
            interpolator=Interpolator(algo.get("InterpolationAlgo", base.interpolator.value)),
            interp_direction=int(algo.get("InterpolationDirection", base.interp_direction)),
            interp_block_size=int(algo.get("InterpolationBlockSize", base.interp_block_size)),
            block_size=int(algo.get("BlockSize", 0)),
            quant_bins=int(algo.get("QuantizationBinTotal", base.quant_bins)),
        )


CONFIG_SCHEMA = T.StructType([
    T.StructField("dims", T.ArrayType(T.IntegerType())),
    T.StructField("algorithm", T.StringType()), T.StructField("mode", T.StringType()),
    T.StructField("abs_bound", T.DoubleType()), T.StructField("rel_bound", T.DoubleType()),
    T.StructField("psnr_bound", T.DoubleType()), T.StructField("l2norm_bound", T.DoubleType()),
    T.StructField("lorenzo", T.BooleanType()), T.StructField("lorenzo2", T.BooleanType()),
    T.StructField("regression", T.BooleanType()), T.StructField("regression2", T.BooleanType()),
    T.StructField("parallel", T.BooleanType()), T.StructField("lossless", T.StringType()),
    T.StructField("encoder", T.StringType()), T.StructField("interpolator", T.StringType()),
    T.StructField("interp_direction", T.IntegerType()),
    T.StructField("interp_block_size", T.IntegerType()),
    T.StructField("quant_bins", T.IntegerType()), T.StructField("block_size", T.IntegerType()),
    T.StructField("pred_dim", T.IntegerType()), T.StructField("element_type", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.LongType())),
])
