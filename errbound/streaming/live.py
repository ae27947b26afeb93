"""Temporal prediction over a live stream of frames: state is each particle's last reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from errbound.functions.quantizer import DEFAULT_RADIUS, quantize_step

AXES = ["x", "y", "z"]
OUTPUT = "pid bigint, frame bigint, qx int, qy int, qz int, rx double, ry double, rz double"
STATE = "x double, y double, z double"


def live_temporal(stream: DataFrame, eb: float, radius: int = DEFAULT_RADIUS) -> DataFrame:
    """Quantize ``(pid, frame, x, y, z)`` as it arrives against the particle's previous reconstruction.

    Frames of one micro-batch are taken in frame order; the first frame ever is predicted from zero.
    The result equals the closed loop of a batch that spans the whole run.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get if state.exists else (0.0, 0.0, 0.0))
        rows = pd.concat(list(frames)).sort_values("frame")
        values = rows[AXES].to_numpy(np.float64)
        q, recon = np.zeros(values.shape, np.int32), np.zeros(values.shape)
        for i, v in enumerate(values):
            q[i], last = quantize_step(v, last, eb, radius)
            recon[i] = last
        state.update(tuple(float(v) for v in last))
        out = pd.DataFrame({"pid": key[0], "frame": rows["frame"].to_numpy()})
        for k, a in enumerate(AXES):
            out[f"q{a}"], out[f"r{a}"] = q[:, k], recon[:, k]
        yield out[["pid", "frame", "qx", "qy", "qz", "rx", "ry", "rz"]]

    return stream.groupBy("pid").applyInPandasWithState(
        step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
