import pytest

from errbound.config import (C_MODE_NUMBERS, LIBRARY_MODE_NUMBERS, Algorithm, Config, ErrorBoundMode, Interpolator,
                             fold_dims, squeeze_dims)


def test_dims():
    assert squeeze_dims([1, 5, 1, 7]) == [5, 7]
    assert squeeze_dims([1, 1]) == [1]
    assert fold_dims([2, 3, 4, 5, 6]) == [6, 4, 5, 6]
    assert Config(dims=(2, 3, 4, 5, 6)).dims == (6, 4, 5, 6)
    assert Config(dims=(100,)).block_size == 128
    assert Config(dims=(10, 10)).block_size == 16
    assert Config(dims=(4, 4, 4)).block_size == 6
    with pytest.raises(ValueError):
        Config(dims=(0, 3))


def test_mode_numbers_differ():
    assert LIBRARY_MODE_NUMBERS[2] is ErrorBoundMode.PSNR and C_MODE_NUMBERS[4] is ErrorBoundMode.PSNR


def test_row_round_trip():
    conf = Config(dims=(4, 5, 6), algorithm=Algorithm.INTERP, mode=ErrorBoundMode.REL, rel_bound=1e-3)
    assert Config.from_row(conf.to_row()) == conf


def test_ini(tmp_path):
    path = tmp_path / "run.ini"
    path.write_text("[GlobalSettings]\nCmprAlgo = ALGO_INTERP\nErrorBoundMode = ABS_AND_REL\nAbsErrorBound = 0.5\n"
                    "RelErrorBound = 1e-2\nOpenMP = YES\n[AlgoSettings]\nInterpolationAlgo = INTERP_ALGO_LINEAR\n"
                    "Lorenzo2ndOrder = Yes\nRegression = No\nBlockSize = 8\nQuantizationBinTotal = 1024\n")
    conf = Config.from_ini(str(path), (10, 20))
    assert conf.algorithm is Algorithm.INTERP and conf.mode is ErrorBoundMode.ABS_AND_REL
    assert conf.interpolator is Interpolator.LINEAR and conf.lorenzo2 and not conf.regression and conf.parallel
    assert (conf.abs_bound, conf.rel_bound, conf.block_size, conf.radius) == (0.5, 1e-2, 8, 512)


def test_extra_parameters_are_stored():
    conf = Config(dims=(4,), extra={"keep_bytes": 3})
    assert Config.from_row(conf.to_row()).extra == {"keep_bytes": 3}
