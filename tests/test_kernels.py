import numpy as np
import pytest

from wavelake.functions import distributions as D
from wavelake.functions import kernels as K

FS = 250


def response(sos, f):
    z = np.exp(-2j * np.pi * f / FS)
    return np.prod([(r[0] + r[1] * z + r[2] * z * z) / (r[3] + r[4] * z + r[5] * z * z) for r in sos])


def test_butterworth_and_notch_response():
    band = K.butter_sos(4, 1, 45, FS)
    assert [abs(response(band, f)) for f in (1, 10, 45)] == pytest.approx([2**-0.5, 1, 2**-0.5], abs=1e-3)
    assert abs(response(band, 0.1)) < 1e-3 and abs(response(band, 100)) < 1e-2
    assert abs(response(K.butter_sos(4, None, 40, FS), 40)) == pytest.approx(2**-0.5, abs=1e-6)
    assert abs(response(K.butter_sos(4, 5, None, FS), 5)) == pytest.approx(2**-0.5, abs=1e-6)
    notch = K.notch_sos(50, FS)
    assert abs(response(notch, 50)) < 1e-9 and abs(response(notch, 40)) > 0.99


def test_blocks_equal_the_direct_recurrence():
    x = np.random.default_rng(0).standard_normal(777)
    for row in K.butter_sos(4, 1, 45, FS):
        s1 = s2 = 0.0
        want = []
        for u in x:
            y = row[0] * u + s1
            s1, s2 = row[1] * u - row[4] * y + s2, row[2] * u - row[5] * y
            want.append(y)
        x2 = K._run_section(row[:3], row[3:], x, np.zeros(2))
        assert np.allclose(x2, want, atol=1e-10)
        x = x2


def test_zero_phase():
    t = np.arange(4000) / FS
    x = np.sin(2 * np.pi * 10 * t)
    sos = K.butter_sos(4, 1, 45, FS)
    assert np.abs(K.filter_zero_phase(sos, x) - abs(response(sos, 10)) ** 2 * x)[1000:-1000].max() < 1e-3
    with pytest.raises(ValueError):
        K.filter_zero_phase(sos, x[:20])
    assert K.band_limits(250, 250, 20) == (112.5, 20)
    with pytest.raises(ValueError):
        K.clean_channel(x, FS, 250, 20, None, strict=True)


def test_density_parseval_and_tone():
    t = np.arange(1024) / FS
    x = 3 * np.sin(2 * np.pi * 20 * t)
    f, p = K.welch(x, FS, 256)
    assert f[np.argmax(p)] == pytest.approx(20, abs=1) and p.sum() * (f[1] - f[0]) == pytest.approx(4.5, rel=0.02)


def test_analytic_wavelet_resampling():
    t = np.arange(1000) / FS
    assert np.abs(np.abs(K.analytic(np.cos(2 * np.pi * 10 * t))) - 1)[50:-50].max() < 1e-2
    burst = np.exp(-(((t - 2) / 0.05) ** 2)) * np.sin(2 * np.pi * 10 * t)
    assert abs(np.argmax(np.abs(K.wavelet_transform(burst, FS, np.array([10.0]))[0])) - 500) <= 1
    assert abs(np.argmax(np.abs(K.wavelet_transform(burst, FS, np.array([10.0]), delayed=True)[0])) - 0) <= 2
    y = K.resample_ratio(np.sin(2 * np.pi * 5 * t), 1, 2)
    assert len(y) == 500 and np.abs(y - np.sin(2 * np.pi * 5 * np.arange(500) / 125))[50:-50].max() < 5e-3
    y = K.resample_fourier(np.sin(2 * np.pi * 5 * t), 500)
    assert np.abs(y - np.sin(2 * np.pi * 5 * np.arange(500) / 125)).max() < 1e-9


def test_components_rebuild_the_data():
    rng = np.random.default_rng(3)
    t = np.arange(3000)
    s = np.c_[np.sign(np.sin(t * 0.07)), np.sin(t * 0.11 + 1), rng.laplace(size=3000)]
    x = s @ rng.standard_normal((3, 4)) + 5
    got, mixing = K.independent_components(x, 3)
    assert np.allclose(got @ mixing + x.mean(0), x)
    assert (np.abs(np.corrcoef(got.T, s.T)[:3, 3:]).max(axis=1) > 0.98).all()


def test_surface_goes_through_its_points():
    g = K.radial_surface([0, 0.5, -0.5], [0, 0.5, 0.5], [1, 2, 3], np.array([0.0, 0.5]), smooth=0)
    assert g[0, 0] == pytest.approx(1) and g[1, 1] == pytest.approx(2)


def test_distributions_at_published_values():
    assert D.t_quantile(0.975, [1, 5, 10, 30]) == pytest.approx([12.706, 2.571, 2.228, 2.042], abs=1e-3)
    assert D.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert D.f_p_value(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert D.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert D.signed_rank_p(8, 10) == pytest.approx(0.0488, abs=1e-3)
    assert D.signed_rank_p(0, 0) == 1.0
