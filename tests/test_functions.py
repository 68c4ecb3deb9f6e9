import math

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import expr as X


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("x", [0.5, 1, 1.5, 2, 7, 100, 5e4])
def test_lgamma(spark, x):
    assert value(spark, X.lgamma(F.lit(float(x)))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_linear_grid(spark):
    assert value(spark, X.linear_grid(F.lit(0.6), 4)) == pytest.approx([0, 0.2, 0.4, 0.6])


def test_interpolated(spark):
    got = value(spark, X.interpolated(arr(0, 0.5, 1), arr(0.2, 0.3, 0.5), arr(0, 0.25, 0.5, 0.75)))
    assert got == pytest.approx([0.17391304, 0.2173913, 0.26086957, 0.34782609])


def test_argmax_takes_the_first(spark):
    assert value(spark, X.argmax(arr(0.1, 0.4, 0.4, 0.1))) == 1


def test_entropy_and_distances(spark):
    p, q = arr(0.25, 0.25, 0.5), arr(0.5, 0.25, 0.25)
    assert value(spark, X.entropy(p)) == pytest.approx(1.0397207708)
    assert value(spark, X.overlap(p, q)) == pytest.approx(0.75)
    assert value(spark, X.jsd(p, p)) == pytest.approx(0, abs=1e-12)
    assert value(spark, X.jsd(p, q)) == pytest.approx(value(spark, X.clipped_jsd(p, q)))


def test_posterior_normalises_and_zero_likelihood_raises(spark):
    post = value(spark, X.posterior(X.log_binomial(F.lit(2.0), F.lit(10.0), arr(0.1, 0.2, 0.5)), arr(0.2, 0.3, 0.5)))
    w = [0.2 * 0.1**2 * 0.9**8, 0.3 * 0.2**2 * 0.8**8, 0.5 * 0.5**2 * 0.5**8]
    assert post == pytest.approx([x / sum(w) for x in w])
    with pytest.raises(Exception, match="zero likelihood"):
        value(spark, X.posterior(X.log_binomial(F.lit(5.0), F.lit(2.0), arr(0.1, 0.2)), arr(0.5, 0.5)))


def test_smoothing_keeps_mass_inside(spark):
    got = value(spark, X.smoothed(arr(0, 0, 0, 1, 0, 0, 0, 0, 0, 0), 0.8))
    assert sum(got) == pytest.approx(1) and got[3] == max(got)
