"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded report value; adding zero turns -0.0 into 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)


def bilog(c: str | Column) -> Column:
    x = col(c)
    return F.signum(x) * F.log1p(F.abs(x))


def normal_pdf(c: Column) -> Column:
    return F.exp(-c * c / 2.0) / math.sqrt(2 * math.pi)


# Published rational approximations of the normal distribution function
# (Hart's, relative error 1e-15) and of its inverse (Wichura's AS 241), highest power first.
CDF_NUM = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
INV_MID_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
               1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
INV_MID_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
               687.1870074920579083, 42.313330701600911252, 1.0]
INV_FAR_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504,
               5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
INV_FAR_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455,
               1.6763848301838038494, 2.05319162663775882187, 1.0]
INV_END_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123,
               1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772]
INV_END_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525,
               0.13692988092273580531, 0.59983220655588793769, 1.0]


def _polynomial(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Normal distribution function; null and NaN give null."""
    a = F.abs(z)
    e = F.exp(-a * a / 2.0)
    near = e * _polynomial(CDF_NUM, a) / _polynomial(CDF_DEN, a)
    chain = a + 0.65
    for i in (4.0, 3.0, 2.0, 1.0):
        chain = a + F.lit(i) / chain
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(e / chain / math.sqrt(2 * math.pi))
    return F.when(F.isnan(z), None).when(z > 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    q = p - 0.5
    mid = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    far, end = tail - 1.6, tail - 5.0
    size = F.when(tail <= 5.0, _polynomial(INV_FAR_NUM, far) / _polynomial(INV_FAR_DEN, far)).otherwise(
        _polynomial(INV_END_NUM, end) / _polynomial(INV_END_DEN, end))
    inner = q * _polynomial(INV_MID_NUM, mid) / _polynomial(INV_MID_DEN, mid)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * size))


def hash_unit(key: Column, tag: str) -> Column:
    """A number in [0, 1) from 48 bits of an md5: the same draw for a key and a tag under any partitioning."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{tag}"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))


def is_number(c: str | Column) -> Column:
    return col(c).try_cast("double").isNotNull()
