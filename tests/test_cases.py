"""Operators on literal cases, against rows worked out by hand."""

import literal_cases
import pytest
from literal_cases import CASES
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(literal_cases)  # workers have no path to it


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    columns, rows, made = CASES[name]
    found = made(spark).select(*[F.col(n).cast(t).alias(n) for n, t in columns]).collect()
    plain = lambda r: tuple(float(v) if t == "double" and v is not None else v for v, (_, t) in zip(r, columns, strict=True))
    assert sorted((tuple(r) for r in found), key=str) == sorted((plain(r) for r in rows), key=str)
