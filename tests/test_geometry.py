"""Straight splits: angles by every bit, splits and certificates against plain versions."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from wayfold.operators import geometry
from wayfold.operators import kernels as K

#: Customers of three instances, by nation, whose parallel pairs have angles next to a bound of the rounding.
CLOSE = {
    1: (
        864489, 864517, 864540, 864551, 864605, 864612, 864664, 864673, 864704, 864792, 864830, 864883, 864892, 864924, 864943, 864952, 865009,
        865024, 865030, 865064, 865065, 865112, 865119, 865134, 865167, 865237, 865251, 865273, 865292, 865300, 865309, 865318, 865347, 865351,
        865369, 865413, 865417, 865419, 865438, 865454, 865492, 865503, 865531, 865602, 865633, 865634, 865647, 865683, 865691, 865723, 865736,
        865748, 865770, 865799, 865838, 865876, 865880, 865900, 865919, 865924, 865929,
    ),
    3: (
        561539, 561556, 561574, 561578, 561598, 561600, 561646, 561685, 561694, 561728, 561737, 561762, 561778, 561781, 561823, 561849, 561870,
        561890, 561908, 561989, 562024, 562055, 562077, 562088, 562106, 562143, 562152, 562158, 562203, 562213, 562235, 562246, 562258, 562313,
        562335, 562411, 562446, 562506, 562520, 562575, 562587, 562600, 562611, 562623, 562636, 562654, 562714, 562740, 562754, 562756, 562781,
        562797, 562801, 562820, 562857, 562914, 562923, 562924, 562935, 562939, 562943,
    ),
    5: (
        782873, 782881, 782899, 782913, 782935, 782967, 783017, 783028, 783078, 783088, 783109, 783151, 783178, 783180, 783196, 783209, 783231,
        783240, 783241, 783254, 783287, 783292, 783296, 783313, 783327, 783335, 783371, 783412, 783432, 783434, 783443, 783470, 783475, 783483,
        783503, 783525, 783582, 783585, 783621, 783627, 783669, 783682, 783701, 783713, 783735, 783740, 783781, 783810, 783831, 783849, 783868,
        783881, 783893, 783910, 783951, 783959, 784026, 784058, 784118, 784154, 784163,
    ),
}


@pytest.fixture(scope="module")
def close(tmp_path_factory):
    where = tmp_path_factory.mktemp("close")
    pd.DataFrame([(k, n) for n, keys in CLOSE.items() for k in keys], columns=["c_custkey", "c_nationkey"]).astype({"c_nationkey": "int32"}).to_parquet(where / "customer.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["critical_angles", "sampled_angles"])
def test_angles_by_every_bit(spark, close, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM '{close}/customer.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, close).collect()]
    assert len(got) == 3 and sorted(got) == sorted(want)


def scattered(n, seed):
    rnd = np.random.default_rng(seed)
    return [(0, i, float(a), float(b)) for i, (a, b) in enumerate(rnd.random((n, 2)) / 10 + (45.4, 4.3), 1)]


SCHEMA = "instance_id long, idx int, lat double, lon double"


def test_splits_ignore_the_order_of_rows(spark):
    rows = scattered(31, 5)
    runs = [sorted(map(tuple, geometry.separable_partitions(spark.createDataFrame(r, SCHEMA)).collect())) for r in (rows, rows[::-1], rows[1::2] + rows[::2])]
    assert runs[0] and runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 15])
def test_splits_and_certificates_plainly(spark, n):
    rows = scattered(n, n)
    rows += [(1, i, 45.0, 4.0) for i in range(1, 5)]  # coincident points have no split
    points = spark.createDataFrame(rows, SCHEMA)
    found = geometry.separable_partitions(points)
    x, y = K.metres_about_centroid([r[2] for r in rows[:n]], [r[3] for r in rows[:n]]) if n else ([], [])
    best = {}
    for t in K.between(K.critical_angles(x, y)):
        p = [float(a * math.cos(t) + b * math.sin(t)) for a, b in zip(x, y, strict=True)]
        order = sorted(range(n), key=lambda i: (p[i], i))
        half = n // 2
        if half and (gap := p[order[half]] - p[order[half - 1]]) > 0:
            key = K.key_of([i + 1 for i in order[:half]], [i + 1 for i in order[half:]])
            key = key if key[0][0] == 1 else key[::-1]
            best[key] = max(best.get(key, 0), gap)
    got = {(tuple(r.group_a), tuple(r.group_b)): r.margin for r in found.collect()}
    assert got == best and (n < 2 or got)
    sound = geometry.certificates(geometry.local_xy(points), found).collect()
    assert len(sound) == len(best) and all(r.violations == 0 and r.margin > 0 for r in sound)
    if n > 3:
        ga, gb = list(range(2, n + 1, 2)), list(range(1, n + 1, 2))
        odd = spark.createDataFrame([(0, ga, gb, 0.3)], "instance_id long, group_a array<int>, group_b array<int>, angle double")
        p = x * math.cos(0.3) + y * math.sin(0.3)
        sides = sorted((p[[i - 1 for i in g]] for g in (ga, gb)), key=np.mean)
        cut = (sides[0].max() + sides[1].min()) / 2
        (r,) = geometry.certificates(geometry.local_xy(points), odd).collect()
        assert r.violations == (sides[0] >= cut).sum() + (sides[1] <= cut).sum() > 0
