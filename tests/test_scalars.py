"""Column functions on literal rows."""

import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from wayfold.config import Settings, bounded_float, bounded_int, flag
from wayfold.functions import geo, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_settings_take_defaults_for_what_they_cannot_read(spark):
    assert bounded_int("12", 5) == 12 and bounded_int("x", 5) == 5 and bounded_int("-1", 5) == 5 and bounded_int("12.7", 5) == 5
    assert bounded_float("0.5", 1.0, 0, 1) == 0.5 and bounded_float("2", 1.0, 0, 1) == 1.0 and flag("Yes") and not flag("no") and flag(None, True)
    spark.conf.set("wayfold.tie_seconds", "12.5")
    spark.conf.set("wayfold.knn_start", "x")
    assert Settings.of(spark).tie_seconds == 12.5 and Settings.of(spark).knn_start == 4
    spark.conf.unset("wayfold.tie_seconds")
    spark.conf.unset("wayfold.knn_start")


def test_haversine_and_finite_coordinates(spark):
    r = one(spark, geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(45.764), F.lit(4.8357)).alias("km"))
    assert r.km == pytest.approx(391.5, abs=0.2)
    rows = [("45.4", "4.3", True), ("nan", "4", False), ("inf", "4", False), ("91", "4", False), (None, "4", False), ("x", "4", False), ("-90", "180", True)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(geo.finite_coords(F.col("a"), F.col("b")).alias("f")).collect()
    assert [r.f for r in got] == [r[2] for r in rows]


@pytest.mark.parametrize(("raw", "value", "error"), [(None, 75, None), ("12", 12, None), ("12.7", None, "not an integer"), ("12.0", None, "not an integer"), ('"60"', None, "not an integer"), ("null", 75, None), ("true", None, "not an integer"), ("0", None, "out of range"), ("99999999999999999999", None, "out of range")])
def test_strict_int(spark, raw, value, error):
    v, e = text.strict_int(F.parse_json(F.lit(raw).cast("string")), 1, 10000, 75)
    r = one(spark, v.alias("v"), e.alias("e"))
    assert (r.v, r.e) == (value, error)


@pytest.mark.parametrize(("a", "b", "want"), [(4, 6, 5.0), (4, None, 4.0), (None, 6, 6.0), (None, None, None)])
def test_symmetrised(spark, a, b, want):
    assert one(spark, geo.symmetrised(F.lit(a).cast("int"), F.lit(b).cast("int")).alias("c")).c == want


def test_capacity_and_levels(spark):
    rows = spark.createDataFrame([(60, 2), (59, 2), (58, 2), (5, 0)], "n int, v int").select(geo.exact_capacity(F.col("n"), F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == [30, 30, 29, 0]
    r = one(spark, geo.enclave_thresholds(F.lit(60)).alias("t"), geo.enclave_level(F.lit(4), F.lit(60)).alias("l"), geo.enclave_level(F.lit(10), F.lit(60)).alias("none"))
    assert r.t == [0, 3, 6, 9] and r.l == 2 and r.none is None


def test_keys(spark):
    a, b = F.array(F.lit(3), F.lit(1)), F.array(F.lit(2), F.lit(4))
    r = one(spark, text.canonical_key(a, b).alias("k"), text.canonical_key(b, a).alias("m"), text.one_sided_key(b, a).alias("o"), text.short_key(F.array_sort(a), b).alias("s"), text.partition_difference(text.canonical_key(a, b), text.canonical_key(b, a)).alias("d"), text.short_key(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("e"))
    assert r.k == r.m and r.k.a == [1, 3] and r.o == [1, 3] and r.d == 0
    assert r.s == hashlib.md5(b"1,3|2,4").hexdigest()[:8] and r.e == "--------"


def test_texts(spark):
    r = one(
        spark, text.counts_text(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("c"), text.counts_text(F.lit(None).cast("map<string,int>")).alias("n"), text.cell_list(F.array(F.lit("x"), F.lit("y"))).alias("l"),
        text.split_ids(F.lit(" 0012 ,a b\n\n12;x\tx")).alias("ids"), text.joined_chunks(text.chunks(F.lit("abcdefg"), 3)).alias("back"), text.chunks(F.lit(""), 3).alias("none"),
        text.html_safe(F.lit("</script>\u2028")).alias("h"), text.token().alias("t"), text.scrubbed(F.lit("fine\nAPI_KEY=1\nok")).alias("s"), text.number(F.lit(" ")).alias("blank"),
    )
    assert r.c == "a=1;b=2" and r.n == "" and r.l == "x / y" and r.ids == ["0012", "a b", "12", "x", "x"]
    assert r.back == "abcdefg" and r.none == ["~"] and r.h == "\\u003c/script>\\u2028" and len(r.t) == 64 and r.s == "fine\n[hidden]\nok" and r.blank is None


def test_rounding_is_half_even(spark):
    assert [one(spark, F.rint(F.lit(x)).alias("r")).r for x in (2.5, 3.5, -0.5)] == [round(x) for x in (2.5, 3.5, -0.5)]


def test_clock_and_ledger():
    from wayfold.plans.control import Ledger, StageClock

    t = [0.0]
    clock = StageClock(10, lambda: t[0])
    clock.begin("a", 3)
    t[0] = 2
    assert not clock.expired() and clock.stage_remaining() == 1
    t[0] = 4
    assert clock.expired() and clock.exhausted == ["a"]
    clock.end("budget")
    clock.begin("b", 60)
    assert clock.stage_remaining() == 6
    t[0] = 11
    assert clock.over() and clock.expired() and clock.timings == {"a": 4000}
    ledger = Ledger(2, 5, 1, lambda: t[0])
    ledger.plan(3)
    assert ledger.may_start()
    ledger.attempt()
    ledger.record("succeeded")
    ledger.attempt()
    ledger.record("timed_out")
    assert not ledger.may_start() and ledger.diagnostics()["failed"] == 1
    late = Ledger(2, 5, 1, lambda: t[0])
    t[0] += 4.5
    assert not late.may_start() and math.isclose(time.monotonic(), time.monotonic(), abs_tol=5)


def test_provider_retries():
    from wayfold.sources.providers import Counted, Reply, geometry_status

    replies = iter([Reply(429), Reply(503), Reply(200, {"x": 1})])
    slept = []
    p = Counted(lambda r: next(replies), sleep=slept.append)
    assert p.fetch({}).body == {"x": 1} and p.calls == 3 and slept == [2.0, 4.0]
    q = Counted(lambda r: Reply(403), sleep=slept.append)
    assert q.fetch({}).status == 403 and q.calls == 1
    broken = Counted(lambda r: 1 / 0, sleep=lambda s: None)
    assert broken.fetch({}).error == "ZeroDivisionError" and broken.calls == 3
    assert [geometry_status(r) for r in (Reply(0, error="ReadTimeout"), Reply(0, error="X"), Reply(500), Reply(200), Reply(200, {"a": 1}))] == ["timeout", "network_error", "http_500", "invalid_response", "ok"]
