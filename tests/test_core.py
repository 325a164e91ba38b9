import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratemill.functions import labels, numbers, stats, text, times
from ratemill.operators import asof, dedup, fix, quotes, registry, robust


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_medians_and_gates(spark):
    rows = [(dt.date(2024, 1, 1), s, "open_market", v, True, False) for s, v in (("a", 1_000_000.0), ("b", 2_000_000.0))]
    rows += [(dt.date(2024, 1, 2), s, "open_market", v, True, False) for s, v in (("a", 1_000_000.0), ("b", 1_010_000.0), ("c", 1_020_000.0))]
    rows += [(dt.date(2024, 1, 2), "a", "crypto_usdt", 5.0, True, True)]
    df = spark.createDataFrame(rows, "day date, source string, benchmark string, value double, ok boolean, stale boolean")
    got = {(r.day.day, r.benchmark): r for r in fix.fixes(df).collect()}
    assert (got[1, "open_market"].fix, got[1, "open_market"].status, got[1, "open_market"].withheld, got[1, "open_market"].available) == (1_500_000, "WITHHOLD", True, False)
    assert (got[2, "open_market"].fix, got[2, "open_market"].status) == (1_010_000, "Green")
    assert got[2, "crypto_usdt"].withheld
    assert not {(r.day.day, r.benchmark): r for r in fix.fixes(df, allow_stale=True).collect()}[2, "crypto_usdt"].withheld


def official_rows(spark, rows):
    at = lambda s: dt.datetime.fromisoformat(s) if s else None
    return spark.createDataFrame([(dt.date(2026, 3, 29), s, "official", v, at(q), at(t)) for s, v, q, t in rows], "day date, source string, benchmark string, value double, quote_time timestamp, sampled_at timestamp")


def test_official_takes_the_freshest_then_the_busiest(spark):
    r = fix.official(official_rows(spark, [("aux_a", 1_325_072.0, "2026-03-27 12:00:00", "2026-03-29 14:00:00"), ("aux_b", 1_403_083.0, "2026-03-29 12:11:00", "2026-03-29 14:00:00")])).first()
    assert (r.fix, r.selection_method, r.selected_sources, r.using_stale_fallback) == (1_403_083, "freshest_quote_time", ["aux_b"], False)
    same = [("aux_a", 1_390_000.0, "2026-03-29 12:00:00", "2026-03-29 14:00:00"), ("aux_c", 1_401_000.0, "2026-03-29 11:00:00", "2026-03-29 13:45:00"), ("aux_c", 1_403_083.0, "2026-03-29 12:00:00", "2026-03-29 14:00:00")]
    r = fix.official(official_rows(spark, same)).first()
    assert (r.fix, r.selection_method) == (1_403_083, "freshest_quote_time_then_update_cadence")
    r = fix.official(official_rows(spark, [("aux", 1_403_083.0, "2026-03-27 12:00:00", "2026-04-13 14:00:00")])).first()
    assert (r.fix, r.using_stale_fallback) == (1_403_083, True)
    assert fix.official(official_rows(spark, [("aux", 1.0, "2026-01-01 12:00:00", "2026-04-13 14:00:00")])).count() == 0


def test_gaps(spark):
    wide = spark.createDataFrame([("d", 1_600_000.0, 1_380_000.0, 1_500_000.0, 1_650_000.0, None)], "day string, open_market double, official double, regional_transfer double, crypto_usdt double, emami_gold_coin double")
    r = fix.gaps(wide).first()
    assert r.street_official_gap_pct == pytest.approx(220 / 13.8) and r.street_transfer_gap_pct == pytest.approx(100 / 15) and r.street_crypto_gap_pct == pytest.approx(3.125) and r.street_gold_gap_pct is None


def test_peer_band(spark):
    df = spark.createDataFrame([(0, "subject", 2_000_000.0, True, False), (0, "x", 1_500_000.0, True, False), (0, "y", 1_520_000.0, True, False), (1, "subject", 1.0, True, False), (2, "subject", 1.0, False, False)], "attempt int, source string, value double, ok boolean, stale boolean")
    got = {r.attempt: r.peer_result for r in fix.peer_validation(df, "subject", ["x", "y"], 0.10).collect()}
    assert got == {0: "failed", 1: "skipped_no_peer_values", 2: "skipped_sample_not_valid"}


@pytest.mark.parametrize(("clock", "inside"), [("13:45:00", True), ("14:15:59", True), ("14:16:00", False), ("13:44:59", False)])
def test_window_edges(spark, clock, inside):
    assert one(spark, times.in_window(F.lit(f"2024-01-01 {clock}").cast("timestamp")))[0] is inside


def test_future_quotes_are_fresh(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, times.fresh(at("2024-06-01"), at("2024-01-01")), times.fresh(at("2024-01-01"), at("2024-01-04")), times.fresh(F.lit(None).cast("timestamp"), at("2024-01-04")))[:] == (True, False, False)


def test_jalali(spark):
    d = lambda y, m, k: times.jalali_to_date(F.lit(y), F.lit(m), F.lit(k))
    assert tuple(one(spark, d(1403, 1, 1), d(1399, 12, 30), d(1357, 11, 22), d(1404, 1, 1), d(1100, 1, 1))) == (dt.date(2024, 3, 20), dt.date(2021, 3, 20), dt.date(1979, 2, 11), dt.date(2025, 3, 21), None)


def test_numbers(spark):
    p = lambda s: numbers.parse_float(F.lit(s))
    assert tuple(one(spark, p("۱۲۳,۴۵۶"), p(" -1.5 "), p("1d"), p("NaN"), p(""), numbers.parse_number(F.lit("-3")))) == (123456.0, -1.5, None, None, None, None)
    assert one(spark, numbers.to_rial(F.lit(136_000.0), F.lit("toman")))[0] == 1_360_000
    assert one(spark, numbers.number_tokens(F.lit("USD 148,500 / 149,000 and 12345 no 123")))[0] == [148500, 149000, 12345]
    a, b = numbers.slash_pair(F.lit("148,500 / 149,000"))
    assert tuple(one(spark, a, b)) == (148500, 149000)
    assert one(spark, numbers.near_keyword(F.lit("buy: 148500 then"), quotes.BUY))[0] == 148500
    assert one(spark, numbers.implied_fx(F.lit(705_000_000.0), F.lit(3000.0)))[0] == pytest.approx(1_000_000)


@pytest.mark.parametrize(("buy", "sell", "reason"), [(None, 1.0, "missing USD buy/sell quote"), (2.0, 1.0, "buy quote above sell quote"), (-2.0, -1.0, "invalid sell quote"), (1.0, 1.0, "non-positive bid/ask spread"), (1.0, 2.0, "bid/ask spread exceeds configured maximum"), (99.0, 100.0, None)])
def test_spreads(spark, buy, sell, reason):
    r = one(spark, labels.spread_check(F.lit(buy).cast("double"), F.lit(sell).cast("double"), 0.05).alias("s")).s
    assert (r.reason, r.ok) == (reason, reason is None)


def values(spark, xs):
    return spark.createDataFrame([("g", float(x)) for x in xs], "g string, v double")


def test_statistics(spark):
    v = F.col("v")
    r = values(spark, [1, 2, 4, 10]).agg(stats.percentile(v, 0.25), stats.median(v), stats.percentile(v, 0.75)).first()
    assert tuple(r) == (1.75, 3.0, 5.5)
    r = values(spark, [1, 2, 9]).agg(stats.cv_of_mean(v), stats.cv_of_median(v)).first()
    assert r[0] == pytest.approx(0.890, abs=1e-3) and r[1] == pytest.approx(1.780, abs=1e-3)
    ten = list(range(1, 11))
    for f in (stats.trimmed_model, stats.trimmed_basket, stats.trimmed_research):
        assert values(spark, [*ten[:-1], 1000]).agg(f(v)).first()[0] == pytest.approx(5.5)
        assert values(spark, [1, 3]).agg(f(v)).first()[0] == 2.0
    assert values(spark, [1, 3]).agg(stats.weighted_mean(v, F.when(v == 1, 1.0).otherwise(-2.0)), stats.weighted_mean_any(v, F.lit(-1.0))).first()[:] == (1.0, None)


def basket(spark, rates, handles):
    rows = [("b", h, float(r), "direct_shop", 1.0, 90.0) for r, h in zip(rates, handles)]
    return robust.summarize_baskets(spark.createDataFrame(rows, "basket string, handle string, rate double, category string, weight double, freshness double"), 1_450_000.0).first()


def test_basket_gates(spark):
    r = basket(spark, [1_450_000, 1_451_000, 1_449_200, 1_450_700], ["a"] * 4)
    assert (r.publishable, r.suppression_reason, r.usable) == (False, "single_channel_concentration", 4)
    r = basket(spark, [1_448_500, 1_449_000, 1_450_000, 1_450_500, 1_451_000], ["a", "a", "b", "b", "b"])
    assert r.publishable and r.confidence > 55 and r.channels == 2
    r = basket(spark, [1_450_000 + x for x in (0, 10, 20, 30, 40, 18_000, 5, 15)], "aabbccdd")
    assert r.outliers_removed == 0 and r.channels == 4
    assert basket(spark, [1_450_000, 1_450_000], "ab").suppression_reason == "insufficient_usable_records"


def test_outlier_rules_differ(spark):
    df = values(spark, [100, 101, 102, 103, 104, 500])
    assert [r.v for r in robust.outliers_model(df, ["g"], "v").where("outlier").collect()] == [500]
    assert [r.v for r in robust.outliers_basket(df, ["g"], "v").where("outlier").collect()] == [500]
    assert robust.outliers_research(df, ["g"], "v", 8).where("outlier").count() == 0
    assert {r.v for r in robust.outliers_research(df, ["g"], "v", 5).where("outlier").collect()} == {100, 500}


def test_asof(spark):
    d = lambda n: dt.date(2024, 1, n)
    h = spark.createDataFrame([("k", d(1), 100.0), ("k", d(3), 110.0), ("k", d(9), 121.0), ("k", d(10), 130.0)], "key string, day date, fix double")
    got = {r.day.day: r.trend_pct for r in asof.trend(h, ["key"], "day", "fix").collect()}
    assert got == {1: None, 3: None, 9: pytest.approx(21.0), 10: pytest.approx(130 / 110 * 100 - 100)}
    got = {r.day.day: r.matched_fix for r in asof.backward(h, h, ["key"], "day", ["fix"], F.col("fix") < 125, 5).collect()}
    assert got == {1: None, 3: 100.0, 9: None, 10: 121.0}


def test_dedup_order(spark):
    rows = [("a", 1, "e1", "n", "n", 50, "P2"), ("a", 2, "e1", "n", "n", 50, "P2"), ("a", 3, "e2", "n", "n", 50, "P2"), ("b", 1, "e1", "n", "n", 50, "P1")]
    df = spark.createDataFrame(rows, "handle string, msg_index int, exact_key string, near_sig string, cross_key string, score int, priority string")
    got = {(r.handle, r.msg_index): (r.keep, r.flag, r.score) for r in dedup.across_channels(dedup.in_channel(df, score="score")).collect()}
    assert got == {("a", 1): (False, "reposted_cross_channel", 32), ("a", 2): (False, "exact_duplicate_in_channel", 28), ("a", 3): (False, "near_duplicate_in_channel", 34), ("b", 1): (True, "none", 50)}


def test_history(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    old = spark.createDataFrame([(ts("2026-03-29 10:00"), "Iran", 1.0), (ts("2026-03-31 10:00"), "Iran", 2.0), (ts("2026-03-31 10:00"), "UAE", 3.0)], "ts timestamp, locality string, rate double")
    new = spark.createDataFrame([(ts("2026-03-31 10:00"), "Iran", 1_450_000.0)], old.schema)
    assert sorted((r.locality, r.rate) for r in registry.history(old, new, 2).collect()) == [("Iran", 1_450_000.0), ("UAE", 3.0)]
    points = spark.createDataFrame([(ts("2026-03-30 10:00"), "Iran", 1.0), (ts("2026-03-30 20:00"), "Iran", 2.0), (ts("2026-03-31 10:00"), "Iran", 3.0)], old.schema)
    r = registry.timeseries(points).first()
    assert (r.point_count, r.daily_count, r.latest_rate, r.daily[0].rate) == (3, 2, 3.0, 2.0)


def test_new_only_is_greedy(spark):
    from ratemill.session import shared_folder

    shared_folder(spark)
    found = spark.createDataFrame([(1, "a", "d1", 9), (2, "a", "d2", 8), (3, "b", "d2", 7), (4, "c", "d9", 6), (5, None, None, 5)], "id int, name string, domain string, points int")
    known = spark.createDataFrame([("zz", "d9")], "name string, domain string")
    # 2 is turned away by 1 and so doesn't block 3
    assert sorted(r.id for r in registry.new_only(found, known, ["name", "domain"], [-F.col("points"), F.col("id")]).collect()) == [1, 3, 5]


def test_text(spark):
    html = "<html><title> A &amp; B </title><script>var x='<p>';</script><body><p>Rate</p><br>12 &lt; 13<!-- no --></body></html>"
    assert one(spark, text.title_of(F.lit(html)), text.domain_of(F.lit("https://www.Ex.com:80/a?b")), text.website(F.lit("https://www.ex.com/a/?b#c")))[:] == ("A &amp; B", "ex.com", "https://ex.com/a")
    assert "12 < 13" in one(spark, text.clean_html(F.lit(html)))[0] and "var" not in one(spark, text.clean_html(F.lit(html)))[0]
    assert one(spark, text.alias_hits(F.lit("Euro and دلار in Dubai"), text.CURRENCIES), text.best_alias(F.lit("London london dubai"), text.CITIES))[:] == (["EUR", "USD"], "London")
    assert one(spark, text.source_key(F.lit("Telegram"), F.lit("@Shop"), F.lit("")), text.tokens(F.lit("a| b,a||c")))[:] == ("telegram:shop", ["a", "b", "c"])
