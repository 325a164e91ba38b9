import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ratemill.functions import payloads, rules, scores
from ratemill.operators import publish, regional, registry

RECORD = "basket string, handle string, rate double, weight double, quality double, freshness double"


def test_enriched_keeps_the_variety_of_sources(spark):
    tight = [("b", h, 1_450_000.0 + i, 1.0, 80.0, 90.0) for i, h in enumerate("aaaabbbb")]
    far = [("b", "c", 2_900_000.0, 1.0, 80.0, 90.0), ("b", "c", 2_800_000.0, 1.0, 80.0, 90.0), ("b", "d", 2_950_000.0, 1.0, 80.0, 90.0)]
    r = regional.enriched(spark.createDataFrame(tight + far, RECORD), 1_450_000.0).first()
    assert (r.n, r.sources) == (9, 3)  # c gives back the nearer of its two, d isn't needed any more
    lone = [("b", "a", 1_450_000.0 + i, 1.0, 80.0, 90.0) for i in range(6)] + [("b", "z", 2_900_000.0, 1.0, 80.0, 90.0)]
    r = regional.enriched(spark.createDataFrame(lone, RECORD), 1_450_000.0).first()
    assert (r.n, r.sources) == (7, 2)  # with one source left nothing is removed


def test_board_states(spark):
    rows = [("x", h, 1_450_000.0, 1.0, 80.0, "fresh") for h in "aabb"] + [("y", "a", 1.0, 1.0, 80.0, "old"), ("y", "a", 1.0, 1.0, 80.0, "stale")] + [("z", "a", 1.0, 1.0, 0.0, "old")]
    got = {r.locality: (r.state, r.reason) for r in regional.board(spark.createDataFrame(rows, "locality string, handle string, rate double, weight double, parse double, fresh string"), 1_450_000.0).collect()}
    assert got == {"x": ("publish", ""), "y": ("monitor", "needs_more_fresh_sources"), "z": ("hide", "insufficient_signal")}


def test_cards_merge_only_what_agrees(spark):
    schema = "locality string, state string, rate double, artifact string, usable int, sources int, fresh int, confidence double"
    rows = [("a", "publish", 100.0, "board", 10, 1, 1, 100.0), ("a", "publish", 120.0, "legacy", 10, 1, 0, 100.0), ("b", "publish", 100.0, "board", 10, 1, 1, 100.0), ("b", "publish", 130.0, "enriched", 10, 1, 1, 100.0), ("c", "hide", None, "board", 0, 0, 0, None)]
    got = {r.locality: (r.artifact, r.rate) for r in registry.cards(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("merged_diagnostics", 110.0), "b": ("enriched", 130.0), "c": ("board", None)}


def test_cards_of_equal_candidates(spark):
    schema = "id int, locality string, state string, rate double, artifact string, usable int, sources int, fresh int, confidence double"
    rows = [(i, "a", "publish", r, "board", 10, 1, 1, 100.0) for i, r in ((2, 900.0), (1, 100.0), (3, 500.0))]
    for some in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(some, schema).coalesce(1)
        assert [registry.cards(df, 1.25, by).first().rate for by in ("id", None)] == [100.0, 900.0]


def test_usable_records_of_large_keys(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(129_468, -861.2), (129_565, -900.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r.k: r.rate for r in entry.queries()["f13_usable_records"](spark, str(tmp_path)).collect()} == {129_468: 2_395_180.0, 129_565: 2_395_650.0}
    bounded = rules.dollar_rate_in(F.lit("usd 239565 toman"), F.lit("unknown"), F.lit(797_500.0), F.lit(2_392_500.0))
    assert spark.range(1).select(bounded["basis"]).first()[0] == "unusable"


def test_registry_upsert_is_idempotent(spark):
    reg = "key string, title string, status string, country string, origins array<string>, localities array<string>, families array<string>, last_quote_message_count long, best_quote_message_count long, last_usable_record_count long, best_usable_record_count long, first_seen date, last_seen date, last_success date"
    upd = "key string, title string, status string, country string, origins array<string>, localities array<string>, families array<string>, quote_message_count long, usable_record_count long"
    d = dt.date
    old = spark.createDataFrame([("k", "t", "ok", "unknown", ["a"], [], None, 1, 9, 2, 8, d(2024, 1, 1), d(2024, 1, 1), None)], reg)
    new = spark.createDataFrame([("k", "", "new", "Iran", ["b", "a"], ["x"], [], 3, 0), ("n", "t2", "", "unknown", None, None, None, 0, 0)], upd)
    once = registry.upsert(old, new, F.lit(d(2024, 2, 1)))
    got = {r.key: r for r in once.collect()}
    k = got["k"]
    assert (k.title, k.status, k.country, k.origins, k.localities) == ("t", "new", "Iran", ["a", "b"], ["x"])
    assert (k.last_quote_message_count, k.best_quote_message_count, k.first_seen, k.last_seen, k.last_success) == (3, 9, d(2024, 1, 1), d(2024, 2, 1), d(2024, 2, 1))
    assert (got["n"].country, got["n"].first_seen, got["n"].last_success) == ("unknown", d(2024, 2, 1), None)
    twice = registry.upsert(once, new, F.lit(d(2024, 2, 1)))
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_payloads(spark):
    body = '{"data": {"USD": {"name": "x", "price": "1,500"}, "list": [{"symbol": "usd", "sell": 1600}, {"symbol": "eur", "sell": 9}]}, "updated_at": "2024-01-01 10:00:00", "ts": 1600000000, "usd": -5}'
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, None), (4, "[]")], "id int, body string")
    assert [(r.key, r.value) for r in payloads.symbol_value(df, "id", "body", ("usd",)).collect()] == [(1, 1550.0)]
    assert {r.path: r.value for r in payloads.leaves(df, "id", "body").where("key = 1").collect()}["data.list[1].sell"] == "9"
    assert [(r.key, str(r.quote_time)) for r in payloads.quote_time(df, "id", "body").collect()] == [(1, "2024-01-01 10:00:00")]


def test_attempts_and_guardrails(spark):
    at = lambda s: dt.datetime.fromisoformat(s)
    day = dt.date(2024, 1, 1)
    rows = [(day, at("2024-01-01 13:45:00"), 5.0, "Green", False), (day, at("2024-01-01 14:00:00"), 6.0, "WITHHOLD", True), (day, at("2024-01-01 15:00:00"), 7.0, "Green", False)]
    r = publish.pick_attempt(spark.createDataFrame(rows, "day date, at timestamp, fix double, status string, withheld boolean")).first()
    assert (r.fix, r.attempts, r.valid_candidates, r.strategy) == (5.0, 3, 1, "latest_valid_in_window")
    latest = spark.createDataFrame([(day, None, True, "no intraday samples", 1, False), (dt.date(2024, 1, 2), 5.0, False, "", 0, True)], "day date, fix double, withheld boolean, reason string, valid_candidates int, official_ok boolean")
    tries = spark.createDataFrame([(day, 5.0, False, True)], "day date, fix double, withheld boolean, official_ok boolean")
    assert sorted(x.failure for x in publish.guardrails(latest, tries).collect()) == ["intraday_samples_exist", "official_available", "withheld_despite_candidates"]


def test_scores(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(scores.comparable_rial(F.lit(100.0), F.lit("AED"), F.lit("UAE")), scores.comparable_rial(F.lit(100.0), F.lit("EUR"), F.lit("Iran")), scores.per_hundred(F.lit(100.0), F.lit("IQD"), F.lit("صد دینار")))[:] == (367.25, None, 1.0)
    assert one(scores.operational_bucket(F.lit("exchange_shop"), F.lit(8), F.lit(0), F.lit(False), F.lit(75), F.lit(4)), scores.use_status(F.lit(3), F.lit(True), F.lit("fresh"), F.lit(68), F.lit(True)), scores.support(F.lit(1), F.lit(0), F.lit(0)))[:] == ("P1", "publishable", "monitor_card")


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables here")
def test_payload_queries_read_all_orders(spark):
    import __spark_entry__ as entry

    here, queries = "/root/testdata/sf0.001", entry.queries()
    orders = spark.read.parquet(f"{here}/orders.parquet").count()
    assert queries["n2_symbol_value_all"](spark, here).count() == orders
    assert queries["n4_quote_time_all"](spark, here).count() == orders
    assert queries["n1b_leaves_all"](spark, here).count() == 8 * orders
    assert queries["c25_support_all"](spark, here).count() == 6
