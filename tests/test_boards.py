"""Messages of boards, pages and payloads, with the rates and times that they tell."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratemill.functions import extraction, pages, payloads, probes, rules, times
from ratemill.operators import boards


def told(text, benchmark):
    return {place: (rate, money, basis) for place, _, _, rate, _, basis, money in boards.place_quotes(text, benchmark)}


def test_board_with_a_line_for_each_place():
    got = told("\n  تهران 147300 / 147500\n  هرات 147600 / 147700\n  سلیمانیه 147800 / 147900\n  دبی درهم 40300\n", 1_449_922.07)
    assert set(got) == {"Tehran", "Herat", "Sulaymaniyah", "Dubai"} and got["Dubai"][0] > 1_400_000
    assert got["Tehran"] == (1_474_000.0, "USD", "midpoint")


@pytest.mark.parametrize(
    ("text", "benchmark", "place", "rate", "money"),
    [
        ("حواله درهم امارات 42,360 تومان", 1_550_000.0, "Dubai", 423_600 * 3.6725, "AED"), ("نرخ پوند امروز لندن خرید حساب رسمی: 190,000 فروش حساب رسمی: 215,000 تومان", 1_650_000.0, "London", 1_557_692.31, "GBP"),
        ("حواله بانکی آلمان فروش یورو 185,000 تومان", 1_650_000.0, "Germany", 1_622_807.02, "EUR"), ("حواله 68788 بابت #فروش یورو نرخ پیشنهادی: 200,000 تومان حساب از آلمان", 1_773_250.0, "Germany", 1_754_385.96, "EUR"),
        ("ریال قطر : 48,750 تومان", 1_773_250.0, "Qatar", 1_774_500.0, "QAR"), ("درام ارمنستان : 455 تومان", 1_773_250.0, "Armenia", 1_774_500.0, "AMD"), ("صد دینار عراق : 136,000 ریال", 1_773_250.0, "Iraq", 1_781_600.0, "IQD"),
    ],
)
def test_single_notes(text, benchmark, place, rate, money):
    got = told(text, benchmark)
    assert got[place][1] == money and got[place][0] == pytest.approx(rate, abs=0.01)


def test_board_in_one_line():
    text = "قیمت ارزها دلار : 1,779,200 ریال یورو : 2,081,900 ریال پوند انگلیس : 2,403,500 ریال درهم امارات : 484,780 ریال لیر ترکیه : 39,300 ریال دینار عراق : 1,360 ریال ریال قطر : 488,000 ریال درام ارمنستان : 4,550 ریال"
    got = told(text, 1_773_250.0)
    want = {"Dubai": (1_780_354.55, "AED"), "Turkey": (1_775_574.0, "TRY"), "Iraq": (1_781_600.0, "IQD"), "Qatar": (1_776_320.0, "QAR"), "Armenia": (1_774_500.0, "AMD")}
    assert {p: (round(got[p][0], 2), got[p][1]) for p in want} == want


def test_board_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "تهران 147300 / 147500", None), (3, "تهران 147300 / 147500", "z"), (3, "تهران 147300 / 147500", "z")], "id long, said string, place string")
    got = boards.board_quotes(df, "id", "said", 1_450_000.0).collect()
    assert sorted((str(r.id), r.place, r.rate) for r in got) == [("3", "Tehran", 1_474_000.0)] * 2 + [("None", "Tehran", 1_474_000.0)]
    assert boards.board_quotes(df.where("false"), "id", "said", 0.0).count() == 0


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_page_times(spark):
    at = F.lit("2026-05-03 15:10:00").cast("timestamp")
    history = "<table><tr><td>1405/01/07</td><td>1,403,083</td></tr><tr><td>1405/01/06</td></tr></table>"
    shown = '<div>یکشنبه ۱۳ اردیبهشت - ۱۸:۴۰:۰۰</div><td class="r">زمان ثبت آخرین نرخ</td> <td class="l">۱۸:۳۳:۳۱</td>'
    bare = '<span class="tgju-widget-up-i">۱۸:۳۳:۳۱</span>'
    note = "به روز رسانی: سه شنبه 08 اردیبهشت 1405 ساعت 15:04"
    got = one(spark, pages.history_time(F.lit(history)), pages.profile_time(F.lit(shown), at), pages.profile_time(F.lit(bare), at), pages.update_time(F.lit(note)), pages.history_time(F.lit("x")), pages.update_time(F.lit("x")), pages.hhmm(F.lit("14:05")), pages.hhmm(F.lit("24:00")))
    when = dt.datetime(2026, 5, 3, 15, 3, 31)
    assert [x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x for x in got] == [dt.datetime(2026, 3, 27, 8, 30), when, when, dt.datetime(2026, 4, 28, 15, 4), None, None, 845, None]


def test_direct_rates(spark):
    got = one(spark, pages.direct_rates(F.lit("نرخ تبدیل درهم به تومان در حال حاضر 42,360 تومان است"), 1_550_000.0), pages.direct_rates(F.lit("nothing"), 1_550_000.0))
    assert [tuple(r) for r in got[0]] == [("AED", 42_360, "toman", 423_600.0)] and got[1] == []


def test_payloads_by_symbol(spark):
    body = '{"current": {"ice_currency_usd_sell": {"p": "1,644,182", "ts": "2026-04-13 00:00:00"}, "ice_average_usd_sell": {"p": "1,311,134", "ts": "2026-04-13 00:00:00"}}}'
    df = spark.createDataFrame([(1, body), (2, None), (3, "{bad"), (4, "{}")], "k long, body string")
    best = payloads.by_priority(df, "k", "body", ("ice_currency_usd_sell", "ice_average_usd_sell"), 4).collect()
    assert [tuple(r) for r in best] == [(1, 1_644_182.0, "ice_currency_usd_sell")]
    assert [r.quote_time.replace(tzinfo=None) for r in payloads.symbol_time(df, "k", "body", ("ice_average_usd_sell",), 4).collect()] == [dt.datetime(2026, 4, 13)]
    assert payloads.resolved(df, "k", "body", "official", ("other",), ("ice_average_usd_sell",), True, 4).count() == 0


def test_payloads_are_parsed_once(spark):
    """Each query over payloads reads its input once, however deep it looks."""
    df = spark.range(3).select("id", F.concat(F.lit('{"usd": {"p": "'), F.col("id") + 5, F.lit('", "ts": "2026-04-13"}, "official": {"usd": 20000}}')).alias("body"))
    ways = {"own": ("official", ("usd",), (), True), "any": ("official", ("none",), ("usd",), False), "path": ("official", (), (), False)}
    made = [payloads.by_priority(df, "id", "body", ("usd", "x"), 4), payloads.symbol_time(df, "id", "body", ("usd",), 4), payloads.symbol_value(df, "id", "body", ("usd",), 4), payloads.path_value(df, "id", "body", "official", 4), payloads.resolved_ways(df, "id", "body", ways, 4), payloads.quote_time(df, "id", "body", 4)]
    for out in made:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Range (") == 1  # one branch over the input, where there was one for each level
    assert sorted(map(tuple, made[4].where("key = 1").collect())) == [(1, "any", 10_003.0, None), (1, "own", 10_003.0, "usd"), (1, "path", 20_000.0, None)]


def test_payloads_of_a_key_in_several_rows(spark):
    rows = [(1, '{"usd": 10, "x": [{"code": "USD", "p": "30", "ts": "2026-04-13"}]}'), (1, '{"usd": 50, "eur": {"p": 5, "date": "2026-04-14"}}'), (None, '{"u-s-d": 7}'), (None, '{"usd": 9}'), (2, "[[[1]]]"), (3, None), (4, "null")]
    df = spark.createDataFrame(rows, "k int, body string")
    assert {r.key: r.value for r in payloads.symbol_value(df, "k", "body", ("usd",), 4).collect()} == {1: 30.0, None: 8.0}
    assert {r.key: (r.value, r.symbol) for r in payloads.by_priority(df, "k", "body", ("usd", "eur"), 4).collect()} == {1: (5.0, "eur"), None: (8.0, "usd")}
    assert {(r.key, r.path, r.value) for r in payloads.leaves(df.where("k > 1"), "k", "body", 4).collect()} == {(2, "[0][0][0]", "1"), (4, "", None)}
    assert payloads.leaves(df.where("k = 2"), "k", "body", 2).count() == 0


def test_signals_look_once(spark):
    said = F.lit("Tehran 150,000 / 150,200\nSulaymaniyah +250")
    s = extraction.signal(said, ("Sulaymaniyah",), ("Tehran",))
    got = one(spark, s, extraction.signal(F.lit("Sulaymaniyah: ۱۵۰٬۰۰۰ / ۱۵۱٬۰۰۰"), ("Sulaymaniyah",), ("Tehran",)), extraction.signal(F.lit(None).cast("string"), ("x",), ("y",)), extraction.signal(F.lit("Sulaymaniyah +250"), ("Sulaymaniyah",), ("Tehran",)))
    assert [x and tuple(x) for x in got] == [("relative", 150_350.0), ("pair", 150_500.0), None, None]
    assert str(s._jc).count("regexp_extract") <= 14  # two of a pair's places in two orders, two for a single value, two for a difference; once for each place


def test_quote_counts_look_once(spark):
    blocks = F.array(F.lit("buy ۱۵۰۰۰۰ sell 151,000"), F.lit("USD 140000"), F.lit("buy nothing"), F.lit("150000 151000"), F.lit("rate 12"))
    counts = probes.quote_counts(blocks)
    got = one(spark, counts, probes.quote_counts(blocks, 1), probes.quote_counts(F.array(F.lit("rate 15000"), F.lit(None).cast("string"))), probes.quote_counts(F.array().cast("array<string>")))
    assert [tuple(x) for x in got] == [(2, 1), (1, 1), (None, None), (0, 0)]
    assert str(counts._jc).count("regexp_extract_all") == 1


def test_page_times_are_worked_out_once(spark):
    at = F.lit("2026-05-03 15:10:00").cast("timestamp")
    shown = pages.profile_time(F.col("html"), at)
    assert str(shown._jc).count("regexp_extract") == 3  # the last rate's time in two forms, and the day
    dates = times.nearest_jalali(F.lit(30), F.lit(12), at)  # only leap years have that day, and it counts as the next one in others
    got = one(spark, dates, times.nearest_jalali(F.lit(40), F.lit(1), at), pages.hhmm(F.lit("24:00")), pages.hhmm(F.lit(" 23:59 ")), pages.hhmm(F.lit("1:00")))
    assert [str(x) for x in got] == ["2026-03-21", "None", "None", "1439", "None"]


def test_gates(spark):
    yes, no = F.lit(True), F.lit(False)
    got = one(
        spark, rules.direct_shop(yes, no, no, yes, F.lit("Tehran"), F.lit(4), F.lit(0), F.lit(0), no), rules.direct_shop(yes, yes, yes, yes, F.lit("Tehran"), F.lit(9), F.lit(9), F.lit(99), yes), rules.direct_shop(no, no, yes, yes, F.lit("x"), F.lit(0), F.lit(0), F.lit(10), no),
        rules.coherence(F.lit(30), F.lit(0.03), F.lit(0.2), F.lit(8.0), F.lit(85.0), F.lit(90.0)), rules.coherence(F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0)),
    )
    assert tuple(got) == (True, False, True, 100.0, 0.0)
