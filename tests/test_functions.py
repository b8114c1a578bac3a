"""Truth tables of the column expressions."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vinlake.functions import dates, geo, labels, meta, mileage, money, numbers, phrases, states, text, urls
from vinlake.functions import vin as V


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (V.vin, ["1m8gdm9axkp042788", " 1M8GDM9AX-KP042788 ", "1M8GDM9AXKP04278", "WVWZZZ1JZXW000001", "11111111111111111", "AAAAAAAAAAAAAAAAA", "1M8GDM9A1222222222", None], ["1M8GDM9AXKP042788", "1M8GDM9AXKP042788", None, None, None, None, None, None]),
    (V.labelled_vin, ["wvwzzz1jzxw000001", "12345678901234567", "WVWZZZ1J111111111"], ["WVWZZZ1JZXW000001", None, None]),
    (V.check_digit_ok, ["1M8GDM9AXKP042788", "1M8GDM9A1KP042788", "11111111111111111", "short", None], [True, False, True, False, False]),
    (V.chassis, ["NKE165-7241190", "jzx100-0065750", "3CA-8WDTPF", "ABC*1234567", "ASK", "UNKNOWN", None], ["NKE1657241190", "JZX1000065750", None, None, None, None, None]),
    (V.history_id, ["1m8gdm9axkp042788", "WVWZZZ1JZXW000001", "NKE165-7241190", "n/a"], ["1M8GDM9AXKP042788", "WVWZZZ1JZXW000001", "NKE1657241190", None]),
    (V.checkable, ["ab12x", "abcd", "1M8GDM9AXKP042788", "has space", "1M8GDM9AXKP042788X"], [True, False, True, False, False]),
    (V.vins_in, ["see 1M8GDM9AXKP042788, not 1M8GDM9A1KP042788", "none", ""], [["1M8GDM9AXKP042788"], [], []]),
    (mileage.in_text, ["60,000 km", "84,431 mi", "주행거리: 12345", "nice60000KM", "12 km", "1 km", "odometer 0", "2,000,001 km", None, "drove 99 kmh"], [60000.0, 84431.0, 12345.0, 60000.0, 12.0, None, None, None, None, None]),
    (mileage.coerce, ["60,000 km", "about 12 345", "x"], [60000.0, 12345.0, None]),
    (labels.fuel, ["Plug-in Hybrid", "ДИЗЕЛЬ", "디젤", "gas/electric", "EV", "EVO", "BENZIN", "Flexible fuel", "GPL", "гибрид", "hydrogen", "", None, "steam"], ["Plug-in Hybrid", "Diesel", "Diesel", "Hybrid", "Electric", None, "Gasoline", "Flex Fuel", "LPG", "Hybrid", "Hydrogen", None, None, None]),
    (labels.model, ["5er", "5-series touring", "3 ER", "c class", "GLCclass", "X class", "M3", "  a  b ", "", None], ["5 Series", "5 Series touring", "3 Series", "C-Class", "GLC-Class", "X class", "M3", "a b", None, None]),
    (labels.engine_cc, ["2.0 L", "1998cc", "1,998", "x", None], [2000, 1998, 1998, None, None]),
    (geo.country, ["kr", "S. Korea", "u.s.a.", "DEUTSCHLAND", "south_korea", "Atlantis ", " ", None], ["South Korea", "South Korea", "United States", "Germany", "South Korea", "Atlantis", None, None]),
    (geo.slug, ["KR", "u.s.", "Bosnia"], ["south_korea", "united_states", "bosnia_and_herzegovina"]),
    (text.salvage, ["Title-Salvaged", "CERT OF TITLE-SALVAGE", "Total loss: 0", "Vehicle total loss count: 0", "Salvage, total loss count: 0, 3 owners", "total_loss", "전손", "전손: 0", "rebuilt", "junkyard", "clean", None], [True, True, False, False, True, True, True, False, True, False, False, False]),
    (text.title_state, ["TX - Salvage", "ca – Clear", "Salvage", None], ["TX", "CA", None, None]),
    (text.looks_like_page, ["<!DOCTYPE html><html>", " <html lang=en>", '{"a": 1}', "<b>bold</b>", None], [True, True, False, False, False]),
    (dates.day, ["2023-08-29T10:00", "20230829", "2023-08", None], ["2023-08-29", "2023-08-29", None, None]),
    (dates.short_day, ["260820", "750101", "20230829", "999999", "x"], [dt.date(2026, 8, 20), dt.date(1975, 1, 1), dt.date(2023, 8, 29), None, None]),
    (dates.from_item_code, ["CI202608060005181701", "CI2026", None], [dt.datetime(2026, 8, 6), None, None]),
    (dates.from_goods_id, ["PT260820-0010399", "PT260820x"], [dt.datetime(2026, 8, 20), None]),
    (dates.from_object_id, ["507f1f77bcf86cd799439011", "xyz"], [dt.datetime(2012, 10, 17, 21, 13, 27), None]),
    (dates.precision, ["2020-01-02", "2020-01", "2020", "then"], ["day", "month", "year", None]),
    (urls.picture, ["https://www.cdn.example.com/a/640x480/p_1.jpg?w=3", "http://cdn.example.com/a/p_1-1024x768.webp#x", "https://cdn.example.com/a/p_1.png/"], ["cdn.example.com/a/p_1"] * 2 + ["cdn.example.com/a/p_1"]),
    (urls.host, ["https://WWW.Example.com:8080/x", "nope", None], ["example.com", None, None]),
    (urls.junk_picture, ["https://x/logo.png", "data:image/png;base64,", "https://x/car_1.jpg", None, "https://x/logos_of_cars.jpg"], [True, True, False, True, False]),
    (numbers.digits_number, ["$ 1,234.50", "0", "free", None], [1234.5, None, None, None]),
    (text.same_day_text, ["New car shipment (done)", "Automobile inspection!"], ["new car delivery done", "car inspection"]),
]


@pytest.mark.parametrize("f, values, want", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_truth_table(spark, f, values, want):
    assert apply(spark, f, values) == want


def test_numbers(spark):
    assert apply(spark, numbers.half_up, [2.5, -2.5, -0.5, 0.49], "double") == [3, -2, 0, 0]
    assert apply(spark, numbers.text_of_number, [12000000.0, 1.5, None], "double") == ["12000000", "1.5", ""]
    assert apply(spark, mileage.usable, [0.0, 1.0, 2.0, 2e6, 2000001.0, None], "double") == [False, False, True, True, False, False]
    assert apply(spark, lambda x: mileage.to_km(x, F.lit("Miles")), [60000.0], "double") == [96561]
    assert apply(spark, mileage.to_miles, [96561], "long") == [60000]


def test_money(spark):
    rows = spark.createDataFrame([(100.0, "usd"), (92.0, "EUR"), (1400000.0, "KRW"), (5.0, "XXX"), (None, "USD"), (7.0, None)], "a double, c string")
    got = [(r.usd, r.eur) for r in money.with_usd_eur(rows, "a", "c").collect()]
    assert got == [(100.0, 92.0), (100.0, 92.0), (1000.0, 920.0), (None, None), (None, None), (7.0, 6.44)]
    assert money.with_usd_eur(rows, "a", "c", rates={"USD": 1.0}).filter("usd IS NOT NULL").isEmpty()
    krw = [(r.k, r.a) for r in spark.createDataFrame([(1999.0,), (250000.0,), (999.0,), (5.0,), (0.0,), (5555.0,)], "x double").select(money.from_tenthousands(F.col("x"))[0].alias("k"), money.from_tenthousands(F.col("x"))[1].alias("a")).collect()]
    assert krw == [(19990000, False), (250000, False), (9990000, True), (50000, True), (None, True), (55550000, True)]
    usd, eur = money.resolved_usd_eur(F.col("a"), F.col("c"), F.lit(50.0), F.lit(None).cast("double"))
    assert {(r.u, r.e) for r in rows.select(usd.alias("u"), eur.alias("e")).collect()} == {(50.0, 46.0)}


def test_metadata(spark):
    rows = ['{"km": "60,000 km", "n": "12", "s": " x ", "b": true, "e": ""}', "[1]", "broken {", None, '{"n": 1.5, "b": "yes"}']
    m = F.col("x")
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i")
    p = meta.parsed(m)
    got = df.select(meta.loose_number(p, "q", "km").alias("a"), meta.number(p, "km", "n").alias("b"), meta.text(p, "e", "s").alias("c"), meta.flag(p, "b").alias("d")).collect()
    assert [tuple(r) for r in got] == [(60000.0, 12.0, "x", True), (None,) * 4, (None,) * 4, (None,) * 4, (None, 1.5, None, None)]
    changed = df.select(meta.with_fields(m, F.create_map(F.lit("n"), F.lit("9"))).alias("y")).collect()
    assert '"n":"9"' in changed[0].y and changed[3].y == '{"n":"9"}'


def test_marks(spark):
    got = apply(spark, lambda x: text.mark(F.lit(None).cast("string"), x), ["replacement", "Repainted", "rust", "scratch here", "dent", "crack", "normal", "good", "교환", "odd", "defective"])
    assert got == ["Z", "W", "R", "C", "N", "P", None, None, "Z", None, "P"]


def test_pairs(spark):
    rows = spark.createDataFrame([("kr", "de"), ("Germany", "ge"), (None, "ge"), ("kr", "ge")], "a string, b string")
    assert [r.x for r in rows.select(geo.origin(F.col("a"), F.col("b")).alias("x")).collect()] == ["Germany", "Germany", "Georgia", "South Korea"]
    h = spark.createDataFrame([("abc", "abd"), ("abc", "ab"), ("abc", "abc")], "a string, b string")
    assert [r.x for r in h.select(V.hamming(F.col("a"), F.col("b")).alias("x")).collect()] == [1, None, 0]
    assert labels.model_spellings("5-series") == labels.model_spellings("5 Series") and "5er" in labels.model_spellings("5 Series")
    assert "usa" in geo.spellings("United States") and geo.spellings("Atlantis") == ["atlantis"]


def test_schedule_hash(spark):
    def want(s, h=0):
        for ch in s:
            h = (h * 31 + ord(ch)) % (1 << 32)
        return h

    names = ["encore", "a", "", "supplier#000001"]
    assert apply(spark, text.poly_hash, names) == [want(n) for n in names]
    assert apply(spark, lambda x: text.poly_hash(x, 17), names) == [want(n, 17) for n in names]


def test_balanced_and_states_against_a_json_reader(spark):
    """Objects of any nesting with brackets, quotes and escapes in their strings: what a JSON reader takes from their beginning."""
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind < 2:
            return "".join(rng.choice('ab{}[]"\\/= \n;é') for _ in range(rng.randrange(8)))
        if kind < 4:
            return rng.choice([0, -1.5, True, None, 10**6])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice("abc{}\\") + str(i): value(depth - 1) for i in range(rng.randrange(4))}

    rows = []
    for i in range(200):
        whole = json.dumps(rng.choice([[value(3)], {"k": value(3)}]), ensure_ascii=rng.random() < 0.5)
        rows.append((i, whole + rng.choice(["", "; var x = 1;", "}]", ' "']), len(whole)))
        rows.append((1000 + i, whole[:-1], None))  # cut off
    df = spark.createDataFrame(rows + [(5000, "text", None), (5001, "", None), (5002, None, None), (5003, '{"a" 1}', 7)], "i int, t string, n int")
    assert df.filter(~states.balanced_length(F.col("t")).eqNullSafe(F.col("n"))).count() == 0
    pages = [(r[0], f"<html><script>window.a = 1; self['S{r[0]}']= {r[1]}</script><script type=text/x>y={{}}</script></html>") for r in rows if r[2] and "</script" not in r[1]]
    got = {(r.i, r.name): json.loads(r.state) for r in states.page_states(spark.createDataFrame(pages, "i int, html string"), "html", "i").collect()}
    want = {(i, n): v for i, t, k in rows if k for n, v in ((f"S{i}", json.loads(t[:k])), ("y", {}))}
    assert got == want


def test_states_of_odd_pages(spark):
    pages = [
        (1, '<script id="__NEXT_DATA__" type="application/json">\n {"a": "x = {1}"} </script>'), (2, 'no script'), (3, None), (4, ''), (5, '<script>var a = {"s": "b = {\\"c\\": [1]}"}, d = [2]; e = {f: 1}</script>'),
        (6, '<SCRIPT type="application/ld+json">[{"@type": "Car"}]</SCRIPT>'), (7, '<script>if (a == b) { c = [1, 2 }</script>'), (8, '<script>s = {"t": "' + "[" * 200_000 + '"}</script>'),
    ]
    found = states.page_states(spark.createDataFrame(pages, "i int, html string"), "html", "i")
    got = {(r.i, r.name, r.pos): r.state for r in found.collect()}
    assert got.keys() == {(1, "__NEXT_DATA__", 0), (5, "a", 0), (5, "d", 2), (6, "application/ld+json", 0), (8, "s", 0)} and got[5, "d", 2] == "[2]"
    assert [tuple(r) for r in found.filter("i in (1, 6)").select("i", states.at_path(F.col("state"), "a"), states.at_path(F.col("state"), "0.@type")).orderBy("i").collect()] == [(1, "x = {1}", None), (6, None, "Car")]


def test_harvested_pictures(spark):
    html = """<img src="//a.com/p/320x240/one.jpg?x=1"><img src='https://a.com/p/1024x768/one.jpg'><script>{"u":"https:\\/\\/b.com\\/two_thumb.png","v":"https:\\u002F\\u002Fb.com\\u002Ftwo.png"}</script><img src="https://a.com/logo.png"> http://c.com/three.webp"""
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "i int, html string")
    got = [tuple(r) for r in states.harvested_pictures(df, "html", "i").orderBy("i", "pos").collect()]
    assert got == [(1, 0, "https://a.com/p/1024x768/one.jpg"), (1, 1, "https://b.com/two.png"), (1, 2, "http://c.com/three.webp")]
    assert [r.url for r in states.harvested_pictures(df, "html", "i", hint="B.com").collect()] == ["https://b.com/two.png"]
    assert states.harvested_pictures(df, "html", "i", most=1).count() == 1


def plain_replaced(text, meanings, whole_words=False):
    """The longest phrase at each place, by trying all of them."""
    out, at = [], 0
    inside = lambda i: 0 <= i < len(text) and text[i].isalnum()
    while at < len(text):
        fits = [p for p in meanings if text.startswith(p, at) and not (whole_words and (inside(at - 1) or inside(at + len(p))))]
        p = max(fits, key=len, default=None)
        out.append(meanings[p] if p else text[at])
        at += len(p) if p else 1
    return "".join(out)


@pytest.mark.parametrize("whole_words", [False, True])
def test_phrases_against_a_plain_loop(spark, whole_words):
    rng = random.Random(6)
    letters = "ab전손 .$(é\U0001f600"
    meanings = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.choice(["", "X", "ab", "$1", "\\"]) for _ in range(60)}
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "ab " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "i int, t string")
    want = {i: plain_replaced(t, meanings, whole_words) for i, t in enumerate(texts)} | {9999: None}
    words = spark.createDataFrame([*meanings.items(), ("", "no"), (None, "no")], "word string, meaning string")
    assert {r.i: r.t for r in phrases.replaced(df, "t", words, whole_words).collect()} == want
    one = words.filter("word != ''")
    assert {r.i: r.t for r in phrases.replaced_by_table(df, "t", one, "i", whole_words).collect()} == want
    assert phrases.replaced(df, "t", words.limit(0)).exceptAll(df).count() == 0


def test_a_large_dictionary(spark):
    """Beyond MOST phrases the dictionary is joined, and gives the same."""
    meanings = {f"w{i}": f"m{i}" for i in range(phrases.MOST + 10)}
    df = spark.createDataFrame([(1, "w1 w12 w123 w1234, w99999 x"), (2, "none")], "i int, t string")
    words = spark.createDataFrame(list(meanings.items()), "word string, meaning string")
    assert {r.i: r.t for r in phrases.replaced(df, "t", words, key="i").collect()} == {i: plain_replaced(t, {k: v for k, v in meanings.items() if k in t}) for i, t in ((1, "w1 w12 w123 w1234, w99999 x"), (2, "none"))}
    with pytest.raises(ValueError):
        phrases.replaced(df, "t", words)


def test_phrases_in_json(spark):
    d = phrases.Phrases({"a": "1", "ab": 'q"\\', "é": "e"})
    raws = ['{"ab": "xab", "n": [{"a": "a\\u00e9\\"", "b": 1.50}, "é", null, true], "e": ""}', '"ab"', "[]", '{"ab": "a"', "ab", None, '{"k" : "a"}']
    got = apply(spark, d.replaced_in_json, raws)
    assert [json.loads(got[0]), json.loads(got[1])] == [{"ab": 'xq"\\', "n": [{"a": '1e"', "b": 1.5}, "e", None, True], "e": ""}, 'q"\\']
    assert "1.50" in got[0] and got[2:] == ["[]", '{"ab": "a"', "ab", None, '{"k" : "1"}']


def test_picture_rules_of_hosts(spark):
    keys = ((r"vis\.a\.com/resizer\?imagekeys=([^&~]+)", "vis:$1"), (r"//c[ds]n\d*\.b\.com/.+?/([a-z0-9]{17})-(\d+)(?:-[a-f0-9]+)*\.(?:jpe?g|webp)", "b:$1:$2"))
    got = apply(spark, lambda u: urls.picture_by_rules(u, keys), ["https://vis.a.com/resizer?imageKeys=123~SID~I1&w=9", "https://cdn2.b.com/x/y/1M8GDM9AXKP042788-3-ab12.webp?z", "https://csn.b.com/q/1M8GDM9AXKP042788-3.jpg", "https://www.c.com/640x480/p_thumb.jpg?q", None])
    assert got == ["vis:123", "b:1m8gdm9axkp042788:3", "b:1m8gdm9axkp042788:3", "c.com/p", None]
    frames = ((r"-plate-(\d+)\.", 1000), (r"/(\d+)\.avif", 0))
    assert apply(spark, lambda u: urls.frame_by_rules(u, frames), ["https://a.com/x-plate-2.jpg", "https://a.com/7.avif?x=1", "https://a.com/frame_12.jpg", None]) == [1002, 7, 12, None]
