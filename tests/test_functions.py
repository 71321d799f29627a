"""Scalar functions against literal values."""

import pytest
from pyspark.sql import functions as F

from rivulet.functions import blocks, coerce, dates, numbers, text
from rivulet.functions.userlib import LIBRARY as L


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ts(x):
    return F.lit(x).cast("timestamp")


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2), (2.5, 3), (-0.5, 0), (0.49, 0), (1e9 + 0.5, 1000000001)])
def test_half_up(spark, x, want):
    assert one(spark, numbers.half_up(F.lit(x))) == want


def test_money(spark):
    assert one(spark, numbers.cents_to_micro(F.lit(123))) == 123_000_000
    assert one(spark, numbers.micro_to_cents(F.lit(1_500_000))) == 2
    assert one(spark, numbers.micro_or_cents(F.lit(None).cast("long"), F.lit(7).cast("long"))) == 7_000_000
    assert one(spark, numbers.usd(F.lit(123_456_000_000))) == "$1,234.56"
    assert [one(spark, numbers.compact(F.lit(x))) for x in (999, 1234, 1_260_000)] == ["999", "1.2K", "1.3M"]
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None and one(spark, numbers.ratio(F.lit(1), F.lit(3))) == 0.333333
    assert one(spark, numbers.gated_ratio(F.lit(10), F.lit(149), 150)) == 0


def test_iso_weeks(spark):
    assert one(spark, dates.iso_week_id(ts("2027-01-01"))) == "2026-W53"
    assert one(spark, dates.iso_week_number(ts("2024-12-30"))) == 202501
    assert str(one(spark, dates.iso_week_start(F.lit(202653)))) == "2026-12-28"
    assert str(one(spark, dates.week_start(ts("2024-03-10 23:00:00")))) == "2024-03-04 00:00:00"  # a Sunday
    assert str(one(spark, dates.week_end(ts("2024-03-04")))) == "2024-03-11 00:00:00"


@pytest.mark.parametrize(
    ("now", "anchor", "start", "end"),
    [
        ("2026-03-20 10:00:00", "2026-01-15 08:00:00", "2026-03-15 08:00:00", "2026-04-15 08:00:00"),
        ("2026-03-10 10:00:00", "2026-01-15 08:00:00", "2026-02-15 08:00:00", "2026-03-15 08:00:00"),
        ("2026-03-01 10:00:00", "2026-01-31 12:00:00", "2026-02-28 12:00:00", "2026-03-31 12:00:00"),
        ("2026-03-15 08:00:00", "2026-01-15 08:00:00", "2026-03-15 08:00:00", "2026-04-15 08:00:00"),
        ("2026-02-28 12:00:00", "2026-01-30 12:30:00", "2026-01-30 12:30:00", "2026-02-28 12:30:00"),
        ("2026-01-05 00:00:00", "2025-06-10 00:00:00", "2025-12-10 00:00:00", "2026-01-10 00:00:00"),
    ],
)
def test_month_bounds(spark, now, anchor, start, end):
    assert str(one(spark, dates.month_start(ts(now), ts(anchor)))) == start
    assert str(one(spark, dates.month_end(ts(now), ts(anchor)))) == end


def test_other_dates(spark):
    assert one(spark, dates.seconds_to_next_day(ts("2024-01-01 23:59:50"))) == 10
    assert one(spark, dates.seconds_to_next_day(ts("2024-01-01"))) == 86400
    assert one(spark, dates.minute_key(ts("2024-01-02 03:04:05"))) == "202401020304"
    assert one(spark, dates.shifted_day(ts("2024-01-01 20:00:00"), "+05:30")) == "2024-01-02"
    assert one(spark, dates.zone_offset(ts("2024-07-01"), "Europe/Berlin")) == 120
    assert one(spark, F.size(dates.days_of_month(ts("2024-02-10")))) == 29


@pytest.mark.parametrize(("x", "want"), [("m-free", "m"), ("m-free:global", "m"), ("m:global-free-free", "m"), ("-free", "unknown"), ("", "unknown"), (None, "unknown"), ("free-m", "free-m")])
def test_suffixes(spark, x, want):
    assert one(spark, text.strip_suffixes(F.lit(x).cast("string"), ("-free", ":global"))) == want


def test_text(spark):
    assert one(spark, text.slug(F.lit(" Hello, World!  x--y "))) == "hello-world-x-y"
    assert one(spark, text.token_estimate(F.lit("12345678901"))) == 3 and one(spark, text.token_estimate(F.lit("12"))) == 1
    assert one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, text.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, text.last_rule(F.lit("git push"), [("*", "ask"), ("git *", "allow"), ("git pus?", "deny")], "none")) == "deny"
    assert one(spark, text.dedented(F.lit("    a\n      b\n\n    c"))) == "a\n  b\n\nc"
    assert one(spark, text.squeezed(F.lit(" a \n\t b "))) == "a b" and one(spark, text.line_trimmed(F.lit(" a \n b"))) == "a\nb"
    assert one(spark, text.unescaped(F.lit(r"a\nb\"c"))) == 'a\nb"c'
    assert one(spark, text.fuzzy_score(F.lit("ab"), F.lit("a_b"))) > one(spark, text.fuzzy_score(F.lit("ab"), F.lit("xaxxbx")))
    assert one(spark, text.fuzzy_score(F.lit("ba"), F.lit("ab"))) is None
    assert one(spark, blocks.block_similarity(F.lit("a\nbc"), F.lit(" a\nbd"))) == pytest.approx(0.75)
    assert one(spark, text.normalized(F.lit("é"))) == "é"


@pytest.mark.parametrize(
    ("ip", "want"),
    [("1.2.3.4", "1.2.3.4/32"), ("2001:db8::1", "2001:db8:0:0::/64"), ("2001:0DB8:0001:0000:0:0:0:1", "2001:db8:1:0::/64"), ("::1", "0:0:0:0::/64"), ("::", "0:0:0:0::/64"), ("nothing", None), ("1:2:3", None), ("1:2:3:4:5:6:7:8:9", None)],
)
def test_ip_prefix(spark, ip, want):
    assert one(spark, coerce.ip_prefix(F.lit(ip))) == want


def test_coercion(spark):
    assert [one(spark, coerce.loose_double(F.lit(x))) for x in ("1.5", "x", "", "NaN", "Infinity", " 2 ")] == [1.5, None, 0.0, None, None, 2.0]
    assert [one(spark, coerce.loose_long(F.lit(x))) for x in ("2.5", "-2.5", "1e3")] == [3, -2, 1000]
    assert [one(spark, coerce.loose_boolean(F.lit(x))) for x in ("true", "false", "1", "TRUE")] == [True, False, None, None]
    assert [one(spark, coerce.country(F.lit(x).cast("string"))) for x in ("de", "d", "", None, "deu")] == ["DE", "ZZ", "ZZ", "ZZ", "ZZ"]


def cases():
    A = F.array(*[F.lit(x) for x in (3, 1, 2, 1)])
    S = F.lit("héllo wörld")
    DAY = F.lit("2024-02-29 13:14:15.678").cast("timestamp")
    return {
        "array.at": ((A, -1), 1), "array.slice": ((A, 1, -1), [1, 2]), "array.indexOf": ((A, 1), 1), "array.lastIndexOf": ((A, 1), 3), "array.includes": ((A, 9), False), "array.with": ((A, 1, 7), [3, 7, 2, 1]), "array.splice": ((A, 1, 2, 8, 9), [3, 8, 9, 1]),
        "array.fill": ((A, 0, 2), [3, 1, 0, 0]), "array.copyWithin": ((A, 0, 2), [2, 1, 2, 1]), "array.pop": ((A,), [3, 1, 2]), "array.shift": ((A,), [1, 2, 1]), "array.push": ((A, 5), [3, 1, 2, 1, 5]), "array.join": ((F.array(F.lit("a"), F.lit(None)), "-"), "a-"), "array.toSorted": ((A,), [1, 1, 2, 3]),
        "array.find": ((A, lambda x: x < 3), 1), "array.findLast": ((A, lambda x: x > 1), 2), "array.findIndex": ((A, lambda x: x == 2), 2), "array.findLastIndex": ((A, lambda x: x == 1), 3), "array.reduce": ((A, F.lit(0), lambda a, x: a + x), 7), "array.keys": ((A,), [0, 1, 2, 3]), "array.flatMap": ((A, lambda x: F.array(x, x)), [3, 3, 1, 1, 2, 2, 1, 1]),
        "map.set": ((F.create_map(F.lit("a"), F.lit(1)), "a", 2), {"a": 2}), "map.delete": ((F.create_map(F.lit("a"), F.lit(1)), "a"), {}), "set.add": ((A, 3), [3, 1, 2]), "object.assign": ((F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(5))), {"a": 5}),
        "string.indexOf": ((S, "l"), 2), "string.lastIndexOf": ((S, "l"), 9), "string.slice": ((S, -5, -1), "wörl"), "string.substring": ((S, 5, 1), "éllo"), "string.at": ((S, -1), "d"), "string.charAt": ((S, 99), ""), "string.codePointAt": ((S, 1), 233), "string.padStart": ((F.lit("7"), 3, "0"), "007"), "string.padEnd": ((S, 3, "0"), "héllo wörld"),
        "string.replace": ((S, "l", "L"), "héLlo wörld"), "string.replaceAll": ((S, "l", "L"), "héLLo wörLd"), "string.split": ((F.lit("a.b"), "."), ["a", "b"]), "string.trim": ((F.lit(" \t\na\n"),), "a"), "string.search": ((S, "w"), 6), "string.match": ((S, "x"), None), "string.matchAll": ((S, "l+"), ["ll", "l"]), "string.repeat": ((F.lit("ab"), 2), "abab"),
        "math.round": ((F.lit(-2.5),), -2), "math.trunc": ((F.lit(-2.7),), -2), "math.hypot": ((F.lit(3.0), F.lit(4.0)), 5.0), "number.toFixed": ((F.lit(1234.5), 2), "1234.50"), "number.toString": ((F.lit(255), 16), "ff"), "number.parseInt": ((F.lit(" 42px"),), 42), "number.parseFloat": ((F.lit("-1.5e2x"),), -150.0), "number.isInteger": ((F.lit(2.0),), True),
        "date.getUTCMonth": ((DAY,), 1), "date.getUTCDay": ((DAY,), 4), "date.getUTCMilliseconds": ((DAY,), 678), "date.toISOString": ((DAY,), "2024-02-29T13:14:15.678Z"), "date.parse": ((F.lit("bad"),), None), "date.UTC": ((F.lit(1970), F.lit(0), F.lit(2)), 86_400_000),
        "url.hostname": ((F.lit("https://a.b:81/p?q=1#h"),), "a.b"), "url.host": ((F.lit("https://a.b:81/p?q=1#h"),), "a.b:81"), "url.hash": ((F.lit("https://a.b/p?q=1#h"),), "#h"), "url.search": ((F.lit("https://a.b/p"),), ""), "url.getAll": ((F.lit("https://a.b/p?q=1&x=2&q=%20"), "q"), ["1", " "]), "url.canParse": ((F.lit("not a url"),), False),
        "url.encodeURIComponent": ((F.lit("a b&é!'()*~"),), "a%20b%26%C3%A9!'()*~"), "url.decodeURIComponent": ((F.lit("a%20b+c"),), "a b+c"), "coerce.Number": ((F.lit("x"),), None), "json.get": ((F.lit('{"a":{"b":3}}'), "$.a.b"), "3"),
    }


def test_user_library(spark):
    """All at once: a column for each case."""
    found = cases()
    row = spark.range(1).select(*[L[name](*args).alias(name.replace(".", "_")) for name, (args, _) in found.items()]).first()
    assert {name: row[name.replace(".", "_")] for name in found} == {name: want for name, (_, want) in found.items()}
