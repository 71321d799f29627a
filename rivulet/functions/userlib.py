"""The scalar library of user programs: names of a scripting language's standard library as Spark columns.

Offsets are 0-based and count characters (code points). Arrays, maps and texts are values: what mutates elsewhere
returns a new value here. ``LIBRARY`` maps "group.name" to the function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def at(a: Column, i) -> Column:
    """Element at an offset; a negative one counts from the end; null outside."""
    i = lit(i)
    return F.try_element_at(a, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def span(size: Column, start, end) -> tuple[Column, Column]:
    """Clamped (0-based start, length) of a slice with negative offsets counted from the end."""
    fix = lambda x: F.greatest(F.lit(0), F.least(size, F.when(x < 0, size + x).otherwise(x)))
    s, e = fix(lit(start)), fix(size if end is None else lit(end))
    return s, F.greatest(F.lit(0), e - s)


def array_slice(a: Column, start=0, end=None) -> Column:
    s, n = span(F.size(a), start, end)
    return F.slice(a, (s + 1).cast("int"), n.cast("int"))


def find(a: Column, f) -> Column:
    return F.try_element_at(F.filter(a, f), F.lit(1))


def find_last(a: Column, f) -> Column:
    return F.try_element_at(F.filter(a, f), F.lit(-1))


def find_index(a: Column, f) -> Column:
    return (F.coalesce(F.array_position(F.transform(a, f), F.lit(True)), F.lit(0)) - 1).cast("int")


def find_last_index(a: Column, f) -> Column:
    back = F.array_position(F.reverse(F.transform(a, f)), F.lit(True))
    return F.when(back > 0, F.size(a) - back).otherwise(F.lit(-1)).cast("int")


def index_of(a: Column, x) -> Column:
    return (F.array_position(a, lit(x)) - 1).cast("int")


def last_index_of(a: Column, x) -> Column:
    back = F.array_position(F.reverse(a), lit(x))
    return F.when(back > 0, F.size(a) - back).otherwise(F.lit(-1)).cast("int")


def entries(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def splice(a: Column, start: int, remove: int, *items) -> Column:
    s, n = span(F.size(a), start, lit(start) + remove)
    own = F.array(*[lit(x) for x in items]) if items else F.slice(a, 1, 0)
    return F.concat(array_slice(a, 0, s), own, array_slice(a, s + n))


def fill(a: Column, x, start=0, end=None) -> Column:
    s, n = span(F.size(a), start, end)
    return F.transform(a, lambda v, i: F.when((i >= s) & (i < s + n), lit(x)).otherwise(v))


def copy_within(a: Column, target: int, start: int, end=None) -> Column:
    s, n = span(F.size(a), start, end)
    t, _ = span(F.size(a), target, None)
    return F.transform(a, lambda v, i: F.when((i >= t) & (i < t + n), F.try_element_at(a, (i - t + s + 1).cast("int"))).otherwise(v))


def substring(c: Column, start, end=None) -> Column:
    """Offsets below 0 count as 0; crossed offsets are swapped."""
    size = F.char_length(c)
    fix = lambda x: F.greatest(F.lit(0), F.least(size, x))
    s, e = fix(lit(start)), fix(size if end is None else lit(end))
    return F.substr(c, F.least(s, e) + 1, F.abs(e - s))


def text_slice(c: Column, start, end=None) -> Column:
    s, n = span(F.char_length(c), start, end)
    return F.substr(c, s + 1, n)


def text_index(c: Column, x: str, start: int = 0) -> Column:
    return (F.locate(x, c, start + 1) - 1).cast("int")


def text_last_index(c: Column, x: str) -> Column:
    back = F.instr(F.reverse(c), x[::-1])
    return F.when(back > 0, F.char_length(c) - back - len(x) + 1).otherwise(F.lit(-1)).cast("int")


def pad(c: Column, n: int, fill_: str, left: bool) -> Column:
    """A text that is long enough stays (Spark's own padding would cut it)."""
    return F.when(F.char_length(c) >= n, c).otherwise((F.lpad if left else F.rpad)(c, n, fill_))


def trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def to_fixed(c: Column, places: int) -> Column:
    return F.regexp_replace(F.format_number(c, places), ",", "")


def radix(c: Column, base: int) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, base))


def parse_int(c: Column, base: int = 10) -> Column:
    digits = "0-9" if base == 10 else "0-9a-fA-F" if base == 16 else f"0-{base - 1}"
    text = F.regexp_extract(c, rf"^\s*([+-]?[{digits}]+)", 1)
    whole = text if base == 10 else F.conv(text, base, 10)
    return F.when(text != "", whole.try_cast("long"))


def parse_float(c: Column) -> Column:
    text = F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.when(text != "", text.try_cast("double"))


def encode_component(c: Column) -> Column:
    """Blanks as %20, and the marks that stay as they are."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def decode_component(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def query_values(url: Column, key: str) -> Column:
    """All values of a query parameter, in order."""
    pairs = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    own = F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == key)
    return F.transform(own, lambda p: F.url_decode(F.substr(p, F.lit(len(key) + 2))))


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


LIBRARY: dict[str, Callable] = {
    "array.map": F.transform, "array.filter": F.filter, "array.find": find, "array.findIndex": find_index, "array.findLast": find_last, "array.findLastIndex": find_last_index,
    "array.some": F.exists, "array.every": F.forall, "array.reduce": lambda a, start, f: F.aggregate(a, start, f), "array.reduceRight": lambda a, start, f: F.aggregate(F.reverse(a), start, f),
    "array.flatMap": lambda a, f: F.flatten(F.transform(a, f)), "array.sort": F.array_sort, "array.toSorted": F.array_sort, "array.slice": array_slice, "array.concat": F.concat, "array.reverse": F.reverse, "array.toReversed": F.reverse,
    "array.flat": F.flatten, "array.at": at, "array.with": lambda a, i, x: F.transform(a, lambda v, k: F.when(k == i, lit(x)).otherwise(v)), "array.keys": lambda a: F.transform(a, lambda _, i: i), "array.values": lambda a: a, "array.entries": entries,
    "array.join": lambda a, sep=",": F.array_join(a, sep, ""), "array.includes": F.array_contains, "array.indexOf": index_of, "array.lastIndexOf": last_index_of,
    "array.push": F.array_append, "array.pop": lambda a: array_slice(a, 0, -1), "array.shift": lambda a: array_slice(a, 1), "array.unshift": F.array_prepend, "array.splice": splice, "array.fill": fill, "array.copyWithin": copy_within, "array.length": F.size,
    "map.get": lambda m, k: F.try_element_at(m, lit(k)), "map.set": lambda m, k, v: F.map_concat(F.map_filter(m, lambda a, _: a != lit(k)), F.create_map(lit(k), lit(v))), "map.has": F.map_contains_key, "map.delete": lambda m, k: F.map_filter(m, lambda a, _: a != lit(k)),
    "map.clear": lambda m: F.map_filter(m, lambda *_: F.lit(False)), "map.keys": F.map_keys, "map.values": F.map_values, "map.entries": F.map_entries, "map.size": F.size,
    "set.add": lambda a, x: F.array_distinct(F.array_append(a, lit(x))), "set.has": F.array_contains, "set.delete": F.array_remove, "set.union": F.array_union, "set.difference": F.array_except, "set.intersection": F.array_intersect,
    "object.keys": F.map_keys, "object.values": F.map_values, "object.entries": F.map_entries, "object.hasOwn": F.map_contains_key, "object.assign": lambda m, n: F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(n), k)), n), "object.fromEntries": F.map_from_entries,
    "string.toLowerCase": F.lower, "string.toUpperCase": F.upper, "string.trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), "string.trimStart": lambda c: F.regexp_replace(c, r"^\s+", ""), "string.trimEnd": lambda c: F.regexp_replace(c, r"\s+$", ""),
    "string.split": lambda c, sep: F.split(c, F.lit("") if sep == "" else F.lit("\\Q" + sep + "\\E")), "string.slice": text_slice, "string.substring": substring, "string.substr": lambda c, s, n: F.substr(c, lit(s) + 1, lit(n)), "string.includes": F.contains, "string.startsWith": F.startswith, "string.endsWith": F.endswith,
    "string.indexOf": text_index, "string.lastIndexOf": text_last_index, "string.replace": lambda c, a, b: F.when(F.instr(c, a) > 0, F.concat(F.substring_index(c, a, 1), F.lit(b), F.substr(c, F.instr(c, a) + len(a)))).otherwise(c), "string.replaceAll": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "string.repeat": F.repeat, "string.padStart": lambda c, n, f=" ": pad(c, n, f, True), "string.padEnd": lambda c, n, f=" ": pad(c, n, f, False), "string.charAt": lambda c, i: F.substr(c, lit(i) + 1, F.lit(1)), "string.at": lambda c, i: text_slice(c, i, None if i == -1 else i + 1),
    "string.codePointAt": lambda c, i: F.nullif(F.ascii(F.substr(c, lit(i) + 1, F.lit(1))), F.lit(0)), "string.concat": F.concat, "string.match": lambda c, p: F.nullif(F.regexp_extract(c, p, 0), F.lit("")), "string.matchAll": lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0)), "string.search": lambda c, p: (F.regexp_instr(c, F.lit(p)) - 1).cast("int"), "string.length": F.char_length, "string.fromCodePoint": F.char,
    "regexp.test": lambda c, p: c.rlike(p), "regexp.exec": lambda c, p, g=0: F.regexp_extract(c, p, g),
    "math.max": F.greatest, "math.min": F.least, "math.abs": F.abs, "math.floor": F.floor, "math.ceil": F.ceil, "math.round": lambda c: F.floor(c + F.lit(0.5)), "math.trunc": trunc, "math.sign": F.sign, "math.sqrt": F.sqrt, "math.cbrt": F.cbrt, "math.pow": F.pow, "math.hypot": F.hypot,
    "math.log": F.ln, "math.log2": F.log2, "math.log10": F.log10, "math.exp": F.exp,
    "number.toFixed": to_fixed, "number.toString": radix, "number.isInteger": lambda c: c == F.floor(c), "number.isFinite": lambda c: ~F.isnan(c) & (F.abs(c) != float("inf")), "number.isNaN": F.isnan, "number.isSafeInteger": lambda c: (c == F.floor(c)) & (F.abs(c) <= 9007199254740991), "number.parseInt": parse_int, "number.parseFloat": parse_float,
    "date.getTime": millis, "date.getUTCFullYear": F.year, "date.getUTCMonth": lambda c: F.month(c) - 1, "date.getUTCDate": F.dayofmonth, "date.getUTCDay": lambda c: F.dayofweek(c) - 1, "date.getUTCHours": F.hour, "date.getUTCMinutes": F.minute, "date.getUTCSeconds": lambda c: F.second(c), "date.getUTCMilliseconds": lambda c: F.pmod(millis(c), F.lit(1000)).cast("int"),
    "date.toISOString": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "date.parse": lambda c: F.unix_millis(F.try_to_timestamp(c)), "date.UTC": lambda *p: F.unix_millis(F.make_timestamp(p[0], p[1] + 1, *[*p[2:], *([F.lit(1), F.lit(0), F.lit(0), F.lit(0)][len(p) - 2 :])])),
    "json.stringify": F.to_json, "json.parse": F.parse_json, "json.get": F.get_json_object,
    "url.protocol": lambda c: F.concat(F.parse_url(c, F.lit("PROTOCOL")), F.lit(":")), "url.host": lambda c: F.parse_url(c, F.lit("AUTHORITY")), "url.hostname": lambda c: F.parse_url(c, F.lit("HOST")), "url.pathname": lambda c: F.parse_url(c, F.lit("PATH")), "url.search": lambda c: F.coalesce(F.concat(F.lit("?"), F.parse_url(c, F.lit("QUERY"))), F.lit("")), "url.hash": lambda c: F.coalesce(F.concat(F.lit("#"), F.parse_url(c, F.lit("REF"))), F.lit("")),
    "url.canParse": lambda c: F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull(), "url.get": lambda c, k: F.try_element_at(query_values(c, k), F.lit(1)), "url.getAll": query_values, "url.has": lambda c, k: F.size(query_values(c, k)) > 0, "url.encodeURIComponent": encode_component, "url.decodeURIComponent": decode_component,
    "coerce.Number": lambda c: c.cast("string").try_cast("double"), "coerce.String": lambda c: c.cast("string"), "coerce.Boolean": lambda c: c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0") & (c.cast("string") != "false"),
}
