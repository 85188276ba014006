"""Numbers, texts and dates with the reference's semantics, as Columns.

Numbers are doubles; a number is text without a fraction if it is whole. Dates are
read in the session's time zone. Every builder is null-safe as stated.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the numeric texts that count as numbers.
NUMBER_PATTERN = r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"
#: Texts that convert to a number when compared: decimal, with optional sign, fraction and exponent.
LITERAL_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def round_half_up(n: Column, places: int = 0) -> Column:
    """Rounds to ``places``, ties toward positive infinity."""
    scale = float(10**places)
    return F.floor(n * scale + 0.5).cast("double") / scale


def number_text(n: Column) -> Column:
    """A number as text: whole numbers without a fraction, others in shortest form."""
    n = n.cast("double")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(F.isnan(n), "NaN").when(whole, F.floor(n).cast("string")).otherwise(n.cast("string"))


def percent_text(part: Column, whole: Column, places: int = 0) -> Column:
    """part / whole in percent, ``(-)`` if whole is 0."""
    share = round_half_up(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100, places)
    return F.when(whole == 0, F.lit("(-)")).otherwise(F.concat(number_text(share), F.lit("%")))


def locale_number(n: Column, places: int = 0) -> Column:
    """Grouped digits with fixed places, ties away from zero; NaN and null count as 0."""
    n = F.nanvl(F.coalesce(n.cast("double"), F.lit(0.0)), F.lit(0.0))
    scale = float(10**places)
    return F.format_number(F.signum(n) * F.floor(F.abs(n) * scale + 0.5) / scale, places)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return lon - 360 * F.floor((lon + 180) / 360)


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER_PATTERN), F.lit(False))


def to_number(text: Column) -> Column:
    """NaN where the text is no number."""
    return F.when(is_number(text), F.try_to_number_double(text) if hasattr(F, "try_to_number_double") else F.trim(text).try_cast("double")).otherwise(F.lit(float("nan")))


def to_safe_number(text: Column) -> Column:
    """0 where the text is no number."""
    return F.nanvl(to_number(text), F.lit(0.0))


def hex_byte(n: Column) -> Column:
    """Two lower-case hexadecimal digits of 0 to 255; null outside."""
    return F.when(n.between(0, 255), F.lower(F.lpad(F.hex(n.cast("bigint")), 2, "0")))


def text_hash(text: Column) -> Column:
    """The unsigned 32-bit multiply-and-xor hash over characters from last to first; 5381 for ''."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))
    folded = F.aggregate(F.reverse(chars), F.lit(5381).cast("bigint"), lambda h, c: (h * 33).bitwiseXOR(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(text == "", F.lit(5381).cast("bigint")).otherwise(folded)


def keyed_guid(key: Column) -> Column:
    """A random guid with a key character at position 15."""
    return F.overlay(F.uuid(), F.substring(key, 1, 1), 15, 1)


def is_guid(text: Column) -> Column:
    return (F.char_length(text) >= 36) & text.rlike("-.*-.*-.*-")


def guid_key(guid: Column) -> Column:
    return F.substring(guid, 15, 1)


def pretty_date(ts: Column) -> Column:
    """``Mmm D, YYYY at H:MM AM``; midnight prints hour 0, noon 12; null: ``unknown``."""
    hour = F.hour(ts)
    clock = F.concat(F.when(hour > 12, hour - 12).otherwise(hour).cast("string"), F.date_format(ts, ":mm"), F.when(hour >= 12, F.lit(" PM")).otherwise(F.lit(" AM")))
    return F.when(ts.isNull(), "unknown").otherwise(F.concat(F.date_format(ts, "MMM d, yyyy"), F.lit(" at "), clock))


def wordy_date(ts: Column, now: Column) -> Column:
    """A pretty date, with ``today `` in front on the day of ``now``."""
    return F.concat(F.when(F.to_date(ts) == F.to_date(now), "today ").otherwise(""), pretty_date(ts))


def relative_date(ts: Column, now: Column) -> Column:
    """``Today at`` the time, the day in this year, or the full date."""
    hour = F.hour(ts)
    clock = F.concat(F.when(hour > 12, hour - 12).otherwise(hour).cast("string"), F.date_format(ts, ":mm"), F.when(hour >= 12, F.lit(" PM")).otherwise(F.lit(" AM")))
    day = F.when(F.year(ts) == F.year(now), F.date_format(ts, "MMM d")).otherwise(F.date_format(ts, "MMM d, yyyy"))
    return F.when(ts.isNull(), "unknown").when(F.to_date(ts) == F.to_date(now), F.concat(F.lit("Today at "), clock)).otherwise(day)


def recent_date(ts: Column, now: Column) -> Column:
    """Minutes or hours ago (rounded, plus one) within a day, else the relative date; null: ``u``."""
    ms = F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))
    minutes, hours = F.floor(ms / 60_000 + 0.5) + 1, F.floor(ms / 3_600_000 + 0.5) + 1
    return (
        F.when(ts.isNull(), "u")
        .when(ms < 3_600_000, F.concat(minutes.cast("string"), F.lit("m")))
        .when(ms < 86_400_000, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(relative_date(ts, now))
    )


def text_to_html(text: Column) -> Column:
    """Lines as paragraphs; runs of lines that start with ``|`` as one table."""
    cells = lambda line: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(F.regexp_replace(line, r"^\||\|\s*$", ""), r"\|"), lambda c: F.concat(F.lit("<td>"), F.trim(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("table"))

    def step(acc: Column, line: Column) -> Column:
        row = line.startswith("|")
        opened = F.when(row & ~acc["table"], "<table>").when(~row & acc["table"], "</table>").otherwise("")
        body = F.when(row, cells(line)).otherwise(F.concat(F.lit("<p>"), line, F.lit("</p>")))
        return F.struct(F.concat(acc["out"], opened, body).alias("out"), row.alias("table"))

    return F.aggregate(F.split(text, "\r?\n"), start, step, lambda acc: F.concat(acc["out"], F.when(acc["table"], "</table>").otherwise("")))


def size_of(*columns: tuple[Column, str]) -> Column:
    """Approximate bytes of flat values by type name: 8 a number, 4 a boolean, 2 a character."""
    parts = []
    for c, kind in columns:
        each = F.char_length(c) * 2 if kind == "string" else F.lit(4 if kind == "boolean" else 8)
        parts.append(F.when(c.isNull(), 0).otherwise(each))
    return reduce(lambda a, b: a + b, parts)


def is_empty(value: Column) -> Column:
    """Null, or a map or array without entries."""
    return value.isNull() | (F.size(value) == 0)


def count_keys(m: Column) -> Column:
    """Entries of a map; -1 for null."""
    return F.when(m.isNull(), -1).otherwise(F.size(m))


def nth_key(m: Column, n: int = 0) -> Column:
    """The key of entry ``n`` in the map's order, the first for negative ``n``; null beyond the last."""
    return F.get(F.map_keys(m), F.lit(max(n, 0)))


def nth_value(m: Column, n: int = 0) -> Column:
    """The value of entry ``n`` in the map's order, the first for negative ``n``; null beyond the last."""
    return F.get(F.map_values(m), F.lit(max(n, 0)))


def shallow_equal(a: Column, b: Column) -> Column:
    """Whether two maps have the same keys with the same values; null equals null."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return entries(a).eqNullSafe(entries(b))


def partial_equal(wanted: dict[str, object]) -> Column:
    """All named columns equal the given values; null equals null."""
    return reduce(and_, (F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()), F.lit(True))


def near(a: Column, b: Column, epsilon: float) -> Column:
    """Equal within ``epsilon``; null equals null."""
    return F.coalesce(F.abs(a - b) <= epsilon, a.isNull() & b.isNull())


def map_overlay(low: Column, high: Column) -> Column:
    """A map with the entries of ``high`` over those of ``low``."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k))), F.map_entries(high)))


def map_without(m: Column, keys: Column) -> Column:
    """A map without the entries whose keys are in ``keys``."""
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def key_diff(old: Column, new: Column) -> Column:
    """Sorted keys of ``new`` that are not in ``old`` or have another value."""
    return F.array_sort(F.map_keys(F.map_filter(new, lambda k, v: ~F.coalesce(F.try_element_at(old, k).eqNullSafe(v) & F.map_contains_key(old, k), F.lit(False)))))


def sorted_set(values: Column) -> Column:
    """Distinct non-empty texts in case-insensitive order."""
    upper = F.transform(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), lambda x: F.struct(F.upper(x).alias("u"), x.alias("x")))
    return F.transform(F.array_sort(upper), lambda s: s["x"])


def bits_of(members: Column, domain: list[str]) -> Column:
    """Members of a fixed domain as bytes, lowest bit first; unknown members are ignored."""
    out = []
    for lo in range(0, len(domain), 8):
        bits = [F.when(F.array_contains(members, d), 1 << n).otherwise(0) for n, d in enumerate(domain[lo : lo + 8])]
        out.append(F.lpad(F.hex(reduce(lambda a, b: a + b, bits).cast("bigint")), 2, "0"))
    return F.unhex(F.concat(*out)) if out else F.lit(b"")


def members_of(bits: Column, domain: list[str]) -> Column:
    """Members of the domain whose bits are set, in domain order."""
    digits = F.hex(bits)
    found = []
    for n, d in enumerate(domain):
        byte = F.conv(F.substring(digits, 2 * (n // 8) + 1, 2), 16, 10).cast("int")
        found.append(F.when(byte.bitwiseAND(1 << (n % 8)) != 0, F.lit(d)))
    return F.array_compact(F.array(*found))


def bit_string(members: Column, domain: list[str]) -> Column:
    """Members of a domain as the base64 text of their bits."""
    return F.base64(bits_of(members, domain))


def members_of_string(text: Column, domain: list[str]) -> Column:
    """Members of a domain from the base64 text of their bits."""
    return members_of(F.unbase64(text), domain)


def hash_object(value: Column) -> Column:
    """The text hash of a value's JSON; of '' for null."""
    return text_hash(F.when(value.isNull(), "").otherwise(F.to_json(value)))


def depth_of(value: Column, kind: T.DataType) -> Column:
    """How deep a value nests by its first elements: 1 for plain values and null, 2 for an empty list or object, one more than its first element else."""
    if isinstance(kind, T.ArrayType):
        inner = F.when(F.size(value) == 0, 2).otherwise(1 + depth_of(F.get(value, F.lit(0)), kind.elementType))
    elif isinstance(kind, T.MapType):
        inner = F.when(F.size(value) == 0, 2).otherwise(1 + depth_of(F.get(F.map_values(value), F.lit(0)), kind.valueType))
    elif isinstance(kind, T.StructType) and kind.fields:
        inner = 1 + depth_of(value[kind.fields[0].name], kind.fields[0].dataType)
    else:
        return F.lit(1)
    return F.when(value.isNull(), 1).otherwise(inner)


def marked(values: Column) -> Column:
    """Marks of a map of ids to true, false or null: false ones and the empty id are no marks, null is one that is undetermined."""
    return F.map_filter(values, lambda k, v: (k != "") & ~F.coalesce(~v, F.lit(False)))


def undetermined(marks: Column, key: Column) -> Column:
    """Whether an id is marked, but not as true."""
    return F.map_contains_key(marks, key) & F.try_element_at(marks, key).isNull()
