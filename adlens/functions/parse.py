"""Native columns that read values out of advert texts: prices, periods, counts, dates, places, URL shapes. No Python runs on the executors."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as X

#: Words that scale a number, and their factors. Single letters and ``mn`` end at a word's end.
SCALE_WORDS = {"مليون": 1_000_000, "million": 1_000_000, r"mn\b": 1_000_000, r"m\b": 1_000_000, "ألف": 1_000, "الف": 1_000, "آلاف": 1_000, "الاف": 1_000, "thousand": 1_000, r"k\b": 1_000}
#: Bounds of a price, and the lower one of prices by night, week or square metre.
PRICE_MOST, PRICE_LEAST, UNIT_PRICE_LEAST = 999_999_999_999, 100, 5
UNIT_PRICES = ("PER_NIGHT", "PER_WEEK", "PER_SQM")
PERIODS = ("PER_NIGHT", "PER_WEEK", "PER_MONTH", "PER_YEAR")
#: Words for small counts.
COUNT_WORDS = {
    "one": 1, "single": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "غرفة": 1, "غرفه": 1, "واحدة": 1, "واحد": 1, "غرفتين": 2, "غرفتان": 2, "اثنين": 2, "اثنان": 2, "ثلاث": 3, "ثلاثة": 3,
    "أربع": 4, "اربع": 4, "أربعة": 4, "خمس": 5, "خمسة": 5, "ست": 6, "ستة": 6,
}
#: Month names.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "يناير": 1, "فبراير": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "إبريل": 4, "مايو": 5, "يونيو": 6, "يونيه": 6, "يوليو": 7, "يوليه": 7,
    "أغسطس": 8, "اغسطس": 8, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12,
    "كانون الثاني": 1, "شباط": 2, "آذار": 3, "نيسان": 4, "أيار": 5, "حزيران": 6, "تموز": 7, "آب": 8, "أيلول": 9, "تشرين الأول": 10, "تشرين الثاني": 11, "كانون الأول": 12,
}
#: Words of relative time and their seconds (a month is 30 days, a year 365), and the words that mean two.
TIME_UNITS = {
    r"minutes?|mins?|دقيقتين|دقيقة|دقائق": 60, r"hours?|hrs?|ساعتين|ساعات|ساعة": 3_600, r"days?|يومين|أيام|ايام|يوم": 86_400,
    r"weeks?|أسبوعين|اسبوعين|أسابيع|اسابيع|أسبوع|اسبوع": 604_800, r"months?|شهرين|أشهر|اشهر|شهور|شهر": 2_592_000, r"years?|سنتين|سنوات|سنة|أعوام|عام": 31_536_000,
}
DUALS = "دقيقتين|ساعتين|يومين|أسبوعين|اسبوعين|شهرين|سنتين"
TODAY, YESTERDAY, AGO = r"\btoday\b|اليوم|النهارده", r"\byesterday\b|أمس|امس|إمبارح|امبارح", r"\bago\b|منذ|قبل"

#: Fixed pattern: keys of contact data and credentials.
SENSITIVE_KEYS = r"(?i)phone|telephone|email|contact|whatsapp|password|secret|credential|token|session|cookie|authorization|apikey|applicationid|searchkey|runtimeconfig"

_NUMBER = r"(?<![\d.])(\d{1,3}(?:[,\s]\d{3})+|\d+)(\.\d+)?"
_SCALED = rf"(?iu){_NUMBER}(?:\s*({'|'.join(w for w in SCALE_WORDS if len(w.removesuffix(chr(92) + 'b')) > 1)})|(m\b|k\b))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: keeps expressions small."""
    return F.transform(F.array(value), body)[0]


def _plain(text: Column) -> Column:
    return X.ascii_digits(X.clean(text))


def _value(token: Column) -> Column:
    """Of a stretch that the pattern of scaled numbers matches: its value."""
    digits = F.concat(F.regexp_replace(F.regexp_extract(token, _SCALED, 1), r"[,\s]", ""), F.regexp_extract(token, _SCALED, 2))
    word = F.lower(F.concat(F.regexp_extract(token, _SCALED, 3), F.regexp_extract(token, _SCALED, 4)))
    factors = F.create_map(*(F.lit(x) for w, n in SCALE_WORDS.items() for x in (w.removesuffix(r"\b"), n)))
    return (digits.try_cast("decimal(24,6)") * F.coalesce(F.try_element_at(factors, word), F.lit(1))).cast("decimal(30,6)")


def numbers(text: Column) -> Column:
    """Array of all numbers, with thousands separators and scale words applied."""
    return F.transform(F.regexp_extract_all(X.ascii_digits(text), F.lit(_SCALED), F.lit(0)), _value)


def price(text: Column, listing_type: Column | None = None, default_currency: Column | None = None, rent_type: Column | None = None) -> Column:
    """struct(amount, currency, price_type) of a text.

    The text is cut at its currency marker: the last number before and the first after it are candidates, the nearer one counts, the
    earlier one where both are as near. Without a marker the largest number counts. An amount out of bounds is none. What
    the wording doesn't say is by ``rent_type`` (PER_MONTH) for rentals, else TOTAL.
    """
    tokens = lambda part: F.regexp_extract_all(part, F.lit(_SCALED), F.lit(0))
    gaps = lambda part: F.split(part, _SCALED, -1)

    def marker(raw: Column) -> Column:
        """struct(at, n) of the marker that counts, n its place among the currencies: sterling, else the leftmost."""
        marks = F.array(*(F.struct(F.regexp_instr(raw, F.lit(f"(?iu){p}")).alias("at"), F.lit(n).alias("n")) for n, (_, p) in enumerate(X.CURRENCIES)))
        return let(F.filter(marks, lambda m: m["at"] > 0), lambda found: F.coalesce(F.try_element_at(F.filter(found, lambda m: m["n"] == 0), F.lit(1)), F.array_min(found)))

    def nearest(raw: Column, mark: Column) -> Column:
        sides = F.struct(F.substring(raw, F.lit(1), mark["at"] - 1).alias("before"), F.substring(raw, mark["at"], F.length(raw)).alias("after"))
        ends = lambda x: F.struct(
            F.try_element_at(tokens(x["before"]), F.lit(-1)).alias("last"), F.length(F.try_element_at(gaps(x["before"]), F.lit(-1))).alias("left"),
            F.try_element_at(tokens(x["after"]), F.lit(1)).alias("first"), F.length(F.try_element_at(gaps(x["after"]), F.lit(1))).alias("right"),
        )
        near = lambda x: _value(F.when(x["last"].isNotNull() & (x["first"].isNull() | (x["left"] <= x["right"])), x["last"]).otherwise(x["first"]))
        return let(sides, lambda x: let(ends(x), near))

    codes = F.array(*(F.lit(code) for code, _ in X.CURRENCIES))
    base = default_currency if default_currency is not None else F.lit(None).cast("string")
    usual = F.when((listing_type if listing_type is not None else F.lit("")) == "RENT", rent_type if rent_type is not None else F.lit("PER_MONTH")).otherwise("TOTAL")

    def settled(said: Column, code: Column, found: Column) -> Column:
        least = F.when(said.isin(*UNIT_PRICES), UNIT_PRICE_LEAST).otherwise(PRICE_LEAST)
        amount = F.when(found.between(least, PRICE_MOST), F.bround(found, 2).cast("decimal(18,2)"))
        none = F.struct(F.lit(None).cast("decimal(18,2)").alias("amount"), code.alias("currency"), F.when(said == "ON_REQUEST", "ON_REQUEST").otherwise("UNKNOWN").alias("price_type"))
        some = lambda a: F.struct(a.alias("amount"), F.coalesce(code, base).alias("currency"), F.coalesce(F.nullif(said, F.lit("ON_REQUEST")), usual).alias("price_type"))
        return let(amount, lambda a: F.when(a.isNull(), none).otherwise(some(a)))

    def read(raw: Column, mark: Column) -> Column:
        found = F.when(mark.isNotNull(), nearest(raw, mark)).otherwise(F.array_max(F.transform(tokens(raw), _value)))
        said = F.struct(X.price_wording(raw).alias("said"), F.get(codes, mark["n"]).alias("code"), found.alias("found"))
        return let(said, lambda x: settled(x["said"], x["code"], x["found"]))

    return let(_plain(text), lambda raw: let(marker(raw), lambda mark: read(raw, mark)))


def rental_period(text: Column) -> Column:
    """The one period that the text names; null where it names none or several."""
    wording = dict(X.PRICE_WORDING) | {"PER_NIGHT": dict(X.PRICE_WORDING)["PER_NIGHT"] + r"|\bdaily\b"}
    named = lambda raw: F.array_compact(F.array(*(F.when(raw.rlike(f"(?iu){wording[k]}"), k) for k in PERIODS)))
    return let(_plain(text), lambda raw: let(named(raw), lambda kinds: F.when(F.size(kinds) == 1, kinds[0])))


def small_count(text: Column, low: int = 0, high: int = 50) -> Column:
    """A count in digits, within bounds, or the first of the counting words that occurs."""
    words = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in COUNT_WORDS.items()))

    def read(raw: Column, digits: Column) -> Column:
        around = F.concat(F.lit(" "), F.regexp_replace(raw, r"(?U)\W+", " "), F.lit(" "))
        word = let(around, lambda t: F.try_element_at(F.filter(words, lambda x: F.contains(t, F.concat(F.lit(" "), x["w"], F.lit(" ")))), F.lit(1)))["n"]
        number = digits.try_cast("long")
        return F.when(digits != "", F.when(number.between(low, high), number.cast("int"))).otherwise(word)

    return let(F.lower(_plain(text)), lambda raw: let(F.regexp_extract(raw, r"\d+", 0), lambda digits: read(raw, digits)))


def _moment(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, hour if hour is not None else zero, minute if minute is not None else zero, zero)


def listed_at(text: Column, captured_at: Column) -> Column:
    """A moment (UTC, without zone) said in numbers of seconds, as a date with or without a year, or relative to the capture.

    Of dates without a year the latest up to a day after the capture is meant. Moments before 1995 or over two days after the capture are none.
    """
    given = F.struct(F.lower(_plain(text)).alias("raw"), captured_at.cast("timestamp_ntz").alias("seen"))
    return let(given, lambda x: _listed_at(x["raw"], x["seen"]))


def _listed_at(raw: Column, seen: Column) -> Column:
    part = lambda pattern, n: F.regexp_extract(raw, pattern, n)
    number = lambda pattern, n: part(pattern, n).try_cast("int")
    or_zero = lambda c: F.coalesce(c, F.lit(0))

    stamp = F.when(raw.rlike(r"^\d{9,13}(\.\d+)?$"), raw.try_cast("double"))
    epoch = F.timestamp_seconds(F.when(stamp > 1e11, stamp / 1000).otherwise(stamp)).cast("timestamp_ntz")
    iso = r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[t\s](\d{1,2}):(\d{2}))?"
    ways = [epoch, _moment(number(iso, 1), number(iso, 2), number(iso, 3), or_zero(number(iso, 4)), or_zero(number(iso, 5)))]
    month_of = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    for pattern, day, month, year in (
        (rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?\s+({names})\.?,?(?:\s+(\d{{4}}))?", 1, 2, 3),
        (rf"({names})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?!\d)(?:,?\s+(\d{{4}}))?", 2, 1, 3),
    ):
        said = F.struct(F.try_element_at(month_of, part(pattern, month)).alias("m"), number(pattern, day).alias("d"), number(pattern, year).alias("y"))
        late = lambda x: F.coalesce(_moment(F.year(seen), x["m"], x["d"]) > seen + F.expr("INTERVAL 1 DAY"), F.lit(False)).cast("int")
        ways.append(let(said, lambda x: _moment(F.coalesce(x["y"], F.year(seen) - late(x)), x["m"], x["d"])))
    sums = r"(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})(?!\d)"
    swapped = lambda x: (x["b"] > 12) & (x["a"] <= 12)
    ways.append(let(
        F.struct(number(sums, 1).alias("a"), number(sums, 2).alias("b"), number(sums, 3).alias("y")),
        lambda x: _moment(F.when(x["y"] < 100, x["y"] + 2000).otherwise(x["y"]), F.when(swapped(x), x["a"]).otherwise(x["b"]), F.when(swapped(x), x["b"]).otherwise(x["a"])),
    ))
    ways += [F.when(raw.rlike(f"(?u){TODAY}"), seen), F.when(raw.rlike(f"(?u){YESTERDAY}"), seen - F.expr("INTERVAL 1 DAY"))]
    back = F.lit(0).cast("long")
    for words, seconds in TIME_UNITS.items():
        count = lambda t: F.coalesce(F.regexp_extract(t, r"^\d+", 0).try_cast("long"), F.when(t.rlike(DUALS), 2).otherwise(1))
        back = back + seconds * F.aggregate(F.regexp_extract_all(raw, F.lit(rf"(?u)(?:\d+\s*)?(?:{words})"), F.lit(0)), F.lit(0).cast("long"), lambda total, t: total + count(t))
    ago = let(back, lambda seconds: F.when(seconds > 0, seen - F.make_dt_interval(secs=seconds)))
    ways.append(F.when(raw.rlike(f"(?u){AGO}"), ago))
    plausible = lambda when: F.when((F.year(when) >= 1995) & (seen.isNull() | (when <= seen + F.expr("INTERVAL 2 DAYS"))), when)
    return let(F.coalesce(*ways), plausible)


def _bare_letters() -> tuple[str, str]:
    """Latin and Arabic letters with marks, and the letters without, by Unicode's decompositions; besides, two Arabic letters that are written alike."""
    pairs = {"ة": "ه", "ى": "ي"}
    for code in (*range(0xC0, 0x250), *range(0x620, 0x6D4), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            pairs[chr(code)] = bare
    return "".join(pairs), "".join(pairs.values())


_MARKED, _BARE = _bare_letters()


def fold_place(text: Column) -> Column:
    """Place name for comparison: no marks, lower case, single spaces in place of punctuation."""
    bare = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}", ""), _MARKED, _BARE)
    return F.trim(F.regexp_replace(F.lower(bare), r"(?U)[\s\-_,./|()'’`]+", " "))


def folded_place(name: str) -> str:
    """``fold_place`` of a constant."""
    bare = re.sub(r"[\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670]", "", name).translate(str.maketrans(_MARKED, _BARE))
    return re.sub(r"[\s\-_,./|()'’`]+", " ", bare.lower()).strip()


def named_place(text: Column, aliases: Mapping[str, Sequence[str]], coarse: Sequence[str] = ()) -> Column:
    """The place one of whose names occurs as whole words: finer places before ``coarse`` ones, longer names first."""
    table = [(a, name) for name, more in aliases.items() for a in (name, *more)]
    if not table:
        return F.lit(None).cast("string")
    # Names are folded here, once; the table is part of the plan.
    folded = sorted({(name in coarse, -len(f), f, name) for a, name in table if (f := folded_place(a))})
    entries = F.array(*(F.struct(F.lit(f" {alias} ").alias("alias"), F.lit(name).alias("name")) for _, _, alias, name in folded))
    words = F.concat(F.lit(" "), fold_place(text), F.lit(" "))
    return let(words, lambda w: F.try_element_at(F.filter(entries, lambda e: F.contains(w, e["alias"])), F.lit(1))["name"])


def is_named(text: Column, names: Sequence[str]) -> Column:
    """Whether the text is one of the names."""
    return fold_place(text).isin(*map(folded_place, names)) if names else F.lit(False)


LOCALES = ("en", "ar", "fr", "de", "es")


def url_shape(url: Column) -> Column:
    """Coarse pattern of URLs that should be routed alike: host, two literal segments, shape of the last, depth, parameters.

    Words of the last segment that hold a digit, or mix cases over five letters and more, are X; a sub-domain is a star.
    """
    segments = F.filter(F.split(X.path(url), "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(X.query_string(url), "&"), lambda q: q != ""), lambda q: F.split(q, "=")[0])))
    parts = F.struct(X.host(url).alias("host"), plain.alias("path"), F.transform(plain, lambda s: F.lower(s)).alias("low"), names.alias("names"))
    odd = lambda t: t.rlike(r"(?U)\d") | ((F.length(t) >= 5) & t.rlike(r"^\p{ASCII}+$") & (F.lower(t) != t) & (F.upper(t) != t))

    def site(host: Column) -> Column:
        deep = lambda labels: (F.size(labels) > 3) & ~labels[0].isin("m", "mobile")
        return let(F.split(host, r"\."), lambda labels: F.when(deep(labels), F.concat(F.lit("*."), F.array_join(F.slice(labels, 2, F.size(labels)), "."))).otherwise(host))

    def tail(last: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(last, r"([-_.])", "\u0001$1\u0001"), "\u0001"), lambda t: t != "")
        shape = F.array_join(F.transform(words, lambda t: F.when(t.isin("-", "_", "."), t).when(odd(t), "X").otherwise(F.lower(t))), "")
        shape = F.regexp_replace(F.regexp_replace(shape, r"(?:-X)+", "-X"), r"[^\x00-\x7f]+", "U")
        file = lambda s: F.when(s.rlike(r"X\.[a-z0-9]{2,5}$"), "*-X").otherwise("*")
        suffix = lambda s: F.regexp_extract(s, r"\.[a-z0-9]{2,5}$", 0)
        marks = lambda s: F.concat(F.lit("*"), F.regexp_extract(s, r"((?:[-_](?:[a-z]{1,4}[-_])?X)+)$", 1))
        return let(shape, lambda s: F.when(suffix(s) != "", F.concat(file(s), suffix(s))).otherwise(marks(s)))

    def pattern(x: Column, locale: Column) -> Column:
        skip = F.when(locale, 1).otherwise(0)
        depth = F.size(x["low"]) - skip
        lead = F.slice(x["low"], skip + 1, F.least(F.greatest(depth - 1, F.lit(0)), F.lit(2)))
        literal = F.array_join(F.transform(lead, lambda s: F.when(s.rlike("^[a-z][a-z-]*$") | (F.length(s) <= 3), s).otherwise("*")), "/")
        start = F.rtrim(F.concat(site(x["host"]), F.lit("/"), F.when(locale, F.concat(x["low"][0], F.lit("/"))).otherwise(""), literal), F.lit("/"))
        end = F.when(F.size(x["path"]) == 0, "").otherwise(tail(F.try_element_at(x["path"], F.lit(-1))))
        query = F.when(F.size(x["names"]) > 0, F.concat(F.lit("|q:"), F.array_join(x["names"], ","))).otherwise("")
        return F.concat(start, F.lit("/"), end, F.lit("|d"), depth.cast("string"), query)

    return let(parts, lambda x: let(F.coalesce(F.try_element_at(x["low"], F.lit(1)).isin(*LOCALES), F.lit(False)), lambda locale: pattern(x, locale)))


def city_district(label: Column, cities: Sequence[str], city_of: Mapping[str, str], country: str = "Egypt") -> Column:
    """struct(city, district, unresolved) of a label like ``place, parent``.

    A parent is a city or a district of a known city; any other is a district that stays unresolved. A place without a parent is a city, or
    unresolved, unless it is the country.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    place, parent = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    alone = F.size(parts) < 2
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in {**{c: c for c in cities}, **city_of}.items() for x in pair)), parent)
    is_city = F.coalesce(parent.isin(*cities), F.lit(False))
    district = F.when(~alone, F.when(is_city, F.nullif(place, parent)).otherwise(parent))
    lost = F.when(F.when(alone, ~is_city & (place != country)).otherwise(known.isNull()), parent)
    return F.struct(F.when(is_city | ~alone, known).alias("city"), district.alias("district"), lost.alias("unresolved"))


def sensitive(key: Column) -> Column:
    """Whether a key, by its letters alone, names contact data or credentials."""
    return F.regexp_replace(key, "[^a-zA-Z]", "").rlike(SENSITIVE_KEYS)


def redact_nested(value: Column, kind: T.DataType) -> Column:
    """Texts redacted at any depth of a column of this type; fields and map entries with sensitive keys are left out."""
    if isinstance(kind, T.StringType):
        return X.redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda k, v: ~sensitive(k)), lambda k, v: redact_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if not re.search(SENSITIVE_KEYS, re.sub("[^a-zA-Z]", "", f.name))]
        return F.when(value.isNotNull(), F.struct(*(redact_nested(value[f.name], f.dataType).alias(f.name) for f in kept)))
    return value
