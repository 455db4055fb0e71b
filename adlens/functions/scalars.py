"""Native column functions: digits, numbers, prices, areas, URLs, redaction. No Python runs on the executors."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed tables: Arabic-Indic and Persian digits with the Arabic thousands and decimal separators, and what they stand for.
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬٫", "01234567890123456789,."
#: Fixed: currency markers; sterling before pound.
CURRENCIES = (
    ("GBP", r"\bGBP\b|استرليني|إسترليني|sterling"),
    ("EGP", r"ج\s*\.?\s*م|جنيه|جنية|E£|\bL\.?E\b|\bEGP\b|egyptian\s+pounds?"),
    ("USD", r"US\$|\$|\bUSD\b|دولار|dollars?"),
    ("EUR", r"€|\bEUR\b|يورو|euros?"),
    ("AED", r"\bAED\b|درهم"),
    ("SAR", r"\bSAR\b|ريال"),
)
#: Fixed: wording of price types, in order of precedence.
PRICE_WORDING = (
    ("ON_REQUEST", r"call\s+for\s+price|price\s+on\s+request|on\s+request|على\s+الاتصال|السعر\s+عند\s+الاتصال"),
    ("INSTALLMENT", r"مقدم|قسط|اقساط|أقساط|تقسيط|down\s*payment|installments?"),
    ("PER_NIGHT", r"per\s+night|/\s*night|nightly|ليلة|يومي|per\s+day|/\s*day"),
    ("PER_WEEK", r"per\s+week|/\s*week|weekly|أسبوع|اسبوع"),
    ("PER_MONTH", r"per\s+month|/\s*mo(?:nth)?|monthly|شهري|شهريا|بالشهر|في\s+الشهر"),
    ("PER_YEAR", r"per\s+year|/\s*year|yearly|annual|سنوي|سنويا"),
    ("PER_SQM", r"per\s+(?:sq\.?\s*)?m|/\s*m2|/\s*sqm|للمتر|المتر"),
)
#: Fixed patterns: wording of instalments, e-mail addresses, Egyptian and international telephone numbers.
INSTALLMENT_FLAG = r"\bdown\s*payments?\b|\binstal?lments?\b|\bdp\b|مقدم|تقسيط|قسط|أقساط"
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\w)(?:\+?20[\s.-]?)?01[0125](?:[\s.-]?\d){8}(?!\w)"
INTERNATIONAL = r"(?<!\w)\+\d(?:[\s().-]?\d){7,14}(?!\w)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def clean(text: Column) -> Column:
    """Common entities decoded, white space collapsed, trimmed; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def first_number(text: Column) -> Column:
    """First number with its thousands separators and scale word applied, as decimal(30,6); null without one, or where it has over 24 digits before the point.

    ``m`` and ``k`` count in either case where they follow a digit and no letter, digit or underscore follows them.
    """
    raw = ascii_digits(text)
    end = r"(?![\p{L}\p{N}_])"
    # Case by hand: Java's folding would take dotted and dotless Turkish letters for i.
    pattern = rf"(?i)(?<![\d.])(\d{{1,3}}(?:[,\s]\d{{3}})+|\d+)(\.\d+)?(?:\s*(مليون|million|mn{end}|ألف|الف|آلاف|الاف|thou[sſ]and)|(m{end}|[k\u212A]{end}))?"

    def value(found: Column) -> Column:
        part = lambda n: F.regexp_extract(found, pattern, n)
        scale = F.lower(F.concat(part(3), part(4)))
        factor = F.when(scale.isin("مليون", "million", "mn", "m"), 1_000_000).when(scale == "", 1).otherwise(1_000)
        return (F.concat(F.regexp_replace(part(1), r"[,\s]", ""), part(2)).try_cast("decimal(30,6)") * factor).try_cast("decimal(30,6)")

    # A text is searched once, one without a digit not even that.
    once = F.transform(F.array(F.regexp_extract(raw, pattern, 0)), lambda found: F.when(found != "", value(found)))[0]
    return F.when(text.rlike("[0-9٠-٩۰-۹]"), once)


def currency(text: Column) -> Column:
    """Code of the leftmost marker; sterling wins where it occurs at all before others are looked at."""
    raw = ascii_digits(text)
    best = F.lit(None).cast("string")
    at = [(code, F.regexp_instr(raw, F.lit(f"(?iu){p}"))) for code, p in CURRENCIES]
    first = F.array_min(F.filter(F.array(*(F.struct(i.alias("at"), F.lit(n).alias("n"), F.lit(c).alias("code")) for n, (c, i) in enumerate(at))), lambda x: x["at"] > 0))
    best = F.when(at[0][1] > 0, F.lit("GBP")).otherwise(first["code"])
    return best


def price_wording(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PRICE_WORDING):
        out = F.when(ascii_digits(text).rlike(f"(?iu){pattern}"), kind).otherwise(out)
    return out


def area_sqm(text: Column) -> Column:
    """Square metres within 5 to a million, two places; square feet are converted."""
    raw = ascii_digits(clean(text))
    number = F.regexp_replace(F.regexp_extract(raw, r"(?<![\d.])(\d{1,3}(?:[,\s]\d{3})+|\d+)(?:\.(\d+))?", 0), r"[,\s]", "").try_cast("decimal(24,6)")
    feet = raw.rlike(r"(?iu)sq\.?\s*ft|square\s+feet|ft2|ft²|قدم")
    out = F.round(number * F.when(feet, F.lit("0.092903").cast("decimal(10,6)")).otherwise(F.lit("1").cast("decimal(10,6)")), 2)
    return F.when(out.between(5, 1_000_000), out)


def sparse_number(text: Column) -> Column:
    """``10+`` is 10, ``1,250`` is 1250."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("long")


def redact(text: Column) -> Column:
    out = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[redacted]")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(out, PHONE, "[redacted]"), INTERNATIONAL, "[redacted]")


def _with_scheme(url: Column) -> Column:
    raw = F.trim(url)
    return F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("http://"), F.ltrim(raw, F.lit("/"))))


def host(url: Column) -> Column:
    """Lower-case host without user, port, final dot and a leading ``www``."""
    authority = F.regexp_extract(_with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.rtrim(F.lower(authority), F.lit(".")), r"^www\d*\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(_with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(_with_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def surt_key(url: Column) -> Column:
    """Archive key: host labels reversed, path without a final slash, sorted query, all lower case; escapes in the query are kept."""
    port = F.regexp_extract(_with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)(?=[/?#]|$)", 1)
    scheme = F.lower(F.regexp_extract(_with_scheme(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    labels = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    where = F.coalesce(F.nullif(F.rtrim(path(url), F.lit("/")), F.lit("")), F.lit("/"))
    pairs = F.array_sort(F.filter(F.split(query_string(url), "&"), lambda x: x != ""))
    pairs = F.transform(pairs, lambda x: F.regexp_replace(x, "=$", ""))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.lower(F.concat(labels, F.when(~usual, F.concat(F.lit(":"), port)).otherwise(""), F.lit(")"), where, query))


def is_site_root(url: Column) -> Column:
    return (F.trim(path(url), F.lit("/")) == "") & (query_string(url) == "")


def within_domain(url: Column, domain: str) -> Column:
    h = host(url)
    return (h == domain.lower()) | h.endswith("." + domain.lower())


def canonical_id(url: Column, patterns: list[str], rejects: list[str] = []) -> Column:  # noqa: B006
    """First group of the first pattern that matches; null for roots and rejected URLs. Patterns need a group."""
    out = F.coalesce(*(F.nullif(F.regexp_extract(url, f"(?iu){p}", 1), F.lit("")) for p in patterns))
    no = is_site_root(url)
    for p in rejects:
        no = no | url.rlike(f"(?iu){p}")
    return F.when(~no, out)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two 16-digit hexadecimal fingerprints; 64 where one is malformed."""
    bad = ~(a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$"))
    return F.when(F.coalesce(bad, F.lit(True)), 64).otherwise(F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long"))))


def email(text: Column) -> Column:
    return F.lower(F.trim(text))


def token_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def point_in_box(text: Column, lat: tuple[float, float], lon: tuple[float, float]) -> Column:
    """``lon,lat`` as struct(lat, lon), null outside the box."""
    parts = F.split(text, ",")
    x, y = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double"), F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    return F.when(y.between(*lat) & x.between(*lon), F.struct(y.alias("lat"), x.alias("lon")))


def place_of_label(label: Column, cities: list[str], city_of: dict[str, str], whole: str) -> Column:
    """``place, ..., parent`` as struct(name, city, district, unresolved); no place, or ``whole`` alone, is the whole country.

    The last part is a city of ``cities``, or a district whose city ``city_of`` knows, or else unresolved.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), ","), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    first, last = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1))
    several, one = F.size(parts) >= 2, (F.size(parts) == 1) & (first != whole)
    is_city = F.coalesce(last.isin(cities), F.lit(False))
    above = F.try_element_at(F.create_map(*(F.lit(x) for pair in city_of.items() for x in pair)), last) if city_of else F.lit(None).cast("string")
    city = F.when((several | one) & is_city, last).when(several, above)
    district = F.when(several & is_city, F.nullif(first, last)).when(several, last)
    unresolved = F.when((several & above.isNull() | one) & ~is_city, last)
    return F.struct(F.when(several | one, first).otherwise(whole).alias("name"), city.alias("city"), district.alias("district"), unresolved.alias("unresolved"))


def drop_reason(problem: Column) -> Column:
    """``item 3: identity conflict: ...`` is ``identity conflict``."""
    return F.trim(F.element_at(F.split(F.regexp_replace(problem, r"^item \d+:\s*", ""), ":"), 1))


def script_of(text: Column) -> Column:
    """Arabic or Latin by which letters are more."""
    ar, la = F.regexp_count(text, F.lit(r"[؀-ۿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(ar > la, "ar").when(la > 0, "latin")
