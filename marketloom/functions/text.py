"""Values from advert texts, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the patterns: also the no-break space, which adverts use between digits.
WS = r"[\s\x{00A0}]"

# fixed values: words of the adverts and what they stand for
FUELS = {
    "benzín": "gasoline", "nafta": "diesel", "hybrid": "hybrid", "plug-in hybrid": "phev", "phev": "phev", "elektro": "electric", "elektrické": "electric",
    "benzin": "gasoline", "diesel": "diesel", "elektrický": "electric", "hybridní": "hybrid", "lpg": "lpg", "cng": "cng",
}
GEARBOXES = {"manuálna": "manual", "manual": "manual", "automat": "automatic", "automatická": "automatic", "manuální": "manual"}
FUEL_HINTS = ["benzín", "benzin", "nafta", "diesel", "hybridní", "hybrid", "plug-in", "phev", "elektrické", "elektrický", "elektro", "lpg", "cng"]
REGION_CODES = {"BA": "Bratislavský", "TT": "Trnavský", "TN": "Trenčiansky", "NR": "Nitriansky", "ZA": "Žilinský", "BB": "Banskobystrický", "PO": "Prešovský", "KE": "Košický"}
DIESEL_BADGES = ["tdi", "cdi", "hdi", "dci", "crdi", "bluetec", "d-4d", "dtr", "jtd"]
PETROL_BADGES = ["tsi", "tfsi", "t-gdi", "tgdi", "mpi", "vti", "thp", "fsi"]
PART_STEMS = [
    "narazni", "blatnik", "kapota", "calunenie", "zamok bezpecnostneho pasu", "disky", "elektrony", "sada kolies", "rozpredam", "kupim", "riadiaca jednotka", "alternator",
    "brzdov", "tlmic", "autoradio", "zadne svetlo", "spatne zrkadlo", "potah", "snehove retaze", "autobateria", "nosic bicyklov", "autorohoz", "mriezka",
]
# fixed values: letters with marks and their plain forms
MARKED = "áäàâãåčćçďéěëèêíïìîĺľňñóöôòõŕřśšşťúůüùûýÿžźż"
PLAIN = "aaaaaacccdeeeeeiiiillnnooooorrssstuuuuuyyzzz"


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value of the trimmed, lower-cased text, or null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(c)))


def folded(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def digits_only(c: Column, least: int) -> Column:
    """All digits of the text as one number, or null below ``least``."""
    n = F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint")
    return F.when(n >= least, n)


def crowns(c: Column) -> Column:
    """An amount in crowns; null where the text names another currency."""
    named = F.lower(c).rlike("k[čc]|czk")
    return F.when(named | ~c.contains("€"), digits_only(c, 1))


def to_euro(amount: Column, per_euro: int = 25) -> Column:
    return F.floor(amount / per_euro + F.lit(0.5)).cast("bigint")


def first_year(c: Column, next_year: int) -> Column:
    """The first four digits in a row, if they are a plausible year."""
    y = F.regexp_extract(c, r"([0-9]{4})", 1).try_cast("int")
    return F.when(y.between(1980, next_year), y)


def plausible_year(c: Column, next_year: int) -> Column:
    """The first plausible year among all years of the text."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.get(F.filter(found, lambda y: y.between(1980, next_year)), F.lit(0))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def amount_before(c: Column, unit: str, width: int, least: int, below: int) -> Column:
    """The grouped number before a unit, if within bounds."""
    digits = F.regexp_extract(c, rf"(?i)([0-9][0-9\s\x{{00A0}}]{{1,{width}}}){WS}*{unit}", 1)
    n = F.regexp_replace(digits, WS, "").try_cast("bigint")
    return F.when((n >= least) & (n < below), n)


def euro_in_text(c: Column) -> Column:
    return amount_before(c, "€", 12, 100, 10_000_000)


def crowns_in_text(c: Column) -> Column:
    return amount_before(c, "k[čc]", 12, 1000, 100_000_000)


def km_in_text(c: Column) -> Column:
    return amount_before(c, r"km\b", 8, 0, 2_000_000)


def first_hint(c: Column, hints: list[str]) -> Column:
    """The first hint, in list order, that the text contains."""
    return hint_in(F.lower(c), hints)


def hint_in(low: Column, hints: list[str]) -> Column:
    """``first_hint`` of a text that is in lower case already."""
    return F.coalesce(*[F.when(low.contains(h), F.lit(h)) for h in hints])


def prefixed_region(region: Column, country: str) -> Column:
    r = F.trim(region)
    return F.when(r == "", None).when(r.rlike("^[A-Z]{2}-"), r).otherwise(F.concat(F.lit(f"{country}-"), r))


def shown_region(region: Column) -> Column:
    r = F.trim(region)
    return F.when(r == "", None).otherwise(F.regexp_replace(r, "^[A-Z]{2}-", ""))


def fuel_of_badge(c: Column) -> Column:
    """Diesel badges are looked for first."""
    found = lambda badges: F.lower(c).rlike(rf"\b({'|'.join(badges)})\b")
    return F.when(found(DIESEL_BADGES), "diesel").when(found(PETROL_BADGES), "gasoline")


def region_of_code(c: Column) -> Column:
    """'XX kraj' by its code, else a region's full name in the text."""
    table = F.create_map(*[F.lit(x) for kv in REGION_CODES.items() for x in kv])
    code = F.try_element_at(table, F.regexp_extract(c, r"\b([A-ZŽ]{2})\s+kraj\b", 1))
    return F.coalesce(code, *[F.when(c.contains(n), F.lit(n)) for n in REGION_CODES.values()])


def labelled(c: Column, label: str) -> Column:
    """The value after a label, up to two spaces, a line end, a comma or a semicolon."""
    v = F.trim(F.regexp_extract(c, rf"(?i){label}[\s:.\-]*([^\n,;]+?)(?:\s\s|\n|,|;|$)", 1))
    return F.when(v != "", v)


def vin(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.rlike("^[A-HJ-NPR-Z0-9]{17}$"), v)


def phone(c: Column) -> Column:
    raw = F.regexp_extract(c, r"(\+421\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{3}|\b0[0-9]{2,3}\s?[0-9]{3}\s?[0-9]{3,4}\b)", 1)
    v = F.substring(F.trim(F.regexp_replace(raw, r"\s+", " ")), 1, 32)
    return F.when(v != "", v)


def is_vehicle(title: Column) -> Column:
    """Sizes and rims make a part; a diameter glued to the wheel word names a car's equipment; then the stems decide."""
    t = folded(title)
    part = t.rlike(r"\b[0-9]{3}\s*/\s*[0-9]{2}\s*r\s*[0-9]{2}\b|\b[456]\s*x\s*1[0-3][0-9]([.,][0-9])?\b") | t.rlike(r"\brafik")
    equipment = t.rlike("(1[3-9]|2[0-4])\\s*[\"″']?\\s*disk")
    stem = t.rlike("|".join(PART_STEMS))
    return F.when(title.isNull() | (title == ""), True).when(part, False).when(equipment, True).otherwise(~stem)


def photo_basename(url: Column) -> Column:
    """Last path segment without its extension; 'no-photo' where there is none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    base = F.regexp_replace(last, r"(?i)\.[a-z0-9]{1,5}$", "")
    return F.when(F.coalesce(base, F.lit("")) == "", "no-photo").otherwise(base)


def title_of_slug(url: Column) -> Column:
    """Words of a URL's last segment, each with a capital."""
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/+$", ""), "([^/]*)$", 1), r"\.[a-z]+$", "")
    return F.array_join(F.transform(F.split(last, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of an ASCII text."""
    chars = F.split(c, "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: F.when(x == "", h).otherwise((h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))))


def clamped(c: Column, most: int) -> Column:
    """Over-long values become null, never shorter."""
    return F.when(F.length(c) <= most, c)
