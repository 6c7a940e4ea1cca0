"""Column functions for names, labels, sheet numbers and attribute strings. All run in the JVM but normalised(), which Spark cannot express."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed format: a sheet number.
SHEET = r"[A-Z]{1,3}\d{5}(?:-\d{1,2})?"

# Names of push buttons that imply a break (b) or a make (a) contact, by word boundaries of Latin letters.
IMPLIES_B = r"(?<![A-Z])(STOP|EMG|EMS|E-?STOP|OFF)(?![A-Z])|停止|非常|切"
IMPLIES_A = r"(?<![A-Z])(START|RUN|ON)(?![A-Z])|起動|運転|入"


def canonical_device(name: Column) -> Column:
    """Upper case, O, I and B as the digits they are misread for: the form by which device names are compared."""
    return F.translate(F.upper(name), "OIB", "018")


def match_key(name: Column) -> Column:
    """squeezed() without spaces, O, Q and I as digits: the form by which read words are compared."""
    return F.translate(F.replace(squeezed(name), F.lit(" "), F.lit("")), "OQI", "001")


def folded(name: Column) -> Column:
    """Both foldings at once, without white space: for joins of names from tables and from drawings."""
    return F.translate(F.regexp_replace(F.upper(name), r"\s+", ""), "OQIB", "0018")


def compact(text: Column) -> Column:
    """squeezed() without any white space; null is the empty text."""
    return F.replace(squeezed(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" "), F.lit(""))


def implied_contact(name: Column) -> Column:
    """a or b by a push button's name; null if it implies both or none."""
    n = squeezed(name)
    b, a = n.rlike(IMPLIES_B), n.rlike(IMPLIES_A)
    return F.when(b & ~a, "b").when(a & ~b, "a")


def contact_kind(given: Column, name: Column, otherwise: str = "a") -> Column:
    """a or b: as given (with or without `contact_`), else as the name implies, else the default."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(given, F.lit("")))), "^contact_", "")
    return F.coalesce(F.when(plain.isin("a", "b"), plain), implied_contact(name), F.lit(otherwise))


def bus_side(name: Column) -> Column:
    """The node a bus name stands for: PER2100 is P_2100 (the supply's positive side; P without a number), NER... is 0; else null."""
    n = F.upper(F.replace(F.coalesce(name, F.lit("")), F.lit(" "), F.lit("")))
    return F.when(n == "PER", "P").when(n.startswith("PER"), F.concat(F.lit("P_"), F.substring(n, 4, 1_000_000))).when(n.startswith("NER"), "0")


def table_numbers(terminal: Column, contact: Column) -> Column:
    """The two terminal numbers that a contact uses of `NO-COM-NC`: common and make for a, common and break for b; else empty."""
    parts = F.split(F.coalesce(terminal, F.lit("")), "-")
    usable = (F.size(parts) == 3) & contact.isin("a", "b")
    used = F.array(F.get(parts, F.lit(1)), F.when(contact == "a", F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2))))
    return F.when(usable, used).otherwise(F.array().cast("array<string>"))


# Labels of these are no tags, whatever sheet they name. The first three are looked for in the label without spaces, equipment in its words too.
BREAKER = "MCCB|NFB|ELB|ACB|VCB|遮断器|ブレーカ"
CARD = r"D[I1L|][O0]-?\d|D[O0]T-?\d|-C[I1L|][RF]-?\d|-C\d[RF]\d"
TERMINAL_UNIT = r"RCVTB|TB\(\d"
EQUIPMENT = r"^\d?R[A-Z]{2,}|\bL[O0]C\b|\bLN[Z2]\b|\bLMZ\b|\dR\s?P/C|盤|装置|ユニット"
# What is no identifier on a tag, and what stands between those.
PARTICLES, BETWEEN = "へ|より|ヘ", r"[\s()（）、,/]+"


def tag_target(class_key: Column, label: Column) -> Column:
    """The sheet that a tag (class `other`) names: in parentheses or alone; null if it names none, and for breakers, cards, terminal units and equipment."""
    tight = compact(label)
    words = F.split(squeezed(F.coalesce(label, F.lit(""))), " ")
    device = tight.rlike(f"{BREAKER}|{CARD}|{TERMINAL_UNIT}") | tight.rlike(EQUIPMENT) | F.exists(words, lambda w: w.rlike(EQUIPMENT))
    found = F.regexp_extract(tight, f"({SHEET})", 1)
    return F.when((class_key == "other") & ~device, F.nullif(found, F.lit("")))


def identifiers(label: Column, target: Column) -> Column:
    """The other words of a tag's label, distinct: without the sheet it names, particles, punctuation and lone dashes."""
    rest = F.replace(squeezed(F.coalesce(label, F.lit(""))), F.coalesce(F.nullif(target, F.lit("")), F.lit("\x01")), F.lit(" "))
    words = F.split(F.regexp_replace(rest, PARTICLES, " "), BETWEEN)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & (w != "-"))))


def squeezed(text: Column) -> Column:
    """Upper case, runs of white space as one space, trimmed; full-width ASCII becomes ASCII."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    narrow = "".join(chr(0x21 + i) for i in range(94)) + " "
    return F.trim(F.regexp_replace(F.upper(F.translate(text, wide, narrow)), r"\s+", " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


@F.pandas_udf(StringType())
def normalised(text: pd.Series) -> pd.Series:
    """squeezed() after full NFKC normalisation."""
    return text.str.normalize("NFKC").str.upper().str.replace(r"\s+", " ", regex=True).str.strip()


def device_key(label: Column) -> Column:
    """The first two words of a label without its parenthesised parts."""
    words = F.split(F.trim(F.regexp_replace(label, r"\([^)]*\)", " ")), r"\s+")
    return F.array_join(F.slice(words, 1, 2), " ")


def first_word_with_letters(label: Column) -> Column:
    """The first word that is not all digits, null if none."""
    return F.try_element_at(F.filter(F.split(F.trim(label), r"\s+"), lambda w: ~w.rlike(r"^\d*$")), F.lit(1))


def sheet_number(sheet_no: Column, name: Column) -> Column:
    """The first sheet number in `sheet_no`, else in `name`, else null."""
    found = lambda c: F.nullif(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), f"({SHEET})", 1), F.lit(""))
    return F.coalesce(found(sheet_no), found(name))


def base_sheet(sheet: Column) -> Column:
    return F.substring_index(sheet, "-", 1)


def safe_name(name: Column) -> Column:
    """Anything but ASCII letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(name, r"[^0-9A-Za-z_]", "_")


def first_kind(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The kind of the first pattern that is found; rules: (kind, pattern) in order of precedence."""
    out = None
    for kind, pattern in rules:
        out = F.when(text.rlike(pattern), kind) if out is None else out.when(text.rlike(pattern), kind)
    return out.otherwise(otherwise)


def states(text: Column) -> Column:
    """`A=1, B=0, C=?` as a map from name to true, false or null (unknown)."""
    pairs = F.filter(F.split(text, r"\s*,\s*"), lambda x: x.contains("="))
    value = lambda v: F.when(v.isin("1", "ON", "on"), F.lit(True)).when(v.isin("0", "OFF", "off"), F.lit(False))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), value(F.trim(F.substring_index(x, "=", -1))))))


def canonical_class(key: Column, aliases: dict[str, str]) -> Column:
    """Lower case, without a `horizontal_` prefix or suffix, aliases replaced."""
    plain = F.regexp_replace(F.lower(F.trim(key)), r"^horizontal_|_horizontal$", "")
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    return F.coalesce(F.try_element_at(table, plain), plain) if aliases else plain


def japan_time(ts: Column) -> Column:
    """A naive UTC time as ISO seconds at the fixed offset +09:00."""
    return F.date_format(ts.cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
