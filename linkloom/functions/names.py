"""Channel-name column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions.text import any_of, contains_any, let, literal_pairs, strip


#: Traditional characters and their simplified forms, one by one.
CHARACTERS = (rules.TRADITIONAL, rules.SIMPLIFIED)


def simplify(name: Column, table: tuple[str, str] = CHARACTERS) -> Column:
    """Replace characters by the supplied traditional-to-simplified table."""
    return F.translate(name, *table)


def is_blacklisted(name: Column, words: Sequence[str] = tuple(rules.BLACKLIST), ignore_case: bool = True) -> Column:
    return contains_any(name, words, ignore_case)


def is_overseas(name: Column, words: Sequence[str] = tuple(rules.OVERSEAS_KEYWORDS)) -> Column:
    return contains_any(name, words, ignore_case=True)


def probe_timeout(name: Column, domestic: int = 8, overseas: int = 15) -> Column:
    return F.when(is_overseas(name), overseas).otherwise(domestic).cast("bigint")


def has_live_word(name: Column) -> Column:
    return name.rlike(rules.LIVE_NAME_PATTERN)


def clean(name: Column) -> Column:
    """Remove brackets, quality marks, source marks, dates and decoration."""
    out = name
    for pattern in rules.NAME_NOISE:
        out = F.regexp_replace(out, f"(?iU){pattern}", "")
    out = F.regexp_replace(out, r"(?U)[\s_·•]+", "")
    return strip(F.regexp_replace(out, r"(?U)^[\s_·•\-]+|[\s_·•\-]+$", ""))


def apply_aliases(name: Column, aliases: Sequence[tuple[str, str]] = tuple(rules.ALIASES)) -> Column:
    """Exact alias if there is one, else replace the first alias (in table order) contained."""
    table = literal_pairs(aliases)

    def replaced(n):
        inside = F.filter(table, lambda z: F.contains(n, z["a"]))
        exact = F.get(F.filter(inside, lambda z: n == z["a"]), F.lit(0))["b"]
        partial = let(F.get(inside, F.lit(0)), lambda f: F.replace(n, f["a"], f["b"]))
        return F.coalesce(exact, partial)

    some = any_of(a for a, _ in aliases)
    return let(name, lambda n: F.when(n.rlike(some), replaced(n)).otherwise(n))


def canonical_channel(name: Column) -> Column:
    """Strip programme-type and quality suffixes and force the numbered form."""
    kinds = "|".join(rules.CCTV_TYPE_SUFFIXES)
    marks = "|".join(rules.QUALITY_SUFFIXES)
    out = F.regexp_replace(name, rf"(?U)^(CCTV-?\d+\+?)(?:{kinds})?$", "$1")
    out = F.regexp_replace(out, r"(?U)^CCTV(\d+\+?)$", "CCTV-$1")
    out = F.regexp_replace(out, rf"(卫视|电视)(?:{marks})?$", "$1")
    return F.regexp_replace(out, r"(?U)\s+", "")


def normalize(
    name: Column, aliases: Sequence[tuple[str, str]] = tuple(rules.ALIASES), characters: tuple[str, str] = CHARACTERS
) -> Column:
    """Grouping key of a channel name."""
    return canonical_channel(apply_aliases(clean(F.upper(simplify(name, characters))), aliases))


def display(name: Column, characters: tuple[str, str] = CHARACTERS) -> Column:
    """Name shown to users; numbered channels get their canonical label."""
    numbered = r"(?iU)^CCTV[-\s]*(\d+)(\+)?"

    def label(cleaned):
        number = F.regexp_extract(cleaned, numbered, 1)
        plus = F.regexp_extract(cleaned, numbered, 2)
        out = F.when(~cleaned.rlike(numbered), cleaned)
        for n, word, shown in rules.CCTV_LABELS:
            in_name = F.contains(name, F.lit(word))
            if n == 5:
                hit = in_name & (number == "5")
                out = out.when(hit, F.concat(F.lit("CCTV-5"), plus, F.lit(shown)))
            else:
                out = out.when(in_name | (number == str(n)), F.lit(f"CCTV-{n}{shown}"))
        return out.otherwise(F.concat(F.lit("CCTV-"), number, plus))

    return let(clean(simplify(name, characters)), label)


def classify(
    name: Column,
    category_rules: Mapping[str, Sequence[str]] = rules.CATEGORY_RULES,
    order: Sequence[str] = tuple(rules.CATEGORY_ORDER),
    characters: tuple[str, str] = CHARACTERS,
) -> Column:
    """Category of a name: numbered channels, satellite channels, then rules in order."""
    table = str.maketrans(*characters)

    def category_of(s):
        out = F.when(s.rlike(r"(?iU)CCTV-?\d"), rules.CCTV_CATEGORY)
        out = out.when(F.contains(s, F.lit("卫视")), rules.SATELLITE_CATEGORY)
        for category in order:
            words = category_rules.get(category)
            if category != rules.OTHER_CATEGORY and words:
                out = out.when(contains_any(s, [w.translate(table) for w in words], True), category)
        return out.when(s.rlike("中央|央视"), rules.CCTV_CATEGORY).otherwise(rules.OTHER_CATEGORY)

    return let(simplify(name, characters), category_of)


def classify_legacy(
    name: Column,
    category_rules: Mapping[str, Sequence[str]] = rules.CATEGORY_RULES,
    order: Sequence[str] = tuple(rules.CATEGORY_ORDER),
    characters: tuple[str, str] = CHARACTERS,
) -> Column:
    """Earlier form: blacklisted names have no category of their own, no channel special cases."""
    def category_of(s):
        out = F.when(is_blacklisted(s, ignore_case=False), "其他")
        for category in order[:-1]:
            if category_rules.get(category):
                out = out.when(contains_any(s, category_rules[category], True), category)
        return out.otherwise(order[-1])

    return let(simplify(name, characters), category_of)


def _numbered_legacy(name: Column) -> Column:
    """``CCTV<n>`` for numbered channels, with the 5+ and 4K special cases."""

    def standard(n):
        up = F.replace(F.upper(n), F.lit("ＣＣＴＶ"), F.lit("CCTV"))
        pattern = r"(?iU)CCTV\D*?(\d{1,2})\s*(\+?)"
        number = F.regexp_extract(up, pattern, 1).try_cast("int")
        return (
            F.when(number.isNull(), n)
            .when((number == 5) & F.contains(up, F.lit("+")), "CCTV5+")
            .when((number == 4) & F.contains(up, F.lit("K")), "CCTV4K")
            .otherwise(F.concat(F.lit("CCTV"), number.cast("string")))
        )

    return let(name, standard)


def clean_legacy(name: Column, characters: tuple[str, str] = CHARACTERS) -> Column:
    """Earlier cleaning: emoji, overseas prefix, brackets, channel number, one suffix."""
    plain = F.regexp_replace(name, rules.LEGACY_EMOJI, "")

    def by_prefix(n):
        hits = []
        for p in rules.LEGACY_OVERSEAS_PREFIXES:
            word = any_of([p])
            found = F.regexp_extract(n, rf"(?i)({word}[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]+)", 1)
            applies = F.startswith(F.upper(n), F.lit(p.upper())) & (F.length(n) > len(p) + 1)
            hits.append(F.when(applies, F.nullif(found, F.lit(""))))
        return F.when(F.upper(n).rlike("^" + any_of(p.upper() for p in rules.LEGACY_OVERSEAS_PREFIXES)),
                      F.coalesce(*hits, n)).otherwise(n)

    def finish(n):
        number = F.regexp_extract(n, "(?iU)" + rules.LEGACY_CCTV, 1)
        rest = simplify(F.regexp_replace(n, "(?iU)" + rules.LEGACY_SUFFIX, ""), characters)
        tidy = let(
            _numbered_legacy(strip(rest)),
            lambda t: F.when((t == "") | t.rlike("(?U)" + rules.LEGACY_BLANK), rules.UNKNOWN_NAME).otherwise(strip(t)),
        )
        return F.when(~n.rlike("(?i)" + rules.LEGACY_HIRES) & (number != ""), _numbered_legacy(F.upper(number))).otherwise(tidy)

    noiseless = F.regexp_replace(let(plain, by_prefix), rules.LEGACY_NOISE, "")
    return F.when(strip(name) == "", rules.UNKNOWN_NAME).otherwise(let(noiseless, finish))
