"""Scalar building blocks as Column expressions (all evaluated in the JVM)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from filarium import constants as K

# White space as the patterns understand it: wider than Java's ASCII-only \s.
_SPACE_CODES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACES = "".join(map(chr, _SPACE_CODES))
SPACE_CLASS = "[" + "".join(rf"\x{{{code:X}}}" for code in _SPACE_CODES) + "]"
_SPACE_BODY = SPACE_CLASS[1:-1]
# ASCII word boundary, whatever the JDK takes \b to mean; the short form stands before what begins a word.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_START = r"(?<![A-Za-z0-9_])"
_WORD_FIRST = re.compile(r"[A-Za-z0-9](?![?*{])|\\d(?![?*])|\[A-Z\](?![?*])")
_GROUP = re.compile(r"\((?:\?:)?")


def _begins_word(rest: str) -> bool:
    """Whether whatever the pattern matches begins with a letter or a digit, as far as that is easy to see."""
    if _WORD_FIRST.match(rest):
        return True
    opened = _GROUP.match(rest)
    if not opened:
        return False
    depth, first, i = 1, [opened.end()], opened.end()
    while i < len(rest) and depth:
        if rest[i] == "\\":
            i += 1
        elif rest[i] == "|" and depth == 1:
            first.append(i + 1)
        else:
            depth += (rest[i] == "(") - (rest[i] == ")")
        i += 1
    return rest[i:i + 1] not in ("?", "*", "{") and all(_begins_word(rest[x:]) for x in first)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Spell a pattern for Java: ``\\b`` is an edge of an ASCII word, ``\\s`` any white space."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(_SPACE_BODY if in_class else SPACE_CLASS)
        elif two == r"\S":
            out.append("[^" + _SPACE_BODY + "]")
        elif two == r"\b":
            out.append(_START if _begins_word(pattern[i + 2:]) else _EDGE)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def re2_regex(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for an RE2 engine, whose ``\\b`` is ASCII already."""
    return ("(?i)" if ignore_case else "") + pattern


def sql_literal(v) -> str:
    """A Python constant as SQL text."""
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(map(sql_literal, v)) + ")" if v else "CAST(array() AS ARRAY<STRING>)"
    return str(v).lower() if isinstance(v, bool) else repr(v)


def strings(values) -> Column:
    """Constant array<string>, parsed as one expression instead of one per element."""
    return F.expr(sql_literal(list(values)))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Split on white space, dropping empty pieces."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


# ---- names and paths (F1-F5) ----------------------------------------------

def extension(name: Column) -> Column:
    """Last dot suffix in lower case; empty for dotfiles and names without a dot."""
    return F.regexp_extract(F.lower(name), r"(?s)^.+(\.[^.]*)$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: s != "")


def dir_segments(path: Column) -> Column:
    """Lower-cased folder segments: all but the last."""
    segs = segments(F.lower(path))
    return F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))


def ext_norm(c: Column) -> Column:
    """Extension without its dot, for comparing values stored either way."""
    return F.regexp_replace(F.lower(c), r"^\.", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), SPACE_CLASS + "+", "-")


# ---- numbers and texts (F6-F10, F16) --------------------------------------

def half_up_div(n: Column, unit: int, places: int = 0) -> Column:
    """n / unit as text, rounded half up with exact integer arithmetic."""
    scale = 10 ** places
    q = F.floor((n.cast("decimal(38,0)") * (2 * scale) + unit) / (2 * unit)).cast("bigint")
    if places == 0:
        return q.cast("string")
    return F.concat(F.floor(q / scale).cast("string"), F.lit("."),
                    F.lpad((q % scale).cast("string"), places, "0"))


def human_bytes(n: Column) -> Column:
    """Bytes as a short text; one decimal unless the value is whole."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        size = 1024 ** power
        text = F.when(n % size == 0, half_up_div(n, size)).otherwise(half_up_div(n, size, 1))
        out = F.when(n >= size, F.concat(text, F.lit(" " + unit))).otherwise(out)
    return out


def approx_bytes(n: Column) -> Column:
    """Bytes as used in query explanations: no decimals below a gigabyte."""
    return (F.when(n >= 1024 ** 4, F.concat(half_up_div(n, 1024 ** 4, 1), F.lit(" TB")))
            .when(n >= 1024 ** 3, F.concat(half_up_div(n, 1024 ** 3, 1), F.lit(" GB")))
            .when(n >= 1024 ** 2, F.concat(half_up_div(n, 1024 ** 2), F.lit(" MB")))
            .when(n >= 1024, F.concat(half_up_div(n, 1024), F.lit(" KB")))
            .otherwise(F.concat(n.cast("string"), F.lit(" B"))))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def plural(word: str, n: Column) -> Column:
    return F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Constant dictionary lookup."""
    pairs = ", ".join(sql_literal(x) for kv in table.items() for x in kv)
    hit = F.try_element_at(F.expr(f"map({pairs})"), c)
    return hit if default is None else F.coalesce(hit, default)


def status_label(c: Column) -> Column:
    return lookup(c, K.STATUS_LABELS, F.upper(F.translate(c, "_", " ")))


def percent_text(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def parse_number(c: Column) -> Column:
    """Leading decimal number once commas are removed; null if there is none."""
    digits = F.regexp_extract(F.regexp_replace(c, ",", ""), r"^(\d+\.?\d*|\.\d+)", 1)
    return F.try_to_number(F.nullif(F.rtrim(digits, F.lit(".")), F.lit("")),
                           F.lit("9" * 20 + "D" + "9" * 10)).cast("double")


# ---- dates (F12-F15) -------------------------------------------------------

def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.unix_millis(a) - F.unix_millis(b)) / F.lit(86400000.0)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---- predicates (P4, C8, C9) ------------------------------------------------

def sql_like(c: Column, term: Column | str) -> Column:
    """Case-insensitive substring match; % and _ in the term stay wildcards."""
    if isinstance(term, str):
        return c.ilike("%" + term.replace("\\", "\\\\") + "%")
    low, term = F.lower(c), F.lower(term)
    safe = F.replace(term, F.lit("\\"), F.lit("\\\\"))
    wild = F.contains(term, F.lit("%")) | F.contains(term, F.lit("_"))
    # a pattern that differs per row is compiled per row, so only where it is one
    return (F.when(wild, F.call_function("like", low, F.concat(F.lit("%"), safe, F.lit("%"))))
            .otherwise(F.contains(low, term)))


def any_pattern(keywords) -> str:
    """Pattern that finds any of the keywords."""
    return "|".join(k.replace("-", r"\-").replace(".", r"\.") for k in keywords)


def any_of(c: Column, keywords) -> Column:
    """True if any keyword occurs in the text."""
    return c.rlike(any_pattern(keywords))


def first_keyword(text: Column, keywords) -> Column:
    """First keyword of the list that occurs in the text, trimmed."""
    ks = keywords if isinstance(keywords, Column) else strings(keywords)
    return F.trim(F.get(F.filter(ks, lambda k: F.contains(text, k)), F.lit(0)))


def first_segment_keyword(segs: Column, keywords) -> Column:
    """First keyword hit, by segment first and list order second."""
    ks = keywords if isinstance(keywords, Column) else strings(keywords)
    hits = F.flatten(F.transform(segs, lambda s: F.filter(ks, lambda k: F.contains(s, k))))
    return F.trim(F.get(hits, F.lit(0)))


# ---- arrays (F20, U3) --------------------------------------------------------

def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    """Dice of two distinct arrays; 0 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


# ---- hashing and vectors (E2, E4, E5, F17, F18) -------------------------------

def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of a text."""
    codes = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(K.FNV_OFFSET).cast("bigint"),
                       lambda h, x: (h.bitwiseXOR(x) * K.FNV_PRIME).bitwiseAND(F.lit(4294967295)))


def dot(a: Column, b: Column) -> Column:
    """Dot product; null when the lengths differ."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(prod, F.lit(0.0), lambda s, x: s + x))


def norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine held to [0, 1]; 0 for missing, mismatched or zero vectors."""
    den = norm2(a) * norm2(b)
    cos = F.when((F.size(a) == F.size(b)) & (den > 0), dot(a, b) / den)
    # coalesce first: least and greatest pass over nulls
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cos, F.lit(0.0))))


# ---- path similarity (G1, G2, G4) ----------------------------------------------

def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading equal elements of two arrays without nulls."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_diff = F.array_position(same, F.lit(False))
    return F.when(first_diff == 0, F.size(same)).otherwise(first_diff - 1)


def folder_proximity(path_a: Column, path_b: Column) -> Column:
    a, b = segments(path_a), segments(path_b)
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter == 0, F.lit(0.0)).otherwise(common_prefix(a, b) / shorter)


def name_tokens(name: Column) -> Column:
    """Distinct file-name tokens of two or more characters, last suffix dropped."""
    parts = F.split(stem(F.lower(name)), "[" + _SPACE_BODY + r"\-_.]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def date_proximity(a: Column, b: Column) -> Column:
    d = day_distance(a, b)
    out = F.lit(0.0)
    for days, score in reversed(K.DATE_STEPS):
        out = F.when(d <= days, F.lit(score)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))
