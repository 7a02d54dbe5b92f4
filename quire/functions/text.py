"""Column expressions on text: all built of Spark's own functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import config as C

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = r"[ \t-\r]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z folded, all else kept; texts in ASCII take the fast way."""
    c = _col(c)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def str_trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{ASCII_SPACE}+|{ASCII_SPACE}+$", "")


def contains_ignoring_case(text: Column | str, part: Column | str) -> Column:
    return F.contains(ascii_lower(text), ascii_lower(part))


def path_dirname(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def path_normalize(path: Column | str) -> Column:
    """Segments '' and '.' dropped, '..' takes the one before (nothing at the root), a leading slash kept."""
    path = _col(path)
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def path_join(base: Column | str, rel: Column | str) -> Column:
    base, rel = F.coalesce(_col(base), F.lit("")), F.coalesce(_col(rel), F.lit(""))
    joined = F.when(F.startswith(rel, F.lit("/")) | (base == ""), rel).when(rel == "", base).otherwise(F.concat(base, F.lit("/"), rel))
    return path_normalize(joined)


def url_decode(url: Column | str) -> Column:
    """%XX to a byte, + to a space; a % that no two hexadecimal digits follow stays."""
    return F.url_decode(F.regexp_replace(_col(url), "%(?![0-9A-Fa-f]{2})", "%25"))


def url_path(url: Column | str) -> Column:
    return F.substring_index(_col(url), "#", 1)


def url_fragment(url: Column | str) -> Column:
    """What follows the first #; null without one."""
    url = _col(url)
    return F.when(F.contains(url, F.lit("#")), url.substr(F.instr(url, "#") + 1, F.length(url)))


def words(text: Column | str) -> Column:
    """Words between spaces, tabs, line ends and no-break spaces."""
    return F.array_remove(F.split(_col(text), r"[ \t\n\r\x{00A0}]+"), "")


def normalized_text(text: Column | str, unicode_norm: bool = False) -> Column:
    """What running heads are compared by: ASCII without punctuation, spaces collapsed, lower-cased."""
    plain = F.regexp_replace(_col(text), r"\p{Punct}" if unicode_norm else r"[^\x00-\x7F]|\p{Punct}", "")
    joined = F.trim(F.regexp_replace(plain, ASCII_SPACE + "+", " "))
    return F.lower(joined) if unicode_norm else ascii_lower(joined)


def leading_digits(word: Column | str) -> Column:
    return F.regexp_extract(_col(word), r"^[0-9]*", 0)


def is_digits(word: Column | str) -> Column:
    """Digits with . , - among them, one to four digits in all."""
    word = _col(word)
    digits = F.length(F.regexp_replace(word, "[^0-9]", ""))
    return word.rlike(r"^[0-9.,\-]+$") & digits.between(1, C.PAGE_NUMBER_MAX_DIGITS)


def is_page_number(words_: Column | str) -> Column:
    words_ = _col(words_)
    return (F.size(words_) > 0) & F.forall(words_, is_digits)


def normalize_title(title: Column | str) -> Column:
    """Trimmed and collapsed, three dots as an ellipsis, at most 255 bytes; case is kept."""
    spaced = F.trim(F.regexp_replace(_col(title), "[ \\t\\n\\r]+", " "))
    dotted = F.replace(spaced, F.lit("..."), F.lit("…"))
    # the longest beginning of so many bytes, sought only where a title has more
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(dotted), F.lit(C.TITLE_MAX_BYTES))), lambda n: F.octet_length(dotted.substr(F.lit(1), n)) <= C.TITLE_MAX_BYTES)
    cut = dotted.substr(F.lit(1), F.array_max(fits))
    return F.when(F.octet_length(dotted) <= C.TITLE_MAX_BYTES, dotted).otherwise(cut)


def is_junk_title(title: Column | str) -> Column:
    title = _col(title)
    return title.isNull() | (title == "") | ascii_lower(title).isin(*C.JUNK_TITLES)


def synthetic_anchor(spine_index: Column, block_index: Column) -> Column:
    return F.format_string(f"{C.ANCHOR_PREFIX}-%d-%d", spine_index, block_index)


def fallback_title(spine_index: Column) -> Column:
    return F.concat(F.lit("Chapter "), (spine_index + 1).cast("string"))


def progress_percent(page: Column, total: Column) -> Column:
    return F.floor(page * 100 / total).cast("int")


def _looked_up(values: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def css_size(value: Column | str) -> Column:
    """The ratio to the base size that a font-size value gives, as float between 0.2 and 5; null for none."""
    v = ascii_lower(str_trim(value))
    pattern = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)) *([a-z%]*)$"
    x = F.regexp_extract(v, pattern, 1).try_cast("double")
    ratio = x * _looked_up(C.SIZE_UNITS, F.regexp_extract(v, pattern, 2))
    clamped = F.when(ratio > 0, F.greatest(F.lit(C.RATIO_LEAST), F.least(F.lit(C.RATIO_MOST), ratio)))
    return F.coalesce(_looked_up(C.SIZE_KEYWORDS, v), clamped).cast("float")


def css_selector(selector: Column | str) -> Column:
    """struct(kind, key) of the last compound of a selector; null where more than one tag, class or id decides."""
    s = str_trim(selector)
    last = F.regexp_extract(s, r"([^ \t\n\r\f>+~,]*)$", 1)
    key = F.regexp_extract(last, r"^[.#]?([A-Za-z0-9_\-\\]+)$", 1)
    kind = F.when(F.startswith(last, F.lit("#")), "ID").when(F.startswith(last, F.lit(".")), "CLASS").otherwise("TAG")
    good = ~s.rlike(r"[:\[(]") & (key != "") & (F.octet_length(key) < C.CSS_KEY_MAX)
    return F.when(good, F.struct(kind.alias("kind"), ascii_lower(key).alias("key")))


def css_property(prop: Column) -> Column:
    return ascii_lower(str_trim(prop))


def css_value(value: Column, strict: bool = False) -> Column:
    """A value to compare; '!important' is dropped, unless strict."""
    return ascii_lower(str_trim(value if strict else F.regexp_replace(value, r"(?i)\s*!\s*important\s*$", "")))


def css_declaration(p: Column, v: Column) -> Column:
    """struct(bold, italic, underline, center, page_break_before, font_ratio) that a css_property and a css_value set; null for none."""
    weight = F.regexp_extract(v, "^([0-9]+)$", 1).try_cast("int")
    bold = (p == "font-weight") & (v.isin("bold", "bolder") | F.coalesce(weight >= 600, F.lit(False)))
    italic = (p == "font-style") & v.isin("italic", "oblique")
    underline = p.isin("text-decoration", "text-decoration-line") & F.contains(v, F.lit("underline"))
    center = (p == "text-align") & v.isin("center", "centre")
    broken = p.isin("page-break-before", "break-before") & v.isin("always", "page", "left", "right", "recto", "verso")
    ratio = F.when(p == "font-size", css_size(v))
    found = F.struct(bold.alias("bold"), italic.alias("italic"), underline.alias("underline"), center.alias("center"), broken.alias("page_break_before"), ratio.alias("font_ratio"))
    # as one element, so that each part is worked out once
    return F.get(F.filter(F.array(found), lambda d: d["bold"] | d["italic"] | d["underline"] | d["center"] | d["page_break_before"] | d["font_ratio"].isNotNull()), 0)
