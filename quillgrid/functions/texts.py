"""Text operators as Columns: markup to text, entities, case, sniffing, small normalisations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of any kind (Unicode), for trimming.
BLANK = r"[\s\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{a0}]"


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trim_blank(text: Column) -> Column:
    """Both ends without white space of any kind; inner runs are kept."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return trim_blank(F.regexp_replace(text, rf"{BLANK}+", " "))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encode_entities(text: Column, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    return _replaced(text, pairs + [('"', "&quot;"), ("'", "&apos;")] if attribute else pairs)


# The named entities that are decoded.
ENTITIES = (("amp;", "&"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("apos;", "'"))


def _character(code: Column) -> Column:
    """The character of a code point, through its UTF-8 bytes."""
    tail = lambda shift: F.hex(F.lit(0x80) + F.shiftright(code, shift).bitwiseAND(0x3F))
    utf8 = (
        F.when(code < 0x80, F.lpad(F.hex(code), 2, "0"))
        .when(code < 0x800, F.concat(F.hex(F.lit(0xC0) + F.shiftright(code, 6)), tail(0)))
        .when(code < 0x10000, F.concat(F.hex(F.lit(0xE0) + F.shiftright(code, 12)), tail(6), tail(0)))
        .otherwise(F.concat(F.hex(F.lit(0xF0) + F.shiftright(code, 18)), tail(12), tail(6), tail(0)))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def _entity(part: Column) -> Column:
    """What follows an '&', with the entity it begins with decoded; an unknown one keeps its '&'."""
    dec = F.regexp_extract(part, r"\A#([0-9]{1,7});", 1)
    hexa = F.regexp_extract(part, r"\A#[xX]([0-9A-Fa-f]{1,6});", 1)
    code = F.when(dec != "", dec.try_cast("int")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("int"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    out = F.when(part.startswith("#") & valid, F.concat(_character(code), F.regexp_replace(part, r"\A#[xX]?[0-9A-Fa-f]+;", "")))
    for name, ch in ENTITIES:
        out = out.when(part.startswith(name), F.concat(F.lit(ch), F.substring(part, F.lit(len(name) + 1), F.length(part))))
    return out.otherwise(F.concat(F.lit("&"), part))


def decode_entities(text: Column) -> Column:
    """amp, lt, gt, quot, apos and numeric entities; others stay as they are. Each '&' is looked at once."""
    parts = F.split(text, "&")
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _entity), ""))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text of HTML: breaks and block ends to line breaks, list items to dashes, tags dropped, entities decoded.

    The contents of scripts and styles are text too, and names are matched in lower case only.
    """
    text = _replaced(html, [("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n"), ("<li>", "- "), ("</li>", "\n"), ("</h1>", "\n\n"), ("</h2>", "\n\n"), ("</h3>", "\n\n")])
    return decode_entities(F.replace(F.regexp_replace(text, r"(?s)<[^>]*(>|\z)", ""), F.lit(">"), F.lit("")))


def paragraphs(text: Column) -> Column:
    """Paragraphs of plain text: parts between blank lines, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim_blank), lambda p: p != "")


def title_case(text: Column) -> Column:
    """First letter of every word between white space in upper case, the rest in lower case."""
    parts = F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, anything else as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "[\t\r\n]", " ")


def sniff_text(text: Column) -> Column:
    """Format of a text by the first rule that holds: svg, html, md, csv, else txt; null if empty."""
    t = F.regexp_replace(text, r"\A\x{feff}+", "")
    return (
        F.when(t.contains("<svg"), "svg")
        .when(t.startswith("<!doctype html") | t.startswith("<html") | t.contains("<body"), "html")
        .when(t.startswith("#") | t.contains("\n# ") | t.contains("\n- "), "md")
        .when(t.contains(",") & t.rlike("(?s)\n."), "csv")
        .when(t != "", "txt")
    )


def block_kind(line: Column) -> Column:
    """What a line of Markdown is: blank, heading, rule, list, table or text."""
    t = trim_blank(line)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"\A#{1,6}(?!#)\s*\S"), "heading")
        .when(t.isin("---", "***"), "rule")
        .when(t.rlike(r"\A[-*] "), "list")
        .when(t.startswith("|") & t.endswith("|"), "table")
        .otherwise("text")
    )


def roman(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999, else the number itself."""
    tables = [["", "m", "mm", "mmm"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]]
    digit = lambda k, by: F.element_at(F.array(*map(F.lit, tables[k])), (F.floor(n / by) % 10 + 1).cast("int"))
    return F.when(n.between(1, 3999), F.concat(digit(0, 1000), digit(1, 100), digit(2, 10), digit(3, 1))).otherwise(n.cast("string"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of lower-case words in percent; two empty ones 100, one empty 0."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), 1))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 100.0).otherwise(F.size(F.array_intersect(x, y)) * 100.0 / F.size(F.array_union(x, y)))


def column_letters(col: Column) -> Column:
    """Letters of a zero-based column: A, Z, AA; up to three of them."""
    letter = lambda k: F.char((k + 65).cast("bigint"))
    two, three = F.floor(col / 26) - 1, F.floor((F.floor(col / 26) - 1) / 26) - 1
    return F.concat(F.when(three >= 0, letter(three % 26)).otherwise(""), F.when(two >= 0, letter(two % 26)).otherwise(""), letter(col % 26))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), (row + 1).cast("string"))
