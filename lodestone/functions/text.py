"""Text functions as columns: tokens, keys, titles, syllables, blocks."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words that lexical models leave out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on",
    "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: A link's target.
LINK = r'(?i)<a\s(?:[^>]*\s)?href="([^"]+)"'


def let(value: Column, then) -> Column:
    """then(value), where value is worked out once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased lexical tokens without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def lookup_key(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit("ß"), F.lit("ss"))


def title_from_stem(stem: Column) -> Column:
    """A file's stem without its hash of 8 or more hexadecimal digits, with blanks for underscores."""
    return F.trim(F.translate(F.regexp_replace(stem, "_[0-9a-fA-F]{8,}$", ""), "_", " "))


def slug(x: Column, longest: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, longest)


def query_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def head_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(x), r"\s+"), 1, n), " ")


def safe_stem(title: Column, longest: int = 80) -> Column:
    """A file stem: forbidden characters become hyphens, white space underscores; the title's SHA-1 begins the ending."""
    clean = F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*]', "-"), r"\s+", "_")
    clean = F.substring(F.regexp_replace(clean, r"^[_.]+|[_.]+$", ""), 1, longest)
    return F.concat(clean, F.lit("_"), F.substring(F.sha1(title), 1, 10))


def href_title(href: Column, *prefixes: str) -> Column:
    """Page title that a link with one of the prefixes (ignoring case; "/" if none is given) leads to, null for other links."""
    rest = F.lit(None).cast("string")
    for prefix in reversed(prefixes or ("/",)):
        rest = F.when(F.lower(href).startswith(prefix.lower()), F.substr(href, F.lit(len(prefix) + 1))).otherwise(rest)
    inner = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    title = F.trim(F.translate(F.url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), "_", " "))
    return F.when(title != "", title)


def page_url(title: Column, prefix: str = "/") -> Column:
    """The link to a page: blanks become underscores, all but letters, digits and -._~ is percent-encoded."""
    out = F.url_encode(F.translate(F.trim(title), " ", "_"))
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return F.concat(F.lit(prefix), out)


def sentences(text: Column) -> Column:
    """Sentences without the marks that end them, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?]+(?:[ \t\n\x0B\f\r]+|\z)"), lambda s: F.trim(s)), lambda s: s != "")


def syllables(word: Column) -> Column:
    """Vowel groups, less a final silent e, at least one."""
    n = F.regexp_count(F.lower(word), F.lit("[aeiouy]+"))
    return F.greatest(n - F.when(F.lower(word).endswith("e") & (n > 1), 1).otherwise(0), F.lit(1))


def alphabetic(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def sentence_ends(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?]+(\s|$)"))


# ---- HTML


#: Where a page's content begins, the first that is found, and where it ends, the earliest one.
CONTENT_START = ('<div id="mw-content-text"[^>]*>', '<div class="mw-category-generated"[^>]*>')
CONTENT_END = ('<div class="printfooter"', '<div id="catlinks"', '<nav id="mw-navigation"', '<div id="mw-navigation"', '<footer id="footer"')


def fragment(html: Column, starts: tuple[str, ...] = CONTENT_START, ends: tuple[str, ...] = CONTENT_END) -> Column:
    """From the first start marker that matches (ignoring case) up to the earliest end marker after it; all of it where there is no start."""
    place = lambda x, pattern: F.nullif(F.regexp_instr(x, F.lit("(?i)" + pattern)), F.lit(0))

    def cut(segment: Column) -> Column:
        found = [F.when(place(segment, e) > 1, place(segment, e)) for e in ends]
        end = F.least(*found) if len(found) > 1 else found[0]
        return F.when(end.isNull(), segment).otherwise(F.substr(segment, F.lit(1), end - 1))

    at = F.coalesce(*[place(html, s) for s in starts])
    return F.when(at.isNull(), html).otherwise(let(F.substr(html, at), cut))


#: Elements that go, by name, and by name and a word in their class.
GONE = ("script", "style", "noscript", "figure")
GONE_CLASSES = (
    ("table", "infobox|navbox|vertical-navbox|sidebar|metadata|plainlinks|toccolours"),
    ("div", "shortdescription|navbox|metadata|authority-control|reflist|mw-editsection|toc|thumb|sistersitebox|portalbox|ambox|plainlinks"),
    ("span", "mw-editsection|reference-text|error"),
    ("sup", "reference"),
)
BLOCK_TAGS = "p|div|section|tr|ul|ol|dl|dt|dd|h[1-6]"
#: Regular expressions and what replaces them, in order. They hold for Java and RE2 alike.
HTML_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    *((rf"(?is)<{name}\b.*?</{name}>", "") for name in GONE),
    *((rf"""(?is)<{name}\b[^>]*class="[^"]*(?:{words})[^"]*"[^>]*>.*?</{name}>""", "") for name, words in GONE_CLASSES),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</li>", "\n"),
    (rf"(?i)<(?:{BLOCK_TAGS})\b[^>]*>", "\n"),
    (rf"(?i)</(?:{BLOCK_TAGS})>", "\n"),
    (r"<[^>]+>", " "),
)
SPACE_STEPS = (("\u00a0", " "), ("\r", ""), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))
#: The named entities: those of HTML 4, and the apostrophe.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
AMPERSAND = ("amp", "#38", "#x26", "#X26")


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities, each decoded once; unknown ones stay. The ampersand is last, so that what it
    makes is not decoded again."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&(#?[A-Za-z0-9]+);"), F.lit(1)))
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in ENTITIES]), F.array(*[F.lit(c) for c in ENTITIES.values()]))

    def character(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.rlike("^#[0-9]{1,7}$"), F.substr(name, F.lit(2)))
        code = digits.cast("int")
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(name.startswith("#"), F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(F.element_at(known, name))

    rest = F.filter(names, lambda n: ~n.isin(*AMPERSAND))
    out = F.aggregate(rest, text, lambda s, n: F.replace(s, F.concat(F.lit("&"), n, F.lit(";")), F.coalesce(character(n), F.concat(F.lit("&"), n, F.lit(";")))))
    return F.regexp_replace(out, f"&(?:{'|'.join(AMPERSAND)});", "&")


def html_text(html: Column) -> Column:
    """Readable text: unwanted elements go, breaks and list items start lines, blocks too, entities are decoded."""
    out = F.coalesce(html, F.lit(""))
    for pattern, made in HTML_STEPS:
        out = F.regexp_replace(out, pattern, made)
    out = let(out, decode_entities)
    for pattern, made in SPACE_STEPS:
        out = F.regexp_replace(out, pattern, made)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def links(html: Column) -> Column:
    """Distinct link targets, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)))


# ---- exported texts

#: The fields of an exported text's header, which ends at the first blank line.
HEADER_FIELDS = (("title", "Title"), ("canonical_title", "CanonicalTitle"), ("kind", "Kind"), ("url", "URL"))
HEADER_LINES = 8


def header(text: Column) -> Column:
    """What stands before the first blank line; empty where there is none."""
    return F.regexp_extract(text, r"(?s)^(.*?\r?\n\r?\n)", 1)


def body(text: Column) -> Column:
    return F.substr(text, F.length(header(text)) + 1)


def header_field(text: Column, name: str) -> Column:
    """A field of the first HEADER_LINES lines, trimmed; empty where it is missing."""
    head = F.array_join(F.slice(F.split(text, r"\r?\n"), 1, HEADER_LINES), "\n")
    return F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.+)$", 1))


# ---- blocks of cleaned text

#: Headings that end a document's body; words and headings that mark a table.
BACK_MATTER = ("see also", "references", "notes", "footnotes", "citations", "sources", "bibliography", "works cited", "further reading", "external links")
TABLE_WORDS = ("position", "name", "name of greyhound", "breeding", "trap", "sp", "time", "trainer", "review scores", "publication score", "score", "chart", "charts")
SECTION_WORDS = ("final result", "results", "result", "race result", "race results", "draw", "distances", "review scores")


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n+")
    return F.filter(F.transform(cut, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def heading_key(block: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(block, r"\s+", " ")), "^:+|:+$", "")


def lines_of(block: Column) -> Column:
    return F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)))


def sentence_shaped(block: Column) -> Column:
    return (n_words(block) >= 8) & block.rlike(r"[.!?]$")


def heading(block: Column) -> Column:
    return (F.instr(block, "\n") == 0) & (F.length(block) <= 80) & (n_words(block) <= 7) & ~block.rlike(r"[.!?]$")


def number_tokens(block: Column) -> Column:
    return F.regexp_count(F.lower(block), F.lit(r"\b[0-9]+(?:[.,:-][0-9]+)?[a-z%]*\b"))


def bullets(block: Column) -> Column:
    return F.forall(lines_of(block), lambda x: F.ltrim(x).startswith("- "))


def table_like(block: Column) -> Column:
    """A heading word, or few words a line, or short with numbers, or hardly a sentence."""

    def of(lines: Column) -> Column:
        sizes = F.transform(lines, n_words)
        mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(lines), F.lit(1))
        short = F.size(F.filter(sizes, lambda x: x <= 4)) >= 0.75 * F.size(lines)
        return (F.size(lines) >= 3) & (((mean <= 4.5) & short) | ((mean <= 6) & (number_tokens(block) >= 2)))

    words = n_words(block)
    known = heading_key(block).isin(*TABLE_WORDS, *SECTION_WORDS)
    return known | let(lines_of(block), of) | (words <= 4) | ((words <= 8) & (number_tokens(block) >= 1) & ~sentence_shaped(block))
