"""Text scalars.  Everything here is a built-in expression, so it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.binding import let

# Fixed value: the white space a browser-style regex calls \s, which is wider
# than what Java calls \s.
SPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# Words left out of hash embeddings.
EMBEDDING_STOPWORDS = tuple(
    """
    the a an and or but if then else for of to in on at by with
    from as is are was were be been being it its this that these those
    he she they them his her their we you i me my our us your
    not no nor so than too very can will just should now also more most
    has have had do does did done would could may might must shall
    about after before over under again further once here there when where why how
    all any both each few other some such only own same up down out off
    said says say new one two first last year years day people told according
    """.split()
)

_SCRIPT = r"(?is)<script(?:[^A-Za-z0-9_].*?)??</script>"
_STYLE = r"(?is)<style(?:[^A-Za-z0-9_].*?)??</style>"
_TAG = r"<[^>]+>"
_NUMERIC_ENTITY = r"&#([0-9]+);"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def strip_html(html: Column) -> Column:
    """Drop script blocks, style blocks, then every tag; decode entities."""
    text = F.coalesce(html, F.lit(""))
    for pattern in (_SCRIPT, _STYLE, _TAG):
        text = F.regexp_replace(text, pattern, " ")
    return decode_entities(text)


def decode_entities(text: Column) -> Column:
    """Decode a handful of entities, ampersand before the angle brackets."""
    for pattern, char in (
        ("(?i)&nbsp;", " "),
        ("(?i)&amp;", "&"),
        ("(?i)&lt;", "<"),
        ("(?i)&gt;", ">"),
        ("(?i)&quot;", '"'),
        ("(?i)&#39;|&apos;", "'"),
    ):
        text = F.regexp_replace(text, pattern, char)
    return let(
        text, lambda t: F.when(t.rlike(_NUMERIC_ENTITY), _decode_numeric(t)).otherwise(t)
    )


def _decode_numeric(text: Column) -> Column:
    """One pass over decimal entities; numbers that are no character stay as text."""
    between = F.split(text, r"&#[0-9]+;", -1)
    digits = F.regexp_extract_all(text, F.lit(_NUMERIC_ENTITY), 1)

    def char(d: Column) -> Column:
        code = d.try_cast("bigint")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        utf32 = F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0"))
        return F.coalesce(F.decode(utf32, "UTF-32"), F.concat(F.lit("&#"), d, F.lit(";")))

    # There is one more piece of text than there are entities.
    return F.array_join(
        F.zip_with(
            between,
            digits,
            lambda piece, d: F.concat(piece, F.when(d.isNull(), "").otherwise(char(d))),
        ),
        "",
    )


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits longer than one UTF-16 unit."""
    return F.filter(
        F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1),
        lambda t: (F.length(t) > 1) | (F.octet_length(t) == 4),
    )


def content_tokens(text: Column) -> Column:
    """Tokens of at least three UTF-16 units that are not stopwords."""
    return F.filter(
        tokenize(text),
        lambda t: ((F.length(t) >= 3) | ((F.length(t) == 2) & t.rlike(_ASTRAL)))
        & ~t.isin(*EMBEDDING_STOPWORDS),
    )


def excerpt(text: Column, max_length: int = 280) -> Column:
    """Plain text cut at a word border, with an ellipsis when something was cut."""

    def cut(clean: Column) -> Column:
        head = F.regexp_replace(F.substring(clean, 1, max_length - 1), r" [^ ]*$", "")
        return F.when(F.length(clean) <= max_length, clean).otherwise(F.concat(head, F.lit("…")))

    return let(normalize_whitespace(strip_html(text)), cut)


def normalize_query(query: Column, max_length: int = 500) -> Column:
    return F.substring(trim_space(query), 1, max_length)
