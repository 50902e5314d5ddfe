"""Text cleaning, comparison and tokenising."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# All Unicode white space, what a full strip removes: as characters and as a Java character class.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
MARKUP = "<[^>]+>"
# Fixed value: words of three or more letters of the Finnish alphabet, hyphens included.
WORD = "[a-zäöåA-ZÄÖÅ-]{3,}"

# Entities decoded with plain replacements; '&' itself has to come last.
_PLAIN_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"),
    ("&nbsp;", "\u00a0"), ("&amp;", "&"),
]
# those of them that few texts have
_RARE_ENTITY = "&(?:" + "|".join(entity[1:-1] for entity, _ in _PLAIN_ENTITIES[:-1]) + ");"
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|apos|#39|#x27|nbsp|amp);)[#A-Za-z]"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def non_blank(text: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _full_table_unescape():
    """Arrow UDF over the complete HTML entity table, for the texts plain replacement cannot handle."""
    import html

    @F.pandas_udf(T.StringType())
    def unescape_all(texts):
        return texts.map(html.unescape, na_action="ignore")

    return unescape_all


def unescape(text: Column) -> Column:
    """Decode HTML entities once: ``&amp;lt;`` becomes ``&lt;``.

    The common entities stay in the JVM; only texts with any other entity travel to Python. The text is used
    several times, so it should be a column of the input rather than a long expression.
    """
    plain = text
    for entity, character in _PLAIN_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    # each replacement is a slow pass over the text, so those with nothing to find are left out
    last = [F.lit(part) for part in _PLAIN_ENTITIES[-1]]
    plain = F.when(~F.contains(text, F.lit("&")), text).when(text.rlike(_RARE_ENTITY), plain).otherwise(F.replace(text, *last))
    other = text.rlike(_OTHER_ENTITY)
    return F.when(other, _full_table_unescape()(F.when(other, text))).otherwise(plain)


def bare_text(raw: Column, collapse: bool = True) -> Column:
    """Markup to spaces, entities still encoded; missing text is empty."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), MARKUP, " ")
    return F.regexp_replace(text, f"{SPACE}+", " ") if collapse else text


def clean_text(raw: Column, collapse: bool = True) -> Column:
    """Markup to spaces, entities decoded last so that escaped markup survives as text.

    ``collapse`` also folds white space and strips the ends (ingest); the tagger leaves it as it is.
    """
    text = unescape(bare_text(raw, collapse))
    return strip(text) if collapse else text


def longer(a: Column, b: Column) -> Column:
    """The longer of two stripped texts; blanks count as missing and a tie keeps the first."""
    return bind(
        F.struct(non_blank(a).alias("a"), non_blank(b).alias("b")),
        lambda pair: F.when(F.length(pair["b"]) > F.length(pair["a"]), pair["b"]).otherwise(
            F.coalesce(pair["a"], pair["b"])
        ),
    )


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def capitalised(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))
