"""String functions (Column -> Column), built-in expressions except for case
folding and transliteration, which SQL lacks and Arrow UDFs supply.

The patterns are Java's; the expected values in the tests and the SQL
oracles have rules of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wreath.functions import markup
from wreath.session import bound_batches, give_back

SLICE_BYTES = 1 << 20     # of UTF-8 that are Python strings at once


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ I1 / I2
def remove_prefix(c, prefix: str) -> Column:
    """``str.removeprefix``: strip ``prefix`` once, only at the start."""
    return F.regexp_replace(_col(c), "^" + re.escape(prefix), "")


def clean_headline(headline, abstract=None) -> Column:
    """Drop a leading ``LEAD:`` (matched before lowering), lower-case, and
    append the abstract after one space. Null in, null out (``concat``)."""
    h = F.lower(remove_prefix(headline, "LEAD:"))
    return h if abstract is None else F.concat(h, F.lit(" "), _col(abstract))


# ------------------------------------------------------------------ I3 / I4
# Letters with no canonical decomposition and their ASCII
# spelling, as a transliterator writes them.
ASCII_MULTI = (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"),
               ("ß", "ss"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("þ", "th"),
               ("Þ", "Th"), ("ð", "d"), ("Ð", "D"), ("ı", "i"), ("ħ", "h"), ("Ħ", "H"))

# Greek and Cyrillic letters and their usual Latin spelling.
GREEK = (("α", "a"), ("β", "b"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("ζ", "z"), ("η", "e"), ("θ", "th"),
         ("ι", "i"), ("κ", "k"), ("λ", "l"), ("μ", "m"), ("ν", "n"), ("ξ", "x"), ("ο", "o"), ("π", "p"),
         ("ρ", "r"), ("σ", "s"), ("ς", "s"), ("τ", "t"), ("υ", "u"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("ω", "o"))
CYRILLIC = (("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ж", "zh"), ("з", "z"),
            ("и", "i"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"),
            ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"),
            ("ш", "sh"), ("щ", "shch"), ("ъ", "'"), ("ы", "y"), ("ь", "'"), ("э", "e"), ("ю", "iu"), ("я", "ia"),
            ("ђ", "dj"), ("є", "ie"), ("і", "i"), ("ј", "j"), ("љ", "lj"), ("њ", "nj"), ("ћ", "c"), ("џ", "dz"), ("ґ", "g"))


def _ascii_table() -> dict[int, str]:
    """Every letter below U+FFFF whose compatibility decomposition is ASCII
    letters with marks maps to them; Greek and Cyrillic letters with marks map
    like their base; loose accents map to nothing."""
    base = dict(ASCII_MULTI)
    for ch, spelt in (*GREEK, *CYRILLIC):
        base[ch] = spelt
        if len(ch.upper()) == 1:
            base.setdefault(ch.upper(), spelt.capitalize())
    table = {cp: "" for cp in range(0x300, 0x370)}
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if not unicodedata.category(ch).startswith("L"):
            continue
        letters = [x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)]
        spelt = base.get(ch) or "".join(base.get(x, x) for x in letters)
        if spelt and spelt != ch and spelt.isascii() and all(x.isalnum() or x == "'" for x in spelt):
            table[cp] = spelt
    return table


_ASCII = _ascii_table()
_WIDER: dict[str, Broadcast] = {}


def _wider_table(spark: SparkSession) -> dict[int, str]:
    """The other letters, marks, digits and punctuation of the basic plane as the Unicode library that comes with Spark
    spells them, one character at a time: kana, Hangul, Han (each syllable followed by a space), Arabic, Hebrew,
    Indic scripts, curly quotes, dashes. What it has no ASCII spelling for is left out."""
    asked = [cp for cp in range(0x80, 0xFFF0) if cp not in _ASCII and unicodedata.category(chr(cp))[0] in "LMNP"]
    rules = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII")
    spelt = rules.transliterate("\n".join(map(chr, asked))).split("\n")
    table = {}
    for cp, x in zip(asked, spelt, strict=True):
        x = x if unicodedata.category(chr(cp))[0] == "P" else "".join(c for c in x if c.isalnum() or c == "'")
        if x.isascii() and x != chr(cp):
            table[cp] = x + " " if x and unicodedata.name(chr(cp), "").startswith("CJK ") else x
    return table


def _ascii_spelling(spark: SparkSession) -> Broadcast:
    """Both tables, built once an application; some 40,000 characters, whatever the data."""
    key = spark.sparkContext.applicationId
    if key not in _WIDER:
        _WIDER[key] = spark.sparkContext.broadcast({**_wider_table(spark), **_ASCII})
    return _WIDER[key]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``limit`` bytes of text; a longer text is a slice of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield texts.slice(i, j - i)
        i = j


def _text_udf(fold: bool, ascii_: bool):
    """Arrow UDF over whole batches: SQL has neither full case folding nor
    transliteration, and spelling their tables out as nested expressions is
    slower than one pass of the string methods that have them."""
    spark = SparkSession.active()
    bound_batches(spark)
    table = _ascii_spelling(spark) if ascii_ else None

    def spell(t: str) -> str:
        t = t.casefold() if fold else t
        return t if not ascii_ or t.isascii() else t.translate(table.value)

    @F.arrow_udf("string")
    def spelt(texts: pa.Array) -> pa.Array:
        # Python's strings take several times the bytes of a batch
        out = [pa.array([t if t is None else spell(t) for t in part.to_pylist()], pa.string()) for part in slices(texts)]
        whole = pa.concat_arrays(out) if out else pa.array([], pa.string())
        del out
        give_back()
        return whole

    return spelt


def casefold(c) -> Column:
    """Full Unicode case folding."""
    return _text_udf(True, False)(_col(c))


def to_ascii(c) -> Column:
    """Letters and punctuation of the basic plane to ASCII, character by character: Latin, Greek and Cyrillic by the tables
    above, the other scripts by the Unicode library's rules. Characters without a spelling stay."""
    return _text_udf(False, True)(_col(c))


def fold_ascii(c) -> Column:
    """``to_ascii(casefold(c))`` in one pass."""
    return _text_udf(True, True)(_col(c))


# Letters that fold to ASCII letters, other than by lower case.
FOLDS_TO_ASCII = (("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"),
                  ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def folded_start(c) -> Column:
    """Case folding as far as it matters for ASCII prefixes (usable in lambdas)."""
    out = F.lower(_col(c))
    for a, b in FOLDS_TO_ASCII:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# ------------------------------------------------------------------ I5
# Default stop words (common English function words). A parameter: callers
# may pass any list, e.g. a tokenizer library's full list.
STOP_WORDS = tuple("""a about above after again against all am an and any are as at be because been
before being below between both but by can could did do does doing down during each few for from
further had has have having he her here hers herself him himself his how i if in into is it its
itself just me more most my myself no nor not now of off on once only or other our ours ourselves
out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while
who whom why will with would you your yours yourself yourselves""".split())

TOKEN = r"[\p{L}\p{N}]+"


def tokens(c) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), 0)


def name_key(c, stop_words: Sequence[str] = STOP_WORDS, min_len: int = 3) -> Column:
    """Comparison key of a name: case-folded, transliterated, tokens that are
    not stop words and have at least ``min_len`` letters, joined by one space
    (token text, not lemmas: quirk Q7)."""
    toks = tokens(fold_ascii(c))
    kept = F.filter(toks, lambda t: (F.length(t) >= min_len) & ~t.isin(*stop_words))
    return F.array_join(kept, " ")


# ------------------------------------------------------------------ I6 / I7 / I8 / I9
def split_part(c, sep: str, n: int) -> Column:
    return F.split_part(_col(c), F.lit(sep), F.lit(n))


def strip_ws(c) -> Column:
    """Trim whitespace (spaces, tabs, newlines) at both ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


WIKI_PREFIX = "https://en.wikipedia.org/wiki/"


def article_name(c, prefix: str = WIKI_PREFIX) -> Column:
    """Article title from its URL: prefix removed, percent escapes decoded,
    a literal ``+`` kept (``url_decode`` alone would turn it into a space)."""
    raw = remove_prefix(c, prefix)
    # a percent sign that starts no escape stands for itself
    raw = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def str_after(c, marker: str) -> Column:
    """Text after the first ``marker``; '' when the marker is absent."""
    c = _col(c)
    pos = F.instr(c, marker)
    return F.when(pos > 0, F.substr(c, pos + F.lit(len(marker)))).otherwise(F.lit(""))


# ------------------------------------------------------------------ B14
def any_prefix(c, prefixes: Sequence[str]) -> Column:
    """Case-folded ``c`` starts with one of ``prefixes`` (ASCII)."""
    alt = "|".join(re.escape(p) for p in prefixes)
    return folded_start(c).rlike(f"^(?:{alt})")


# ------------------------------------------------------------------ I13 / I14
def paragraph_text(html_col) -> Column:
    """Plain text of every paragraph, joined by newlines, without scripts, styles, comments
    and ``span.error`` elements (:mod:`wreath.functions.markup`)."""
    return markup.paragraph_text(_col(html_col))


def synopsis(html_col, prefixes: Sequence[str]) -> Column:
    """Text of the first section (headings of level 2 to 6; level 1 is the
    page's title) whose case-folded heading begins with one of ``prefixes``, with its
    subsections (deeper headings up to the next of its own level); without such a section, the
    intro (before the first heading); null when the chosen part has no paragraph text. An empty
    synopsis section gives null, never the intro."""
    return markup.synopsis(_col(html_col), prefixes)
