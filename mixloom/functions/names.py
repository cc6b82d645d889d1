"""Keys that bring different spellings of one dataset or language together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-2/3 codes and English names of languages -> ISO 639-1.
LANGUAGES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "spa": "es", "spanish": "es",
    "español": "es", "rus": "ru", "russian": "ru", "zho": "zh", "chi": "zh", "chinese": "zh",
    "cmn": "zh", "jpn": "ja", "japanese": "ja", "hin": "hi", "hindi": "hi", "tha": "th",
    "thai": "th", "ara": "ar", "arabic": "ar", "kor": "ko", "korean": "ko", "por": "pt",
    "portuguese": "pt", "ita": "it", "italian": "it",
}
UNKNOWN = ("", "und", "unknown", "unk", "none", "null", "mul", "mis", "zxx", "n/a", "na", "xx")


def dataset_key(name: Column) -> Column:
    """Name after the owner, without surrounding white space of any kind, in lower case, with
    ``-``, white space and ``_`` alike. Null stays null, a blank name becomes null."""
    bare = F.regexp_replace(name, r"(?s)^.*/", "")
    bare = F.regexp_replace(bare, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+\z", "")
    bare = F.lower(F.regexp_replace(bare, r"(?U)[-\s_]", "_"))
    return F.when(bare != "", bare)


def lang_key(code: Column) -> Column:
    """Two-letter code of a language in any notation; ``und`` for null, blank and unknown ones."""
    plain = F.lower(F.regexp_replace(F.coalesce(code, F.lit("")), r"(?U)^\s+|\s+\z", ""))
    first = F.regexp_extract(plain, r"^([^-_]*)", 1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(plain.isin(*UNKNOWN), F.lit("und")).otherwise(F.coalesce(table[first], first))
