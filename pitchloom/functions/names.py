"""Column expressions on file names, paths and class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIO = ("wav", "mp3", "flac")
# Suffixes that name an isolated voice, in the order of removal.
ISOLATION = (".demucs-vocal", ".vocal-s", ".vocal")
# Parts of paths of recordings that are not a lead voice.
NOT_VOICE = ("multitrack", "violin", "mridangam", "ghatam", "secondary")
# Spellings found in metadata and the class they mean, in order.
SPELLINGS = {
    "bhairavi": "Bhairavi",
    "kalyani": "Kalyani",
    "sankarabharanam": "Shankarabharanam",
    "shankarabharanam": "Shankarabharanam",
    "todi": "Thodi",
    "mohanam": "Mohanam",
    "kambhoji": "Kamboji",
    "hamsadhvani": "Hamsadhvani",
    "saveri": "Saveri",
    "abhogi": "Abhogi",
    "madhyamavati": "Madhyamavati",
    "hindolam": "Hindolam",
    "karaharapriya": "Karaharapriya",
    "harikambhoji": "Harikambhoji",
    "begada": "Begada",
}
_MARKED, _PLAIN = "āīūēōṁṃṇṅñḍṭḷṛṣśḥáàâäãåéèêëíìîïóòôöõúùûüç", "aiueommnnndtlrsshaaaaaaeeeeiiiiooooouuuuc"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    """The file's name without folders and extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def is_audio(path: Column, extensions=AUDIO) -> Column:
    return extension(path).isin(*extensions)


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path, counted from its end (1 is the file); null if there is none."""
    return F.try_element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.lit(-from_end))


def without_timestamp(name: Column) -> Column:
    """A feature file's name without ``_YYYYMMDD_HHMMSS.npz``: all from the last but one underscore goes."""
    return F.when(F.size(F.split(name, "_")) >= 3, F.regexp_replace(name, r"_[^_]*_[^_]*$", "")).otherwise(F.replace(name, F.lit(".npz"), F.lit("")))


def version_stamp(name: Column, base: Column) -> Column:
    """The ``YYYYMMDD_HHMMSS`` stamp if the name is exactly ``base``, stamp and ``.npz``; else null."""
    rest = F.when(name.startswith(F.concat(base, F.lit("_"))), F.substring(name, F.length(base) + 2, F.length(name)))
    return F.nullif(F.regexp_extract(rest, r"^(\d{8}_\d{6})\.npz$", 1), F.lit(""))


def song(name: Column) -> Column:
    """The song a feature file belongs to: no timestamp, no isolation suffix, lower case."""
    out = without_timestamp(name)
    for suffix in ISOLATION:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.lower(out)


def song_trailing(name: Column) -> Column:
    """Variant: of the isolation suffixes only the first that ends the name goes."""
    out = without_timestamp(name)
    cut = out
    for suffix in reversed(ISOLATION):
        cut = F.when(out.endswith(suffix), F.substring(out, F.lit(1), F.length(out) - len(suffix))).otherwise(cut)
    return F.lower(cut)


def isolation(name: Column) -> Column:
    """STEM, DEMUCS or OTHER."""
    return F.when(name.contains(".vocal_") | name.contains(".vocal-s_"), "STEM").when(name.contains(".demucs-vocal_"), "DEMUCS").otherwise("OTHER")


def plain_letters(text: Column) -> Column:
    """Lower case without diacritics, precomposed or combining."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _MARKED, _PLAIN)


def class_name(name: Column, spellings: dict[str, str] = SPELLINGS) -> Column:
    """The class that a spelling means: first known spelling contained, else without diacritics, else as it is."""
    out = name
    for text in (plain_letters(F.trim(name)), F.trim(F.lower(name))):
        for key, value in reversed(spellings.items()):
            out = F.when(text.contains(key), F.lit(value)).otherwise(out)
    return out


def first_keyword(text: Column, keywords) -> Column:
    """The first of the keywords that the text contains, in their order; else null."""
    out = F.lit(None).cast("string")
    for k in reversed(list(keywords)):
        out = F.when(F.lower(text).contains(k.lower()), F.lit(k)).otherwise(out)
    return out


def has(text: Column, word: str) -> Column:
    """Whether a text contains a word, in any case."""
    return F.lower(text).contains(word.lower())


def host(url: Column) -> Column:
    """The host of a web address, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^https?://([^/]+)", 1))


def without_words(df: DataFrame, column: str, words) -> DataFrame:
    """Rows whose text has none of the words, in any case; rows without a text stay."""
    out = df
    for w in words:
        out = out.where(~F.coalesce(has(F.col(column), w), F.lit(False)))
    return out


def denied(path: Column, words=NOT_VOICE) -> Column:
    return F.lower(path).rlike("|".join(words))


def percent(x: Column, digits: int = 1) -> Column:
    """A share as a text in percent, rounded as C's ``printf`` does: by the double's exact value, ties to the even digit.

    Java's ``%f`` rounds the shortest decimal form half up; its number patterns do not.
    """
    pattern = "0." + "0" * digits if digits else "0"
    y = (x * 100).cast("double")
    odd = F.when(F.isnan(y), "nan").when(y == float("inf"), "inf").when(y == float("-inf"), "-inf")
    return F.concat(F.coalesce(odd, F.call_function("format_number", y, F.lit(pattern))), F.lit("%"))


def run_id(moment: Column | None = None) -> Column:
    """The name of a run that began at a moment, or now: ``run_YYYYMMDD_HHMMSS`` in the session's time zone."""
    return F.concat(F.lit("run_"), F.date_format(F.current_timestamp() if moment is None else moment, "yyyyMMdd_HHmmss"))
