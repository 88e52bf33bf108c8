"""Text, number and timestamp helpers: Column in, Column out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions.rows import bind

# --- fixed values -----------------------------------------------------------
TERM_SEPARATORS = r"""(?U)[\s,，。.!?；;:：、/\\()（）\[\]【】"'“”‘’]+"""
LABEL_GAP = "[^0-9a-z一-鿿]+"
ID_GAP = "[^0-9a-z_]+"
FILE_GAP = r"[^A-Za-z0-9._\-]+"
FILE_SUFFIX = r"^.+(\.[^.]+)$"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
# --- end of fixed values ----------------------------------------------------


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def lookup(values: Mapping[str, str], key: Column) -> Column:
    return F.element_at(literal_map(values), key)


def strip(value: Column | str) -> Column:
    """Trim any Unicode whitespace (``trim`` alone removes spaces only)."""
    return F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")


def collapse_ws(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"(?U)\s+", " "))


def normalize_label_plain(value: Column | str) -> Column:
    text = F.lower(F.coalesce(_col(value), F.lit("")))
    return F.trim(F.regexp_replace(text, LABEL_GAP, " "))


def normalize_label(
    value: Column | str, synonyms: Mapping[str, str] | None = config.LABEL_SYNONYMS
) -> Column:
    """Plain form, then the vocabulary by text or by underscored text."""
    plain = normalize_label_plain(value)
    if not synonyms:
        return plain
    def known(label: Column, name: Column) -> Column:
        return (
            F.when(label.isin(*synonyms), lookup(synonyms, label))
            .when(name.isin(*synonyms), lookup(synonyms, name))
            .otherwise(label)
        )

    # A set tells most labels apart from the vocabulary; its map is searched in order.
    return bind(plain, lambda x: bind(F.replace(x, F.lit(" "), F.lit("_")), lambda name: known(x, name)))


def normalize_id(value: Column | str) -> Column:
    text = F.lower(F.coalesce(_col(value), F.lit("")))
    squeezed = F.regexp_replace(F.regexp_replace(strip(text), ID_GAP, "_"), "_+", "_")
    return F.regexp_replace(squeezed, "^_+|_+$", "")


def parse_seconds(value: Column | str, is_number: Column | bool = False) -> Column:
    """Seconds from a number, ``hh:mm:ss`` text or numeric text, else NULL.

    Only real numbers above 100000 are read as milliseconds.
    """
    as_number = F.lit(is_number) if isinstance(is_number, bool) else is_number

    def read(given: Column) -> Column:
        text = given["text"]
        number = text.try_cast("double")
        clock = F.aggregate(
            F.split(text, ":"),
            F.lit(0.0),
            lambda acc, part: acc * F.lit(60.0) + F.trim(part).try_cast("double"),
        )
        return (
            F.when(given["number"] & (number > 100000), number / 1000)
            .when(given["number"], number)
            .when(F.contains(text, F.lit(":")), clock)
            .otherwise(number)
        )

    text = strip(_col(value).cast("string"))
    return bind(F.struct(text.alias("text"), as_number.alias("number")), read)


def format_timestamp(seconds: Column | str) -> Column:
    """``mm:ss`` or ``hh:mm:ss``, rounding half to even."""
    rounded = F.bround(_col(seconds).cast("double"), 0).cast("bigint")
    total = F.when(rounded.isNotNull(), F.greatest(F.lit(0), rounded))
    hours, minutes, secs = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, secs)).when(
        hours == 0, F.format_string("%02d:%02d", minutes, secs)
    )


def format_duration(duration_ms: Column | str) -> Column:
    ms = _col(duration_ms)
    return F.when(ms <= 0, F.lit(config.UNKNOWN_DURATION)).otherwise(format_timestamp(ms / 1000.0))


def clamp(value: Column | str, low: float, high: float) -> Column:
    value = _col(value)
    # greatest and least skip NULL, so a missing value would come back as a bound.
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def clamp_unit(value: Column | str) -> Column:
    return clamp(value, 0.0, 1.0)


def clamp_seconds(value: Column | str, duration: Column | str) -> Column:
    """Clamp to [0, duration]; no upper bound where the duration is unknown."""
    value, duration = _col(value), _col(duration)
    bounded = F.when(duration <= 0, F.greatest(F.lit(0.0), value)).otherwise(
        F.greatest(F.lit(0.0), F.least(duration, value))
    )
    return F.when(value.isNotNull(), bounded)


def clip_text(value: Column | str, max_chars: int, marker: str = config.CLIP_MARKER) -> Column:
    text = _col(value)
    head = F.regexp_replace(F.substring(text, 1, max_chars), r"(?U)\s+$", "")
    return F.when(F.length(text) > max_chars, F.concat(head, F.lit(marker))).otherwise(text)


def summarize(value: Column | str, max_chars: int = 1000) -> Column:
    return clip_text(value, max_chars, "...")


def tokenize(value: Column | str, synonyms: Mapping[str, str] = config.LABEL_SYNONYMS) -> Column:
    """Ordered distinct query terms; short words survive only through the vocabulary."""
    spaced = F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), TERM_SEPARATORS, " "))
    # Vocabulary keys are lower case, so terms fold and repeat before the lookup.
    words = F.array_distinct(F.split(F.lower(spaced), " "))
    vocabulary = literal_map({k: v for k, v in synonyms.items() if k == k.lower()})

    def term(word: Column) -> Column:
        known = word.isin(*synonyms) if synonyms else F.lit(False)
        return F.when(known, F.element_at(vocabulary, word)).when(F.length(word) > 2, word)

    return F.array_distinct(F.array_compact(F.transform(words, term)))


def frame_type(
    value: Column | str, rules: Mapping[str, Sequence[str]] = config.FRAME_TYPE_KEYWORDS
) -> Column:
    """First class in rule order with a keyword in the text."""
    text = _col(value)
    chain = F
    for name, words in rules.items():
        hit = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(text, F.lit(word))
        chain = chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit("overview_frame"))


def base_name(value: Column | str) -> Column:
    return F.substring_index(F.replace(_col(value), F.lit("\\"), F.lit("/")), "/", -1)


def file_suffix(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(name), FILE_SUFFIX, 1))


def file_stem(name: Column | str) -> Column:
    name = _col(name)
    suffix = F.regexp_extract(name, FILE_SUFFIX, 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix))


def safe_filename(key: Column | str, position: Column | str) -> Column:
    """A path-free image file name; ``frame_%05d`` where nothing usable is left."""
    raw = strip(base_name(key))
    suffix = file_suffix(raw)
    suffix = F.when(suffix.isin(*IMAGE_SUFFIXES), suffix).otherwise(F.lit(".jpg"))
    stem = F.regexp_replace(
        F.regexp_replace(file_stem(raw), FILE_GAP, "_"), r"^[._\-]+|[._\-]+$", ""
    )
    stem = F.when(stem == "", F.format_string("frame_%05d", _col(position))).otherwise(stem)
    return F.concat(stem, suffix)


def frame_timestamp_from_name(name: Column | str) -> Column:
    """``000042000.jpg`` is 42000 ms; anything not numeric is 0."""
    return F.coalesce(file_stem(base_name(name)).try_cast("bigint"), F.lit(0).cast("bigint"))


def media_type(suffix: Column | str, types: Mapping[str, str] | None = None) -> Column:
    types = types or {
        **config.VIDEO_MEDIA_TYPES,
        **config.IMAGE_MEDIA_TYPES,
        **config.DOCUMENT_MEDIA_TYPES,
    }
    return F.coalesce(lookup(types, F.lower(_col(suffix))), F.lit(config.DEFAULT_MEDIA_TYPE))


def yaml_escape(value: Column | str) -> Column:
    text = F.replace(F.coalesce(_col(value), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor blank text."""
    return F.coalesce(*[bind(v, lambda x: F.when(strip(x) != "", x)) for v in values])
