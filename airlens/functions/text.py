"""Column expressions for text: normalisation, entity keys, acronyms, request ids, samples, cosine."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> tuple[str, str]:
    """Latin letters with marks, and their base letters."""
    marked, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1:
            marked.append(chr(code))
            base.append(parts[0])
    return "".join(marked), "".join(base)


_MARKED, _BASE = _bases()

#: Words that are no part of a person's name.
TITLES = (
    "presidente", "presidenta", "expresidente", "expresidenta", "licenciado", "licenciada", "lic", "doctor", "doctora", "dr", "dra",
    "ingeniero", "ingeniera", "ing", "abogado", "abogada", "diputado", "diputada", "alcalde", "alcaldesa", "ministro", "ministra",
    "senor", "senora", "don", "dona", "el", "la",
)


def unmarked(text: Column) -> Column:
    """Lower case, without marks."""
    return F.lower(F.regexp_replace(F.translate(text, _MARKED, _BASE), r"\p{Mn}", ""))


def normalize_text(text: Column) -> Column:
    """Without marks, lower case, words of letters, digits and underscores with one space between."""
    plain = unmarked(text)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_entity(name: Column, kind: Column) -> Column:
    """normalize_text; of a person, without titles unless nothing else would be left."""
    plain = normalize_text(name)
    rest = F.filter(F.split(plain, " "), lambda w: ~w.isin(*TITLES))
    return F.when((kind == "persona") & (F.size(rest) > 0), F.array_join(rest, " ")).otherwise(plain)


def titled_entity(name: Column, kind: Column) -> Column:
    """The same with titles kept, of any kind: `La-Paz` stays `la paz`."""
    return normalize_text(name)


def acronym(key: Column) -> Column:
    """Initials of three words or more, else null."""
    parts = F.split(key, " ")
    return F.when(F.size(parts) >= 3, F.array_join(F.transform(parts, lambda w: F.left(w, F.lit(1))), ""))


def embedding_text(title: Column, summary: Column) -> Column:
    return F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit(". "), F.substring(F.trim(F.coalesce(summary, F.lit(""))), 1, 400))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of other lengths and those of norm 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


#: Letters that a request id may have (a fixed value of the batch interface).
ID_LENGTH = 64


def custom_id(rec_id: Column, chunk: Column) -> Column:
    """`recording__chunk`; an id that would be longer than ID_LENGTH is an error, for its answer would never be found again."""
    whole = F.concat_ws("__", rec_id.cast("string"), chunk.cast("string"))
    return F.when(F.length(whole) <= ID_LENGTH, whole).otherwise(F.raise_error(F.concat(F.lit("request id too long: "), whole)))


def parse_custom_id(value: Column) -> tuple[Column, Column]:
    """Recording and chunk, parted at the last `__`."""
    return F.regexp_extract(value, r"^(.*)__(\d+)$", 1), F.regexp_extract(value, r"^(.*)__(\d+)$", 2).cast("int")


def control_sample(ref: Column, idx: Column, percent: int = 20) -> Column:
    """Whether the hash of `ref#idx` falls under so many percent."""
    hashed = F.sha2(F.concat_ws("#", ref.cast("string"), idx.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % 100 < percent


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t\n\r]+"), "")


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)
