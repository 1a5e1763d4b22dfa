"""Text normalisation as Column functions; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish letters and what they fold to.
SPANISH_FROM, SPANISH_TO = "áéíóúÁÉÍÓÚñÑüÜ", "aeiouAEIOUnNuU"
# Characters that no file name may hold.
BAD_FILENAME_CHARS = '<>:"/\\|?*'
MAX_FILENAME = 200
# Content types by extension, for documents, attachments and images.
MIME_TYPES = {
    ".pdf": "application/pdf", ".txt": "text/plain", ".html": "text/html", ".csv": "text/csv", ".json": "application/json", ".xml": "application/xml", ".zip": "application/zip",
    ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".heif": "image/heif",
    ".eml": "message/rfc822", ".msg": "application/vnd.ms-outlook", ".rtf": "application/rtf",
}
SPACES = r"[\x09-\x0D\x1C-\x1F\x{85}\p{Z}]+"
DEFAULT_MIME = "application/octet-stream"


def _folding() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is one base letter and marks, and those bases."""
    pairs = []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def tokens(col: Column) -> Column:
    """Runs of non-space (Unicode's spaces and the control characters among them), without the empty ends that split leaves."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACES), lambda x: x != "")


def clean_tokens(col: Column) -> Column:
    """Tokens of three letters or more and nothing but letters, in lower case."""
    return F.transform(F.filter(tokens(col), lambda x: x.rlike(r"^\p{L}{3,}$")), F.lower)


def clean_text(col: Column) -> Column:
    return F.array_join(clean_tokens(col), " ")


def fold_spanish(col: Column) -> Column:
    return F.translate(col, SPANISH_FROM, SPANISH_TO)


def normal_name(col: Column) -> Column:
    """Lower case, without accents and punctuation, single spaces; null is empty."""
    folded = F.regexp_replace(F.translate(F.lower(F.coalesce(col, F.lit(""))), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def domain(col: Column) -> Column:
    """Before the first slash, without scheme and www."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "^https?://", ""), r"^www\.", "")
    return F.split_part(bare, F.lit("/"), F.lit(1))


def human_size(col: Column) -> Column:
    unit = lambda power, name: F.format_string(f"%.2f {name}", F.bround(col / F.lit(float(1024**power)), 2))  # noqa: E731  halves go to even
    return F.when(col < 1024, F.format_string("%d bytes", col)).when(col < 1024**2, unit(1, "KB")).when(col < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def extension(col: Column) -> Column:
    """With its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(col, F.lit("")), r"(\.[^./\\]+)$", 1))


def safe_filename(col: Column) -> Column:
    """Bad characters to _, no dots or spaces at the ends, a name at least, at most MAX_FILENAME characters with the extension kept."""
    name = F.translate(F.coalesce(col, F.lit("")), BAD_FILENAME_CHARS, "_" * len(BAD_FILENAME_CHARS))
    name = F.regexp_replace(name, r"^[ .]+|[ .]+$", "")
    name = F.when(name == "", "unnamed_attachment").otherwise(name)
    end = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.when(F.char_length(name) > MAX_FILENAME, F.concat(F.substring(name, F.lit(1), F.lit(MAX_FILENAME) - F.char_length(end)), end)).otherwise(name)


def attachment_name(long_name: Column, short_name: Column, display_name: Column, position: Column) -> Column:
    """The first of three names that is not blank, else a numbered one (position from 0)."""
    given = [empty_to_null(F.trim(c)) for c in (long_name, short_name, display_name)]
    return F.coalesce(*given, F.concat(F.lit("attachment_"), (position + 1).cast("string")))


def mime_type(name: Column, default: str = DEFAULT_MIME) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit(default))


def image_mime_type(name: Column) -> Column:
    """As mime_type, but unknown extensions are image/<extension>."""
    end = extension(name)
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, end), F.concat(F.lit("image/"), F.substring(end, F.lit(2), F.char_length(end))))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: a separator after the first row, null cells empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |\n"))
    rule = lambda cells: F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(cells)), F.lit("\n"))
    return F.array_join(F.transform(rows, lambda cells, i: F.concat(line(cells), F.when(i == 0, rule(cells)).otherwise(""))), "")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def ole_magic(content: Column) -> Column:
    """Whether bytes open as an OLE compound file."""
    return F.coalesce(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", F.lit(False))
