"""Optional outside engines behind plain functions: each says clearly what is missing.

A page parser turns PDF bytes into page rows; a recogniser of names turns text into spans; an image decoder turns bytes
into arrays; a document client turns bytes into a result in JSON. They are built once per Python worker.
"""

from __future__ import annotations

import functools
import importlib
import os
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodestone.functions import imaging
from lodestone.operators import pii, text_quality


class Missing(ImportError):
    """An optional library that this adapter needs is not installed."""


def need(module: str, purpose: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise Missing(f"{purpose} needs the optional library {module}") from e


def per_worker(make: Callable[[], Callable]) -> Callable:
    """make() once in each Python worker, on first use."""
    return functools.lru_cache(maxsize=1)(make)


def map_files(files: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]], schema: str) -> DataFrame:
    """Rows that a parser makes of each file (path, content), with the path and an error instead of a failed stage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make()
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [{"path": path, "error": None, **r} for r in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001 - one bad file is a row, not the end of the job
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}", **dict.fromkeys(names)})
            yield pd.DataFrame(rows, columns=["path", "error", *names], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def pdf_pages() -> Callable[[bytes], list[dict]]:
    """Page text by pdfplumber."""
    import io

    library = need("pdfplumber", "reading PDF pages")

    def parse(content: bytes) -> list[dict]:
        with library.open(io.BytesIO(content)) as pdf:
            return [{"page": i + 1, "text": p.extract_text() or "", "n_images": len(p.images), "height": float(p.height)} for i, p in enumerate(pdf.pages)]

    return parse


def image_arrays(mode: str = "RGB") -> Callable[[bytes], list[dict]]:
    """Raw pixels by Pillow, in colour (RGB) or gray (L)."""
    import io

    library = need("PIL.Image", "decoding images")

    def parse(content: bytes) -> list[dict]:
        image = library.open(io.BytesIO(content)).convert(mode)
        return [{"pixels": image.tobytes(), "height": image.height, "width": image.width, "channels": len(mode)}]

    return parse


def page_regions(resolution: int = 300) -> Callable[[bytes, int, tuple[float, float, float, float]], np.ndarray]:
    """A region (x0, y0, x1, y1, from the bottom as PDF has it) of a page as a gray array, by pdfplumber; what lies outside
    the page is left out."""
    import io

    library = need("pdfplumber", "cropping PDF pages")

    def crop(content: bytes, page: int, box: tuple[float, float, float, float]) -> np.ndarray:
        with library.open(io.BytesIO(content)) as pdf:
            p = pdf.pages[page - 1]
            x0, y0, x1, y1 = box
            inside = (max(0, x0), max(0, p.height - y1), min(p.width, x1), min(p.height, p.height - y0))
            return np.array(p.crop(inside).to_image(resolution=resolution).original.convert("L"))

    return crop


# The recogniser's names of languages; others are read as English.
OCR_LANGUAGES = {"en": "eng", "es": "spa", "fr": "fra", "it": "ita"}


def ocr_language(language: str) -> str:
    return OCR_LANGUAGES.get(language, "eng")


def recognised_text(language: str = "en") -> Callable[[bytes], list[dict]]:
    """Text of images by pytesseract after imaging.prepared: one block of text (psm 6), default engine (oem 3)."""
    import io

    engine, library = need("pytesseract", "recognising text"), need("PIL.Image", "decoding images")

    def parse(content: bytes) -> list[dict]:
        page = imaging.prepared(np.array(library.open(io.BytesIO(content)).convert("L")))
        return [{"text": engine.image_to_string(page, lang=ocr_language(language), config="--psm 6 --oem 3")}]

    return parse


def image_texts(files: DataFrame, vocabulary: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]] = recognised_text, threshold: float = text_quality.VALIDITY_THRESHOLD) -> DataFrame:
    """path, text, error, valid: recognised texts with a flag of their quality, which drops nothing."""
    read = map_files(files, make, "text string").withColumnRenamed("path", "doc_id")
    flags = text_quality.validity(read.select("doc_id", "text"), vocabulary, threshold)
    return read.join(flags, "doc_id").select(read["doc_id"].alias("path"), "text", "error", "valid")


def msg_rows() -> Callable[[bytes], list[dict]]:
    """E-mail fields and attachments by extract_msg."""
    library = need("extract_msg", "reading .msg files")
    return lambda content: [msg_row(library.openMsg(content))]


def msg_row(m) -> dict:
    """The fields of an opened message; each attachment with its three names, bytes, size, and whether it is an e-mail."""
    def attachment(a) -> dict:
        embedded = not isinstance(a.data, bytes | None)
        name = lambda field: getattr(a, field, None)
        return {"long_name": name("longFilename"), "short_name": name("shortFilename"), "display_name": name("name"), "size": 0 if embedded or a.data is None else len(a.data), "is_embedded_email": embedded, "content": None if embedded else a.data}

    fields = {f: getattr(m, f, None) for f in ("subject", "body", "sender", "to", "cc", "bcc")}
    return fields | {"date": str(m.date) if m.date else None, "message_id": getattr(m, "messageId", None), "importance": str(m.importance) if getattr(m, "importance", None) is not None else None, "attachments": [attachment(a) for a in m.attachments]}


MSG_SCHEMA = "subject string, body string, sender string, to string, cc string, bcc string, date string, message_id string, importance string"
ATTACHMENT = "array<struct<long_name:string,short_name:string,display_name:string,size:long,is_embedded_email:boolean,content:binary>>"


class Clients:
    """A client of an outside service by its settings, made once in each process: given ones, else those of the environment."""

    made: dict[tuple, object] = {}

    def __init__(self, make: Callable[[str, str], object], variables: tuple[str, str], endpoint: str | None = None, key: str | None = None):
        self.make, self.variables, self.given = make, variables, (endpoint, key)

    def settings(self) -> tuple[str, str]:
        found = tuple(value or os.environ.get(variable) for value, variable in zip(self.given, self.variables, strict=True))
        if missing := [v for v, x in zip(self.variables, found, strict=True) if not x]:
            raise ValueError(f"not set: {', '.join(missing)}")
        return found

    def get(self):
        at = (self.make, *self.settings())
        if at not in self.made:
            self.made[at] = self.make(*at[1:])
        return self.made[at]

    def is_ready(self) -> bool:
        return (self.make, *self.settings()) in self.made

    def valid(self) -> bool:
        """Whether a client can be made; nothing is sent."""
        try:
            self.make(*self.settings())
        except Exception:  # noqa: BLE001 - any failure is the answer
            return False
        return True

    def reset(self) -> None:
        self.made.pop((self.make, *self.settings()), None)


def polled(begin: Callable[[bytes, str], Callable[[], str | None]], wait: float = 1.0, limit: float = 300.0) -> Callable[[bytes, str], str]:
    """A client of a long-running service: begin() starts the work on a document and gives what asks for its result, null
    until it is there."""

    def client(content: bytes, model: str) -> str:
        ask, end = begin(content, model), time.monotonic() + limit
        while (result := ask()) is None:
            if time.monotonic() + wait > end:
                raise TimeoutError(f"no result after {limit} s")
            time.sleep(wait)
        return result

    return client


def names_in(language: str) -> Callable[[], Callable[[str], list[tuple[str, int, int, float]]]]:
    """named_entities with the language's model."""
    return named_entities(pii.NAME_MODELS[pii.check_language(language)])


def named_entities(model: str) -> Callable[[], Callable[[str], list[tuple[str, int, int, float]]]]:
    """A recogniser of PERSON, LOCATION and NRP by a spaCy model, for lodestone.operators.pii."""
    kinds = {"PERSON": "PERSON", "PER": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION", "NORP": "NRP"}

    def make():
        nlp = need("spacy", "recognising names").load(model)
        return lambda text: [(kinds[e.label_], e.start_char, e.end_char, 0.85) for e in nlp(text).ents if e.label_ in kinds]

    return per_worker(make)
