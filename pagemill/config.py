"""Settings and errors. Option beats file, file beats default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


class TranscriptionError(Exception):
    """Base of what a run can end with; `exit_code` is what a command line reports."""

    exit_code = 2


class ModelUnavailable(TranscriptionError):
    exit_code = 5


class RecognitionError(TranscriptionError):
    pass


class EncryptedDocument(TranscriptionError):
    exit_code = 3


class CorruptedDocument(TranscriptionError):
    exit_code = 4


class OutOfMemory(TranscriptionError):
    pass


class FormatMismatch(TranscriptionError):
    exit_code = 4


@dataclass(frozen=True)
class ValidatorConfig:
    # fixed values: accept thresholds of the text layer's signals
    min_arabic_ratio: float = 0.5
    max_replacement_ratio: float = 0.05
    max_word_boundary_kl: float = 1.0
    max_presentation_form_ratio: float = 0.5
    min_letter_count: int = 30

    @classmethod
    def of(cls, doc: dict, section: bool = False) -> ValidatorConfig:
        """From [validator]; without it, unless section is asked for, from the top level. Unknown keys are dropped."""
        found = doc.get("validator", {} if section else doc)
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})

    def to_toml(self) -> str:
        return "[validator]\n" + "".join(f"{k} = {v!r}\n" for k, v in asdict(self).items())


@dataclass(frozen=True)
class ClassifyConfig:
    rtl: bool = True
    header_footer_fraction: float = 0.05
    caption_fraction: float = 0.05
    prune_header_footer: bool = True


@dataclass(frozen=True)
class EngineConfig:
    validator: ValidatorConfig = field(default_factory=ValidatorConfig)
    classify: ClassifyConfig = field(default_factory=ClassifyConfig)
    output_format: str = "md"
    pages: tuple[int, ...] | None = None
    dpi: int = 200
    device: str = "auto"
    dtype: str = "auto"
    normalisation: str = "NFC"
    apply_bidi: bool = True
    rtl: bool = True
    page_breaks: bool = True
    strict: bool = False
    force_ml: bool = False
    strip_formulas: bool = True
    batch_size: int = 1


def load_toml(path: str | Path | None) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}


def parse_pages(spec: str | None) -> tuple[int, ...] | None:
    """"1-3,7" as sorted indices from 0; None for all pages; a bad part is a ValueError."""
    if spec is None:
        return None
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, dash, last = part.partition("-")
        low = int(first)
        high = int(last) if dash else low
        if low < 1 or high < low:
            raise ValueError(f"bad page range: {part}")
        found.update(range(low - 1, high))
    return tuple(sorted(found))


def output_format(path: str | None, flag: str | None) -> str:
    """By the file's extension, else the flag, else Markdown; the two must agree."""
    by_name = {".md": "md", ".markdown": "md", ".docx": "docx"}.get(Path(path).suffix.lower()) if path else None
    if flag not in (None, "md", "docx"):
        raise FormatMismatch(f"unknown format: {flag}")
    if by_name and flag and by_name != flag:
        raise FormatMismatch(f"{path} does not fit format {flag}")
    return by_name or flag or "md"


def resolve(option, doc: dict, section: str, key: str, default):
    if option is not None:
        return option
    return doc.get(section, {}).get(key, default)


def workers(value: str | int) -> int:
    if value == "auto":
        return min(os.cpu_count() or 1, 4)
    n = int(value)
    if n < 1:
        raise ValueError("workers must be at least 1")
    return n


def engine_config(*, config: str | Path | None = None, output: str | None = None, format: str | None = None, pages: str | None = None, dpi: int | None = None, device: str | None = None, dtype: str | None = None, batch_size: int = 1, **rest) -> EngineConfig:
    """A checked EngineConfig from options and a TOML file."""
    doc = load_toml(config)
    kind = output_format(output, format)
    if kind == "docx" and not output:
        raise FormatMismatch("docx needs an output file")
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    dpi = int(resolve(dpi, doc, "render", "dpi", 200))
    if dpi <= 0:
        raise ValueError("dpi must be positive")
    return EngineConfig(validator=ValidatorConfig.of(doc, section=True), output_format=kind, pages=parse_pages(pages), dpi=dpi, device=resolve(device, doc, "runtime", "device", "auto"), dtype=resolve(dtype, doc, "runtime", "dtype", "auto"), batch_size=batch_size, **rest)
