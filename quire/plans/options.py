"""Options of the operators, checked when they are made."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession


def _ratio(name: str, value: float, most: float = 1.0) -> None:
    if not 0 < value <= most:
        raise ValueError(f"{name} must be above 0 and at most {most:g}")


@dataclass(frozen=True)
class PageOptions:
    least_chars: int = 20
    mixed_image_ratio: float = 0.15
    scanned_image_ratio: float = 0.65

    def __post_init__(self) -> None:
        _ratio("mixed_image_ratio", self.mixed_image_ratio)
        _ratio("scanned_image_ratio", self.scanned_image_ratio)


@dataclass(frozen=True)
class RepeatedOptions:
    mode: str = "auto"
    margin: float = 0.12
    recurrence: float = 0.60
    parity_recurrence: float = 0.75
    geometry_tolerance: float = 0.035
    font_tolerance: float = 0.18
    watermark_font: float = 1.60
    least_pages: int = 3

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "off"):
            raise ValueError("mode is auto or off")
        for name in ("margin", "recurrence", "parity_recurrence", "geometry_tolerance", "font_tolerance"):
            _ratio(name, getattr(self, name))
        if self.watermark_font <= 1 or self.least_pages < 3:
            raise ValueError("watermark_font must be above 1 and least_pages at least 3")


@dataclass(frozen=True)
class ParagraphOptions:
    mode: str = "conservative"
    alignment: float = 8.0
    indentation: float = 14.0
    gap: float = 0.75
    width: float = 0.72
    gutter: float = 0.08
    heading_font: float = 1.18
    footnote_font: float = 0.82
    page_edge: float = 0.18

    def __post_init__(self) -> None:
        if self.mode not in ("conservative", "off"):
            raise ValueError("mode is conservative or off")
        for name in ("alignment", "indentation", "gap", "heading_font"):
            _ratio(name, getattr(self, name), float("inf"))
        for name in ("width", "gutter", "footnote_font", "page_edge"):
            _ratio(name, getattr(self, name))


@dataclass(frozen=True)
class LayoutOptions:
    least_font: float = 6.0
    font_step: float = 0.5
    line_height: float = 1.2
    padding: float = 0.5
    expand: bool = False
    default_font: float = 11.0

    def __post_init__(self) -> None:
        if min(self.least_font, self.font_step, self.line_height) <= 0 or self.padding < 0 or self.default_font < self.least_font:
            raise ValueError("fonts, step and line height must be above 0, padding not below, and the default font not below the least")


@dataclass(frozen=True)
class TranslationOptions:
    backend: str = "fake"
    model: str = "prefix"
    source: str = "en"
    target: str = "ru"
    batch_size: int = 8
    token_limit: int = 64

    def __post_init__(self) -> None:
        if self.batch_size < 1 or self.token_limit < 8 or not self.model:
            raise ValueError("a batch has 1 segment or more, a segment 8 tokens or more, and the model has a name")


def identity(*options: object) -> str:
    """Of a run: the hash of its options in canonical JSON."""
    values = [asdict(o) if hasattr(o, "__dataclass_fields__") else o for o in options]  # type: ignore[call-overload]
    return hashlib.sha256(json.dumps(values, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _parsed(name: str, kind: type, text: str) -> object:
    if kind is bool:
        if text.strip().lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name} is true or false, not {text!r}")
        return text.strip().lower() in ("true", "1")
    try:
        return kind(text)
    except ValueError as e:
        raise ValueError(f"{name} is a value of type {kind.__name__}, not {text!r}") from e


def from_environment(kind: type, prefix: str = "QUIRE_") -> object:
    """Options with the values that variables such as QUIRE_TOKEN_LIMIT give."""
    return from_settings(kind, None, prefix)


def from_settings(kind: type, spark: SparkSession | None = None, prefix: str = "QUIRE_", key: str = "spark.quire.") -> object:
    """Options with the values of the session's settings, such as spark.quire.token_limit, or else of variables such as QUIRE_TOKEN_LIMIT.

    A blank value counts as none. What a value can't be is an error that names it; bounds are those of the options themselves.
    """
    own, given = kind(), {}
    for f in fields(kind):
        for name, text in ((key + f.name, spark.conf.get(key + f.name, None) if spark else None), (prefix + f.name.upper(), os.environ.get(prefix + f.name.upper()))):
            if text is not None and text.strip():
                given[f.name] = _parsed(name, type(getattr(own, f.name)), text)
                break
    try:
        return kind(**given)
    except ValueError as e:
        raise ValueError(f"settings of {kind.__name__}: {e}") from e
