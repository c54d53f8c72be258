"""Defaults of every knob. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Segmentation:
    pause: float = 0.60
    span: float = 12.0
    phrase_words: int = 10
    line_words: int = 8
    soft_line_words: int = 5
    group_threshold: float = 0.50


@dataclass(frozen=True)
class Layout:
    target_chars: int = 28
    hard_chars: int = 34
    max_lines: int = 2
    min_slide: float = 4.0
    strong_pause: float = 3.0
    pause: float = 0.60
    aux_chars: int = 28
    aux_words: int = 3
    allow_aux: bool = True


@dataclass(frozen=True)
class QualityLimits:
    aux_word_ratio: float = 0.10
    aux_slide_ratio: float = 0.35
    over_target_ratio: float = 0.30
    median_line_chars: float = 28.0
    empty_slides: int = 0
    hard_lines: int = 0
    min_transition: float = 3.0
    fast_ratio: float = 0.05
    zero_duration_ratio: float = 0.02
    positive_gap_ratio: float = 0.05
    positive_gap: float = 0.05
    coverage: float = 0.80


@dataclass(frozen=True)
class GateLimits:
    total_slide_ratio: float = 1.50
    video_slide_ratio: float = 2.00
    slide_slack: int = 4
    total_line_ratio: float = 1.75
    video_line_ratio: float = 2.50
    line_slack: int = 8
    fast_ratio: float = 0.05
    aux_words_least: int = 10
    aux_words_share: float = 0.50
    aux_word_ratio: float = 0.10
    over_target_ratio: float = 0.30
    reference_least: float = 0.80
    reference_drop: float = 0.02


TARGET, HARD = Layout().target_chars, Layout().hard_chars
#: Words that may not end a line, and words that don't start a phrase. Fixed values.
WEAK_BREAK = ("a", "o", "as", "os", "um", "uma", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "e", "que", "nao", "não")
WEAK_START = ("a", "ao", "as", "da", "de", "do", "e", "em", "na", "no", "o", "os", "por", "pra", "para", "que", "um", "uma")
FILLERS = ("ah", "eh", "hm", "hmm", "hum", "oh", "uh", "um", "music", "musica", "applause", "aplausos")
#: Transcript sources, and their priorities in a fallback. Fixed values.
SOURCES = ("turbo-vocals", "medium-vocals", "medium-original", "medium-denoise", "turbo-original")
PRIORITY = {"turbo-vocals": 42, "medium-vocals": 38, "medium-denoise": 10, "medium-original": 9, "turbo-original": 7, "youtube-caption": 5}
TICK_RATE, FRAME_SECONDS = 192_000.0, 0.02
FUZZY, SKIP_LYRIC, SKIP_WORD = 0.82, -1.0, -0.7
