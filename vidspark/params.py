"""Thresholds and weights. All of them are arguments of the operators; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GateProfile:
    """One set of detection and crop-quality limits."""

    name: str
    blur: float
    edges: float
    contrast: float = 25.0
    brightness_low: float = 30.0
    brightness_high: float = 220.0
    detection_confidence: float = 0.65
    match_threshold: float = 0.40


# The limits of the four crop-quality profiles and the two compared pipelines.
VECTOR_IMAGE = GateProfile("vector_image", blur=25.0, edges=8.0, match_threshold=0.45)
VECTOR_VIDEO = GateProfile("vector_video", blur=15.0, edges=8.0, match_threshold=0.45)
FILE_IMAGE = GateProfile("file_image", blur=100.0, edges=15.0, match_threshold=0.30)
FILE_VIDEO = GateProfile("file_video", blur=75.0, edges=15.0, match_threshold=0.55)
PIPELINE_A = GateProfile("current", blur=100.0, edges=15.0, detection_confidence=0.95, match_threshold=0.35)
PIPELINE_B = GateProfile("arcface", blur=100.0, edges=15.0, detection_confidence=0.95, match_threshold=0.50)
GATE_PROFILES = (VECTOR_IMAGE, VECTOR_VIDEO, FILE_IMAGE, FILE_VIDEO, PIPELINE_A, PIPELINE_B)

# Model name -> distance threshold of the ensemble vote.
ENSEMBLE_THRESHOLDS = {"Facenet512": 0.40, "ArcFace": 0.50}

# Labels never confirmed in a video.
BLOCKLIST = ("Stevan_Stojanovic_Mokranjac", "Nikola_Tesla")


@dataclass(frozen=True)
class FrameVote:
    """Confirmation of a label over the frames of one video."""

    relative_score: float = 0.10
    absolute_score: float = 50.0
    best_confidence: float = 75.0
    max_std: float = 20.0
    max_gap: int = 50
    min_run: int = 3
    min_share: float = 0.6
    min_occurrence: int | None = None
    weighted: bool = True
    blocklist: tuple[str, ...] = BLOCKLIST
    strict_reference: bool = False


@dataclass(frozen=True)
class Tracking:
    iou: float = 0.3
    max_missing: int = 2
    min_length: int = 3
    vector_gate: float | None = None


@dataclass(frozen=True)
class TrackVote:
    min_ratio: float = 0.5
    min_consistency: float = 0.4
    min_best: float = 75.0


@dataclass(frozen=True)
class Admission:
    per_person: int = 40
    per_day: int = 3


@dataclass(frozen=True)
class MergeRules:
    typo_similarity: float = 70.0
    duplicate_similarity: float = 90.0
    surname_similarity: float = 80.0
    spelling: tuple[tuple[str, str], ...] = field(default_factory=lambda: SPELLING_PAIRS)
    nicknames: tuple[tuple[str, str], ...] = field(default_factory=lambda: NICKNAMES)


# Transcribed spelling -> international spelling, in rule order.
SPELLING_PAIRS = (
    ("dzejms", "james"),
    ("dzordan", "jordan"),
    ("dzons", "johns"),
    ("dzeksn", "jackson"),
    ("majkl", "michael"),
    ("majk", "mike"),
    ("vilijams", "williams"),
    ("tompson", "thompson"),
    ("kris", "chris"),
    ("kristofer", "christopher"),
    ("stefn", "stephen"),
    ("stiven", "steven"),
    ("entoni", "anthony"),
    ("rodrriguez", "rodriguez"),
    ("mesi", "messi"),
    ("ronaldo", "ronaldo"),
    ("tramp", "trump"),
    ("bajden", "biden"),
    ("mask", "musk"),
    ("durent", "durant"),
    ("brajant", "bryant"),
    ("alkaraz", "alcaraz"),
    ("alkaras", "alcaraz"),
    ("zverev", "zverev"),
    ("siner", "sinner"),
)

# Nickname -> full first name.
NICKNAMES = (
    ("vasa", "vasilije"),
    ("dule", "dusko"),
    ("pera", "petar"),
    ("mika", "milan"),
    ("zika", "zivko"),
    ("bata", "bratislav"),
    ("ceca", "svetlana"),
    ("seka", "jelisaveta"),
)
