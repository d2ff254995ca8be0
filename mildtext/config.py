"""Settings of the preparation and evaluation jobs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PrepConfig:
    """Languages, cleaning limits, split ratios and subset sizes."""

    source_lang: str = "en"
    target_langs: tuple[str, ...] = ("es", "hi")
    max_length: int = 128
    length_ratio: float = 3.0
    few_shot_sizes: tuple[int, ...] = (50, 100, 200)
    # lang -> (validation share, test share); other languages use default_ratios
    split_ratios: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {"en": (0.12, 0.08), "es": (0.25, 0.0), "hi": (0.25, 0.0)}
    )
    default_ratios: tuple[float, float] = (0.25, 0.0)
    prefix: str = "detoxify: "
    seed: int = 42

    @property
    def langs(self) -> list[str]:
        return sorted({self.source_lang, *self.target_langs})


@dataclass(frozen=True)
class EvalConfig:
    """Thresholds of the success predicates and the bootstrap size."""

    toxicity_threshold: float = 0.5
    similarity_threshold: float = 0.75
    base_ppl: float = 1000.0
    bootstrap_n: int = 1000
    bootstrap_ci: float = 0.95
    seed: int = 42
