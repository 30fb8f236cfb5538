"""Settings of a corpus run; every field is a parameter of one operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

# Eras in rule order, first match wins, both bounds inclusive.
ERAS: tuple[tuple[int, int, str], ...] = (
    (1993, 2001, "Clinton"),
    (2001, 2009, "Bush"),
    (2009, 2017, "Obama"),
    (2017, 2021, "Trump"),
    (2021, 2025, "Biden"),
)

# Presentation order of the known presidents.
PRESIDENTS: tuple[str, ...] = ("Clinton", "Bush", "Obama", "Trump", "Biden")


def eps_grid(low: float = 0.1, high: float = 2.0, steps: int = 10) -> tuple[float, ...]:
    """Evenly spaced radii, both ends included."""
    return tuple(float(e) for e in np.linspace(low, high, steps))


@dataclass(frozen=True)
class CleanSettings:
    remove_stopwords: bool = True
    min_word_length: int = 3
    use_lemmas: bool = True
    lemma_chars: int | None = None  # None: whole text
    max_text_length: int | None = None  # None: whole text

    def capped(self) -> "CleanSettings":
        """The classic budget: 10,000 characters lemmatised, 5,000 kept."""
        return replace(self, lemma_chars=10_000, max_text_length=5_000)


@dataclass(frozen=True)
class EmbedSettings:
    dim: int = 384
    min_chars: int = 50
    max_chars: int | None = None  # None: whole text; 2,048 for word-piece models
    batch_size: int = 32


@dataclass(frozen=True)
class AnalysisSettings:
    pca_components: int = 50
    perplexity: int = 30
    tsne_iterations: int = 1000
    umap_neighbors: int = 15
    umap_min_dist: float = 0.1
    default_k: int = 5
    k_min: int = 2
    k_stop: int = 10  # exclusive
    restarts: int = 10
    min_samples: int = 5
    eps_values: tuple[float, ...] = field(default_factory=eps_grid)
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    start_year: int = 1994
    end_year: int = 2025
    per_page: int = 1000
    clean: CleanSettings = CleanSettings()
    embed: EmbedSettings = EmbedSettings()
    analysis: AnalysisSettings = AnalysisSettings()
