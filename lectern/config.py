"""Settings of ingestion, retrieval and answering, checked when made."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values are those of the engine's published defaults."""

    chunk_size: int = 800
    overlap: int = 30
    min_chunk_chars: int = 20
    min_chunks: int = 2
    dedup_min_chars: int = 40
    max_features: int = 30_000
    alpha: float = 0.45
    top_k: int = 60
    dynamic_low: int = 20
    dynamic_high: int = 40
    dynamic_divisor: int = 5
    rerank_k: int = 5
    min_score: float = 0.01
    mmr_k: int = 3
    mmr_min_rel: float = 0.2
    mmr_lambda: float = 0.72
    mmr_max_chars: int = 650
    mmr_chunks: int = 3
    evidence_chunks: int = 4
    evidence_sentences: int = 2
    evidence_chars: int = 1400
    pdf_max_bytes: int = 50 * 1024 * 1024
    scanned_chars: int = 40
    page_min_chars: int = 100
    embed_dim: int = 64
    mode: str = "structured"

    def __post_init__(self) -> None:
        if not 0 < self.overlap < self.chunk_size:
            raise ValueError("overlap must be positive and smaller than chunk_size")
        if not 0 < self.alpha < 1 or not 0 < self.mmr_lambda <= 1:
            raise ValueError("alpha and mmr_lambda must lie between 0 and 1")
        if self.mode not in ("structured", "local", "hosted"):
            raise ValueError(f"unknown mode {self.mode}")

    @property
    def limit(self) -> int:
        """Words at which a running chunk is cut."""
        return int(self.chunk_size * 1.5)

    @property
    def stride(self) -> int:
        return self.chunk_size - self.overlap

    def fingerprint(self, *made_with) -> str:
        """A short name for what determines an index (and what else it was made with): stored indexes of others aren't read."""
        names = ("chunk_size", "overlap", "min_chunk_chars", "min_chunks", "dedup_min_chars", "max_features", "embed_dim")
        given = {k: v for k, v in asdict(self).items() if k in names} | ({"made_with": made_with} if made_with else {})
        return hashlib.md5(json.dumps(given, sort_keys=True).encode()).hexdigest()[:12]


DEFAULT = Settings()
SMALL = Settings(chunk_size=100, overlap=10)
