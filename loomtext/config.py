"""Knobs of index and search, clamped to their valid ranges."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = (".obsidian/**", ".trash/**", ".git/**")
    wiki_folders: tuple[str, ...] = ("5_Wiki",)
    chunk_chars: int = 400
    overlap_chars: int = 60
    chunker: str = "paragraph-v1"
    bm25_top_k: int = 80
    vector_top_k: int = 80
    final_top_k: int = 40
    rrf_k: int = 60
    title_rrf_weight: float = 1.0
    max_chunks_per_file: int = 1
    prefix_fallback: bool = True
    vector_dim: int = 64
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    tokenizer_version: str = "words-v1"

    def clamped(self) -> Config:
        """Every knob moved to the nearest valid value."""
        chars = max(100, self.chunk_chars)
        return replace(
            self,
            chunk_chars=chars,
            overlap_chars=min(max(0, self.overlap_chars), chars - 1),
            bm25_top_k=max(1, self.bm25_top_k),
            vector_top_k=max(1, self.vector_top_k),
            final_top_k=max(1, self.final_top_k),
            rrf_k=max(1, self.rrf_k),
            title_rrf_weight=max(0.0, self.title_rrf_weight),
            max_chunks_per_file=max(1, self.max_chunks_per_file),
            vector_dim=max(1, self.vector_dim),
        )
