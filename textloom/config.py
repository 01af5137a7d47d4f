"""Tunable limits, with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    parent_similarity: float = 0.50
    child_similarity: float = 0.62
    words_per_token: float = 1.3
    child_max_tokens: int = 800
    child_drop_tokens: int = 6
    child_merge_tokens: int = 45
    question_share: float = 0.6
    parent_drop_tokens: int = 30
    parent_merge_tokens: int = 100
    parent_max_tokens: int = 1200
    snippet_tokens: int = 100
    planner_context_tokens: int = 4000
    generation_context_tokens: int = 3000
    header_share: float = 0.6
    header_least: int = 3
    header_lines: int = 3
    cut_options: bool = True  # whether items with answer options are junk
    cut_footnotes: bool = True  # whether footnote numbers inside a text go
    join_references: bool = True  # whether "Table. 3" and the like end no sentence
    join_lone: bool = True  # whether the last sentence goes on after an abbreviation that stands alone
    wide_edges: bool = True  # whether letters beyond ASCII are letters at a word's edge
    near_duplicate: float = 0.35
    plan_overlap: float = 0.6
    title_min_words: int = 2
    title_max_words: int = 15
    title_batch: int = 4
    title_recent: int = 4
    tag_titles: bool = False  # whether titles must be noun phrases by the tagger
    embedding_dim: int = 1024
    rrf_k: int = 60
    over_fetch: int = 3
    plan_attempts: int = 3
    repair_attempts: int = 2
    fill_attempts: int = 2
    json_repairs: int = 2

    @property
    def child_max_words(self) -> int:
        return max(1, int(self.child_max_tokens / self.words_per_token))

    @property
    def parent_max_words(self) -> int:
        return max(1, int(self.parent_max_tokens / self.words_per_token))


DEFAULTS = Settings()
