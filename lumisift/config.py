"""Settings of a curation run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CurationConfig:
    """Defaults of every threshold. Values enter plans as literals."""

    # source: exactly one of the two
    folder_id: str = ""
    local_root: str | None = None
    page_size: int = 100
    max_download_bytes: int = 100 << 20
    # resolution
    min_megapixels: float = 8.0
    medium_min_megapixels: float = 1.0
    # blur and exposure
    hard_blur_threshold: float = 25.0
    laplacian_threshold: float = 80.0
    black_clip_pct: float = 15.0
    white_clip_pct: float = 15.0
    # aesthetic score
    clip_threshold: float = 0.55
    clip_model: str = "ViT-B-32"
    clip_pretrained: str = "openai"
    positive_prompt: str = "A high quality, professional, beautiful, sharp photograph"
    negative_prompt: str = "A blurry, ugly, amateur, poorly framed snapshot"
    # output
    output_dir: str = "Curated_For_Print"
    output_name: str = "Curated_Best"
    high_dir: str = "Above_8MP"
    medium_dir: str = "Between_1MP_and_8MP"
    # strict groups
    group_cosine: float = 0.97
    group_color: float = 0.14
    group_hash: int = 24
    group_window: int = 20
    sequence_gate: bool = True
    # scene families
    family_cosine: float = 0.93
    family_color: float = 0.28
    family_hash: int = 20
    family_window: int = 4
    # singletons
    singleton_blur: float = 50.0
    singleton_min_quality: float = 2.75
    singleton_penalty: float = 0.6
    # trim
    keep_ratio: float = 1.0
    # background people
    check_background_people: bool = False
    reject_background_people: bool = False
    max_background_faces: int = 0
    min_dominant_face_ratio: float = 0.05
    min_background_face_ratio: float = 0.015
    max_background_relative: float = 0.45
    background_face_penalty: float = 0.25

    @property
    def min_pixels(self) -> int:
        return int(self.min_megapixels * 1_000_000)

    def check_source(self) -> None:
        if bool(self.folder_id) == bool(self.local_root):
            raise ValueError("give a remote folder id or a local root, not both")
