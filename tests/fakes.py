"""Stand-ins for models and clients; workers import this as ``tests.fakes``."""

import json
import zlib
from typing import Any

import numpy as np


def _number(*parts: Any) -> int:
    return zlib.crc32(repr(parts).encode())


class FakeJsonModel:
    """Answers from the prompt's listed names alone, so runs repeat exactly."""

    def __call__(self, prompt: str, images: list[bytes], schema: dict | None = None) -> str:
        names = [x.strip() for x in prompt.rpartition(": ")[2].split(",") if x.strip()]
        order = sorted(names, key=lambda n: (_number(n), n))
        score = {n: 1 + _number(n) % 10 for n in names}
        return json.dumps({
            "keep_filenames": order, "primary_filename": order[0] if order else None, "ranked_filenames": order, "top_filename": order[0] if order else None,
            "top_batch_filenames": sorted(names, key=lambda n: (-score[n], n)), "best_filename": order[0] if order else None, "reason": "chosen by name",
            "photos": [{"filename": n, "printworthy_score": score[n], "reason": "by name"} for n in names], "repair_mode": "tonal_only", "pad_sides": [],
        })


class FakeImageModel:
    def __call__(self, prompt: str, image: bytes, aspect: str) -> tuple[str, bytes]:
        return "image/png", image


class FakeEmbedder:
    """Unit vectors seeded by content."""

    size = 64

    def _of(self, seed: int) -> np.ndarray:
        v = np.random.default_rng(seed).normal(size=self.size)
        return v / np.linalg.norm(v)

    def image(self, image: np.ndarray) -> np.ndarray:
        return self._of(zlib.crc32(np.ascontiguousarray(image).tobytes()))

    def text(self, prompt: str) -> np.ndarray:
        return self._of(zlib.crc32(prompt.encode()))


class SampleClient:
    """A small listing, for tests and trials."""

    files = [
        {"file_id": f"id{i}", "name": f"IMG_{i:04d}.jpg", "mime_type": "image/jpeg" if i % 5 else "image/gif", "width": None if i == 7 else 1000 + 300 * i, "height": 1000 + 200 * i}
        for i in range(25)
    ]

    def page(self, folder_id: str, token: str | None, size: int):
        at = int(token or 0)
        return self.files[at:at + size], str(at + size) if at + size < len(self.files) else None

    def content(self, file_id: str) -> bytes:
        return file_id.encode()
