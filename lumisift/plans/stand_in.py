"""Models and a client that registered queries use in place of real ones."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq

from ..models import ModelError
from ..sources.paths import filesystem


class OrdinalModel:
    """Answers from the numbers in the listed names: keeps the last names,
    scores by the last digit, ranks by score and name."""

    def __call__(self, prompt: str, images: list[bytes], schema: dict | None = None) -> str:
        names = sorted(x.strip() for x in prompt.rpartition(": ")[2].split(",") if x.strip())
        score = {n: 1 + int("0" + "".join(c for c in n if c.isdigit())) % 10 for n in names}
        best = sorted(names, key=lambda n: (-score[n], n))
        return "Answer: " + json.dumps({
            "keep_filenames": names[::-1], "primary_filename": names[-1] if names else None, "top_batch_filenames": best, "ranked_filenames": best, "top_filename": best[0] if best else None, "best_filename": best[0] if best else None, "reason": "by number",
            "photos": [{"filename": n, "printworthy_score": score[n], "category": "c" + n[-5:-4], "reason": "by number"} for n in names], "reasons": [{"filename": n, "reason": "last " + n[-5:-4]} for n in best[::2]],
        })


class PickingModel(OrdinalModel):
    """The same answer without words around it."""

    def __call__(self, prompt: str, images: list[bytes], schema: dict | None = None) -> str:
        return super().__call__(prompt, images, schema).removeprefix("Answer: ")


class NoSchemaModel:
    """Refuses JSON mode, as some models do, and answers without it."""

    def __call__(self, prompt: str, images: list[bytes], schema: dict | None = None) -> str:
        if schema is not None:
            raise ModelError("JSON mode is not enabled for this model", 400)
        return f"plain: {prompt}, {len(images)} images of {sum(map(len, images))} bytes"


class TurningModel:
    """An image model that gives the bytes back in reverse; it refuses some."""

    def __call__(self, prompt: str, image: bytes, aspect: str) -> tuple[str, bytes]:
        if prompt.startswith("refuse"):
            raise ModelError("refused", 400)
        return f"image/{aspect.replace(':', 'x')}", image[::-1]


class QuarterDetector:
    """Finds one face in a picture's upper left quarter."""

    def __call__(self, image: np.ndarray) -> list[tuple[int, int, int, int]]:
        return [(0, 0, image.shape[1] // 2, image.shape[0] // 2)]


class MeanEmbedder:
    """A picture's mean blue, green and red."""

    def image(self, image: np.ndarray) -> np.ndarray:
        return image.reshape(-1, image.shape[2]).mean(axis=0)

    def text(self, prompt: str) -> np.ndarray:
        return np.ones(3)


class PartListing:
    """A remote listing of the parts of a folder of tables: ``folder_id`` is
    that folder. A part is a file whose size follows from its key."""

    def __init__(self):
        self.files: dict[str, list] = {}
        self.group: tuple = (None, None)

    def _rows(self, folder: str, file: int, group: int) -> pa.Table | None:
        """A row group of a file of the table, the last one kept; None if the
        table has no such file or the file no such group."""
        if folder not in self.files:
            fs, path, _ = filesystem(f"{folder}/part.parquet")
            self.files[folder] = [pq.ParquetFile(fs.open_input_file(f)) for f in ds.dataset(path, filesystem=fs, format="parquet").files]
        if file >= len(self.files[folder]):
            return None
        if self.group[0] != (folder, file, group):
            read = self.files[folder][file]
            rows = read.read_row_group(group, columns=["p_partkey", "p_name", "p_size"]) if group < read.num_row_groups else None
            self.group = (folder, file, group), rows
        return self.group[1]

    def page(self, folder_id: str, token: str | None, size: int) -> tuple[list[dict], str | None]:
        """The next rows of the table in the order of its files. A token is the
        file, the row group and the row where a page begins; a page ends with
        its row group, so that only that group is read."""
        file, group, at = map(int, token.split(".")) if token else (0, 0, 0)
        rows = self._rows(folder_id, file, group)
        if rows is None:
            return [], f"{file + 1}.0.0" if file + 1 < len(self.files[folder_id]) else None
        files = [
            {"file_id": f"id{k}", "name": f"{name}.jpg", "mime_type": "image/png" if k % 3 else "text/plain", "width": 100 * n + 1 if n % 5 else None, "height": 1001 + 2 * (k % 350)}
            for k, name, n in zip(*(rows.column(c).slice(at, size).to_pylist() for c in ("p_partkey", "p_name", "p_size")))
        ]
        return files, f"{file}.{group}.{at + size}" if at + size < rows.num_rows else f"{file}.{group + 1}.0"

    def content(self, file_id: str) -> bytes:
        return b"x" * (int(file_id[2:]) % 50)
