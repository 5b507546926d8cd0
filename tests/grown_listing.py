"""A remote listing for tests: ``folder_id`` is a folder with ``files.json``,
which may grow; workers import this as ``tests.grown_listing``."""

import json
from pathlib import Path


class Client:
    def page(self, folder_id, token, size):
        files = json.loads((Path(folder_id) / "files.json").read_text())
        at = int(token or 0)
        return files[at:at + size], str(at + size) if at + size < len(files) else None

    def content(self, file_id):
        return file_id.encode()
