"""Model adapters: protocols, retries, answers that are kept, and the hosts that
run models over DataFrames."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.tables import stored
from .sources.paths import filesystem

RETRY_STATUS = frozenset({429, 500, 503, 504})
ATTEMPTS = 3


class ModelError(Exception):
    """A failed call; ``status`` is the HTTP status, or None for the network."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class JsonModel(Protocol):
    def __call__(self, prompt: str, images: list[bytes], schema: dict | None) -> str: ...


class ImageModel(Protocol):
    def __call__(self, prompt: str, image: bytes, aspect: str) -> tuple[str, bytes]: ...


class FaceDetector(Protocol):
    def __call__(self, image: np.ndarray) -> list[tuple[int, int, int, int]]: ...


class Embedder(Protocol):
    def image(self, image: np.ndarray) -> np.ndarray: ...

    def text(self, prompt: str) -> np.ndarray: ...


def with_retry(call: Callable[[], Any], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Any:
    """Up to ``attempts`` tries on overload and network errors, pausing 1.5
    seconds times the number of the try."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except ModelError as error:
            if n == attempts or (error.status is not None and error.status not in RETRY_STATUS):
                raise
            wait(1.5 * n)


def json_call(model: JsonModel, prompt: str, images: list[bytes], schema: dict | None) -> str:
    """With retries; a model that refuses JSON mode is asked without a schema."""
    try:
        return with_retry(lambda: model(prompt, images, schema))
    except ModelError as error:
        if schema is None or error.status != 400 or "json mode is not enabled" not in str(error).lower():
            raise
        return with_retry(lambda: model(prompt, images, None))


class Pace:
    """Times of the calls of one of ``callers`` tasks, so that all of them
    together make no more than ``per_second`` calls a second, in even steps: a
    task's first call waits for its turn, the others for a round of all."""

    def __init__(self, per_second: float | None, callers: int, place: int, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self.step = callers / per_second if per_second else 0.0
        self.clock, self.wait = clock, wait
        self.next = clock() + (place % callers) / per_second if per_second else 0.0

    def __call__(self) -> None:
        if self.step:
            now = self.clock()
            if now < self.next:
                self.wait(self.next - now)
            self.next = max(self.next, now) + self.step


def ask(requests: DataFrame, factory: Callable[[], JsonModel], schema: dict | None = None, per_second: float | None = None, callers: int = 1) -> DataFrame:
    """Adds response, error and elapsed_seconds to ``requests`` (with prompt
    and images array<binary>). The model is made once per task; failures are
    recorded, not raised.

    ``per_second`` limits the calls of all tasks together: the requests are
    dealt to ``callers`` tasks, each of which makes its share of them in turn.
    It is reached if as many tasks can run at once, and never exceeded.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", response string, error string, elapsed_seconds double"
    rows = requests.repartition(callers) if per_second else requests

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, pace = factory(), Pace(per_second, callers, TaskContext.get().partitionId())
        for frame in frames:
            out = []
            for prompt, images in zip(frame["prompt"], frame["images"]):
                pace()
                out.append(_answered(model, prompt, images, schema))
            yield frame.assign(response=[o[0] for o in out], error=[o[1] for o in out], elapsed_seconds=[o[2] for o in out])

    return rows.mapInPandas(run, fields)


def _answered(model: JsonModel, prompt: str, images, schema: dict | None) -> tuple[str | None, str | None, float]:
    began = time.monotonic()
    try:
        return json_call(model, prompt, [] if images is None else list(images), schema), None, time.monotonic() - began
    except ModelError as error:
        return None, str(error), time.monotonic() - began


#: Calls after which a task writes down what it was answered.
EVERY = 8
#: Parts of the answer table, each of which one task asks for.
SHELVES = 64
_SHELF = pa.schema([("key", pa.string()), ("response", pa.string()), ("elapsed_seconds", pa.float64())])


def _shelf(store: str, shelf: int) -> tuple:
    fs, base, _ = filesystem(store)
    return fs, f"{base.rstrip('/')}/shelf={shelf}"


def _known(store: str, shelf: int) -> dict[str, tuple[str, float]]:
    """Answers on a shelf, by key."""
    fs, place = _shelf(store, shelf)
    if fs.get_file_info(place).type != pafs.FileType.Directory:
        return {}
    found = {}
    for f in fs.get_file_info(pafs.FileSelector(place)):
        if f.base_name.endswith(".parquet"):
            for row in pq.read_table(fs.open_input_file(f.path), schema=_SHELF).to_pylist():
                found[row["key"]] = (row["response"], row["elapsed_seconds"])
    return found


def _put(store: str, shelf: int, rows: list[tuple[str, str, float]]) -> None:
    """One more file of answers, whole or not at all."""
    fs, place = _shelf(store, shelf)
    fs.create_dir(place, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{place}/.{name}") as out:
        pq.write_table(pa.Table.from_pylist([dict(zip(_SHELF.names, r)) for r in rows], schema=_SHELF), out)
    fs.move(f"{place}/.{name}", f"{place}/{name}.parquet")


def ask_once(requests: DataFrame, factory: Callable[[], JsonModel], store: str, model: str, schema: dict | None = None, per_second: float | None = None, callers: int | None = None, every: int = EVERY) -> DataFrame:
    """As ``ask``, but what ``store`` holds an answer to is not asked.

    An answer's key is a hash of the model's name, the schema, the prompt and
    the images. Equal requests are asked once. A task asks for the keys of its
    shelves of the table and writes down every ``every`` answers; if it is
    killed, its repetition reads them and goes on from there. Failed calls are
    recorded in the result alone, so that a later run asks again. Several runs
    that share a store may at worst ask the same prompt at the same time.
    """
    spark = requests.sparkSession
    asked = json.dumps(schema, sort_keys=True) if schema else ""
    images = F.transform(F.coalesce("images", F.array().cast("array<binary>")), lambda x: F.sha2(F.coalesce(x, F.lit(b"")), 256))
    key = F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.lit(asked).alias("schema"), F.col("prompt").alias("prompt"), images.alias("images"))), 256)
    keyed = requests.withColumn("key_", key)
    n = callers or SHELVES
    todo = keyed.groupBy("key_").agg(F.first("prompt").alias("prompt"), F.first("images").alias("images")).withColumn("shelf", F.pmod(F.xxhash64("key_"), F.lit(SHELVES)).cast("int"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, pace, known = None, Pace(per_second, n, TaskContext.get().partitionId()), {}
        for frame in frames:
            out, fresh = [], {}
            for k, prompt, pictures, shelf in zip(frame["key_"], frame["prompt"], frame["images"], frame["shelf"]):
                if shelf not in known:
                    known[shelf] = _known(store, shelf)
                if k in known[shelf]:
                    response, took = known[shelf][k]
                    out.append((k, response, None, took))
                    continue
                worker = worker or factory()
                pace()
                response, error, took = _answered(worker, prompt, pictures, schema)
                out.append((k, response, error, took))
                if error is None:
                    known[shelf][k] = response, took
                    fresh.setdefault(shelf, []).append((k, response, took))
                    if sum(map(len, fresh.values())) >= every:
                        for s, rows in fresh.items():
                            _put(store, s, rows)
                        fresh = {}
            for s, rows in fresh.items():
                _put(store, s, rows)
            yield pd.DataFrame(out, columns=["key_", "response", "error", "elapsed_seconds"])

    answers = stored(todo.repartition(n, "shelf").mapInPandas(run, "key_ string, response string, error string, elapsed_seconds double"), "answers")
    return keyed.join(answers, "key_").select(*requests.columns, "response", "error", "elapsed_seconds")


def pick_one(groups: DataFrame, factory: Callable[[], JsonModel], key: str = "group_id") -> DataFrame:
    """``(key, best_filename, reason)`` from a local model per group of two or
    more files; a group is a burst, small by nature."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["filename"])
        if len(names) < 2:
            raise ValueError("a choice needs two images")
        got = json.loads(factory()("Pick the best: " + ", ".join(names), list(frame["content"]), None))
        if got["best_filename"] not in names:
            raise ValueError(f"picked an unknown file: {got['best_filename']}")
        return pd.DataFrame({key: [frame[key].iloc[0]], "best_filename": [got["best_filename"]], "reason": [got["reason"]]})

    kind = dict(groups.dtypes)[key]
    return groups.groupBy(key).applyInPandas(run, f"{key} {kind}, best_filename string, reason string")


def _looks(images: DataFrame, looks: list[tuple[dict[str, str], Callable[[], Callable[[np.ndarray], tuple]]]], keep: list[str], decode: Callable[[pd.Series], pd.Series] | None) -> DataFrame:
    """``keep`` plus what looks at decoded images give, all in one worker. A
    look is the types of its columns and what makes it, once per task; rows
    without a picture have nulls. ``decode`` as in ``pixels.stacks``."""
    from .functions.pixels import stacks

    types = dict(images.dtypes)
    added = {n: kind for fields, _ in looks for n, kind in fields.items()}
    fields = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"{n} {kind}" for n, kind in added.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [make() for _, make in looks]
        for frame in frames:
            rows: list[tuple] = [(None,) * len(added)] * len(frame)
            for places, stack in stacks(frame["height"], frame["width"], frame["nChannels"], frame["data"], decode):
                for i, img in zip(places, stack):
                    rows[i] = tuple(v for look in ready for v in look(img))
            yield frame[keep].assign(**{n: pd.Series([r[k] for r in rows], index=frame.index, dtype=object) for k, n in enumerate(added)})

    return images.select(*keep, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, fields)


def _faces(factory: Callable[[], FaceDetector], side: int):
    from .functions.pixels import fit_side

    def make():
        detector = factory()

        def look(img: np.ndarray) -> tuple:
            img = fit_side(img, side)
            return [dict(zip("xywh", map(int, box))) for box in detector(img)], img.shape[0], img.shape[1]

        return look

    return {"faces": "array<struct<x:int,y:int,w:int,h:int>>", "image_h": "int", "image_w": "int"}, make


def _vector(factory: Callable[[], Embedder]):
    def make():
        model = factory()
        return lambda img: (model.image(img).tolist(),)

    return {"clip_vector": "array<double>"}, make


def detect_faces(images: DataFrame, factory: Callable[[], FaceDetector], keep: list[str], side: int = 1280) -> DataFrame:
    """``keep`` plus faces array<struct<x,y,w,h>>, image_h and image_w of decoded
    images, shrunk to ``side`` first."""
    return _looks(images, [_faces(factory, side)], keep, None)


def embed_images(images: DataFrame, factory: Callable[[], Embedder], keep: list[str]) -> DataFrame:
    """``keep`` plus clip_vector; the model loads once per task."""
    return _looks(images, [_vector(factory)], keep, None)


def detect_and_embed(images: DataFrame, detector: Callable[[], FaceDetector], embedder: Callable[[], Embedder], keep: list[str], side: int = 1280, decode: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """What ``detect_faces`` and ``embed_images`` add, of one look at each image,
    so that nothing is joined. ``decode`` as in ``pixels.stacks``."""
    return _looks(images, [_faces(detector, side), _vector(embedder)], keep, decode)


def improve(images: DataFrame, factory: Callable[[], ImageModel]) -> DataFrame:
    """Adds mime, output, error and elapsed_seconds to rows with prompt, content
    and aspect."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields) + ", mime string, output binary, error string, elapsed_seconds double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            out = []
            for prompt, content, aspect in zip(frame["prompt"], frame["content"], frame["aspect"]):
                began = time.monotonic()
                try:
                    out.append((*with_retry(lambda: model(prompt, content, aspect)), None, time.monotonic() - began))
                except ModelError as error:
                    out.append((None, None, str(error), time.monotonic() - began))
            yield frame.assign(**{n: [o[i] for o in out] for i, n in enumerate(("mime", "output", "error", "elapsed_seconds"))})

    return images.mapInPandas(run, fields)


def probe(factory: Callable[[], Any]) -> bool:
    """Whether a model can be made at all, asked once before planning."""
    try:
        factory()
        return True
    except Exception:
        return False


def resolve_project(arg: str | None = None, env: dict | None = None, credentials: str | None = None) -> str | None:
    """A project's name: argument, environment, then the credentials file. Runs
    on the driver; nothing secret enters a plan."""
    env = os.environ if env is None else env
    if arg:
        return arg
    for key in ("GOOGLE_CLOUD_PROJECT", "GCLOUD_PROJECT"):
        if env.get(key):
            return env[key]
    path = credentials or env.get("GOOGLE_APPLICATION_CREDENTIALS")
    if path and Path(path).is_file():
        found = json.loads(Path(path).read_text())
        return found.get("project_id") or found.get("quota_project_id")
    return None


def stage2_command(script: str, model: str, family_divisor: int, portfolio_divisor: int, batch_size: int, timeout: int, stage1_dir: str | None = None, resume_family_dir: str | None = None) -> list[str]:
    """Arguments that start the ranking stage as a process of its own."""
    given = {"--stage1-dir": stage1_dir, "--resume-family-dir": resume_family_dir, "--model": model, "--family-divisor": family_divisor, "--portfolio-divisor": portfolio_divisor, "--batch-size": batch_size, "--timeout": timeout}
    return ["python3", script, *(str(x) for k, v in given.items() if v is not None for x in (k, v))]
