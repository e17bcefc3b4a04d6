"""Text to vectors: the embedder contract and how it runs inside Spark tasks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.functions.binding import with_computed
from shoal.functions.vectors import hashing_embedding
from shoal.session import ship_package

# Names of the model's tensors.
MODEL_INPUTS = ("input_ids", "attention_mask", "token_type_ids")
MODEL_OUTPUT = "last_hidden_state"


class Embedder:
    """Turns a list of texts into an array of shape (texts, dim).

    Instances travel to the workers with the task, so anything heavy belongs
    into `open`, which runs once per worker process.
    """

    dim: int

    def open(self) -> None:
        """Load what `embed` needs; called in the worker before the first batch."""

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def close(self) -> None:
        """Release what a task holds; what is shared by a worker's tasks stays open."""


class HashingEmbedder(Embedder):
    """Word-count hashing, the same vectors as `hashing_embedding`. Not a model."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                out[row, int(hashlib.sha256(word.encode()).hexdigest()[:8], 16) % self.dim] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


class OnnxEmbedder(Embedder):
    """First-token vector of an ONNX text model, with its own tokenizer file.

    Both files are opened once per worker. A path that does not exist there is
    looked up among the files added with `ship_model`. Texts of equal token
    count share one model call, so no padding enters the computation.
    """

    _open_models: dict[tuple[str, str], tuple] = {}

    def __init__(self, model_path: str, tokenizer_path: str, dim: int = 384, max_batch: int = 64):
        self.model_path = model_path
        self.tokenizer_path = tokenizer_path
        self.dim = dim
        self.max_batch = max_batch

    def open(self) -> None:
        key = (self.model_path, self.tokenizer_path)
        if key not in self._open_models:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(
                _worker_file(self.model_path), options, providers=["CPUExecutionProvider"]
            )
            self._open_models[key] = (session, Tokenizer.from_file(_worker_file(self.tokenizer_path)))

    def embed(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._open_models[(self.model_path, self.tokenizer_path)]
        ids = [encoding.ids for encoding in tokenizer.encode_batch(texts, add_special_tokens=True)]
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        lengths = np.array([len(i) for i in ids])
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for start in range(0, len(rows), self.max_batch):
                part = rows[start : start + self.max_batch]
                tokens = np.array([ids[r] for r in part], dtype=np.int64)
                feeds = (tokens, (tokens != 0).astype(np.int64), np.zeros_like(tokens))
                hidden = session.run([MODEL_OUTPUT], dict(zip(MODEL_INPUTS, feeds)))[0]
                out[part] = hidden.reshape(len(part), -1)[:, : self.dim]
        return out


def _worker_file(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def ship_model(spark: SparkSession, *paths: str) -> None:
    """Copy model files from shared storage to every executor's working folder."""
    for path in paths:
        spark.sparkContext.addFile(path)


def require_embedder(embedder: Embedder | None) -> Embedder:
    """Refuse to build a plan without an embedder."""
    if embedder is None:
        raise ValueError("embedder is not initialized")
    return embedder


def _vectors(array: np.ndarray, valid: np.ndarray, dim: int) -> pa.Array:
    lengths = np.where(valid, dim, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = pa.array(np.ascontiguousarray(array, dtype=np.float32).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~valid))


def embed_batch(embedder: Embedder, ids: list, texts: list[str]) -> np.ndarray:
    """One vector per text, in order; a failure names the record it comes from."""
    try:
        vectors = np.asarray(embedder.embed(texts))
    except Exception:
        for record_id, text in zip(ids, texts):
            try:
                embedder.embed([text])
            except Exception as error:
                raise RuntimeError(f"failed to embed record {record_id!r}: {error}") from error
        raise
    if vectors.shape != (len(texts), embedder.dim):
        raise RuntimeError(f"embedder returned shape {vectors.shape} for {len(texts)} texts of width {embedder.dim}")
    return vectors


def embed_documents(
    df: DataFrame,
    embedder: Embedder | None,
    *,
    id_col: str = "id",
    text_col: str = "document",
    out_col: str = "embedding",
) -> DataFrame:
    """Add one vector per text.

    Only the id and the text go to the Python workers, as Arrow batches; the
    other columns stay in the JVM. A NULL text has a NULL vector.
    """
    embedder = require_embedder(embedder)
    ship_package(df.sparkSession)

    @F.arrow_udf("array<float>")
    def vectors_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        embedder.open()
        try:
            for ids, texts in batches:
                valid = np.asarray(texts.is_valid())
                kept = texts.drop_null().to_pylist()
                vectors = np.zeros((0, embedder.dim))
                if kept:
                    vectors = embed_batch(embedder, ids.filter(texts.is_valid()).to_pylist(), kept)
                yield _vectors(vectors, valid, embedder.dim)
        finally:
            embedder.close()

    # Non-deterministic to the optimizer, or a filter on the vectors would embed twice.
    return df.withColumn(out_col, vectors_of.asNondeterministic()(F.col(id_col), F.col(text_col)))


def hashing_embed(df: DataFrame, dim: int, *, text_col: str = "document", out_col: str = "embedding") -> DataFrame:
    """The hashing stand-in as a plain column expression, without Python workers."""
    return with_computed(df, **{out_col: hashing_embedding(F.col(text_col), dim)})
