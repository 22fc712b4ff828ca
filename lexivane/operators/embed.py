"""Text to vectors. Corpus and queries share one embedder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.operators import kernels


def once(function: Callable, kind: str) -> Callable[[Column], Column]:
    """An Arrow function Spark must not run twice.

    Filters on the result of a deterministic function are pushed below it, which
    repeats the call; calling it non-deterministic keeps it in one place.
    """
    return F.arrow_udf(function, kind).asNondeterministic()


def loaded_encoder(key: tuple[str, int], load: Callable[[], Callable]) -> Callable:
    """What ``load`` gave this process the first time. Kept with the interpreter's own
    modules, as functions sent to a worker may arrive without theirs."""
    import sys

    kept = sys.modules.setdefault("_lexivane_encoders", type(sys)("_lexivane_encoders"))
    if not hasattr(kept, "by_key"):
        kept.by_key = {}
    if key not in kept.by_key:
        kept.by_key[key] = load()
    return kept.by_key[key]


@dataclass(frozen=True)
class WordEmbedder:
    """The default embedder: hashed words. Lexical, deterministic, no model to load."""

    dim: int = 384
    name: str = "hashed-words"

    def vector(self, text: Column) -> Column:
        return once(kernels.word_embedder(self.dim), "array<float>")(text)


@dataclass(frozen=True)
class ModelEmbedder:
    """Any batch model: ``load()`` runs once per Python process and returns an
    encoder from a list of texts to a matrix. Vectors are made unit length.
    Embedders of one name and dimension share what was loaded."""

    load: Callable[[], Callable]
    dim: int
    name: str
    batch_size: int = 32

    def vector(self, text: Column) -> Column:
        load, dim, batch_size, key = self.load, self.dim, self.batch_size, (self.name, self.dim)
        unit_rows, list_array, loaded = kernels.unit_rows, kernels.list_array, loaded_encoder

        def embed(texts):
            import numpy as np

            encode = loaded(key, load)
            values = texts.fill_null("").to_pylist()
            parts = [
                np.asarray(encode(values[at : at + batch_size]), dtype=np.float64)
                for at in range(0, len(values), batch_size)
            ]
            matrix = np.concatenate(parts) if parts else np.zeros((0, dim))
            if matrix.shape[1] != dim:
                raise ValueError(f"model gives {matrix.shape[1]} dimensions, expected {dim}")
            unit, empty = unit_rows(matrix)
            return list_array(unit, empty | texts.is_null().to_numpy(zero_copy_only=False))

        return once(embed, "array<float>")(text)


def sentence_transformer(model: str, dim: int = 384) -> ModelEmbedder:
    """A transformer encoder, where that package and the weights are installed."""

    def load():
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model, trust_remote_code=False)
        return lambda texts: encoder.encode(texts, convert_to_numpy=True, show_progress_bar=False)

    return ModelEmbedder(load=load, dim=dim, name=model)


def embed(df: DataFrame, embedder, text: str = "combined_text", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embedder.vector(F.col(text)))


def dimension_fault(vector: Column, dim: int) -> Column:
    """Why a vector cannot be stored, or null."""
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dim, "dimension")
        .when(F.exists(vector, lambda x: x.isNull()), "null element")
    )
