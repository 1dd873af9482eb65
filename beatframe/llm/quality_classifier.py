"""Document quality by a byte convolutional network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from beatframe.llm.conv import draw, learning_chunks, mean_logits, start, train

CHUNK, HOP = 512, 448


def crc_remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None,
                  per_class: int = 1500, per_doc: int = 6, steps: int = 500) -> dict:
    """Train on at most about ``per_class`` labelled documents of each class, ``per_doc`` chunks each (bounds of the sample).

    Only the text is an input. Labels other than 0 and 1, null texts and rows without an id are not learned from. With no usable
    label, or labels of one class only, the prior decides. The ids must not repeat in ``labels``.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (allowed if allowed is not None else F.lit(True))).select(
        F.col(label_col).cast("int").alias("y"), F.col(id_col).alias("id"))
    drawn, counts = draw(known, per_class)
    rows = F.broadcast(drawn).join(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), F.col("doc") == F.col("id"))
    x, y = learning_chunks(rows, CHUNK, per_doc)
    params = start(2, (8,), 32, 8, 16, 2, seed=3)
    if len(set(y)) == 2:
        params = train(x, np.array(y), params, steps)
    else:
        params["out"][:] = 0
    n_of = {r["y"]: r["n"] for r in counts.collect()}  # two classes
    prior = np.log((n_of.get(1, 0) + 1) / (n_of.get(0, 0) + 1))
    params["out_bias"] = params["out_bias"] + np.array([0, prior], np.float32)  # learned on even classes
    return params


def quality_score(text: Column, params: dict) -> Column:
    """Probability of label 1: filters over 512-byte chunks that overlap by 64 bytes and cover the whole text, max-pooled per chunk,
    the mean of the chunks' logits combined into one probability. Null and empty texts are scored as one empty chunk."""
    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        z = mean_logits(col, params, CHUNK, HOP)
        return pa.array(1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60))))
    return score(text)
