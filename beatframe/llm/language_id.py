"""Language of a text by a byte convolutional network with filters of several widths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from beatframe.llm.conv import draw, learning_chunks, mean_logits, softmax, start, train

WINDOW = 256


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed: Column | None = None,
                    per_class: int = 500, per_doc: int = 6, steps: int = 400, most: int = 50_000) -> tuple[dict, list[str]]:
    """Train on at most about ``per_class`` documents of each language and ``most`` in all, ``per_doc`` windows each (bounds of the sample).

    Only texts with a letter and a non-null language are learned from. Many languages lower the documents of each (see ``draw``); none is left out
    up to ``most`` languages.
    """
    rows = docs.where((allowed if allowed is not None else F.lit(True)) & F.rlike(text_col, F.lit(r"\p{L}")))
    drawn, _ = draw(rows.select(F.col(lang_col).alias("y"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_class, most)
    x, y = learning_chunks(drawn, WINDOW, per_doc)
    names = sorted(set(y))
    params = start(max(1, len(names)), (3, 4, 5), 10, 8, 16, 1, seed=5)
    if len(names) > 1:
        params = train(x, np.searchsorted(names, y), params, steps)
    return params, names


def language(text: Column, params: dict, names: list[str]) -> Column:
    """Struct (lang_pred, score): softmax of the mean logits of all 256-byte windows of the text.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language was learned.
    """
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(col: pa.Array) -> pa.Array:
        p = softmax(mean_logits(col, params, WINDOW, WINDOW))
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array([names[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best])], names=["lang_pred", "score"])
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not names:
        return und
    letters = F.rlike(text, F.lit(r"\p{L}"))
    return F.when(letters, predict(text)).otherwise(und)
