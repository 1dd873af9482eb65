"""A small byte convolutional network in numpy: embedding, filters of one or more widths, max pooling, two dense layers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beatframe.llm.base import stage, text_buffers


def as_windows(x: np.ndarray, params: dict) -> np.ndarray:
    """Embedded bytes of every filter position, side by side: (chunks, positions, width * dims)."""
    e, width, stride = params["embed"][x], params["width"], params["stride"]
    b, n, d = e.shape
    s = e.strides
    return np.lib.stride_tricks.as_strided(e, (b, (n - width) // stride + 1, width * d), (s[0], s[1] * stride, s[2])).reshape(-1, width * d)


def forward(x: np.ndarray, params: dict) -> tuple[np.ndarray, tuple]:
    """Logits of chunks (rows of bytes), and what the way back needs."""
    z = (as_windows(x, params) @ params["filters"]).reshape(len(x), -1, params["filters"].shape[1])
    at = z.argmax(axis=1) if params.get("training") else None
    top = z.max(axis=1) + params["bias"]
    pooled = np.maximum(top, 0)
    hidden = np.maximum(pooled @ params["dense"] + params["dense_bias"], 0)
    return hidden @ params["out"] + params["out_bias"], (at, top, pooled, hidden)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def start(classes: int, widths: tuple[int, ...], filters: int, dims: int, hidden: int, stride: int, seed: int) -> dict:
    """Random weights; narrower filters are zero outside their width."""
    g, width = np.random.default_rng(seed), max(widths)
    mask = np.concatenate([np.repeat(np.arange(width * dims) < w * dims, filters).reshape(width * dims, filters) for w in widths], axis=1)
    f = filters * len(widths)
    p = {"embed": g.normal(0, 1, (256, dims)), "filters": g.normal(0, 1, mask.shape) * mask / np.sqrt(mask.sum(0)), "bias": np.zeros(f),
         "dense": g.normal(0, np.sqrt(2 / f), (f, hidden)), "dense_bias": np.zeros(hidden), "out": g.normal(0, 0.1, (hidden, classes)), "out_bias": np.zeros(classes)}
    return {k: v.astype(np.float32) for k, v in p.items()} | {"mask": mask.astype(np.float32), "width": width, "stride": stride}


LEARNED = ("embed", "filters", "bias", "dense", "dense_bias", "out", "out_bias")


def gradients(x: np.ndarray, y: np.ndarray, params: dict) -> tuple[dict, float]:
    """Gradient of the mean cross-entropy. Max pooling sends it to the one position that won."""
    logits, (at, top, pooled, hidden) = forward(x, params | {"training": True})
    p = softmax(logits)
    loss = float(-np.log(p[np.arange(len(y)), y] + 1e-9).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    g = {"out": hidden.T @ p, "out_bias": p.sum(0)}
    back = (p @ params["out"].T) * (hidden > 0)
    g |= {"dense": pooled.T @ back, "dense_bias": back.sum(0)}
    back = (back @ params["dense"].T) * (top > 0)
    g["bias"] = back.sum(0)
    width, dims = params["width"], params["embed"].shape[1]
    seen = x[np.arange(len(x))[:, None, None], at[:, :, None] * params["stride"] + np.arange(width)]
    g["filters"] = np.einsum("bf,bfk->kf", back, params["embed"][seen].reshape(*at.shape, -1)) * params["mask"]
    to = (back[:, :, None] * params["filters"].T[None]).reshape(-1, dims)
    g["embed"] = np.stack([np.bincount(seen.ravel(), to[:, d], 256) for d in range(dims)], axis=1)
    return {k: v.astype(np.float32) for k, v in g.items()}, loss


def train(x: np.ndarray, y: np.ndarray, params: dict, steps: int, batch: int = 64, rate: float = 0.004, seed: int = 0) -> dict:
    """Adam over batches drawn evenly from the classes."""
    g = np.random.default_rng(seed)
    by = [np.flatnonzero(y == c) for c in range(params["out"].shape[1])]
    by = [c for c in by if len(c)]
    m, v = ({k: np.zeros_like(params[k]) for k in LEARNED} for _ in range(2))
    for t in range(1, steps + 1):
        pick = np.concatenate([g.choice(c, -(-batch // len(by))) for c in by])
        grad, _ = gradients(x[pick], y[pick], params)
        lr = np.float32(rate * min(1.0, 2 * (1 - (t - 1) / steps)))
        for k in LEARNED:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            params[k] = (params[k] - lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)
    return params


# ---------------------------------------------------------------- chunks of texts
def chunk_places(sizes: np.ndarray, chunk: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of chunks that cover every byte; an empty text has one empty chunk."""
    n = 1 + np.maximum(0, -(-(sizes - chunk) // hop))
    doc = np.repeat(np.arange(len(sizes)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * hop


def chunk_bytes(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, begin: np.ndarray, chunk: int) -> np.ndarray:
    """Rows of bytes, zero after the end of the text."""
    at = (off[doc] + begin)[:, None] + np.arange(chunk)
    inside = at < off[doc + 1][:, None]
    padded = buf if len(buf) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8)


def mean_logits(col, params: dict, chunk: int, hop: int, part: int = 64) -> np.ndarray:
    """Mean logits of each text's chunks. Nulls count as empty texts."""
    col = col.fill_null("") if col.null_count else col
    buf, off = text_buffers(col)
    doc, begin = chunk_places(np.diff(off), chunk, hop)
    total = np.zeros((len(off) - 1, params["out"].shape[1]))
    for a in range(0, len(doc), part):
        d = doc[a:a + part]
        np.add.at(total, d, forward(chunk_bytes(buf, off, d, begin[a:a + part], chunk), params)[0])
    return total / np.bincount(doc, minlength=len(off) - 1)[:, None]


def draw(rows: DataFrame, per_class: int, most: int = 50_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """About ``per_class`` rows (y, id, ...) of each class, drawn by a hash of the id, and the table (y, n, least) of all class counts and least hashes.

    About ``most`` rows are drawn at most: where there are too many classes, the rows per class are halved until they fit, down to one.
    The row of the least hash is always drawn, so every class keeps one. Only with more than ``most`` classes a seeded part of the classes is drawn. Classes of fewer rows are
    drawn whole; the shares of the others, at most ``most`` rows, are broadcast.
    """
    known = rows.where("y IS NOT NULL")
    mark = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    counts = stage(known.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min(mark).alias("least")), "classes")
    levels = [1.2 * per_class]
    while levels[-1] > 1:
        levels.append(max(1.0, levels[-1] / 2))
    classes, *sums = counts.agg(F.count(F.lit(1)), *[F.sum(F.least(F.col("n").cast("double"), F.lit(x))) for x in levels]).first()
    if not classes:
        return known.limit(0), counts
    per = next((x for x, s in zip(levels, sums) if s <= most), levels[-1])
    within = F.pmod(F.xxhash64("y", F.lit(seed)), F.lit(1_000_000)) < F.lit(1_000_000 * most // classes)
    share = F.greatest(F.floor(1_000_000 * (F.lit(per) / F.col("n"))), F.col("least") + 1)
    large = counts.where(F.col("n") > per).where(within).select(F.col("y").alias("large_y"), share.alias("share"))
    drawn = known.where(within).join(F.broadcast(large), F.col("y") == F.col("large_y"), "left")
    return drawn.where(mark < F.coalesce("share", F.lit(1_000_000))).select(*known.columns), counts


def learning_chunks(drawn: DataFrame, chunk: int, per_doc: int) -> tuple[np.ndarray, list]:
    """At most ``per_doc`` chunks, evenly placed, of each of a bounded sample of rows (y, id, text), and their classes."""
    drawn = drawn.where("text IS NOT NULL").select("y", "id", "text")

    def cut(batches):
        for b in batches:
            buf, off = text_buffers(b.column(2))
            size = np.diff(off)
            n = np.minimum(per_doc, 1 + np.maximum(0, size - chunk) // (chunk // 2))
            doc = np.repeat(np.arange(len(size)), n)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(0, size - chunk)[doc] * k // np.maximum(1, n - 1)[doc]
            x = chunk_bytes(buf, off, doc, begin, chunk)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["y", "id", "x"])
    kind = dict(drawn.dtypes)
    got = drawn.mapInArrow(cut, f"y {kind['y']}, id {kind['id']}, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    return np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(-1, chunk), got.column("y").to_pylist()
