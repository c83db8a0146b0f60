"""Quality classifier (operator 8): a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import remainder, rows_of, slices, tidy

#: Bytes of a stride; a filter sees two of them, a half chunk has HALF of them, and chunks overlap by a half.
STRIDE, HALF = 4, 64
EMBEDDING, FILTERS = 8, 24
#: Half chunks of a long text that are scored at once.
BLOCK = 4096
#: Labelled rows, about, that the network is fitted on.
SAMPLE = 3000
TEXT_BYTES = 2 << 20
CUT = 0.3


class Network:
    """Embedded bytes, FILTERS filters over 8 bytes every 4, the maximum of each in chunks of 512 bytes that overlap by half, a score for each chunk, and the logistic of the mean score: one probability for a whole text."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = STRIDE * EMBEDDING
        self.weights = {
            "bytes": r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": r.normal(0, 1 / np.sqrt(2 * wide), (2, wide, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.3, FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes one after another, each filled up with zeros (one at least, an empty text too) to whole half chunks; where each begins, in half chunks."""
        sizes = np.array([len(t) // (STRIDE * HALF) + 1 for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        data = np.zeros(begins[-1] * STRIDE * HALF, np.uint8)
        for t, b in zip(texts, begins, strict=False):
            data[b * STRIDE * HALF :][: len(t)] = np.frombuffer(t, np.uint8)
        return data, begins

    def maxima(self, data: np.ndarray, begins: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each chunk, and where it is. A text of one half chunk is one chunk."""
        w = self.weights
        x = w["bytes"][data].reshape(-1, STRIDE * EMBEDDING)
        z = x @ w["filters"][0]
        second = x @ w["filters"][1]
        second[begins[:-1] * HALF] = 0  # a text's last window sees nothing of the next text
        z[:-1] += second[1:]
        z = z.reshape(-1, HALF, FILTERS)
        first, after = self.halves(begins)
        if not places:
            m = z.max(axis=1)
            return np.maximum(m[first], m[after]), None
        at = z.argmax(axis=1)
        m = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
        at = at + np.arange(len(z))[:, None] * HALF
        return np.maximum(m[first], m[after]), np.where(m[first] >= m[after], at[first], at[after])

    @staticmethod
    def halves(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk, its two half chunks."""
        n = np.diff(begins)
        chunks = np.maximum(n - 1, 1)
        first = np.repeat(begins[:-1], chunks) + np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        return first, np.minimum(first + 1, np.repeat(begins[1:] - 1, chunks))

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each chunk of each text, one text after another, and how many each has."""
        data, begins = self.layout(texts)
        m, _ = self.maxima(data, begins)
        return np.maximum(m + self.weights["bias"], 0) @ self.weights["out"] + self.weights["shift"], np.maximum(np.diff(begins) - 1, 1)

    def mean_of(self, text: bytes) -> float:
        """The mean score of the chunks of a long text, which is taken in overlapping blocks of BLOCK half chunks."""
        half, total, n, at = STRIDE * HALF, 0.0, 0, 0
        while True:
            last = (at + BLOCK + 2) * half >= len(text)
            # of a block that is not the last one, the chunks at its end do not see what follows
            own = self.logits([text[at * half : (at + BLOCK + 2) * half]])[0][: None if last else BLOCK]
            total, n, at = total + float(own.sum(dtype=np.float64)), n + len(own), at + BLOCK
            if last:
                return total / n

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text."""
        mean = np.zeros(len(texts))
        long = np.array([len(t) > BLOCK * STRIDE * HALF for t in texts], bool)
        mean[long] = [self.mean_of(t) for t, is_long in zip(texts, long, strict=True) if is_long]
        if not long.all():
            logits, chunks = self.logits([t for t, is_long in zip(texts, long, strict=True) if not is_long])
            mean[~long] = np.add.reduceat(logits, np.cumsum(chunks) - chunks) / chunks
        # a matrix product rounds by the other rows of its slice; the result must not depend on them
        return np.round(1 / (1 + np.exp(-np.clip(mean.astype(float), -30, 30))), 6)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        data, begins = self.layout(texts)
        m, at = self.maxima(data, begins, places=True)
        h = np.maximum(m + w["bias"], 0)
        chunks = np.maximum(np.diff(begins) - 1, 1)
        logits = h @ w["out"] + w["shift"]
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(logits, np.cumsum(chunks) - chunks) / chunks, -30, 30)))
        d = np.repeat((p - labels) / len(texts) / chunks, chunks).astype(np.float32)
        dh = d[:, None] * w["out"] * (h > 0)
        blocks = data.reshape(-1, STRIDE)
        starts = set(begins[:-1] * HALF)
        follows = np.array([(i + 1) not in starts and i + 1 < len(blocks) for i in range(len(blocks))], bool)
        g = {"out": h.T @ d, "shift": d.sum(keepdims=True), "bias": dh.sum(axis=0), "filters": np.zeros_like(w["filters"]), "bytes": np.zeros_like(w["bytes"])}
        for f in range(FILTERS):
            hot = np.flatnonzero(dh[:, f])
            for side in (0, 1):
                rows = at[hot, f] + side
                use = hot if side == 0 else hot[follows[at[hot, f]]]
                rows = rows if side == 0 else rows[follows[at[hot, f]]]
                own = blocks[rows]
                g["filters"][side, :, f] += dh[use, f] @ w["bytes"][own].reshape(len(rows), STRIDE * EMBEDDING)
                spread = dh[use, f][:, None, None] * w["filters"][side, :, f].reshape(1, STRIDE, EMBEDDING)
                np.add.at(g["bytes"], own, spread)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam on the log loss."""
        r, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                step += 1
                for k, g in self.gradients([texts[j] for j in pick], labels[pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """Learn from about ``sample`` labelled documents, drawn by the hash of the id: a bounded sample, fitted in one task.

    An id labelled several times has its mean label, 1 from a half on; an id met in several rows teaches with each.
    Null ids, labels and texts teach nothing; without any row, every text scores the same.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    rows = rows_of(docs, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")  # about ``sample`` ids

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        got = sorted((r["doc_id"], r["text"], r["y"]) for b in batches for r in b.to_pylist())
        network = Network()
        if got:
            network.fit([t for _, t, _ in got], np.array([y for *_, y in got], np.float32))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(network.weights)], pa.binary())})

    import pickle

    out = Network()
    for r in rows.repartition(1).mapInArrow(tidy(train), "model binary").collect():
        out.weights = pickle.loads(bytes(r.model))
    return out


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score([t or b"" for t in part.column("text").to_pylist()]), pa.float64())], ["doc_id", "score"])

    return rows_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, score double")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; ids whose crc32 mod 5 is 0 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = score(docs, fit(docs, labels.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
