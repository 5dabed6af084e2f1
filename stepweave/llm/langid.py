"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes, blanks included, in windows of ``SPAN`` bytes forwards and backwards and labels every
byte with a probability for each language. Windows overlap by ``EDGE`` bytes on either side, so that each byte's label
has seen what stands before and after it. A document's probabilities are the mean over the labels of its letters. The
network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import plain

#: Bytes of a window, of its overlap on either side, and of a window that is trained on.
SPAN, EDGE, TRAINED = 128, 8, 64
STRIDE = SPAN - 2 * EDGE
#: Windows that run together, and characters of the texts that are read at one time.
BATCH, BLOCK_CHARS = 2048, 200_000
UNKNOWN = "und"

#: Bytes that can be of a letter: a-z and all beyond ASCII.
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def _encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class ByteGRU:
    """Weights of both directions (input rows by byte, recurrent) and of the output layer.

    ``floor``: a document whose best probability is below it is of no language that the network knows.
    """

    languages: list[str]
    weights: dict[str, np.ndarray]
    floor: float = 0.0

    @staticmethod
    def fresh(languages: list[str], hidden: int, seed: int) -> ByteGRU:
        rng = np.random.default_rng(seed)
        weights = {}
        for d in "fb":
            weights[f"W{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            weights[f"U{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            weights[f"O{d}"] = rng.normal(0, 0.3, (hidden, len(languages))).astype(np.float32)
        weights["c"] = np.zeros(len(languages), np.float32)
        return ByteGRU(languages, weights)

    def _direction(self, d: str, codes: np.ndarray, keep: bool = False):
        """Hidden states (length, batch, hidden) of one direction; ``keep`` returns what training needs too."""
        W, U = self.weights[f"W{d}"], self.weights[f"U{d}"]
        length, batch = codes.shape
        H = U.shape[0]
        h = np.zeros((batch, H), W.dtype)
        states, tape = np.empty((length, batch, H), W.dtype), []
        with np.errstate(over="ignore"):
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                x, u = W[codes[t]], h @ U
                zr = x[:, : 2 * H] + u[:, : 2 * H]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
                if keep:
                    tape.append((t, h, zr, new, u[:, 2 * H :]))
                h = new + z * (h - new)
                states[t] = h
        return states, tape

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        scores = forward @ self.weights["Of"] + backward @ self.weights["Ob"] + self.weights["c"]
        top = scores[..., 0].copy()
        for k in range(1, scores.shape[-1]):
            np.maximum(top, scores[..., k], out=top)
        scores = np.exp(scores - top[..., None])
        return scores / (scores @ np.ones(scores.shape[-1], scores.dtype))[..., None]

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (length, batch, language) of every byte of sequences of one length."""
        return self._softmax(self._direction("f", codes)[0], self._direction("b", codes)[0])

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the letters of each text; zero for one without any."""
        blank = b" " * SPAN
        joined = np.frombuffer(blank + blank.join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = SPAN + np.cumsum(sizes + SPAN) - sizes - SPAN
        windows = -(-sizes // STRIDE)
        owner = np.repeat(np.arange(len(texts)), windows)
        start = begin[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
        end = (begin + sizes)[owner]
        total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at in range(0, len(owner), BATCH):
            own = slice(at, at + BATCH)
            place = start[own] + np.arange(-EDGE, SPAN - EDGE)[:, None]
            codes = joined[place]
            counted = _LETTER[codes] & (place < end[own])
            counted[:EDGE] = counted[SPAN - EDGE :] = False
            sums = np.einsum("tbk,tb->bk", self.positions(codes), counted.astype(np.float32))
            np.add.at(total, owner[own], sums)
            np.add.at(letters, owner[own], counted.sum(axis=0))
        return total / np.maximum(letters, 1)[:, None]

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all bytes of a batch of equal length."""
        length, batch = codes.shape
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        kept = {d: self._direction(d, codes, keep=True) for d in "fb"}
        error = self._softmax(kept["f"][0], kept["b"][0])
        error[:, np.arange(batch), target] -= 1
        error /= length * batch
        grads["c"] = error.sum(axis=(0, 1))
        for d in "fb":
            states, tape = kept[d]
            H = states.shape[2]
            U, O = self.weights[f"U{d}"], self.weights[f"O{d}"]  # noqa: E741
            grads[f"O{d}"] = states.reshape(-1, H).T @ error.reshape(length * batch, -1)
            back, inputs = np.zeros((batch, H), states.dtype), np.empty((length, batch, 3 * H), states.dtype)
            for t, h, zr, new, un in reversed(tape):
                z, r = zr[:, :H], zr[:, H:]
                dh = back + error[t] @ O.T
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                grads[f"U{d}"] += h.T @ du
                back = dh * z + du @ U.T
            np.add.at(grads[f"W{d}"], codes.ravel(), inputs.reshape(-1, 3 * H))
        return grads


def fit(examples: list[tuple[int, str, bytes]], hidden: int = 12, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 5) -> ByteGRU | None:
    """A network from ``(document, language, window)``, windows of ``TRAINED`` bytes; batches draw the languages evenly.

    A fifth of the documents is held out for ``floor``: a quarter of the way from chance to the probability that all but
    one in fifty of them have for their own language.
    """
    examples = sorted(x for x in examples if _LETTER[np.frombuffer(x[2], np.uint8)].any())
    languages = sorted({x[1] for x in examples})
    if not languages:
        return None
    model = ByteGRU.fresh(languages, hidden, seed)
    if len(languages) == 1:
        return model
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(x[1]) for x in examples])
    codes = np.frombuffer(b"".join(x[2] for x in examples), np.uint8).reshape(-1, TRAINED)
    documents = np.array([x[0] for x in examples])
    held = documents % 5 == 0
    taught = [own if len(own) else np.flatnonzero(label == k) for k in range(len(languages)) for own in [np.flatnonzero((label == k) & ~held)]]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        drawn = rng.integers(len(languages), size=batch)
        rows = np.array([taught[k][rng.integers(len(taught[k]))] for k in drawn])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in model.gradients(np.ascontiguousarray(codes[rows].T), label[rows]).items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.weights[k] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    if held.any():
        own, first = np.unique(documents[held], return_index=True)
        texts = [codes[documents == k].tobytes() for k in own]
        found = model.pooled(texts)[np.arange(len(own)), label[held][first]]
        chance = 1 / len(languages)
        model.floor = float(chance + max(np.quantile(found, 0.02) - chance, 0) / 4)
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = 400, sample_windows: int = 16, **options) -> ByteGRU | None:
    """A network learnt from labelled documents: about ``sample_docs`` of each language, chosen by a hash of the key.

    Each gives ``sample_windows`` windows of ``TRAINED`` bytes at most, spread evenly over the whole text. Rows with a
    null text or language are not used; rows that repeat a key and text are chosen together, and each is a document.
    """
    rows = plain(docs, text=text_col, lang=lang_col, key=key_col).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {lang: n for lang, n in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    keep = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(sample_docs / n)) for lang, n in counts.items()), F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64("key", "lang", F.length("text")), F.lit(1 << 24)) < keep * (1 << 24))
    chosen = chosen.select(F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("doc"), "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, langs, windows = [], [], []
            for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = _encoded(text)
                n = min(sample_windows, -(-len(raw) // TRAINED))
                for k in range(n):
                    at = (len(raw) - TRAINED) * k // max(n - 1, 1) if len(raw) > TRAINED else 0
                    docs.append(doc)
                    langs.append(lang)
                    windows.append(raw[at : at + TRAINED].ljust(TRAINED))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["doc", "lang", "window"])

    seen = chosen.mapInArrow(cut, "doc bigint, lang string, window binary")
    return fit([(doc, lang, bytes(window)) for doc, lang, window in seen.collect()], **options)  # sample_docs * sample_windows rows a language


def with_language(docs: DataFrame, model: ByteGRU | None, text_col: str = "text") -> DataFrame:
    """``(row, lang_pred, score)``, one row for each row of ``docs``; ``row`` is the input row as a struct.

    ``und`` and 0 for null texts, texts without a letter, and all texts if nothing could be learnt. ``score`` is the
    pooled probability of the language named. Only the text is read; whole texts are labelled, whatever their length.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.select("row", _predict(model)(F.col("row")[text_col]).alias("p")).select("row", "p.lang_pred", "p.score")


def _blocks(texts) -> Iterator[list[bytes]]:
    """Encoded texts of bounded size together; those without a letter are empty."""
    block, size = [], 0
    for text in texts:
        if size + len(text or "") > BLOCK_CHARS and block:
            yield block
            block, size = [], 0
        block.append(_encoded(text) if has_letter(text) else b"")
        size += len(text or "")
    if block:
        yield block


def _predict(model: ByteGRU | None) -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, scores = [], []
            for block in _blocks(texts):
                if model is None:
                    labels += [UNKNOWN] * len(block)
                    scores += [0.0] * len(block)
                    continue
                found = model.pooled(block)
                best = found.argmax(axis=1)
                labels += [model.languages[k] if raw else UNKNOWN for k, raw in zip(best, block, strict=True)]
                scores += [float(min(p[k], 1.0)) if raw else 0.0 for p, k, raw in zip(found, best, block, strict=True)]
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    return predict
