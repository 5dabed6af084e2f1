"""Toxicity of texts written to hide it: a noisy channel undone by Viterbi decoding, then a word model.

A token that may be disguised (figures and signs for letters, letters set apart, letters repeated, masked letters) is a
lattice of characters. The path with the best sum of channel costs and character trigram log probabilities is the
restored token. Between letters set apart the lattice has two arcs for a separator: it goes, or a word ends. The trigram
counts come from every text of the corpus. Restored texts are scored by a noisy-or model over their words, fitted on
labelled texts and calibrated on those that it was not fitted on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import durable, plain

#: Character classes of the language model: 0 stands between words, a-z, U+00DF to U+00FF, and one class for the rest.
CLASSES = 61

#: What a sign can stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
MASKS = "*#"
SEPARATORS = "._-~'’"
#: Costs of the channel, in nats; SPLIT: a word ends at a separator of one character, WIDE at one of several.
SUBSTITUTE, DROP, MASK, FEWER, SPLIT, WIDE = 0.7, 1.5, 2.5, 0.7, 6.5, 1.5

_SIGNS = re.escape("".join(LEET) + MASKS + SEPARATORS)
_EDGES = "%&\"“”«»,;:?)]}[{<>=/\\^`"
_LETTER = r"[^\W\d_]"
_SPACED = re.compile(rf"(?<![^\s])(?:{_LETTER}|[{re.escape(''.join(LEET))}])(?:[ \t._*~-]{{1,2}}(?:{_LETTER}|[{re.escape(''.join(LEET))}])){{2,}}(?![^\s.,;:!?])")
_RUN = re.compile(r"(.)\1*", re.S)
_APART = re.compile(r"(?P<apart>[ \t._*~-]+)|(.)\2*", re.S)
_WORDS = re.compile(rf"{_LETTER}+")
_REPEATS = re.compile(rf"({_LETTER})\1\1|({_LETTER})\2.*({_LETTER})\3")
_DISGUISED = re.compile(rf"(?={_LETTER}*.*{_LETTER})(?:.*[{_SIGNS}].*)", re.S)


def _class(c: str) -> int:
    k = ord(c)
    return k - 96 if 97 <= k <= 122 else k - 0xDF + 27 if 0xDF <= k <= 0xFF and k != 0xF7 else 60 if c.isalpha() else 0


_TABLE = np.array([_class(chr(k)) for k in range(0x250)], np.int32)


def trigrams(texts: list) -> np.ndarray:
    """Counts of class trigrams over whole texts; anything between words is one mark."""
    total = np.zeros(CLASSES**3, np.int64)
    for text in texts:
        codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        ids = np.where(codes < 0x250, _TABLE[np.minimum(codes, 0x24F)], 60)
        ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]
        ids = np.concatenate([[0], ids])
        total += np.bincount((ids[:-2] * CLASSES + ids[1:-1]) * CLASSES + ids[2:], minlength=CLASSES**3) if len(ids) > 2 else 0
    return total


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [c, b, a] of class a after c and b, from the trigrams of all texts (61 cubed sums in Spark)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                joined = "\n".join(t or "" for t in texts[at : at + 64])
                total += trigrams([joined])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["code", "n"])

    n3 = np.zeros(CLASSES**3)
    for code, n in plain(docs, text=text_col).mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n")).collect():
        n3[code] = n
    n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    p2 = (n2 + 4 * p1[None, :]) / (n2.sum(axis=1, keepdims=True) + 4)
    p3 = (n3 + 4 * p2[None, :, :]) / (n3.sum(axis=2, keepdims=True) + 4)
    return np.log(p3).astype(np.float32)


class Decoder:
    """Restores tokens; what it found for a token is kept for the next time it comes."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp.tolist()
        self.known: dict[str, str] = {}

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character the strings it may stand for, with their costs.

        Where the token has blanks its letters are set apart: each run of separators is dropped or ends a word.
        """
        out = []
        for match in (_APART if " " in token or "\t" in token else _RUN).finditer(token):
            c, k = match[0][0], len(match[0])
            if match.lastgroup == "apart":
                options = [("", 0.1), (" ", SPLIT if k == 1 else WIDE)]
            elif c in LEET:
                options = [(x * n, SUBSTITUTE + (FEWER if n != k else 0)) for x in LEET[c] for n in {1, min(k, 2)}] + [("", DROP)]
            elif c in MASKS:
                options = [(chr(97 + i), MASK) for i in range(26)] + [("", DROP)]
            elif not c.isalpha():
                options = [("", 0.1)]
            else:
                options = [(c * min(k, 2), 3 * FEWER if k > 2 else 0.0)] + ([(c, FEWER if k > 2 else 2 * FEWER)] if k > 1 else [])
            out.append(options)
        return out

    def restore(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[token] = self._viterbi(token)
        return found

    def _viterbi(self, token: str) -> str:
        logp = self.logp
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(token):
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for emitted, cost in options:
                    x, y, total = a, b, score - cost
                    for c in emitted:
                        k = _class(c)
                        total += logp[x][y][k]
                        x, y = y, k
                    # Longer readings pay for their letters: the mean letter's log probability is given back.
                    total += 2.2 * len(emitted)
                    if (x, y) not in nxt or total > nxt[x, y][0]:
                        nxt[x, y] = (total, text + emitted)
            best = nxt
        return max(((s + logp[a][b][0], t) for (a, b), (s, t) in best.items()))[1]

    def words(self, token: str) -> tuple[str, ...]:
        """The words of one blank-free token, as written and restored."""
        plain_words = _WORDS.findall(token)
        core = token.strip(_EDGES + ".!*#$|+~'-_(")if token[-1:] in "!.*#$|+~'-_(" + _EDGES or token[:1] in _EDGES else token
        forms = {core, token.strip(_EDGES + ".!"), token.strip(_EDGES + ".!*#|+~'-_(")} - {""}
        found = list(plain_words)
        for form in forms:
            if _DISGUISED.match(form) or _REPEATS.search(form):
                found.append(self.restore(form))
        return tuple(dict.fromkeys(found))

    def spaced(self, text: str) -> list[str]:
        """Words of the readings of all runs of letters set apart."""
        return [w for m in _SPACED.finditer(text) for w in self.apart(m[0]).split()]

    def apart(self, run: str) -> str:
        """The reading of a run of letters set apart; marks alone (``a.b.c``) are read like blanks."""
        return self.restore(run if " " in run or "\t" in run else re.sub(r"[._*~-]+", " ", run))

    def restored_text(self, text: str) -> str:
        """The whole text with every disguised token restored."""
        joined = _SPACED.sub(lambda m: self.apart(m[0]), text.lower())
        return " ".join(" ".join(self.words(t)[-1:]) or t for t in joined.split())


#: A feature is a candidate in so many toxic documents at least, and so many times as frequent there as in clean ones.
LEAST_DOCS, FAVOUR = 3, 16.0
#: Clean documents without a word that each feature is held to be in besides, rounds of the fit, and parts of the cross-fitting.
DOUBT, ROUNDS, FOLDS = 0.5, 300, 5
#: Lengths of the word beginnings that are features beside whole words (inflected and compound words share them).
PREFIXES = (4, 5, 6, 7)


def _features(words) -> tuple[str, ...]:
    """Words of three letters or more, and the beginnings of longer ones, marked by a star."""
    return tuple(dict.fromkeys(f for w in words if len(w) > 2 for f in (w, *(w[:n] + "*" for n in PREFIXES if n < len(w)))))


class _Seen(dict):
    """Features of tokens, refilled when it gets large; ``keep`` narrows them to a vocabulary."""

    def __init__(self, decoder: Decoder, keep=None):
        super().__init__()
        self.decoder, self.keep = decoder, keep

    def __missing__(self, token: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        found = _features(self.decoder.words(token))
        self[token] = found = found if self.keep is None else tuple(w for w in found if w in self.keep)
        return found


def document_words(text: str, seen: _Seen) -> set[str]:
    """Distinct features of a whole text, those of restored words included (within the vocabulary of ``seen``, if any)."""
    low = text.lower()
    out = {w for found in map(seen.__getitem__, set(low.split())) if found for w in found}
    extra = _features(seen.decoder.spaced(low))
    return out | {w for w in extra if seen.keep is None or w in seen.keep}


def _candidates(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` features speak for toxic, by the documents ``y`` that have them."""
    toxic, n_toxic = np.bincount(cols, weights=y[rows], minlength=size), y.sum()
    clean, n_clean = np.bincount(cols, minlength=size) - toxic, len(y) - n_toxic
    return (toxic >= LEAST_DOCS) & (toxic * n_clean >= FAVOUR * (clean + 0.5) * n_toxic)


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Strengths of the features and of no feature in a noisy-or model, by expectation and maximisation.

    Document ``rows[i]`` has feature ``cols[i]``; it is toxic with probability ``1 - exp(-sum of strengths)``: each feature
    can make it so alone, none excuses another. The posterior mode is found under an exponential prior (``DOUBT``).
    """
    held = np.bincount(cols, minlength=size) + DOUBT
    strength, base = np.full(size, 0.3), 0.05
    for _ in range(ROUNDS):
        # How often each cause is expected to have struck in the documents that are toxic.
        share = y / -np.expm1(-(np.bincount(rows, weights=strength[cols], minlength=len(y)) + base))
        strength = strength * np.bincount(cols, weights=share[rows], minlength=size) / held
        base = (base * share.sum() + 0.5) / (len(y) + 1)
    return strength, base


def _odds(strength):
    """Log odds of toxic at a sum of strengths."""
    return np.log(np.expm1(np.clip(strength, 1e-9, 30)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cross_fitted(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, fold: np.ndarray, size: int) -> np.ndarray:
    """Log odds of each document by a model, candidates included, of the other folds."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold != k
        place = np.cumsum(own) - 1
        use = own[rows]
        chosen = _candidates(place[rows[use]], cols[use], y[own], size)
        use &= chosen[cols]
        w, b = _fit(place[rows[use]], cols[use], y[own], size)
        out[~own] = _odds(np.bincount(rows, weights=np.where(chosen, w, 0)[cols], minlength=len(y))[~own] + b)
    return out


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``(slope, shift)`` that make log odds probabilities, by Newton's method on smoothed labels."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    at, x = np.array([1.0, 0.0]), np.column_stack([odds, np.ones(len(odds))])
    for _ in range(30):
        p = _sigmoid(x @ at)
        gradient = x.T @ (p - goal) + np.array([at[0] - 1, 0])
        at = at - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1e-6]), gradient)
    return max(float(at[0]), 0.0), float(at[1])


def learn(docs: DataFrame, labels: DataFrame, logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 8000) -> dict:
    """``{"base": b, "weights": {feature: w}, "slope": s, "shift": t}``: a calibrated noisy-or model over the features of restored texts.

    It is fitted on labelled documents, ``sample_rows`` of each class at most (by hash). ``labels`` with null ids or labels are
    not used; of several labels of one id the greatest counts, and documents that repeat a text and its label count once.
    Slope and shift are fitted on what models of the other folds say of each document; then the classes' true shares
    are put in. Of one class alone, or none, only that class is learnt.
    """
    spark = docs.sparkSession
    marked = plain(labels, id=id_col, toxic=label_col).where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("id")
    totals = {toxic: n for toxic, n in marked.groupBy("toxic").count().collect()}
    sample = marked.where("toxic = 1").orderBy(order, "id").limit(sample_rows).unionByName(marked.where("toxic = 0").orderBy(order, "id").limit(sample_rows))
    chosen = plain(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id")  # 2 * sample_rows rows at most
    chosen = chosen.withColumn("th", F.xxhash64("text")).dropDuplicates(["th", "toxic"])
    shared = spark.sparkContext.broadcast(logp)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(Decoder(shared.value))
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = [["", *sorted(document_words(t or "", seen))] for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["th", "toxic", "words"])

    # Every document has the feature '', which stands for the document itself.
    rows = durable(chosen.select("th", "toxic", "text").mapInArrow(split, "th bigint, toxic int, words array<string>"))
    rows = rows.select("th", "toxic", F.explode("words").alias("word"))
    counts = rows.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    size = counts.where("word = ''").first()
    if size is None or not size["t"] or not size["c"]:
        return {"base": 1.0, "weights": {}, "slope": 0.0, "shift": 30.0 if size is not None and size["t"] else -30.0}
    n_toxic, n_clean = size["t"], size["c"]
    favoured = (F.col("t") >= LEAST_DOCS) & (F.col("t") * n_clean >= FAVOUR * 0.5 * (F.col("c") + 0.5) * n_toxic)  # half as much: folds differ
    vocabulary = counts.where((F.col("word") == "") | favoured).select("word")  # of 2 * sample_rows documents at most
    found = rows.join(F.broadcast(vocabulary), "word").groupBy("th", "toxic").agg(F.collect_list("word").alias("words")).collect()
    found = sorted(found, key=lambda r: (r.th is None, r.th, r.toxic))
    names = sorted({w for r in found for w in r.words} - {""})
    index = {w: k for k, w in enumerate(names)}
    y = np.array([r.toxic for r in found], float)
    pairs = np.array([(k, index[w]) for k, r in enumerate(found) for w in r.words if w], int).reshape(-1, 2)
    rows_, cols = pairs[:, 0], pairs[:, 1]
    rank = np.where(y > 0, np.cumsum(y), np.cumsum(1 - y)).astype(int)  # both classes in every fold
    slope, shift = _calibrate(_cross_fitted(rows_, cols, y, rank % FOLDS, len(names)), y)
    use = _candidates(rows_, cols, y, len(names))[cols]
    w, b = _fit(rows_[use], cols[use], y, len(names))
    # The sample's share of toxic documents becomes that of all labelled rows.
    prior = math.log(totals[1] / totals[0] * min(totals[0], sample_rows) / min(totals[1], sample_rows))
    kept = set(cols[use].tolist())
    return {"base": b, "weights": {name: x for k, (name, x) in enumerate(zip(names, w.tolist(), strict=True)) if k in kept and x > 1e-6}, "slope": slope, "shift": shift + prior}


def with_toxicity(docs: DataFrame, logp: np.ndarray, model: dict, text_col: str = "text") -> DataFrame:
    """``(row, score, predicted)``, one row for each row of ``docs``; ``row`` is the input row as a struct.

    ``score`` is the probability that a text is toxic; null and empty texts get that of a text without telling features.
    Whole texts are read, whatever their length; copies get equal scores.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast((logp, model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logp, model = shared.value
        weights = model["weights"]
        seen = _Seen(Decoder(logp), weights)
        for texts in batches:
            strength = [model["base"] + sum(weights[w] for w in sorted(document_words(t or "", seen))) for t in texts]
            yield pd.Series(_sigmoid(model["slope"] * _odds(np.array(strength, float)) + model["shift"]), dtype="float64")

    return rows.select("row", score(F.col("row")[text_col]).alias("score")).select("row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
