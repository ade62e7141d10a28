"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a whole text, across words, and labels every position; a
document's probabilities are the mean over its positions. Texts are read in windows that
overlap: a state is warmed up on the bytes beside a window before its positions count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import as_bytes, importable

#: Documents of a language and in all that training draws at most, spans that it draws of each, and characters of a span.
PER_LANGUAGE, DOCUMENTS, SPANS, SPAN = 400, 6000, 8, 48
#: Positions of a window that count, and bytes that are read before and after them; rows of windows that are read in step.
WINDOW, BESIDE, ROWS = 512, 16, 2048
#: Texts whose windows are read together, and their bytes if more than one.
LOT, LOT_BYTES = 1000, 4_000_000
#: How many times the share of an even guess the pooled probability must be for a language to be clear, and the most that is asked.
CLEAR, MOST = 1.6, 0.5
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Gru:
    """One direction of a light gated unit: update gate z, candidate m, both piecewise linear.

    States are columns. Bytes enter as columns of a table, which holds the biases too.
    """

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        h = self.hidden = hidden
        self.w = rng.normal(0, 0.3, (2 * h, 256)).astype(np.float32)
        self.w[:h] += 0.5
        self.u = (rng.normal(0, 0.7, (2 * h, h)) / np.sqrt(h)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u]

    def step(self, x: np.ndarray, state: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state, written over state; a and c are room to work in."""
        h = self.hidden
        np.take(self.w, x, axis=1, out=a, mode="clip")
        np.dot(self.u, state, out=c)
        a += c
        z, m = a[:h], a[h:]
        np.clip(z, 0, 1, out=z)
        np.clip(m, -1, 1, out=m)
        state -= m
        state *= z
        state += m
        return state

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: (steps, rows) bytes -> states (steps, hidden, rows), and what backward() needs."""
        h, (steps, n) = self.hidden, x.shape
        states, tape, state = np.empty((steps, h, n), np.float32), [], np.zeros((h, n), np.float32)
        for t in range(steps):
            a = self.w[:, x[t]] + self.u @ state
            z, m = np.clip(a[:h], 0, 1), np.clip(a[h:], -1, 1)
            tape.append((state, z, m))
            state = states[t] = m + z * (state - m)
        return states, tape

    def backward(self, x: np.ndarray, tape: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, through time; d_states: of the loss by each state."""
        du, outer = np.zeros_like(self.u), np.empty((len(x), 2 * self.hidden, x.shape[1]), np.float32)
        carry = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            state, z, m = tape[t]
            d = d_states[t] + carry
            dz = np.where((z > 0) & (z < 1), d * (state - m), 0)
            dm = np.where(np.abs(m) < 1, d * (1 - z), 0)
            outer[t] = g = np.concatenate([dz, dm])
            du += g @ state.T
            carry = d * z + self.u.T @ g
        dw = np.stack([np.bincount(x.ravel(), g.ravel(), 256) for g in outer.transpose(1, 0, 2)])
        return [dw.astype(np.float32), du]


def softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    logits -= logits.max(axis=axis, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=axis, keepdims=True)
    return logits


class Tagger:
    """Labels every byte of a text with a language, from both sides."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.v = (rng.normal(0, 1, (len(languages), 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.c = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.v, self.c]

    def step(self, x: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of spans (steps, rows), and its gradients."""
        n, h = x.shape[1], self.ahead.hidden
        a, tape_a = self.ahead.forward(x)
        b, tape_b = self.back.forward(x[::-1])
        both = np.concatenate([a, b[::-1]], axis=1)
        p = softmax(np.matmul(self.v, both) + self.c, 1)
        loss = -float(np.log(p[:, labels, np.arange(n)] + 1e-9).mean())
        p[:, labels, np.arange(n)] -= 1
        d = p / np.float32(x.size)
        d_both = np.matmul(self.v.T, d)
        grads = self.ahead.backward(x, tape_a, d_both[:, :h]) + self.back.backward(x[::-1], tape_b, d_both[::-1, h:])
        return loss, [*grads, np.matmul(d, both.transpose(0, 2, 1)).sum(axis=0), d.sum(axis=(0, 2))[:, None]]

    def fit(self, x: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over spans (spans, bytes), each language as often as the others. Gives the last loss."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by_label, loss = [np.flatnonzero(labels == k) for k in np.unique(labels)], 0.0
        for k in range(1, steps + 1):
            some = np.array([rng.choice(by_label[j]) for j in rng.integers(len(by_label), size=batch)])
            loss, grads = self.step(np.ascontiguousarray(x[some].T), labels[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 2.0 * (1 - k / (steps + 1)))
            for p, g, m, v in zip(params, grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                p -= now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.998**k)) + 1e-6)
        return loss

    def read(self, windows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Sums (windows, languages) of the probabilities at positions from first to before end of each window's bytes."""
        out = np.zeros((len(windows), len(self.languages)))
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i][0]))
        rows = max(64, min(ROWS, 2**24 // ((WINDOW + 2 * BESIDE) * len(self.languages))))
        for z in range(0, len(order), rows):
            some = order[z : z + rows]
            out[some] = self._read([windows[i] for i in some])
        return out

    def _read(self, windows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """The same for windows that fit in memory, longest first: shorter ones drop out of later steps."""
        n, sizes = len(windows), np.array([len(w) for w, _, _ in windows])
        steps, h = int(sizes[0]), self.ahead.hidden
        x = np.frombuffer(b"".join(w.ljust(steps, b" ") for w, _, _ in windows), np.uint8).reshape(n, steps).T
        x = np.ascontiguousarray(x)
        live = np.searchsorted(-sizes, -np.arange(steps), "left")  # rows of more than t bytes
        logits = np.zeros((steps, len(self.languages), n), np.float32)
        a, c = (np.empty((2 * h * n,), np.float32) for _ in range(2))
        room = lambda buffer, k: buffer[: 2 * h * k].reshape(2 * h, k)
        state = np.zeros((h, n), np.float32)
        v_ahead, v_back = np.ascontiguousarray(self.v[:, :h]), np.ascontiguousarray(self.v[:, h:])
        for t in range(steps):
            k = int(live[t])
            if k < state.shape[1]:
                state = np.ascontiguousarray(state[:, :k])
            self.ahead.step(x[t, :k], state, room(a, k), room(c, k))
            logits[t, :, :k] = v_ahead @ state
        state = np.zeros((h, 0), np.float32)
        for t in range(steps - 1, -1, -1):
            k = int(live[t])
            if k > state.shape[1]:
                state = np.concatenate([state, np.zeros((h, k - state.shape[1]), np.float32)], axis=1)
            self.back.step(x[t, :k], state, room(a, k), room(c, k))
            logits[t, :, :k] += v_back @ state
        total = np.zeros((len(self.languages), n))
        first, end = (np.array([w[i] for w in windows]) for i in (1, 2))
        for t in range(0, steps, 64):
            p = logits[t : t + 64]
            at = np.arange(t, t + len(p))[:, None]
            p += self.c
            np.clip(p, -40, 40, out=p)
            np.exp(p, out=p)
            p *= (((at >= first) & (at < end)) / p.sum(axis=1)).astype(np.float32)[:, None, :]
            total += p.sum(axis=0)
        return total.T


def windows_of(text: bytes) -> list[tuple[bytes, int, int]]:
    """The overlapping windows of a text, A-Z in lower case: (bytes, where positions begin to count, where they end)."""
    low, out = text.lower(), []
    for i in range(0, len(low), WINDOW):
        a, z = max(0, i - BESIDE), min(len(low), i + WINDOW + BESIDE)
        out.append((low[a:z], i - a, min(len(low), i + WINDOW) - a))
    return out


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def pooled(tagger: Tagger, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean probabilities over all positions of each text."""
    out = np.zeros((len(texts), len(tagger.languages)))
    lot, home, size = [], [], 0

    def flush() -> None:
        np.add.at(out, home, tagger.read(lot))
        lot.clear(), home.clear()

    for i, text in enumerate(texts):
        for z in range(0, len(text), LOT_BYTES):  # a very long text in parts, each with what stands beside it
            a = max(0, z - BESIDE)
            for w, first, end in windows_of(text[a : z + LOT_BYTES + BESIDE]):
                lot.append((w, first, end)), home.append(i)
            size += min(LOT_BYTES, len(text) - z)
            if size >= LOT_BYTES:
                flush()
                size = 0
    if lot:
        flush()
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", seed: int = 11) -> Tagger | None:
    """A tagger from a bounded, even sample of labelled documents; None if none is labelled.

    Draws about PER_LANGUAGE documents of each label (fewer if there are many labels) by a hash
    of the id, and SPANS spans of SPAN characters from anywhere in the whole text of each.
    """
    usable = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, DOCUMENTS // len(counts)))
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max(1.3 * each, each + 40.0) / n))])
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    place = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.greatest(F.length("text") - SPAN + 1, F.lit(1))).cast("int")
    spans = F.transform(F.sequence(F.lit(1), F.lit(SPANS)), lambda i: F.substring(F.col("text"), place(i) + 1, F.lit(SPAN)))
    rows = usable.filter(draw < F.element_at(shares, F.col("label"))).select("label", draw.alias("draw"), "id", spans.alias("spans")).collect()
    languages, x, labels = sorted(counts), [], []
    for i, name in enumerate(languages):
        mine = sorted((r for r in rows if r["label"] == name), key=lambda r: (r["draw"], str(r["id"])))[:each]
        for s in dict.fromkeys(s for r in mine for s in r["spans"]):
            raw = s.encode().lower()[:SPAN]
            if has_letter(raw):
                x.append((raw + b" " + raw * (SPAN // len(raw)))[:SPAN])  # short texts over and over
                labels.append(i)
    tagger = Tagger(languages)
    if x:
        tagger.fit(np.frombuffer(b"".join(x), np.uint8).reshape(-1, SPAN), np.array(labels))
    return tagger


def predictor(tagger: Tagger | None):
    """A column function: text -> struct of lang_pred and score."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            names, scores = [], []
            for i in range(0, len(column), LOT):
                some = as_bytes(column[i : i + LOT])
                told = [k for k, x in enumerate(some) if tagger is not None and has_letter(x)]
                p = pooled(tagger, [some[k] for k in told]) if told else np.empty((0, 1))
                name, score = [UNKNOWN] * len(some), [0.0] * len(some)
                for k, best, high in zip(told, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    name[k], score[k] = tagger.languages[best], min(1.0, high)
                names += name
                scores += score
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()  # so that it runs once a row, wherever it is used


def identify(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from whole texts.

    Null texts and texts without a letter are ``und`` with score 0, as all are without a tagger.
    Rows stay as many as they are, whatever their id; equal texts are labelled alike, and equal
    probabilities go to the first language in order. Other columns are not looked at.
    """
    importable(docs.sparkSession)
    told = docs.select(F.col(id_col).alias("doc_id"), predictor(tagger)(F.col(text_col)).alias("p"))
    return told.select("doc_id", "p.lang_pred", "p.score")


def least_score(tagger: Tagger | None) -> float:
    """The pooled probability from which a language is clear: CLEAR times that of an even guess."""
    return min(MOST, CLEAR / len(tagger.languages)) if tagger and len(tagger.languages) > 1 else 0.0


def clear(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The rows, all columns as they are, whose language is told with a score of at least least (least_score() if None)."""
    importable(docs.sparkSession)
    name = "_told"
    while name in docs.columns:
        name += "_"
    told = docs.withColumn(name, predictor(tagger)(F.col(text_col)))
    return told.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= (least_score(tagger) if least is None else least))).drop(name)
