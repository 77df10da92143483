"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of ``SPAN``; in each window one gated recurrent network runs forward and one
backward, and from both states every byte gets a probability for each language. A document's probabilities are the mean
over all its bytes. The network is trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled rows: at most about ``sample_docs`` documents a language, chosen by a hash of their ids, ``sample_windows``
windows from each, at places chosen by hash. Languages are those that the sampled labels hold; nothing but the text is
read when predicting.

Defined cases: a text that is null or has no letter is ``und`` with score 0; empty tables give no rows; without a
labelled row every text is ``und``; texts are read whole; repeated rows each have their row. A null id is held out.
Extra columns are not read by ``identify`` and are kept by ``accept``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 48
PAD = 256
#: Windows run through the network together.
BATCH = 1024


@dataclass
class Network:
    """Two gated recurrent networks (axis 0: forward, backward) and one output layer.

    table: (2, 257, 3h), what each byte adds to update gate, reset gate and candidate; hidden: (2, h, 3h);
    out: (2h, languages); bias: (languages,).
    """

    languages: list[str]
    table: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    #: The trigrams of the training windows, and the share of a text's trigrams that the sample is too small to have met.
    known: np.ndarray | None = None
    unmet: float = 1.0

    @property
    def size(self) -> int:
        return self.hidden.shape[1]

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(2, span, n, h): the states at each position of (n, span) windows, both in text order."""
        n, span, h = len(windows), windows.shape[1], self.size
        both = np.stack((windows.T, windows.T[::-1])).astype(np.intp)  # (2, span, n)
        state = np.zeros((2, n, h), self.hidden.dtype)
        out = np.empty((2, span, n, h), self.hidden.dtype)
        added = np.empty((2, n, 3 * h), self.hidden.dtype)
        for t in range(span):
            for i in (0, 1):
                np.take(self.table[i], both[i, t], axis=0, out=added[i], mode="clip")
            inner = state @ self.hidden
            gates = _bend(added[..., : 2 * h] + inner[..., : 2 * h])
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :h], gates[..., h:]
            new = r * inner[..., 2 * h :]
            new += added[..., 2 * h :]
            _bend(new)
            if keep is not None:
                keep.append((state, inner[..., 2 * h :].copy(), z, r, new))
            state = state - new
            state *= z
            state += new
            out[0, t] = state[0]
            out[1, span - 1 - t] = state[1]
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """(span, n, languages): probabilities at each position."""
        h = self.size
        logits = states[0] @ self.out[:h] + states[1] @ self.out[h:] + self.bias
        np.exp(logits, out=logits)  # states lie within 1, so logits within the size of the weights
        logits /= logits @ np.ones((logits.shape[-1], 1), logits.dtype)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probabilities over all bytes of each text; zeros for empty texts."""
        total = np.zeros((len(texts), len(self.languages)))
        size = np.array([len(t) for t in texts])
        need = -(-size // SPAN)
        for group in _groups(need):
            codes = np.full(need[group].sum() * SPAN, PAD, np.int16)
            owner = np.repeat(group, need[group])
            at = 0
            for i in group:
                codes[at : at + size[i]] = np.frombuffer(texts[i], np.uint8)
                at += need[i] * SPAN
            windows = codes.reshape(-1, SPAN)
            for k in range(0, len(windows), BATCH):
                part = windows[k : k + BATCH]
                p = self.positions(self.states(part))
                if (part[:, -1] == PAD).any():
                    p *= (part.T != PAD)[..., None]
                np.add.at(total, owner[k : k + BATCH], p.sum(axis=0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def _bend(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: bounded like tanh at a fifth of its cost; gates are half of it plus a half."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``_bend`` where it gives y."""
    return (1 - np.abs(y)) ** 2


def _groups(need: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in runs of about BATCH windows; a longer text is a run of its own."""
    run, held = [], 0
    for i, n in enumerate(need.tolist()):
        if n and held + n > BATCH and run:
            yield np.array(run)
            run, held = [], 0
        if n:
            run.append(i)
            held += n
    if run:
        yield np.array(run)


def start(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(languages, draw(2, 257, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32))


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
    h, (n, span) = net.size, windows.shape
    keep: list = []
    states = net.states(windows, keep)
    p = net.positions(states)
    real = (windows.T != PAD)[..., None]
    count = max(1, int(real.sum()))
    loss = -float((np.log(np.maximum(p[:, np.arange(n), labels], 1e-12)) * real[..., 0]).sum()) / count
    delta = p
    delta[:, np.arange(n), labels] -= 1
    delta *= real / np.float32(count)
    flat = delta.reshape(span * n, -1)
    d_out = np.concatenate([states[i].reshape(span * n, h).T @ flat for i in (0, 1)])
    d_bias = flat.sum(axis=0)
    d_states = np.stack([delta @ net.out[:h].T, (delta @ net.out[h:].T)[::-1]])  # in each network's own order
    both = np.stack((windows.T, windows.T[::-1]))
    d_table, d_hidden = np.zeros_like(net.table), np.zeros_like(net.hidden)
    back = np.zeros((2, n, h), np.float32)
    for t in range(span - 1, -1, -1):
        before, inner, z, r, new = keep[t]
        back = back + d_states[:, t]
        d_new = back * (1 - z) * _slope(new)
        d_z = back * (before - new) * _slope(2 * z - 1) / 2
        d_r = d_new * inner * _slope(2 * r - 1) / 2
        added = np.concatenate((d_z, d_r, d_new), axis=-1)
        inward = np.concatenate((d_z, d_r, d_new * r), axis=-1)
        for i in (0, 1):
            np.add.at(d_table[i], both[i, t], added[i])
        d_hidden += before.transpose(0, 2, 1) @ inward
        back = back * z + inward @ net.hidden.transpose(0, 2, 1)
    return loss, [d_table, d_hidden, d_out, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = 10, steps: int = 500, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on batches that hold each language equally often."""
    net, rng = start(languages, hidden, seed), np.random.default_rng(seed)
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    weights = [net.table, net.hidden, net.out, net.bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, -(-batch // len(of))) for x in of])
        _, grads = gradients(net, windows[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 1.5 - 1.5 * step / steps)
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_windows: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages. Only so many windows as the parameters allow come to the driver."""
    usable = docs.where(~_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in counts)
    # By a hash of its id a document is taken with the chance that gives sample_docs of its language.
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, sample_docs / r["n"]))).otherwise(share)
    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(17)), 11) / F.lit(float(1 << 53))
    chosen = usable.where(chance < share).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, langs = [], []
            for key, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                last = max(0, len(raw) - SPAN)
                for k in range(min(sample_windows, 1 + last // SPAN)):
                    at = zlib.crc32(f"{key}/{k}".encode()) % (last + 1)
                    out.append(raw[at : at + SPAN])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["window", "lang"])

    got = chosen.mapInArrow(windows, "window binary, lang string").orderBy("lang", "window").toArrow()
    raw = [w for w in got.column("window").to_pylist()]
    codes = np.full((len(raw), SPAN), PAD, np.int16)
    for i, w in enumerate(raw):
        codes[i, : len(w)] = np.frombuffer(w, np.uint8)
    place = {x: i for i, x in enumerate(languages)}
    labels = np.array([place[x] for x in got.column("lang").to_pylist()], int)
    seen = sorted(set(labels.tolist()))
    return codes, np.searchsorted(seen, labels), [languages[i] for i in seen]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 500, sample_windows: int = 8, **options) -> Network | None:
    windows, labels, languages = sample(docs, id_col, text_col, lang_col, sample_docs, sample_windows)
    if not len(windows):
        return None
    net = train(windows, labels, languages, **options)
    net.known, net.unmet = met(windows, labels)
    return net


#: Bytes as trigrams see them: A-Z lowered, what is no letter in ASCII a blank; the last is PAD's.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower()] + [32], np.int32)
BLOCK = 1 << 20
#: How far the bound of ``familiar`` widens: by FEW / sqrt(distinct trigrams).
FEW = 1.0


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Codes of three neighbours along the last axis, those with two blanks or more left out."""
    a = FOLD[codes]
    x, y, z = a[..., :-2], a[..., 1:-1], a[..., 2:]
    return ((x << 16) | (y << 8) | z)[(x == 32).astype(np.int8) + (y == 32) + (z == 32) < 2]


def met(windows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The sample's trigrams, and by Good and Turing the share of unmet ones in the language where it is greatest."""
    unmet = 0.0
    for k in np.unique(labels):
        counts = np.unique(trigrams(windows[labels == k]), return_counts=True)[1]
        unmet = max(unmet, float((counts == 1).sum() / max(1, counts.sum())))
    return np.unique(trigrams(windows)), unmet


def familiar(text_col: str, net: Network, least_met: float) -> Column:
    """Whether a text is made of what the languages' samples hold; always true for one without trigrams.

    Of its trigrams the share ``least_met`` of those that the sample leads one to expect must be met. The bound follows
    the sample (what it can't have met is not asked for) and widens for texts with few distinct trigrams; it does not depend on how many languages there are.
    """
    known, least = net.known, least_met * (1 - net.unmet)

    @F.arrow_udf("boolean")
    def each(texts: pa.Array) -> pa.Array:
        table = np.zeros(1 << 24, bool)
        table[known] = True
        out = []
        for text in texts.cast(pa.binary()).to_pylist():
            raw = np.frombuffer(text or b"", np.uint8)
            hit = size = 0
            distinct = np.empty(0, np.int32)
            for at in range(0, max(0, len(raw) - 2), BLOCK):
                found = trigrams(raw[at : at + BLOCK + 2])
                hit, size, distinct = hit + int(table[found].sum()), size + len(found), np.union1d(distinct, found)
            out.append(not size or hit / size >= least - FEW / np.sqrt(len(distinct)))
        return pa.array(out, pa.bool_())

    return each(F.col(text_col))


def predicted(text_col: str, net: Network | None) -> Column:
    """struct(lang_pred, score) for a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def each(texts: pa.Array, readable: pa.Array) -> pa.Array:
        raw = [t if ok and net else b"" for t, ok in zip(texts.cast(pa.binary()).to_pylist(), readable.to_pylist(), strict=True)]
        if net and raw:
            p = net.pooled(raw)
            names = [net.languages[k] if t else "und" for k, t in zip(p.argmax(axis=1), raw, strict=True)]
            scores = np.round(np.clip(p.max(axis=1), 0, 1), 6).tolist()
        else:
            names, scores = ["und"] * len(raw), [0.0] * len(raw)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return each(F.col(text_col), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))


def identify(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score): one row per input row; trains on ``docs`` unless given a network."""
    net = net or fit(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col), _held_out(id_col).alias("held_out"), predicted(text_col, net).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")


def accept(docs: DataFrame, least: float, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_met: float = 0.0) -> DataFrame:
    """The rows whose text has a language with a score of ``least`` or more and is familiar (see there), columns unchanged.

    The network shares its mass among the languages it learned, so a high score does not tell that a text is in one of
    them, nor that it is language; familiarity does. Where no row has a label there is no language to tell, and all texts with a letter stay.
    """
    net = net or fit(docs, id_col, text_col, lang_col)
    if net is None:
        return docs.where(F.col(text_col).rlike("\\p{L}"))
    marked = docs.withColumns({"__language": predicted(text_col, net), "__familiar": familiar(text_col, net, least_met)})
    return marked.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= least) & F.col("__familiar")).select(*docs.columns)
