"""LM scoring with a gated recurrent language model in numpy.

Words are counted over all training documents. The commonest soft_words get a place in the output; every other word
belongs to one of `rare` classes by its spelling (nearest centre of hashed byte trigrams). The output softmax is
factored by class: P(word | h) = P(class | h) P(word | class, h) within the classes of common words, and
P(class | h) (c + 1) / (N_class + V_class + 1) for the other words, whose last slot is that of words never seen; so the
probabilities sum to 1. The network is a gated recurrent unit (reset after the product), trained by backpropagation
truncated at window steps, with the state carried from window to window and cleared between documents.

Texts are split into words twice, by Arrow and without an object for each word: for the counts, and once more to write
each document's ids, from which both training and scoring read. A pilot on a bounded number of documents, whole, gives all tasks one start; then each task trains on
all of its training documents, and the weights are averaged by tokens in the cluster. Counts use every training
document. Scoring runs lanes of documents side by side, carries each one's state over its whole length, and adds
up log10 P of every word and the end. How rows are split over tasks decides which documents a net sees, so scores differ
a little with it.

Counts of the commonest lookup_words words travel to the tasks; that is a bound. All other words of a document are
joined with the full table of counts.

Null and empty texts are one token, the end. Repeated rows are counted and scored each: rows are told apart by a number
that is written with their ids. The hash of a null id is null,
so such a row is trained on and not held out. Ties in counts go by the word. Only the id and the text are read, so
other columns, whatever their names, don't matter. Without training tokens, c, N and V are 0 and every score equals the
base score. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quillmill.llm.common import commonest, durable, map_batches, table

TRIGRAMS = 4096
BLOCK = 4096
PIECE = 512  # lanes of documents that are scored side by side
LETTERS = 48  # trigrams of a word that are added up word beside word
TEXT = 8 << 20  # bytes of text that are split at once
ROWS = 224  # rows of a product: so few that it needs no packing by the library and stays in a core's cache
GROUP = 4 * ROWS  # rows whose softmax is worked on at once
DEFAULTS = {"soft_words": 8192, "lookup_words": 100_000, "rare": 32, "in_class": 128, "width": 24, "hidden": 32, "window": 16, "streams": 256, "pilot_docs": 500, "seed": 5}


def words_of(text: str | None) -> list[bytes]:
    """Bytes, so that only A-Z are lower-cased and only the six ASCII white space characters split."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(batch: pa.RecordBatch, text: pa.Array):
    """A batch in runs of rows with about TEXT bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, TEXT + (size[i - 1] if i else 0), side="right")))
        yield batch.slice(i, j - i)
        i = j


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of() over Arrow strings: the words of all texts, one after another, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not some.all():  # before a text's first word or behind its last one
        n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
        words = words.filter(pa.array(some))
    return words.cast(pa.binary()), n


class Spelling:
    """Classes of words by their spelling."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres  # TRIGRAMS x classes

    @staticmethod
    def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed trigrams of all words (each with a space before and two behind), where each word's begin, and how many
        they are."""
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        data = np.frombuffer(b" " + pc.binary_join(row, b"   ")[0].as_py() + b"  ", np.uint8).astype(np.int32)
        n = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = (data[:-2] * 31 + data[1:-1] * 977 + data[2:] * 40503 + data[:-2] * data[2:]) & (TRIGRAMS - 1)
        return code, np.cumsum(n + 2) - n - 2, n

    def of(self, words: list[bytes] | pa.Array) -> np.ndarray:
        words, out = words if isinstance(words, pa.Array) else pa.array(words, pa.binary()), []
        for i in range(0, len(words), 2000):
            code, start, n = self.grams(words[i : i + 2000])
            order = np.argsort(-n, kind="stable")
            start, n = start[order], n[order]
            sums, active = self.centres.take(code[start], 0), len(n)
            for t in range(1, min(LETTERS, int(n[0]))):
                active = int(np.searchsorted(-n, -t))
                sums[:active] += self.centres.take(code[start[:active] + t], 0)
            for w in range(int(np.searchsorted(-n, -LETTERS))):  # longer words, a piece at a time
                for t in range(LETTERS, int(n[w]), 4096):
                    sums[w] += self.centres[code[start[w] + t : start[w] + min(t + 4096, int(n[w]))]].sum(0)
            got = np.empty(len(n), np.int64)
            got[order] = np.argmax(sums, axis=1)
            out.append(got)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    @classmethod
    def learn(cls, words: list[bytes], classes: int, seed: int, steps: int = 12) -> Spelling:
        rng = np.random.default_rng(seed)
        if not words:
            return cls(np.zeros((TRIGRAMS, classes), np.float32))
        x = np.zeros((len(words), TRIGRAMS), np.float32)
        for i, w in enumerate(words):
            code, _, _ = cls.grams(pa.array([w], pa.binary()))
            np.add.at(x[i], code, 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = x[rng.permutation(len(x))[:classes]]
        centres = np.concatenate([centres, np.zeros((classes - len(centres), TRIGRAMS), np.float32)])
        for _ in range(steps):
            to = np.argmax(x @ centres.T, axis=1)
            for k in range(classes):
                if (to == k).any():
                    m = x[to == k].sum(0)
                    centres[k] = m / np.linalg.norm(m)
        return cls(np.ascontiguousarray(centres.T))


def softmax(logits: Callable[[], np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that logits() makes: their exps, the sums of these, and the log probability of each row's place `at`.
    Rows are shifted by their maxima only where sums would leave the range of float32."""
    a, rows = logits(), np.arange(len(at))
    chosen = a[rows, at]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        sums = a @ np.ones(a.shape[1], np.float32)
    if len(at) and not (sums.min() > 1e-25 and sums.max() < 1e30):
        a = logits()
        a -= a.max(1, keepdims=True)
        chosen = a[rows, at]
        np.exp(a, out=a)
        sums = a.sum(1)
    return a, sums, chosen - np.log(sums)


def sums_by_id(ids: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids (below size) that occur, and the sum of each one's rows. Most occur once: only the others are added up."""
    ids = ids.astype(np.int16) if size < 1 << 15 else ids
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
    times = np.diff(np.r_[first, len(ids)])
    out, many = values.take(order[first], 0), times > 1
    if many.any():
        starts = np.cumsum(times[many]) - times[many]
        out[many] = np.add.reduceat(values.take(order[np.repeat(many, times)], 0), starts, axis=0)
    return ids[order[first]], out


class Network:
    """ids: 0..S-1 common words, S the end, S+1.. rare classes. Output classes: those of common words, then the end,
    then the rare ones. within[c] holds the ids of class c."""

    def __init__(self, word_classes: list[list[int]], soft: int, rare: int, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.soft, self.rare, self.hidden = soft, rare, hidden
        self.members = [np.array(m, np.int64) for m in word_classes]
        self.n_classes = len(word_classes) + 1 + rare
        self.class_of = np.zeros(soft + 1 + rare, np.int64)
        self.place = np.zeros(soft + 1 + rare, np.int64)
        for c, m in enumerate(self.members):
            self.class_of[m], self.place[m] = c, np.arange(len(m))
        self.class_of[soft:] = len(word_classes) + np.arange(1 + rare)
        g = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "emb": g(soft + 1 + rare, width), "wx": g(width, 3 * hidden, k=width**-0.5), "uh": g(hidden, 3 * hidden, k=hidden**-0.5), "b": np.zeros(3 * hidden, np.float32),
            "wc": g(hidden, self.n_classes), "bc": np.zeros(self.n_classes, np.float32), "wk": g(soft, hidden), "bk": np.zeros(soft, np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def set_biases(self, counts: np.ndarray) -> None:
        """Start from the frequencies: counts of all ids."""
        by_class = np.bincount(self.class_of, counts, self.n_classes) + 1
        self.p["bc"] = np.log(by_class / by_class.sum()).astype(np.float32)
        for m in self.members:
            self.p["bk"][m] = np.log((counts[m] + 1) / (counts[m] + 1).sum())

    def gates(self, name: str, halved: bool = False) -> np.ndarray:
        """A weight of all gates as one matrix for each; halved: those of the two sigmoid gates by 2."""
        w = np.ascontiguousarray(self.p[name].reshape(-1, 3, self.hidden).transpose(1, 0, 2))
        if halved:
            w[:2] *= 0.5
        return w

    def step(self, gx: np.ndarray, h: np.ndarray, uh: np.ndarray, hu=None, zr=None, c=None, out=None) -> np.ndarray:
        """The next state. gx and uh by gates and halved; the rest is written where it is given."""
        hu = np.matmul(h, uh, out=hu)
        zr = np.add(gx[:2], hu[:2], out=zr)
        np.tanh(zr, out=zr)  # 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2
        zr *= 0.5
        zr += 0.5
        c = np.multiply(zr[1], hu[2], out=c)
        c += gx[2]
        np.tanh(c, out=c)
        h = np.subtract(h, c, out=out)
        h *= zr[0]
        h += c
        return h

    def words(self) -> np.ndarray:
        """Output weights of the common words by class and place, as columns with their biases below; a bias of -1e30
        where no word is."""
        w = np.zeros((len(self.members), self.hidden + 1, max(map(len, self.members), default=0)), np.float32)
        w[:, -1] = -1e30
        cls, at = self.class_of[: self.soft], self.place[: self.soft]
        w[cls, :-1, at], w[cls, -1, at] = self.p["wk"], self.p["bk"]
        return w

    def heads(self) -> np.ndarray:
        """Output weights of the classes as columns, with their biases below."""
        return np.concatenate([self.p["wc"], self.p["bc"][None]])

    def by_class(self, h: np.ndarray, y: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]], np.ndarray]:
        """All rows in the order of their classes, so common words first: which they are, their h with a one behind, the
        classes of common words as groups of (class, begin, end) with ROWS rows at most, and the common words' places."""
        order = np.argsort(cls.astype(np.int16) if self.n_classes < 1 << 15 else cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.members) + 1)).tolist()
        ones = np.empty((len(order), self.hidden + 1), np.float32)
        ones[:, :-1], ones[:, -1] = h.take(order, 0), 1
        groups, first = [[]], 0
        for c, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            for i in range(begin, end, ROWS):
                if (j := min(i + ROWS, end)) - first > GROUP:
                    groups.append([])
                    first = i
                groups[-1].append((c, i, j))
        return order, ones, [g for g in groups if g], self.place[y[order[: cuts[-1]]]]

    @staticmethod
    def by_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), b.shape[1]), np.float32)
        for i in range(0, len(a), ROWS):
            np.matmul(a[i : i + ROWS], b, out=out[i : i + ROWS])
        return out

    @staticmethod
    def in_class(ones: np.ndarray, words: np.ndarray, group: list[tuple[int, int, int]]) -> np.ndarray:
        """The logits of a group's rows within their classes."""
        first = group[0][1]
        a = np.empty((group[-1][2] - first, words.shape[2]), np.float32)
        for c, i, j in group:
            np.matmul(ones[i:j], words[c], out=a[i - first : j - first])
        return a

    def log_probs(self, h: np.ndarray, y: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Natural logs of P(class | h), and of P(word | class, h) too where y is a common word."""
        cls, words, heads = self.class_of[y], self.words() if words is None else words, self.heads()
        order, ones, groups, places = self.by_class(h, y, cls)
        cls, logs, out = cls[order], np.empty(len(y)), np.empty(len(y))
        for i in range(0, len(y), GROUP):
            logs[i : i + GROUP] = softmax(lambda i=i: self.by_rows(ones[i : i + GROUP], heads), cls[i : i + GROUP])[2]
        for group in groups:
            i, j = group[0][1], group[-1][2]
            logs[i:j] += softmax(lambda group=group: self.in_class(ones, words, group), places[i:j])[2]
        out[order] = logs
        return out

    def train(self, y: np.ndarray, streams: int, window: int, rate: float, memory: dict | None = None) -> float:
        """One pass over the tokens y (documents one after another, each with its end), cut into streams; Adagrad.
        Streams are of equal length: the first tokens come again where the last stream would be shorter. The mean loss.
        Arrays are by gate, so that every operation runs over whole arrays; of a step back only what depends on the step
        behind it is done step by step."""
        if not len(y):
            return 0.0
        streams = max(1, min(streams, len(y) // (2 * window)))
        steps = -(-len(y) // streams)
        y = np.resize(y, streams * steps)
        end, p, k = self.soft, self.p, self.hidden
        x = np.ascontiguousarray(np.concatenate([[end], y[:-1]]).reshape(streams, steps).T)
        y = np.ascontiguousarray(y.reshape(streams, steps).T)
        g2 = memory if memory is not None else {n: np.full(v.shape if n not in ("emb", "wk") else (len(v), 1), 1e-6, np.float32) for n, v in p.items()}
        words, known = self.words(), (self.class_of[: self.soft], self.place[: self.soft])
        slopes, turned = np.zeros_like(words), np.empty((len(words), words.shape[2], k), np.float32)
        of_words, of_biases = np.ones(slopes[:, 0].shape, np.float32), np.ones(slopes[:, 0].shape, np.float32)
        of_words[known], of_biases[known] = g2["wk"][:, 0], g2["bk"]
        most = min(window, steps)
        buffers = [np.empty((*gate, most, streams, k), np.float32) for gate in ((), (), (), (3,), (2,), (4,))]
        emb, width = np.concatenate([p["emb"], np.ones((len(p["emb"]), 1), np.float32)], axis=1), p["emb"].shape[1]  # a one for the biases
        h, total = np.zeros((streams, k), np.float32), 0.0
        for t0 in range(0, steps, window):
            xs, ys = x[t0 : t0 + window], y[t0 : t0 + window]
            n = xs.shape[0]
            h0, hs, c, hu, zr, du = (b[..., :n, :, :] for b in buffers)
            e = emb.take(xs.reshape(-1), 0).reshape(n, streams, -1)
            wx, uh = self.gates("wx"), self.gates("uh", halved=True)
            gx = np.matmul(e, np.concatenate([wx, p["b"].reshape(3, 1, k)], axis=1)[:, None] * np.array([0.5, 0.5, 1], np.float32)[:, None, None, None])
            cleared = [np.flatnonzero(row) for row in xs == end]
            for t in range(n):
                h0[t] = h
                h0[t, cleared[t]] = 0
                h = self.step(gx[:, t], h0[t], uh, hu[:, t], zr[:, t], c[t], hs[t])
            yf = ys.reshape(-1)
            scale, rows, cls = np.float32(1 / len(yf)), np.arange(len(yf)), self.class_of[yf]
            order, ones, groups, places = self.by_class(hs.reshape(-1, k), yf, cls)
            cls, dh_out = cls[order], np.empty((len(yf), k), np.float32)
            # softmaxes are left undivided: what the rows are multiplied with is divided by their sums
            heads, down, of_heads = self.heads(), np.ascontiguousarray(p["wc"].T), np.zeros((k + 1, self.n_classes), np.float32)
            for i in range(0, len(yf), GROUP):
                h1, cls1 = ones[i : i + GROUP], cls[i : i + GROUP]
                prob, sums, logs = softmax(lambda: self.by_rows(h1, heads), cls1)  # noqa: B023
                total -= float(logs.sum())
                prob[rows[: len(cls1)], cls1] -= sums
                share = (scale / sums)[:, None]
                h1 = h1 * share
                for j in range(0, len(h1), ROWS):
                    of_heads += h1[j : j + ROWS].T @ prob[j : j + ROWS]
                np.multiply(self.by_rows(prob, down), share, out=dh_out[i : i + GROUP])
            np.copyto(turned, words[:, :-1].transpose(0, 2, 1))
            met = set()
            for group in groups:
                first, last = group[0][1], group[-1][2]
                prob, sums, logs = softmax(lambda: self.in_class(ones, words, group), places[first:last])  # noqa: B023
                total -= float(logs.sum())
                prob[rows[: last - first], places[first:last]] -= sums
                share = (scale / sums)[:, None]
                h1, dh = ones[first:last] * share, np.empty((last - first, k), np.float32)
                for c_, i, j in group:
                    prob1 = prob[i - first : j - first]
                    np.matmul(prob1, turned[c_], out=dh[i - first : j - first])
                    if c_ in met:
                        slopes[c_] += h1[i - first : j - first].T @ prob1
                    else:
                        np.matmul(h1[i - first : j - first].T, prob1, out=slopes[c_])
                        met.add(c_)
                dh *= share
                dh_out[first:last] += dh
            slopes[[c_ for c_ in range(len(words)) if c_ not in met]] = 0
            for i in range(0, len(words) if groups else 0, 16):
                d, of_w, of_b = slopes[i : i + 16], of_words[i : i + 16], of_biases[i : i + 16]
                of_w += np.einsum("ckw,ckw->cw", d[:, :-1], d[:, :-1]) / np.float32(k)
                of_b += d[:, -1] * d[:, -1]
                d[:, :-1] *= (rate / np.sqrt(of_w))[:, None]
                d[:, -1] *= rate / np.sqrt(of_b)
                words[i : i + 16] -= d
            unsorted = np.empty_like(dh_out)
            unsorted[order] = dh_out
            # slopes of the gates, then what comes back to them: the candidate's product with the state, both sigmoids, the candidate
            (z, r), (dm, dz, dr, dc) = zr, du
            np.subtract(1, z, out=dm)
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= dm
            np.subtract(h0, c, out=dz)
            dz *= z
            dz *= dm
            np.multiply(dc, r, out=dm)
            np.subtract(1, r, out=dr)
            dr *= hu[2]
            dr *= dm
            dh_out, dh, back = unsorted.reshape(n, streams, k), np.zeros((streams, k), np.float32), np.ascontiguousarray(self.gates("uh")[[2, 0, 1]].transpose(0, 2, 1))
            for t in range(n - 1, -1, -1):
                dh += dh_out[t]
                now = du[:, t]
                now *= dh
                dh *= z[t]
                for b in np.matmul(now[:3], back):
                    dh += b
                dh[cleared[t]] = 0
            by_gate = {name: np.matmul(side.transpose(0, 2, 1), d).sum(1) for name, side, d in (("uh", h0, du[:3]), ("wx", e, du[1:]))}
            grad = {"wc": of_heads[:-1], "bc": of_heads[-1], "b": by_gate["wx"][:, -1].reshape(-1)}
            grad |= {name: g.transpose(1, 0, 2).reshape(-1, 3 * k) for name, g in (("uh", by_gate["uh"][[1, 2, 0]]), ("wx", by_gate["wx"][:, :-1]))}
            turn = np.zeros((3, 1, k, width + 1), np.float32)
            turn[:, 0, :, :-1] = wx.transpose(0, 2, 1)
            de = np.matmul(du[1], turn[0])
            for gate in (1, 2):
                de += np.matmul(du[1 + gate], turn[gate])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            for name, g in grad.items():
                g = g * clip
                g2[name] += g * g
                p[name] -= rate * g / np.sqrt(g2[name])
            rows, de = sums_by_id(xs.reshape(-1), de.reshape(len(yf), -1), len(emb))
            de *= clip
            memories = g2["emb"][rows] + np.einsum("rk,rk->r", de, de)[:, None] / np.float32(width)
            g2["emb"][rows] = memories
            de *= rate / np.sqrt(memories)
            emb[rows] -= de
        p["emb"] = emb[:, :-1].copy()
        p["wk"], p["bk"] = words[known[0], :-1, known[1]], words[known[0], -1, known[1]]
        g2["wk"][:, 0], g2["bk"][:] = of_words[known], of_biases[known]
        return total / (streams * steps)

    def score(self, docs: list[np.ndarray], hold: int = 32_768) -> np.ndarray:
        """Natural log probability of each sequence of ids (ends included), states carried over whole documents."""
        out = np.zeros(len(docs))
        sign = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        table_ = np.matmul(self.p["emb"], self.gates("wx", halved=True)) + self.p["b"].reshape(3, 1, -1) * sign
        uh, words = self.gates("uh", halved=True), self.words()
        # documents one after another in lanes of like length, the longest first, so that steps stay wide
        n = np.array([len(d) for d in docs], np.int64)
        lanes: list[list[int]] = [[] for _ in range(min(PIECE, len(docs)))]
        free = [(0, lane) for lane in range(len(lanes))]
        for i in np.argsort(-n, kind="stable").tolist():
            size, lane = free[0]
            heapq.heapreplace(free, (size + int(n[i]), lane))
            lanes[lane].append(i)
        order = [i for _, lane in sorted(free, reverse=True) for i in lanes[lane]]
        lengths = np.array([size for size, _ in sorted(free, reverse=True)], np.int64)
        start, most, t = np.cumsum(lengths) - lengths, len(lanes), 0
        ids, of = np.concatenate([docs[i] for i in order] or [[]]).astype(np.int64), np.repeat(np.array(order, np.int64), n[order])
        hs, buffers = np.empty((hold + most, self.hidden), np.float32), [np.empty((*gate, most, self.hidden), np.float32) for gate in ((), (3,), (3,), (2,), ())]
        h, x = np.zeros((most, self.hidden), np.float32), np.full(most, self.soft)
        while docs and t < lengths[0]:
            active = int(np.searchsorted(-lengths, -t))
            steps = np.arange(t, min(t + max(1, hold // active), lengths[0]))
            at, inside, size = np.minimum(start[:active, None] + steps, len(ids) - 1), steps[:, None] < lengths[:active], 0
            y = np.ascontiguousarray(ids[at].T)
            x = np.concatenate([x[None, :active], y[:-1]])
            cleared = [np.flatnonzero(row) for row in x == self.soft]
            for step, wide in enumerate(inside.sum(1).tolist()):
                h0, gx, *work = (b[..., :wide, :] for b in buffers)
                h0[:] = h[:wide]
                h0[cleared[step][: np.searchsorted(cleared[step], wide)]] = 0
                for gate in range(3):
                    np.take(table_[gate], x[step, :wide], 0, out=gx[gate], mode="clip")
                h, size = self.step(gx, h0, uh, *work, out=hs[size : size + wide]), size + wide
            out += np.bincount(of[at].T[inside], self.log_probs(hs[:size], y[inside], words), len(docs))
            h, x, t = h.copy(), y[-1], int(steps[-1]) + 1
        return out


class Vocabulary:
    """Places of words in the look-up (common words first) and their ids in the network; spelling gives the class of any
    word that isn't in it."""

    def __init__(self, soft: int, lookup: dict[bytes, int], spelling: Spelling):
        self.soft, self.lookup, self.spelling = soft, lookup, spelling

    def start(self):
        self.words = pa.array(self.lookup, pa.binary())
        classes = self.spelling.of(list(self.lookup)[self.soft :])
        self.net = np.concatenate([np.arange(self.soft), self.soft + 1 + classes]).astype(np.int32)
        return self

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words of texts, their places in the look-up (-1 for none) and the network's ids; for each token
        its word's number; each text's number of words."""
        flat, n = split(texts)
        coded = flat.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        none, net = place < 0, np.empty(len(place), np.int32)
        net[~none] = self.net[place[~none]]
        net[none] = self.soft + 1 + self.spelling.of(words.filter(pa.array(none)))
        return words, place, net, at, n

    def ids(self, net: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.dtype) -> np.ndarray:
        """The network's ids of texts, one after another, each with its end."""
        out, ends = np.empty(len(at) + len(n), kind), np.cumsum(n + 1) - 1
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word], out[ends] = net.astype(kind)[at], self.soft
        return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame, text_col: str, most: int = 300_000) -> DataFrame:
    """word and count over all rows; each task adds its words up before they are shuffled."""

    def run(batches):
        held, size = [], 0

        def summed():
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches:
            for part in pieces(batch, batch.column(0)):
                words, _ = split(part.column(0))
                found = pc.value_counts(words)
                held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "c"]))
                size += len(found)
                if size > 2 * most:
                    held = [summed()]
                    size = len(held[0])
                    if size > most:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if size:
            yield from summed().to_batches()

    return docs.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def average(parts: DataFrame, size: int) -> tuple[np.ndarray | None, int]:
    """The mean of the tasks' weights (rows part, at, w, tokens) by tokens, in two levels so that no group grows with
    the number of tasks by more than its root."""
    def mean(rows):
        n = rows["tokens"].to_numpy(np.float64)
        w = np.average(np.stack(rows["w"].to_numpy()), axis=0, weights=n)
        return pd.DataFrame({"part": [0], "at": [rows["at"].iloc[0]], "w": [w.astype(np.float32)], "tokens": [n.sum()]})

    schema = "part long, at int, w array<float>, tokens double"
    rows = parts.withColumn("part", F.pmod("part", F.lit(64))).groupBy("at", "part").applyInPandas(mean, schema)
    rows = rows.groupBy("at").applyInPandas(mean, schema).collect()
    if not rows:
        return None, 0
    out = np.zeros(size, np.float32)
    for r in rows:
        out[r["at"] : r["at"] + len(r["w"])] = r["w"]
    return out, int(rows[0]["tokens"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, **options) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. held: a boolean column, true for
    the rows that aren't trained on."""
    o = DEFAULTS | options
    held = held_out(id_col) if held is None else held
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = durable(count_words(training, "text"), "counts")
    ends = training.count()
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = (total or 0) + ends, distinct + (ends > 0)
    top = commonest(counts, "c", o["lookup_words"]).collect()
    lookup = {bytes(r["word"]): r["c"] for r in sorted(top, key=lambda r: (-r["c"], bytes(r["word"])))}
    soft = [w for w, c in list(lookup.items())[: o["soft_words"]] if c > 2]
    spelling = Spelling.learn(soft[:4096], o["rare"], o["seed"])

    # classes of common words: by spelling, cut at in_class words
    by = spelling.of(soft)
    classes = [m[i : i + o["in_class"]].tolist() for k in range(o["rare"]) if len(m := np.flatnonzero(by == k)) for i in range(0, len(m), o["in_class"])]
    words = Vocabulary(len(soft), lookup, spelling)

    # totals of the rare classes, over the whole table of counts
    def class_totals(batches):
        common = pa.array(soft, pa.binary())
        for b in batches:
            rare = b.filter(pc.invert(pc.is_in(b.column("word"), value_set=common)))
            k, c = spelling.of(rare.column("word")), rare.column("c").to_numpy()
            sums = [np.arange(o["rare"]), np.bincount(k, c, o["rare"]).astype(np.int64), np.bincount(k, minlength=o["rare"])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sums], names=["k", "n", "v"])

    sums = counts.mapInArrow(class_totals, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    in_class = np.ones(o["rare"])
    rare_n = np.zeros(o["rare"])
    for r in sums:
        in_class[r["k"]] += r["n"] + r["v"]
        rare_n[r["k"]] = r["n"]

    net = Network(classes, len(soft), o["rare"], o["width"], o["hidden"], o["seed"])
    net.set_biases(np.concatenate([[lookup[w] for w in soft], [ends], rare_n]))
    # by a threshold of the texts' hashes, equal texts once: about pilot_docs rows leave the tasks
    part = F.pmod("h", F.lit(1 << 40)) <= (1 << 40) * o["pilot_docs"] // max(ends, 1)
    chosen = training.select("text", F.xxhash64("text").alias("h")).where(part).groupBy("h").agg(F.min("text").alias("text"))
    pilot = [r["text"] for r in sorted(chosen.collect())]
    if pilot:
        _, _, *ids = words.start().encode(pa.array(pilot, pa.string()))
        y = words.ids(*ids, np.int64)
        for rate in (0.1, 0.05):
            net.train(y, 64, o["window"], rate)
        del words.words, words.net
    start = net.flat()

    unit = float(n + v + 1) if n else 1.0
    ln10 = np.log(10)
    kind = np.dtype("<u2" if len(soft) + 1 + o["rare"] < 1 << 16 else "<i4")

    known = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    coded_schema = _parse_datatype_string(f"{known}, tail array<binary>, times array<int>, ids binary")
    schema = to_arrow_schema(coded_schema)

    def encode(batches):
        own = words.start()
        slot = np.log10(in_class)
        log_c = np.log10(np.fromiter(lookup.values(), np.float64, len(lookup)) + 1)
        base_of, model_of = log_c - np.log10(unit), np.zeros(len(lookup))
        model_of[len(soft) :] = log_c[len(soft) :] - slot[own.net[len(soft) :] - len(soft) - 1]
        unseen, end_base = float(np.log10(unit)), float(np.log10((ends + 1) / unit))
        for batch in batches:
            for part in pieces(batch, batch.column("text")):
                found, place, net, at, n = own.encode(part.column("text"))
                seen, rows_ = place >= 0, len(n)
                base, model = np.full(len(place), -unseen), np.empty(len(place))
                base[seen], model[seen] = base_of[place[seen]], model_of[place[seen]]
                model[~seen] = -slot[net[~seen] - len(soft) - 1]
                doc = np.repeat(np.arange(rows_), n)
                tokens = [np.bincount(doc, x[at], rows_) for x in (seen, base, model)]
                rest = np.flatnonzero(~seen[at])
                keys, times = np.unique(doc[rest] * len(place) + at[rest], return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(rows_ + 1) * len(place)), pa.int32())
                ids, size = own.ids(net, at, n, kind), np.concatenate([[0], np.cumsum(n + 1)]) * kind.itemsize
                made = [
                    *(part.column(c) for c in ("row", "id", "held_out")), n + 1, tokens[0].astype(np.int64) + (ends > 0), tokens[1] + end_base, tokens[2],
                    pa.ListArray.from_arrays(cuts, found.take(pa.array(keys % max(len(place), 1)))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                    pa.Array.from_buffers(pa.binary(), rows_, [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(ids)]),
                ]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    cols = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    coded = durable(cols.mapInArrow(encode, coded_schema), "ids")

    def train_part(batches):
        schema, total, who = pa.schema([("part", pa.int64()), ("at", pa.int32()), ("w", pa.list_(pa.float32())), ("tokens", pa.float64())]), 0, 0
        for b in batches:
            docs = b.column(0).to_pylist()
            who = who or (len(docs) * 2654435761 + sum(map(len, docs))) % (1 << 40)
            for i in range(0, len(docs), 1000):
                y = np.frombuffer(b"".join(docs[i : i + 1000]), kind).astype(np.int64)
                net.train(y, o["streams"], o["window"], 0.03)
                total += len(y)
        if total:
            flat = net.flat()
            at = list(range(0, len(flat), BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([who] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([flat[i : i + BLOCK] for i in at], pa.list_(pa.float32())), pa.array([float(total)] * len(at))], schema=schema)

    parts = durable(coded.where(~F.col("held_out")).select("ids").mapInArrow(train_part, "part long, at int, w array<float>, tokens double"), "weights")
    flat, _ = average(parts, len(start))
    if flat is not None:
        net.load(flat)

    def score():
        def each(*cols):
            *cols, scores, docs = cols
            done, first, size = list(scores), 0, 0
            for at, doc in enumerate(docs, 1):
                size += len(doc) // kind.itemsize
                if size > 3_000_000 or at == len(docs):
                    logs = net.score([np.frombuffer(x, kind).astype(np.int32) for x in docs[first:at]]) / ln10
                    done[first:at] = [s + float(x) for s, x in zip(done[first:at], logs, strict=True)]
                    first, size = at, 0
            return [*cols, done]

        return each

    told = durable(map_batches(coded.drop("tail", "times"), known, score), "scores")
    # words beyond the lookup: their log10(c + 1) counts for base and score alike
    tail = coded.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("k"))
    more = tail.join(counts, "word").groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = told.join(durable(more, "tails"), "row", "left")
    add = F.coalesce("more", F.lit(0.0))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"), (F.col("score") + add if n else F.col("base") + add).alias("score"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
