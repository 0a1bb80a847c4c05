"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: over the subsequences of 3 and 4 characters of a token (with a mark at its start) that lie within a span of 5
and 6; one that spans s characters weighs decay**s, and kernels are normalised. Inserted characters only stretch a
span, so "idi.ot" stays near "idiot". Letters that stand alone in a row ("i d i o t") are read as one token.

Training: labelled rows' sentences are bags of tokens (multiple-instance training). Every token of a clean document's
sentence is taken for clean, but for tokens that seven tenths of their documents call toxic (labels have errors); a
toxic document has at least one sentence with a toxic token. Document frequencies give the first witnesses; to them the
machine adds its own in each round: the token of the largest decision in each sentence that it holds for toxic, and in
the best sentence of each toxic document, against random and the hardest clean tokens. (Without the first witnesses in
the later rounds, the machine drifts: 61 % of held-out toxic documents were found in place of 93 %.)
Instances are single tokens, so abuse made of several ordinary words is not covered. Landmarks are drawn from both
sides; the machine is solved in the landmarks' space (squared hinge, Newton steps). Its decision is linear in the
subsequences, so the landmarks are folded into one weight for each subsequence, and scoring a token is a look-up.
A document's score is logistic in its two largest decisions and the sum of its positive ones.

Labels are fitted on a bounded sample: at most train_rows labelled rows (by hash of their id), which the driver holds.
Every document is scored over its whole text, in one pass without a shuffle; null and empty texts get the score of a
document without toxic tokens. Labels, language, source and id are never inputs of a score. Without labels of both
kinds, the score is the share of toxic labels (0 where there is none). A null id is not held out and has no label.
Repeated rows are scored each, and equal texts alike; of a labelled id with several texts the smallest is read, and an
id with both labels counts as toxic. Only the id and the text are read, so other columns, whatever their names, don't
matter. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import map_batches, table

# The kernel's alphabet: a mark for the start of a token, then these, then symbols that all other letters are dealt over
# by code point, and one symbol for what is no letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåçèéêëìíîïñòóôöõùúûüß"
OTHERS = 7
BASE = len(LETTERS) + OTHERS + 2
TOKEN_CHARS = 24
COMBOS = [(3, (0, i, j), j) for j in range(2, 5) for i in range(1, j)] + [(4, (0, i, j, k), k) for k in range(3, 6) for j in range(2, k) for i in range(1, j)]
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?!\S)")
EDGES = " \t\n\r\f\v.,;:!?\"'()[]{}<>|%&#$*+=~`^/\\-_0123456789…«»“”‘’"
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")


def tokens_of(text: str) -> set[str]:
    """Distinct tokens, lower-cased and trimmed; longer ones than TOKEN_CHARS as overlapping parts."""
    text = text.lower()
    words = set(text.split())
    for m in SPACED.finditer(text):
        words.add("".join(re.findall(r"[^\W\d_]", m[0])))
    out = set()
    for w in words:
        if len(w) > 2 and len(w := w.strip(EDGES)) > 2:
            if len(w) <= TOKEN_CHARS:
                out.add(w)
            else:
                out.update(w[i : i + TOKEN_CHARS] for i in range(0, len(w) - TOKEN_CHARS // 2, TOKEN_CHARS // 2))
    return out


class Kernel:
    def __init__(self, decay: float = 0.7):
        self.decay = decay
        self.code = np.fromiter((len(LETTERS) + 1 + c % OTHERS if chr(c).isalpha() else BASE - 1 for c in range(0x110000)), np.int8, 0x110000)
        for i, c in enumerate(LETTERS):
            self.code[ord(c)] = i + 1

    def features(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token's place, feature and weight of every subsequence, in the tokens' order for each combination."""
        marked = ["\0" + t[:TOKEN_CHARS] for t in tokens]
        n = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points].astype(np.int64)
        codes[points == 0] = 0
        ends = np.repeat(np.cumsum(n), n)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(codes))
        who, feature, weight = [], [], []
        for k, places, span in COMBOS:
            p = at[at + span < ends]
            f = codes[p]
            for d in places[1:]:
                f = f * BASE + codes[p + d]
            who.append(owner[p])
            feature.append(f + (BASE**3 if k == 4 else 0))
            weight.append(np.full(len(p), self.decay ** (span + 1 - k), np.float32))
        return np.concatenate(who), np.concatenate(feature), np.concatenate(weight)

    def norms(self, who, feature, weight, n: int) -> np.ndarray:
        order = np.lexsort((feature, who))
        who, feature, weight = who[order], feature[order], weight[order]
        new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (feature[1:] != feature[:-1])]) if len(who) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, new).astype(np.float64) if len(new) else np.zeros(0)
        return np.sqrt(np.bincount(who[new], total**2, n))


class Machine:
    """Weights of subsequences, and the logistic layer; marks are the landmarks with their coefficients. decide() gives max(0, decision) of tokens, exact where it is
    positive: the squared weights without merging equal subsequences bound the norm from below, so most tokens need no
    exact norm."""

    def __init__(self, decay, index, value, bias, layer, marks=()):
        self.decay, self.index, self.value, self.bias, self.layer, self.marks = decay, index, value, bias, layer, marks

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("kernel", "table")}

    def start(self):
        if "table" in self.__dict__:
            return self
        self.kernel = Kernel(self.decay)
        self.table = np.zeros(BASE**3 + BASE**4, np.float32)
        self.table[self.index] = self.value
        return self

    def decide(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(0)
        if len(tokens) > 5000:  # a token has about a hundred subsequences
            return np.concatenate([self.decide(tokens[i : i + 5000]) for i in range(0, len(tokens), 5000)])
        who, feature, weight = self.kernel.features(tokens)
        top = np.bincount(who, self.table[feature] * weight, len(tokens))
        least = np.sqrt(np.bincount(who, weight.astype(np.float64) ** 2, len(tokens)))
        out = np.zeros(len(tokens))
        maybe = np.flatnonzero((top / np.maximum(least, 1e-12) + self.bias > 0) & (least > 0))
        if len(maybe):
            norm = self.kernel.norms(*self.kernel.features([tokens[i] for i in maybe]), len(maybe))
            out[maybe] = np.maximum(0, top[maybe] / norm + self.bias)
        return out

    def score(self, decisions: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(layer_inputs(decisions) @ self.layer)))


def layer_inputs(decisions) -> np.ndarray:
    x = np.zeros((len(decisions), 4))
    x[:, 0] = 1
    for i, d in enumerate(decisions):
        if len(d):
            top = np.sort(d)[-2:]
            x[i, 1:] = top[-1], top[0] if len(top) > 1 else 0, np.log1p(d.sum())
    return x


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Squared-hinge machine in the primal: Newton steps over the rows within the margin. The last column is 1."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(np.diag(reg) + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def stems(token: str) -> set[str]:
    return {*(token[:k] + "*" for k in (3, 4, 5) if len(token) > k)}


def first_witnesses(bags: list[list[set]], toxic: np.ndarray) -> set[str]:
    """Tokens of toxic documents whose word or stem is commoner there than chance among so many stems allows: the log
    likelihood of its documents' labels, against their overall share, exceeds the log of the number of stems."""
    # copies count once: documents of one kind with the same three smallest hashes of tokens are taken for copies
    seen: dict[tuple, set] = {}
    for sentences, y in zip(bags, toxic, strict=True):
        words = {t for bag in sentences for t in bag}
        if words:
            seen.setdefault((int(y), *heapq.nsmallest(3, (zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in words))), set()).update(words)
    per = (Counter(), Counter())
    for (y, *_), words in seen.items():
        per[y].update(words)
    share, least = max(1e-9, sum(k[0] for k in seen) / max(1, len(seen))), np.log(len(per[0].keys() | per[1].keys()) + 1)

    def strength(s: str) -> float:
        a, b = per[1][s], per[0][s]
        return a * np.log(a / (a + b) / share) + (b * np.log(b / (a + b) / (1 - share)) if b else 0) if a / (a + b) > max(share, 0.7) else 0

    sure = {s for s, n in per[1].items() if n > 1 and strength(s) >= least}
    for (y, *_), words in seen.items():  # stems of the other words: a sure word speaks for itself alone
        per[y].update({s for t in words - sure for s in stems(t)})
    sure |= {s for s, n in per[1].items() if s.endswith("*") and n > 1 and strength(s) >= least}
    return {t for sentences, y in zip(bags, toxic, strict=True) if y for bag in sentences for t in bag if t in sure or not sure.isdisjoint(stems(t))}


def train(texts: list[str], toxic: list[int], landmarks: int = 160, rounds: int = 3, decay: float = 0.7, seed: int = 11) -> Machine:
    rng = np.random.default_rng(seed)
    y = np.array(toxic, dtype=int)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        z = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Machine(decay, np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0, np.array([z, 0, 0, 0]))
    bags = [[frozenset(map(sys.intern, b)) for s in SENTENCE.split(t.lower()) if (b := tokens_of(s))] for t in texts]
    fold = rng.permutation(len(y)) % 3
    fit = (fold > 0) if y.sum() >= 60 else np.ones(len(y), bool)
    inner = [b for b, f in zip(bags, fit, strict=True) if f]
    yi = y[fit]
    per = [Counter(t for b, v in zip(inner, yi, strict=True) if v == k for t in set().union(*b)) for k in (0, 1)]
    # labels have errors: a token is known to be clean by three tenths of its documents at least, not by a single one
    known_clean = {t for t, n in per[0].items() if 7 * n >= 3 * per[1][t]}
    clean = sorted(known_clean)
    sure = first_witnesses(inner, yi) - known_clean
    kernel, machine = Kernel(decay), None
    for turn in range(rounds):
        good = set(sure)
        if machine is not None:
            names = sorted({t for b, v in zip(inner, yi, strict=True) if v for s in b for t in s} - known_clean)
            told = dict(zip(names, machine.decide(names).tolist(), strict=True))
            for b, v in zip(inner, yi, strict=True):
                best = [max((told.get(t, 0.0), t) for t in s) for s in b] if v else []
                good.update(t for d, t in best if d > (0.5 if (d, t) == max(best) else 0.9))
        good = sorted(good)
        if not good:
            break
        good += sorted({t[:k] + mark + t[k:] for t in good for k in (len(t) // 3, 2 * len(t) // 3) if k for mark in ".*"} - known_clean - set(good))  # written with a sign between
        some = [clean[i] for i in rng.permutation(len(clean))[: max(3000, len(good))]]
        if machine is not None:
            d = machine.start().decide(clean)
            some = list(dict.fromkeys([*some, *(clean[i] for i in np.argsort(-d, kind="stable")[:2000] if d[i] > 0)]))
        names = [*good, *some]
        label = np.r_[np.ones(len(good)), -np.ones(len(some))]
        pick = lambda names, n: [names[i] for i in rng.permutation(len(names))[:n]]
        marks = pick(good, landmarks // 2) + pick(some[-2000:], landmarks // 2)
        who, feature, weight = kernel.features(names)
        norm = np.maximum(kernel.norms(who, feature, weight, len(names)), 1e-12)
        z = [np.zeros(0)] * len(marks)
        k = np.empty((len(names), len(marks)))
        table_ = np.zeros(BASE**3 + BASE**4, np.float32)
        for j, mark in enumerate(marks):
            w, f, g = kernel.features([mark])
            scale = max(float(kernel.norms(w, f, g, 1)[0]), 1e-12)
            np.add.at(table_, f, g / scale)
            k[:, j] = np.bincount(who, table_[feature] * weight, len(names)) / norm
            ids = np.unique(f)
            z[j] = (ids, table_[ids].copy())
            table_[f] = 0
        place = {t: i for i, t in enumerate(names)}
        kmm = k[[place[m] for m in marks]]
        values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        cost = np.where(label > 0, len(label) / 2 / len(good), len(label) / 2 / len(some))
        w = solve(np.c_[k @ root, np.ones(len(names))], label, cost)
        alpha = root @ w[:-1]
        for (ids, v), a in zip(z, alpha, strict=True):
            table_[ids] += (a * v).astype(np.float32)
        index = np.flatnonzero(table_)
        machine = Machine(decay, index, table_[index], float(w[-1]), np.zeros(4), list(zip(marks, alpha.tolist(), strict=True))).start()
    if machine is None:
        return Machine(decay, np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0, np.array([np.log(y.mean() / (1 - y.mean())), 0, 0, 0]))
    held = np.flatnonzero(~fit) if not fit.all() else np.arange(len(y))
    x = layer_inputs([machine.decide(sorted({t for s in bags[i] for t in s})) for i in held])
    return Machine(decay, machine.index, machine.value, machine.bias, logistic(x, y[held]), machine.marks)


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str, text_col: str) -> tuple[list[str], list[int]]:
    """Texts and labels of at most train_rows labelled rows, by hash of their id, but for the held-out fifth. The ids
    are chosen from the labels first, so only a bounded table is broadcast and no text is shuffled."""
    ids = labels.select(F.col(id_col).alias("key"), "toxic").where((F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0) & F.col("toxic").isin(0, 1))
    ids = ids.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(ids), "key").groupBy("key").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("key", "text", "toxic").collect()
    rows.sort(key=lambda r: r[0])
    return [r[1] or "" for r in rows], [int(r[2]) for r in rows]


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep_tokens: int = 300_000) -> DataFrame:
    """id and score of each row. Decisions of up to keep_tokens tokens are kept in a task."""

    def make():
        machine.start()
        known: dict[str, float] = {}

        def each(ids, texts):
            bags = [tokens_of(t) if t else () for t in texts]
            fresh = list({t for b in bags for t in b if t not in known})
            if len(known) + len(fresh) > keep_tokens:
                known.clear()
                fresh = list({t for b in bags for t in b})
            known.update(zip(fresh, machine.decide(fresh).tolist(), strict=True))
            found = [np.array([d for t in b if (d := known[t]) > 0]) for b in bags]
            return [ids, machine.score([np.sort(f) for f in found])]

        return each

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "id long, score double", make)


def score_column(docs: DataFrame, machine: Machine, text_col: str = "text"):
    """The score as a column, for filters that keep all of a row: an Arrow-batched scalar function."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        machine.start()
        bags = [sorted(tokens_of(t)) if t else [] for t in texts]
        every = list({t for b in bags for t in b})
        known = dict(zip(every, machine.decide(every).tolist(), strict=True))
        return pd.Series(machine.score([np.sort(np.array([d for t in b if (d := known[t]) > 0])) for b in bags]))

    return score(F.col(text_col))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    return train(*labelled_rows(docs, labels, train_rows, id_col, text_col))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
