"""Secret scans: fixed rules, and a character convolutional network over every candidate and its surroundings.

Every run of 16 or more key characters is a candidate, also where rules found something. The network, written in
numpy, sees the candidate and the characters around it; of a long one it sees both ends together and then all its
stretches through a window that slides over it, and the best score counts. It is trained here on labelled findings
that a seeded generator writes (`Training.examples` of them, the documented bound), its scores are calibrated on a part
that training doesn't see, and the threshold is the highest one that keeps the demanded recall there by a margin of two
standard errors. Spans that the
network accepts are added as kind "net", also where they overlap spans of rules, which all stay.

Defined results: a null or empty text has no spans; very long texts are scanned whole; spans of one start are ordered
by kind; repeated rows are scanned each on its own; extra columns are ignored (`scan_secrets`) or kept
(`redact_secrets`); an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import batches, bounded, map_texts

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "net")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_net bigint, base_sha256 string, spans string"
BEFORE, INSIDE, AFTER = 24, 40, 16
STEP = 10
WIDTH = BEFORE + INSIDE + AFTER


@dataclass(frozen=True)
class Training:
    examples: int = 9000
    seed: int = 7
    epochs: int = 8
    least_recall: float = 0.99


def window(text: str, start: int, end: int) -> bytes:
    """What the network sees: characters before, the candidate's first and last ones, characters after."""
    inner = text[start:end] if end - start <= INSIDE else text[start : start + INSIDE // 2] + text[end - INSIDE // 2 : end]
    shown = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + inner.ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    return shown.encode("latin-1", "replace")


def views(text: str, start: int, end: int) -> list[bytes]:
    """The candidate's window; of one longer than the network sees at once, also those of all its stretches by steps."""
    last = end - INSIDE
    slid = [*range(start, last, STEP), last] if last > start else []
    return [window(text, start, end), *(window(text, s, s + INSIDE) for s in slid)]


#: Classes of characters: 0 none, 1 other, then digits, letters and signs one by one.
_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-.:\"' \n"
_CODES = np.ones(256, np.int64)
_CODES[0] = 0
for _i, _c in enumerate(_SIGNS):
    _CODES[ord(_c)] = _i + 2
N_CLASSES = len(_SIGNS) + 2


def encode(windows: list[bytes]) -> np.ndarray:
    return _CODES[np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)] if windows else np.zeros((0, WIDTH), np.int64)


def labelled(n: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    """Findings with labels: keys as tools issue them, against names, numbers, paths, dates and long words."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda a=2, b=9: pick(low, a, b)
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 5)))
    names = ["key", "auth", "credential", "private_key", "client_secret", "access", "bearer", "pwd", "signature"]
    out, y = [], []
    for i in range(n):
        if i % 2:
            body = rng.choice([
                lambda: pick(low + up + dig, 20, 44), lambda: pick(low + up + dig + "+/", 28, 60) + "=" * rng.randint(0, 2), lambda: "ghx_" + pick(low + up + dig, 30, 36),
                lambda: "sk-" + pick(low + up + dig, 24, 40), lambda: pick("0123456789abcdef", 20, 64), lambda: pick(up + dig, 18, 24), lambda: pick("0123456789ABCDEF", 32, 48),
                lambda: pick(low + up, 24, 40), lambda: "AKIA" + pick(up + dig, 16, 16), lambda: word(3, 8) + "/" + pick(low + up + dig, 32, 44) + "/" + word(3, 8),
            ])()
            lead = rng.choice([lambda: f'{rng.choice(names)} = "', lambda: f"{rng.choice(names)}: ", lambda: f"{rng.choice(names)} ", lambda: ""])()
        else:
            body = rng.choice([
                lambda: "-".join(word(3, 8) for _ in range(4)) + pick(dig, 1, 2), lambda: "/".join(word(3, 8) for _ in range(4)) + "/" + pick(dig, 1, 4), lambda: f"{word(3, 8)}_{word(3, 8)}_{word(3, 8)}_{pick(dig, 1, 3)}",
                lambda: word(9, 20) + pick(dig, 1, 2) + word(6, 12)[:1], lambda: f"20{pick(dig, 2, 2)}-{pick(dig, 2, 2)}-{pick(dig, 2, 2)}T{pick(dig, 2, 2)}-{pick(dig, 2, 2)}-{pick(dig, 2, 2)}Z",
                lambda: f"{word(8, 12)}-{word(8, 12)}-{pick(dig, 2, 4)}", lambda: word(10, 16).upper() + "-" + pick(dig, 4, 6), lambda: "A" + pick(dig, 16, 20), lambda: "=" * rng.randint(14, 30) + word(2, 3) + pick(dig, 1, 1),
                lambda: word(16, 24), lambda: word(8, 12) + word(8, 14), lambda: pick(dig, 16, 24), lambda: rng.choice("=-_/+") * rng.randint(16, 60), lambda: "-".join(word(3, 9) for _ in range(4)), lambda: word(16, 20).capitalize(), lambda: word(16, 22).upper(),
                lambda: "_".join(word(3, 8).upper() for _ in range(4)), lambda: word(3, 7) + "".join(word(3, 8).capitalize() for _ in range(3)), lambda: "/".join(word(3, 8) for _ in range(rng.randint(3, 9))),
            ])()
            lead = rng.choice([lambda: "", lambda: "see ", lambda: f"{word()}: ", lambda: "www."])()
        head, tail = f"{prose()} {lead}", rng.choice(['" ', " ", ". ", "\n"]) + prose()
        text = head + body + tail
        out.append(window(text, len(head), len(head) + len(body)))
        y.append(i % 2)
    return out, np.array(y, np.float32)


class Net:
    """Embedding, one convolution, maxima over places, logistic output."""

    DIM, FILTERS, SPAN = 8, 24, 5

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (N_CLASSES, self.DIM)), "w": rng.normal(0, 0.15, (self.SPAN * self.DIM, self.FILTERS)), "b": np.zeros(self.FILTERS), "v": rng.normal(0, 0.2, self.FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        places = WIDTH - self.SPAN + 1
        spans = self.p["e"][x[:, np.arange(places)[:, None] + np.arange(self.SPAN)]].reshape(len(x) * places, -1)
        act = (spans @ self.p["w"] + self.p["b"]).reshape(len(x), places, self.FILTERS)
        best = act.argmax(1)
        top = np.maximum(np.take_along_axis(act, best[:, None], 1)[:, 0], 0)
        return spans.reshape(len(x), places, -1), best, top, top @ self.p["v"] + self.p["c"][0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> None:
        rng, m, s, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                xb, yb = x[(rows := order[at : at + 128])], y[rows]
                spans, best, top, z = self._forward(xb)
                dz = (1 / (1 + np.exp(-z)) - yb) / len(xb)
                dtop = dz[:, None] * self.p["v"] * (top > 0)
                picked = np.take_along_axis(spans, best[:, :, None], 1)  # rows, filters, inputs
                dspan = dtop[:, :, None] * self.p["w"].T
                codes = xb[np.arange(len(xb))[:, None, None], best[:, :, None] + np.arange(self.SPAN)]
                de = np.zeros_like(self.p["e"])
                np.add.at(de, codes.ravel(), dspan.reshape(-1, self.DIM))
                grads = {"e": de, "w": np.einsum("nfi,nf->if", picked, dtop), "b": dtop.sum(0), "v": top.T @ dz, "c": np.array([dz.sum()])}
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, least_recall: float) -> None:
        """A logistic of the raw score fitted by Newton steps; then the highest threshold of enough recall."""
        z = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        self.scale, self.shift = float(a), float(b)
        found = np.sort(self.score(x)[y == 1])
        # as many as may be missed lie below it, less two standard errors of their number
        missed = (1 - least_recall) * len(found) - 2 * np.sqrt(least_recall * (1 - least_recall) * len(found))
        self.threshold = float(found[max(int(missed), 0)]) - 1e-9

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -60, 60)))


@lru_cache(maxsize=4)
def train(training: Training = Training()) -> Net:
    windows, y = labelled(training.examples, training.seed)
    x = encode(windows)
    cut = len(x) * 3 // 4
    net = Net(training.seed)
    net.fit(x[:cut], y[:cut], training.epochs, training.seed)
    net.calibrate(x[cut:], y[cut:], training.least_recall)
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the rules find."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(texts: list[str | None], net: Net) -> list[list[tuple[int, int, int]]]:
    """All spans of each text; the network scores every candidate, all of a batch at once."""
    spans, asked, begins, windows = [], [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        spans.append(base_spans(text))
        for m in CANDIDATE.finditer(text):
            asked.append((i, m.start(), m.end()))
            begins.append(len(windows))
            windows += views(text, m.start(), m.end())
    if asked:
        scores = np.concatenate([net.score(encode(windows[at : at + 4096])) for at in range(0, len(windows), 4096)])
        for (i, s, e), p in zip(asked, np.maximum.reduceat(scores, begins), strict=True):
            if p >= net.threshold:
                spans[i].append((s, 3, e))
    return [sorted(x) for x in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """Counts and spans for each row of docs(doc_id, text). Narrow: no shuffle; the weights travel with the tasks."""
    net = train(training)

    def fn(piece):
        found = scan(piece["text"], net)
        count = lambda k: [sum(x[1] == k for x in spans) for spans in found]
        digest = [hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
        return {"doc_id": piece["doc_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_net": count(3), "base_sha256": digest, "spans": [joined(x) for x in found]}

    return map_texts(docs, fn, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each maximal run of covered characters replaced by one mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """docs with its columns; secrets in text are replaced, n_chars follows where there is such a column."""
    import pyarrow as pa

    net = train(training)

    def run(rows):
        for batch in rows:
            texts, clean = batch.column("text").to_pylist(), []
            for piece in batches([batch.select(["text"])]):
                clean += [t if t is None or not spans else redact(t, spans) for t, spans in zip(piece["text"], scan(piece["text"], net), strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(clean, batch.schema.field("text").type)
            if "n_chars" in columns:
                counts = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, clean, strict=True)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return bounded(docs).mapInArrow(run, docs.schema)
