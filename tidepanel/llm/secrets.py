"""Secrets in texts: fixed patterns, and a character convolutional network for what they miss.

Every run of 16 or more letters of the secret alphabet that holds a digit and no base span is a candidate.  The
network (numpy) reads the candidate and the text around it: character embeddings, one convolution, the maxima and
means of its filters over the candidate, their maxima over the context, a logistic output.  It is trained on
labelled findings: base findings of a bounded sample of documents, keys of public formats generated by rule, and
generated lookalikes.  Other candidates of the sample are nobody's counterexamples unless a first network is sure of
them.  Held-back findings calibrate the output and set the threshold, the highest one that keeps ``RECALL`` of the
secrets among them.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import kept, sampled, texts_of

KINDS = ("assign", "access", "hex", "learned")
# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
#: Characters before, of and after a candidate that the network reads at a time; a longer candidate is read in pieces.
BEFORE, INSIDE, AFTER = 24, 48, 8
#: Documents whose candidates are learnt from, and findings of each label kept of them.
TRAIN_DOCS, TRAIN_FINDINGS = 4000, 1500
RECALL = 0.98
#: Candidates of the corpus below this probability are learnt from as counterexamples.
SURELY_NONE = 0.05
EMBEDDED, FILTERS, WIDTH = 8, 24, 5
EPOCHS, BATCH, RATE = 12, 128, 0.01

_ALPHABET = {c: i + 1 for i, c in enumerate(string.ascii_letters + string.digits + "+/_=-.:\"' \n@()")}
_OTHER = len(_ALPHABET) + 1

Finding = tuple[str, str, str]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order; kinds by number, offsets in code points."""
    spans = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return sorted(spans)


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets and overlap no base span."""
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]):
            while at < len(base) and base[at][2] <= m.start():
                at += 1
            if not any(s < m.end() and e > m.start() for s, _, e in base[at : at + 8]):
                out.append(m.span())
    return out


def context(text: str, start: int, end: int) -> Finding:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]


def encoded(findings: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pieces of all findings, (pieces, BEFORE + INSIDE + AFTER), and the finding of each piece."""
    rows, owners = [], []
    for i, (left, value, right) in enumerate(findings):
        for at in range(0, max(1, len(value)), INSIDE):
            piece = left.rjust(BEFORE, "\0")[-BEFORE:] + value[at : at + INSIDE].ljust(INSIDE, "\0") + right.ljust(AFTER, "\0")[:AFTER]
            rows.append([0 if c == "\0" else _ALPHABET.get(c, _OTHER) for c in piece])
            owners.append(i)
    return np.array(rows, np.int32).reshape(-1, BEFORE + INSIDE + AFTER), np.array(owners)


@dataclass
class Network:
    """Parameters of the network, its calibration (slope, shift) and threshold."""

    weights: dict[str, np.ndarray]
    curve: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, symbols: np.ndarray) -> tuple[np.ndarray, dict]:
        w = self.weights
        x = w["embed"][symbols]
        places = x.shape[1] - WIDTH + 1
        stacked = np.concatenate([x[:, i : i + places] for i in range(WIDTH)], axis=2)
        act = np.maximum(stacked @ w["conv"] + w["bias"], 0)
        inside = act[:, BEFORE : BEFORE + INSIDE - WIDTH + 1]
        filled = (symbols[:, BEFORE : BEFORE + inside.shape[1]] > 0)[:, :, None]
        share = filled / np.maximum(1, filled.sum(axis=1, keepdims=True))
        pooled = np.concatenate([(inside * filled).max(axis=1), (inside * share).sum(axis=1), act[:, : BEFORE - 2].max(axis=1)], axis=1)
        return pooled @ w["out"] + w["shift"], {"x": x, "stacked": stacked, "act": act, "pooled": pooled, "filled": filled, "share": share}

    def backward(self, symbols: np.ndarray, kept_: dict, pull: np.ndarray) -> dict[str, np.ndarray]:
        w, act = self.weights, kept_["act"]
        grads = {"out": kept_["pooled"].T @ pull, "shift": pull.sum()}
        back = pull[:, None] * w["out"][None, :]
        d = np.zeros_like(act)
        n, f = np.arange(len(act))[:, None], np.arange(FILTERS)[None, :]
        inner = act[:, BEFORE : BEFORE + INSIDE - WIDTH + 1]
        top = (inner * kept_["filled"]).argmax(axis=1)
        d[n, BEFORE + top, f] += back[:, :FILTERS]
        d[:, BEFORE : BEFORE + inner.shape[1]] += back[:, None, FILTERS : 2 * FILTERS] * kept_["share"]
        d[n, act[:, : BEFORE - 2].argmax(axis=1), f] += back[:, 2 * FILTERS :]
        d *= act > 0
        grads["conv"] = np.einsum("npi,npf->if", kept_["stacked"], d, optimize=True)
        grads["bias"] = d.sum(axis=(0, 1))
        spread = d @ w["conv"].T
        dx = np.zeros_like(kept_["x"])
        for i in range(WIDTH):
            dx[:, i : i + d.shape[1]] += spread[:, :, i * EMBEDDED : (i + 1) * EMBEDDED]
        grads["embed"] = np.zeros_like(w["embed"])
        np.add.at(grads["embed"], symbols, dx)
        grads["embed"][0] = 0
        return grads

    def probability(self, findings: list[Finding]) -> np.ndarray:
        """Calibrated probability of each finding, that of its most suspicious piece."""
        out = np.full(len(findings), -np.inf)
        for at in range(0, len(findings), 512):
            symbols, owners = encoded(findings[at : at + 512])
            np.maximum.at(out, at + owners, self.forward(symbols)[0])
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * out + shift, -30, 30)))


def generated(n: int, seed: int = 17) -> list[tuple[Finding, int]]:
    """Labelled findings by rule: keys of public formats in plain context (1), and lookalikes (0)."""
    rng = np.random.default_rng(seed)

    def some(alphabet: str, k: int) -> str:
        return "".join(rng.choice(list(alphabet), k))

    alnum, words = string.ascii_letters + string.digits, ["config", "version", "static", "image", "report", "chapter", "module", "index", "release"]
    keys = [
        lambda: "ghp_" + some(alnum, 36),
        lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24),
        lambda: "sk_live_" + some(alnum, 24),
        lambda: "AIza" + some(alnum + "-_", 35),
        lambda: "glpat-" + some(alnum, 20),
        lambda: "eyJ" + some(alnum, 40),
        lambda: some(alnum + "+/", int(rng.integers(24, 48))) + "=",
        lambda: some(string.ascii_uppercase + string.digits, int(rng.integers(24, 40))),
    ]
    plain = [
        lambda: some(string.digits, int(rng.integers(16, 22))),
        lambda: "-".join(rng.choice(words, 3)) + "-" + some(string.digits, 2),
        lambda: "_".join(rng.choice(words, 3)) + some(string.digits, 1),
        lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-" + "-".join(rng.choice(words, 2)),
        lambda: "/".join(rng.choice(words, 3)) + "/" + some(string.digits, 4),
        lambda: "".join(w.title() for w in rng.choice(words, 3)) + some(string.digits, 1),
        lambda: "=" * int(rng.integers(8, 20)) + some(string.digits, 1) + "=" * 8,
    ]
    sides = ["key ", "use ", "the ", ": ", "= \"", "\n", "export X=", "Authorization: Bearer ", "see ", "in ", "https://a.b/"]
    out = []
    for i in range(n):
        label = i % 2
        make = (keys if label else plain)[int(rng.integers(len(keys if label else plain)))]
        out.append(((str(rng.choice(sides)), make(), str(rng.choice([" ", "\n", "\"", ". ", ""]))), label))
    return out


def labelled(documents: DataFrame) -> tuple[list[tuple[Finding, int]], list[Finding]]:
    """Findings of a bounded sample of documents: base findings (1, with and without what stands before them), and other candidates, of which nothing is known."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts_of(batch.column("text")):
                base = base_spans(text)
                for start, kind, end in base:
                    if kind:
                        found.append((*context(text, start, end), 1))
                for start, end in candidate_spans(text, base):
                    found.append((*context(text, start, end), 0))
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], names=["left", "value", "right", "label"])

    ids = kept(sampled(documents.select("doc_id").filter("doc_id is not null"), TRAIN_DOCS), "secret-ids")
    sample = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    rows_ = kept(sample.mapInArrow(rows, "left string, value string, right string, label int"), "findings")
    known, unknown = [], []
    for label in (0, 1):
        for r in rows_.filter(F.col("label") == label).orderBy(F.xxhash64("value", "left"), "value", "left").limit(TRAIN_FINDINGS).collect():
            finding = (r.left, r.value, r.right)
            if label:
                known += [(finding, 1), (("", *finding[1:]), 1)]
            else:
                unknown.append(finding)
    return known, unknown


def fit(findings: list[tuple[Finding, int]], seed: int = 17) -> Network:
    """A network trained by Adam; each fifth finding, by a hash of its value, is held back for calibration."""
    rng = np.random.default_rng(seed)
    net = Network({
        "embed": rng.normal(0, 0.3, (_OTHER + 1, EMBEDDED)).astype(np.float32), "conv": rng.normal(0, 0.2, (WIDTH * EMBEDDED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), "shift": np.zeros((), np.float32),
    })
    net.weights["embed"][0] = 0
    back = np.array([hashlib.md5(f[1].encode()).digest()[0] % 5 == 0 for f, _ in findings])
    labels = np.array([y for _, y in findings], np.float32)
    symbols, owners = encoded([f for f, _ in findings])
    train = np.flatnonzero(~back[owners])
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            logit, mid = net.forward(symbols[rows])
            pull = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[owners[rows]]) * weight[owners[rows]] / len(rows)
            step += 1
            for k, g in net.backward(symbols[rows], mid, pull.astype(np.float32)).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                pace = RATE * (0.5 if epoch > EPOCHS // 2 else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.weights[k] = (net.weights[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    held = [f for (f, _), b in zip(findings, back, strict=True) if b]
    truth = labels[back]
    if truth.sum() and (1 - truth).sum():
        chance = net.probability(held)
        logits = np.log(chance / (1 - chance))
        net.curve = _calibrated(logits, truth)
        right = np.sort(net.probability(held)[truth == 1])
        net.threshold = float(right[int(len(right) * (1 - RECALL))])
    return net


def _calibrated(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift."""
    slope, shift = 1.0, 0.0
    target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / (len(truth) - truth.sum() + 2))
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(slope * logits + shift, -30, 30)))
        slope -= 0.05 * float(np.mean((p - target) * logits)) / max(1.0, float(np.mean(logits**2)) / 10)
        shift -= 0.5 * float(np.mean(p - target))
    return max(slope, 0.05), shift


def train(documents: DataFrame) -> Network:
    """A network of the base findings and of findings made by rule.

    Other candidates of the documents may be keys of formats that nobody labelled.  Only those that a first
    network is sure to be none are counterexamples of the second, so keys in the corpus never teach against themselves.
    """
    known, unknown = labelled(documents)
    known += generated(2000)
    if not unknown:
        return fit(known)
    first = fit(known)
    harmless = [(f, 0) for f, p in zip(unknown, first.probability(unknown), strict=True) if p < SURELY_NONE]
    return fit(known + harmless) if harmless else first


def spans_of(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, (start, kind, end) in order: the base findings and what the network adds."""
    out, asked, places = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        for start, end in candidate_spans(text, base):
            asked.append(context(text, start, end))
            places.append((i, start, end))
    if asked:
        for (i, start, end), p in zip(places, net.probability(asked), strict=True):
            if p >= net.threshold:
                out[i].append((start, 3, end))
    return [sorted(spans) for spans in out]


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FINDINGS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def findings(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    NULL texts are empty.  Repeated rows are rows of their own; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net or train(documents))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            everything = spans_of(texts_of(batch.column("text")), learnt)
            base = [[s for s in spans if s[1] < 3] for spans in everything]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(said(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([said(s) for s in everything], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, _FINDINGS)


def redacted(documents: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret in ``text`` replaced by ``mark`` (overlapping spans by one) and ``n_chars``, if there, counted anew."""
    shared = documents.sparkSession.sparkContext.broadcast(net or train(documents))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = []
            for text, spans in zip(texts, spans_of([t or "" for t in texts], learnt), strict=True):
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                clean.append("".join([*parts, text[at:]]) if spans else text)
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            columns["text"] = pa.array(clean, pa.string())
            if "n_chars" in columns:
                changed = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, clean, strict=True)]
                columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.mapInArrow(rows, documents.schema)
