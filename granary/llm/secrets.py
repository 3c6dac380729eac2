"""Secret scans: fixed patterns, and a character convolutional network over other candidates.

The patterns' findings always count. A network in numpy looks at every further
candidate, a long run of token characters, together with the text around it. It
is trained on labelled findings: a bounded sample of the documents gives what the
patterns find (secret) and what else is a candidate there (not secret), and
examples of other kinds of tokens and of look-alikes are set into that sample's
contexts. Probabilities are calibrated on examples kept out of the training, and
the threshold is the highest that still has the wanted recall on them.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, map_batches

# The patterns, the group whose length counts, and the least length.
PATTERNS = {
    "assign": (
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
        ),
        2, 6,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = (*PATTERNS, "model")

#: Documents whose findings and candidates train the network, at most about so many.
TRAINING_DOCUMENTS = 2_000
EXAMPLES = 2_400
RECALL = 0.95

CONTEXT, PIECE = 24, 128
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_RUN_BYTES = bytes(b if chr(b) in string.ascii_letters + string.digits + "+/_.=-" else 32 for b in range(256))
_ALNUM = re.compile(rb"[0-9]")


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of what the patterns find, in order.

    A cheap look at the bytes first rules out most texts for each pattern.
    """
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(LOWER)
    out = []
    for at, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        if kind == "assign" and not any(k in low for k in KEYWORDS):
            continue
        if kind == "access" and b"AKIA" not in raw:
            continue
        if kind == "hex" and not any(len(w) >= least for w in raw.translate(_RUN_BYTES).split()):
            continue
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), at, m.end(), m.start(group)))
    return sorted(out)


def candidates(text: str, found: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of 16 or more token characters with letters and a digit, outside findings."""
    words = text.encode("utf-8", "surrogatepass").translate(_RUN_BYTES).split()
    if not any(len(w) >= 16 and _ALNUM.search(w) for w in words):
        return []
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".-":
            end -= 1
        word = text[start:end]
        if end - start < 16 or not any(c.isdigit() for c in word) or not any(c.isalpha() for c in word):
            continue
        if all(end <= s or start >= e for s, _, e, _ in found):
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """A candidate with its surroundings; a very long one in pieces."""
    return [
        (text[max(0, a - CONTEXT) : min(end, a + PIECE) + CONTEXT], a - max(0, a - CONTEXT), min(end, a + PIECE) - max(0, a - CONTEXT))
        for a in range(start, end, PIECE)
    ]


def _encoded(windows: Sequence[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes, 1 inside the candidate, 1 where there is text; padded."""
    size = max(len(w) for w, _, _ in windows) + 4
    codes = np.zeros((len(windows), size), np.int64)
    inside = np.zeros((len(windows), size), np.float32)
    there = np.zeros((len(windows), size), np.float32)
    for i, (w, a, b) in enumerate(windows):
        codes[i, 2 : 2 + len(w)] = [ord(c) if ord(c) < 128 else 128 + c.isalpha() for c in w]
        inside[i, 2 + a : 2 + b] = 1
        there[i, 2 : 2 + len(w)] = 1
    return codes, inside, there


@dataclass
class Network:
    """Embedding, one convolution of width 5, pooling inside and outside, two layers."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def start(seed: int, embedded: int = 12, filters: int = 24, hidden: int = 16) -> Network:
        r = np.random.default_rng(seed)
        norm = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Network(
            {
                "table": r.standard_normal((130, embedded)).astype(np.float32) * 0.5,
                "kernel": norm(5 * (embedded + 1), filters), "kernel_b": np.zeros(filters, np.float32),
                "dense": norm(3 * filters, hidden), "dense_b": np.zeros(hidden, np.float32),
                "out": norm(hidden, 1), "out_b": np.zeros(1, np.float32),
            }
        )

    def forward(self, codes, inside, there):
        w = self.weights
        x = np.concatenate([w["table"][codes] * there[..., None], inside[..., None]], axis=2)
        n, size, channels = x.shape
        stacked = np.concatenate([x[:, k : size - 4 + k] for k in range(5)], axis=2)
        conv = np.maximum(stacked @ w["kernel"] + w["kernel_b"], 0)
        mid_in, mid_there = inside[:, 2:-2, None], there[:, 2:-2, None]
        count = np.maximum(mid_in.sum(axis=1), 1)
        most, around = conv * mid_in, conv * (mid_there - mid_in)
        pooled = np.concatenate([most.max(axis=1), most.sum(axis=1) / count, around.max(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        logit = (hidden @ w["out"] + w["out_b"])[:, 0]
        return logit, (x, stacked, conv, most, around, mid_in, mid_there, count, pooled, hidden)

    def gradients(self, data, labels) -> dict[str, np.ndarray]:
        codes, inside, there = data
        w = self.weights
        logit, (x, stacked, conv, most, around, mid_in, mid_there, count, pooled, hidden) = self.forward(*data)
        n, f = len(labels), conv.shape[2]
        d = ((1 / (1 + np.exp(-logit)) - labels) / n)[:, None].astype(np.float32)
        g = {"out": hidden.T @ d, "out_b": d.sum(axis=0)}
        d_hidden = (d @ w["out"].T) * (hidden > 0)
        g |= {"dense": pooled.T @ d_hidden, "dense_b": d_hidden.sum(axis=0)}
        d_pool = d_hidden @ w["dense"].T
        d_conv = np.broadcast_to((d_pool[:, f : 2 * f] / count)[:, None] * mid_in, conv.shape).copy()
        rows, columns = np.arange(n)[:, None], np.arange(f)[None]
        for part, mask, grad in ((most, mid_in, d_pool[:, :f]), (around, mid_there - mid_in, d_pool[:, 2 * f :])):
            at = part.argmax(axis=1)
            d_conv[rows, at, columns] += grad * mask[rows, at, 0]
        d_conv *= conv > 0
        flat = d_conv.reshape(-1, f)
        g |= {"kernel": stacked.reshape(-1, stacked.shape[2]).T @ flat, "kernel_b": flat.sum(axis=0)}
        d_stack = d_conv @ w["kernel"].T
        d_x, channels = np.zeros_like(x), x.shape[2]
        for k in range(5):
            d_x[:, k : x.shape[1] - 4 + k] += d_stack[:, :, k * channels : (k + 1) * channels]
        table = np.zeros_like(w["table"])
        np.add.at(table, codes, d_x[:, :, :-1] * there[..., None])
        return g | {"table": table}

    def probability(self, windows: Sequence[tuple[str, int, int]]) -> np.ndarray:
        out = [
            self.forward(*_encoded(windows[i : i + 256]))[0] for i in range(0, len(windows), 256)
        ]
        logit = np.concatenate(out) if out else np.empty(0)
        return 1 / (1 + np.exp(-(self.slope * logit + self.shift)))


def fit(examples: Sequence[tuple[tuple[str, int, int], int]], recall: float = RECALL, seed: int = 11, epochs: int = 8) -> Network:
    """Train, calibrate and set the threshold; every third example is kept out for the latter two."""
    order = list(range(len(examples)))
    random.Random(seed).shuffle(order)
    held, used = order[::3], [i for k, i in enumerate(order) if k % 3]
    net, r = Network.start(seed), random.Random(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for _ in range(epochs):
        r.shuffle(used)
        for i in range(0, len(used), 64):
            batch = [examples[j] for j in used[i : i + 64]]
            g = net.gradients(_encoded([w for w, _ in batch]), np.array([y for _, y in batch], np.float32))
            step += 1
            for k, v in g.items():  # Adam
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.weights[k] -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    labels = np.array([examples[i][1] for i in held], float)
    raw = net.probability([examples[i][0] for i in held])
    logit = np.log(np.clip(raw, 1e-9, 1 - 1e-9) / np.clip(1 - raw, 1e-9, 1))
    net.slope, net.shift = _calibrated(logit, labels)
    p = 1 / (1 + np.exp(-(net.slope * logit + net.shift)))
    positive = np.sort(p[labels == 1])
    net.threshold = float(positive[int((1 - recall) * len(positive))])
    return net


def _calibrated(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one number, by Newton steps."""
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - labels) + 1e-3 * (beta - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hess, grad)
    return float(beta[0]), float(beta[1])


def _made(r: random.Random) -> tuple[str, str, int]:
    """A made finding: what stands before it, the candidate, and whether it is a secret."""
    chars = lambda pool, n: "".join(r.choice(pool) for _ in range(n))
    alnum, lower, digits, upper = string.ascii_letters + string.digits, string.ascii_lowercase, string.digits, string.ascii_uppercase
    word = lambda: chars(lower, r.randint(3, 9))
    raw = bytes(r.randrange(256) for _ in range(r.randint(18, 48)))
    secret = [
        ("", lambda: r.choice(["ghp_", "gho_", "npm_", "glpat-", "sk-", "pk_live_", "sk_live_", "rk_test_"]) + chars(alnum, r.randint(20, 40))),
        ("", lambda: r.choice(["xoxb-", "xoxp-"]) + chars(digits, 11) + "-" + chars(alnum, 24)),
        ("", lambda: "AIza" + chars(alnum + "_-", 35)),
        (r.choice(["Authorization: Bearer ", "auth=", "credential: "]), lambda: ".".join(["eyJ" + chars(alnum, 17), "eyJ" + chars(alnum, 40), chars(alnum + "_-", 43)])),
        (r.choice(["key ", "private_key: ", "client_id=", "pwd: ", "auth ", ""]), lambda: base64.b64encode(raw).decode()),
        (r.choice(["pass ", "pw=", "key is ", "access "]), lambda: chars(alnum, r.randint(18, 40))),
    ]
    benign = [
        (r.choice(["IBAN ", "iban: ", "", "account "]), lambda: chars(upper, 2) + chars(digits, r.randint(14, 26))),
        ("", lambda: chars(upper, 2) + chars(digits, 2) + chars(upper + digits, r.randint(12, 20)) if r.random() < 0.5 else chars(digits, 2) + word() + chars(digits, 12)),
        (r.choice(["id ", "uuid ", ""]), lambda: "-".join(chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))),
        (r.choice(["see ", "at ", ""]), lambda: f"www.{word()}{r.randint(1, 99)}.example.com"),
        ("", lambda: "/".join([word(), word(), str(r.randint(1, 2030)), word()]) + r.choice([".html", ".txt", "-1", ".py2"])),
        ("", lambda: "-".join([word(), word(), word(), str(r.randint(1, 40))])),
        ("", lambda: "_".join([word(), word(), "v" + str(r.randint(1, 9)), word()])),
        ("", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.00.00Z"),
        ("", lambda: word() + word() + word() + str(r.randint(1, 99))),
        ("mail ", lambda: f"{word()}.{r.randint(1, 99)}.mail{r.randint(1, 9)}.example.org"),
    ]
    label = int(r.random() < 0.5)
    before, make = r.choice(secret if label else benign)
    return before, make(), label


def labelled_findings(texts: Sequence[str], seed: int = 7, most: int = EXAMPLES) -> list[tuple[tuple[str, int, int], int]]:
    """Windows with labels, from a sample of texts and from made findings set into them."""
    r = random.Random(seed)
    out, contexts = [], []
    for text in texts:
        found = base_findings(text)
        out += [(window(text, v, e)[0], 1) for _, _, e, v in found[:4] if e - v >= 16]
        out += [(window(text, a, b)[0], 0) for a, b in candidates(text, found)[:4]]
        if not found and text:
            at = r.randrange(len(text))
            cut = text.find(" ", at)
            contexts.append(text[max(0, cut - 40) : cut + 40] if cut >= 0 else "")
    r.shuffle(out)
    out = out[: most // 2]
    contexts = contexts or ["", "some words around it and more"]
    while len(out) < most:
        before, word, label = _made(r)
        context = r.choice(contexts) if r.random() < 0.5 else " ".join(
            "".join(r.choice(string.ascii_letters) for _ in range(r.randint(1, 9))) for _ in range(12)
        )
        cut = context.find(" ", len(context) // 2) + 1
        quote = r.choice(["", "", '"', "'"])
        head = context[:cut] + before + quote
        out.append((window(head + word + quote + " " + context[cut:], len(head), len(head) + len(word))[0], label))
    return out


def trained(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> Network:
    """A network fitted on about `documents` of the given documents, drawn by a hash.

    The only bound on data here; scanning looks at every text.
    """
    rows = docs.where("text is not null").select("doc_id", "text")
    share = max(1, docs.count() // documents)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(4 * documents)
    texts = [t for _, t in sorted((str(r.doc_id), r.text) for r in drawn.toLocalIterator())]
    return fit(labelled_findings(texts))


def all_findings(text: str, net: Network) -> list[tuple[int, int, int, int]]:
    return scanned([text], net)[0]


def scanned(texts: Sequence[str], net: Network) -> list[list[tuple[int, int, int, int]]]:
    """(start, kind, end, start of the value) of all findings of each text, in order."""
    found = [base_findings(t) for t in texts]
    spots = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, found[i])]
    pieces = [(k, w) for k, (i, a, b) in enumerate(spots) for w in window(texts[i], a, b)]
    likely = np.zeros(len(spots))
    if pieces:
        np.maximum.at(likely, [k for k, _ in pieces], net.probability([w for _, w in pieces]))
    for (i, a, b), p in zip(spots, likely):
        if p >= net.threshold:
            found[i].append((a, len(KINDS) - 1, b, a))
    return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id and its findings.

    `findings` is an array of (kind, start, end, value_start), by start, then kind
    in the order assign, access, hex, model; code points, ends exclusive. A
    pattern's span is its whole match. Null and empty texts have none. Repeated
    rows each get theirs, a null doc_id stays null, other columns are not looked
    at. Every whole text is scanned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    finding = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "value_start": v} for a, k, b, v in f]
                for f in scanned(texts, model)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(finding))], ["doc_id", "findings"]
            )

    schema = "doc_id long, findings array<struct<kind: string, start: long, end: long, value_start: long>>"
    return map_batches(docs.select("doc_id", "text"), scan, schema)


MASK = "[secret removed]"


def redacted(text: str, found: Sequence[tuple[int, int, int, int]]) -> str:
    """The text with every found value replaced by MASK; overlapping ones by one."""
    spans: list[list[int]] = []
    for start, end in sorted((v, e) for _, _, e, v in found):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    for start, end in reversed(spans):
        text = text[:start] + MASK + text[end:]
    return text


def redact_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """All rows and columns, with secrets masked in `text` and n_chars brought up to date where it changed."""
    shared, names = docs.sparkSession.sparkContext.broadcast(net), docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scanned([t or "" for t in texts], model)
            new = [redacted(t, f) if f else t for t, f in zip(texts, found)]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                old = batch.column("n_chars")
                counts = [len(t) if f else n for t, f, n in zip(new, found, old.to_pylist())]
                columns[names.index("n_chars")] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, mask, docs.schema)
