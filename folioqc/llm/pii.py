"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns give fixed spans. Mentions that no base span covers (words with an at sign, runs of
digits) and the base spans of a document are the nodes of a random field: neighbours along the
text share chain potentials, and mentions that are the same or similar (equal text, equal digits,
equal last digits, equal local part of an address), however far apart, share skip potentials.
Loopy message passing, until no message changes, makes their labels agree, so a number written
without its prefix is found where the document has it in full. Where several numbers stand side by
side, the node potentials decide which groups of digits are a mention. Weights are learnt by pseudo-likelihood from a bounded sample of
base spans and degraded copies of them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import sample_rows, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The base patterns, in forms that take linear time on any text.
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9])*")
GROUP = re.compile(r"[+(]{0,2}[0-9](?:[().-]{0,2}[0-9])*")

#: Digits that an uncovered run must have to be a mention if no base span has the same ones, digits that a part of a run may have to be
#: one, and the marginal of spans that are kept.
MIN_DIGITS, PART_DIGITS, MIN_MARGINAL = 7, (10, 19), 0.5
#: Bounds of the learning sample, of whole documents: rows and bytes.
MAX_DOCUMENTS, MAX_BYTES = 3000, 24 << 20
#: Message passing ends when no message changes by more, or after so many rounds (loops may not settle).
TOLERANCE, MAX_ROUNDS, DAMPING = 1e-3, 200, 0.3
SKIPS = ("same text", "same digits", "same tail", "same local part")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs: the local part is the run before one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL_CHARS))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four parts of a dotted run are one match."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".") if run.end() - run.start() > 6 else ()
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all base matches, by start, then kind."""
    found: list[Span] = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(a, b, 1) for a, b in ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


@dataclass
class Graph:
    """Mentions of one document in text order; label -1 is open, others are observed."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    kind: np.ndarray


N_FEATURES = 16


def shape(text: str, before: str, after: str) -> np.ndarray:
    """Features of how a mention is written."""
    d = _digits(text)
    f = np.zeros(N_FEATURES, np.float32)
    f[0] = 1
    f[1] = "@" in text
    f[2] = "@" in text and "." in text.rpartition("@")[2]
    f[3] = text.startswith("+")
    f[4] = "(" in text
    f[5] = "-" in text
    f[6] = " " in text
    f[7] = text.count(".") == 3
    n = len(d)
    f[8:13] = (7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 13, 14 <= n <= 16, n > 16)
    f[13] = 14 <= n <= 19 and luhn(d)
    f[14] = before.isalnum()
    f[15] = after.isalnum()
    return f


def keys(text: str) -> list[tuple[int, str]]:
    """What a mention has in common with similar ones, by kind of skip edge."""
    found = [(0, text.lower())]
    d = _digits(text)
    if d and "@" not in text:
        found += [(1, d), (2, d[-7:])] if len(d) >= MIN_DIGITS else [(1, d)]
    if "@" in text:
        found.append((3, text.lower().partition("@")[0]))
    return found


def build(mentions: list[tuple[int, int, str, str, str]], observed: list[int]) -> Graph:
    """Nodes and edges. Of mentions with an equal key each is linked to the one before and to the first
    observed one (or the first of all), so that evidence is one step away however often a mention
    is repeated, and n of them have fewer than 2 n edges of a kind."""
    n = len(mentions)
    features = np.stack([shape(t, b, a) for _, _, t, b, a in mentions]) if n else np.zeros((0, N_FEATURES), np.float32)
    last: dict[tuple[int, str], int] = {}
    sure: dict[tuple[int, str], int] = {}
    for i, m in enumerate(mentions):
        for key in keys(m[2]):
            if key not in sure or observed[i] >= 0 > observed[sure[key]]:
                sure[key] = i
    skip, kind = [], []
    for i, m in enumerate(mentions):
        linked = set()
        for key in keys(m[2]):
            for j in (last.get(key), sure[key]):
                if j is not None and j != i and j not in linked and (j < i or last.get(key) is None):
                    skip.append((min(i, j), max(i, j)))
                    kind.append(key[0])
                    linked.add(j)
            last[key] = i
    chain = np.stack([np.arange(n - 1), np.arange(1, n)], 1) if n > 1 else np.zeros((0, 2), np.int64)
    return Graph([(m[0], m[1]) for m in mentions], features, np.asarray(observed, np.int64), chain, np.asarray(skip, np.int64).reshape(-1, 2), np.asarray(kind, np.int64))


def gaps(a: int, b: int, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What is left of (a, b) outside of disjoint ascending spans."""
    for k in range(bisect.bisect_right(ends, a), len(starts)):
        if starts[k] >= b:
            break
        if starts[k] > a:
            yield a, starts[k]
        a = max(a, ends[k])
    if a < b:
        yield a, b


def number_mentions(text: str, starts: list[int], ends: list[int], field: Field | None, known: frozenset[str] = frozenset()) -> Iterator[tuple[int, int]]:
    """Runs of digits outside of base spans, divided where the field finds mentions in them. What has
    the very digits of a base span (known) is a mention however short it is."""
    for run in RUN.finditer(text):
        if run.end() - run.start() < MIN_DIGITS and not known:
            continue
        for lo, hi in gaps(run.start(), run.end(), starts, ends):
            for part in RUN.finditer(text, lo, hi):
                for c, d, same in repeats(text, part.start(), part.end(), known) if known else [(*part.span(), False)]:
                    if same:
                        yield c, d
                        continue
                    for a, b in divided(text, c, d, field) if field else [(c, d)]:
                        if b - a >= MIN_DIGITS and len(_digits(text[a:b])) >= MIN_DIGITS:
                            yield a, b


def repeats(text: str, a: int, b: int, known: frozenset[str]) -> Iterator[tuple[int, int, bool]]:
    """text[a:b], a run of digit groups, as parts whose digits are known, leftmost first and longest
    of these, and what lies between."""
    groups = [g.span() for g in GROUP.finditer(text, a, b)]
    digits = [_digits(text[x:y]) for x, y in groups]
    most = max(map(len, known))
    k = free = 0
    while k < len(groups):
        said, hit = "", 0
        for j in range(k, len(groups)):
            said += digits[j]
            if len(said) > most:
                break
            if said in known:
                hit = j + 1
        if hit:
            if free < k:
                yield groups[free][0], groups[k - 1][1], False
            yield groups[k][0], groups[hit - 1][1], True
            k = free = hit
        else:
            k += 1
    if free < len(groups):
        yield groups[free][0], groups[-1][1], False


def divided(text: str, a: int, b: int, field: Field) -> list[tuple[int, int]]:
    """text[a:b], a run of digit groups, as parts: those whose node potentials speak for a kind, with
    the greatest sum of their margins over no kind, and what lies between. A base pattern takes
    numbers side by side for one number and drops it."""
    groups = [g.span() for g in GROUP.finditer(text, a, b)]
    if len(groups) < 2:
        return [(a, b)]
    digits = np.cumsum([0, *(len(_digits(text[x:y])) for x, y in groups)])
    best, back = [0.0], [0]
    for k in range(1, len(groups) + 1):
        best.append(best[-1])
        back.append(k)
        for j in range(k - 1, -1, -1):
            n = digits[k] - digits[j]
            if n > PART_DIGITS[1]:
                break
            if n >= PART_DIGITS[0]:
                x, y = groups[j][0], groups[k - 1][1]
                scores = shape(text[x:y], text[x - 1 : x] if x else "", text[y : y + 1]) @ field.node
                gain = best[j] + float(scores[1:].max() - scores[0])
                if gain > best[k]:
                    best[k], back[k] = gain, j
    parts, k, end = [], len(groups), None
    while k:
        j = back[k]
        if j == k:
            end, k = groups[k - 1][1] if end is None else end, k - 1
            start = groups[k][0]
            continue
        if end is not None:
            parts.append((start, end))
            end = None
        parts.append((groups[j][0], groups[k - 1][1]))
        k = j
    if end is not None:
        parts.append((groups[0][0], end))
    return parts[::-1]


def open_mentions(text: str, base: list[Span], field: Field | None = None) -> list[tuple[int, int]]:
    """Mentions that no base span touches."""
    starts, ends = [], []
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found = []
    if "@" in text:
        for m in WORD.finditer(text):
            if "@" in m[0]:
                a = m.start() + len(m[0]) - len(m[0].lstrip("(<[{\"'*#$%&!"))
                b = m.end() - len(m[0]) + len(m[0].rstrip(")>]}\"'*#$%&!.,;:"))
                if b - a > 2 and next(gaps(a, b, starts, ends), None) == (a, b):
                    found.append((a, b))
    found += number_mentions(text, starts, ends, field, frozenset(_digits(text[a:b]) for a, b, k in base if k))
    found.sort()
    out, free = [], 0
    for a, b in found:
        if a >= free:
            out.append((a, b))
            free = b
    return out


def graph_of(text: str, base: list[Span], field: Field) -> Graph | None:
    """None when nothing is open: base spans stay as they are."""
    loose = open_mentions(text, base, field)
    if not loose:
        return None
    nodes = sorted([(a, b, k + 1) for a, b, k in base] + [(a, b, -1) for a, b in loose])
    return build([(a, b, text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]) for a, b, _ in nodes], [y for _, _, y in nodes])


@dataclass
class Field:
    """Potentials: features x labels, chain labels x labels, skip agreement by kind and label."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def skip_table(self, kind: np.ndarray) -> np.ndarray:
        out = np.zeros((len(kind), len(LABELS), len(LABELS)))
        diagonal = np.arange(len(LABELS))
        out[:, diagonal, diagonal] = self.skip[kind]
        return out


def marginals(field: Field, graphs: list[Graph]) -> list[np.ndarray]:
    """Loopy sum-product over all graphs of a batch at once, damped; a graph stops when its messages do."""
    sizes = [len(g.spans) for g in graphs]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    unary = np.concatenate([g.features for g in graphs]) @ field.node
    seen = np.concatenate([g.observed for g in graphs])
    fixed = np.flatnonzero(seen >= 0)
    unary[fixed] = -1e3
    unary[fixed, seen[fixed]] = 0
    chain = np.concatenate([g.chain + o for g, o in zip(graphs, offset)])
    skip = np.concatenate([g.skip + o for g, o in zip(graphs, offset)])
    kind = np.concatenate([g.kind for g in graphs]).astype(int)
    edges = np.concatenate([chain, skip])
    tables = np.concatenate([np.broadcast_to(field.chain, (len(chain), *field.chain.shape)), field.skip_table(kind)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.exp(np.concatenate([tables, tables.transpose(0, 2, 1)]))
    e = len(edges)
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    messages = np.zeros((2 * e, len(LABELS)))
    graph_of_edge = np.searchsorted(offset, target, "right") - 1
    moving = np.arange(2 * e)
    for _ in range(MAX_ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        rest = belief[source[moving]] - messages[back[moving]]
        rest = np.exp(rest - rest.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", rest, tables[moving]) + 1e-300)
        new -= new.max(1, keepdims=True)
        change = np.abs(new - messages[moving]).max(1) > TOLERANCE
        messages[moving] = DAMPING * messages[moving] + (1 - DAMPING) * new
        # Graphs share no messages, so what a batch holds besides changes nothing.
        restless = np.zeros(len(graphs), bool)
        restless[graph_of_edge[moving[change]]] = True
        moving = moving[restless[graph_of_edge[moving]]]
        if not len(moving):
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return [p[a:b] for a, b in zip(offset[:-1], offset[1:])]


def degrade(text: str, kind: int, rng: np.random.Generator) -> str:
    """Another way to write a mention, which its base pattern does not match."""
    if kind == 0:
        local, _, domain = text.partition("@")
        return f"{local}@{domain.split('.')[0]}"
    d = _digits(text)
    if kind == 3:
        short = d[-10:] if len(d) > 10 else d
        return [short, f"({short[:3]}) {short[3:6]}-{short[6:]}", f"{short[:-7]}-{short[-7:-4]}-{short[-4:]}", d][rng.integers(0, 4)]
    if kind == 2:
        return ".".join(d[k : k + 4] for k in range(0, len(d), 4)) if rng.random() < 0.5 else "  ".join(d[k : k + 4] for k in range(0, len(d), 4))
    return "-".join(text.split("."))


def training_graphs(texts: list[str], rng: np.random.Generator) -> list[tuple[Graph, np.ndarray]]:
    """Documents' mentions (those with a base span's digits labelled as it, others none) with degraded
    copies of some base spans (labelled as these), whole cards
    and phones as they are where two numbers were cut apart (labelled as these), degraded spans of
    other documents without support and similar-looking numbers (labelled none)."""
    made, spare = [], [("+1 (555) 010-1234", 3), ("4111111111111111", 2), ("10.20.30.40", 1), ("ab.c@mail.example.com", 0)]
    for text in texts:
        base = base_spans(text)
        loose = open_mentions(text, base)
        nodes = [(a, b, text[a:b], text[a - 1 : a] if a else "", text[b : b + 1], k + 1, k + 1) for a, b, k in base]
        said = {_digits(text[a:b]): k + 1 for a, b, k in base if k}
        nodes += [(a, b, text[a:b], text[a - 1 : a] if a else "", text[b : b + 1], -1, said.get(_digits(text[a:b]), 0)) for a, b in loose]
        for a, b, k in base:
            if rng.random() < 0.6:
                nodes.append((int(rng.integers(0, len(text) + 1)), -1, degrade(text[a:b], k, rng), " ", " ", -1, k + 1))
        whole, k = spare[rng.integers(0, len(spare))]
        if k > 1 and rng.random() < 0.7:
            nodes.append((int(rng.integers(0, len(text) + 1)), -1, whole, " ", " ", -1, k + 1))
        if rng.random() < 0.7:
            other, k = spare[rng.integers(0, len(spare))]
            nodes.append((int(rng.integers(0, len(text) + 1)), -1, degrade(other, k, rng), " ", " ", -1, 0))
        for _ in range(int(rng.integers(1, 5))):
            number = "".join(map(str, rng.integers(0, 10, int(rng.choice((7, 8, 9, 10, 10, 11, 12, 16, 17))))))
            if len(number) >= 14 and luhn(number):
                continue
            nodes.append((int(rng.integers(0, len(text) + 1)), -1, number, " ", " ", -1, 0))
        spare += [(text[a:b], k) for a, b, k in base[:2]]
        nodes.sort(key=lambda n: n[:2])
        if nodes:
            made.append((build([n[:5] for n in nodes], [n[5] for n in nodes]), np.asarray([n[6] for n in nodes])))
    return made


def train(texts: list[str], steps: int = 300, seed: int = 29) -> Field:
    """Pseudo-likelihood: each open mention given its neighbours' labels, by Adam with L2."""
    rng = np.random.default_rng(seed)
    data = training_graphs(texts or ["a@b.example.com +1 (555) 010-1234 10.0.0.1 4111111111111111"] * 50, rng)
    k = len(LABELS)
    offset = np.concatenate([[0], np.cumsum([len(g.spans) for g, _ in data])])
    x = np.concatenate([g.features for g, _ in data]).astype(float)
    y = np.concatenate([t for _, t in data])
    loose = np.concatenate([g.observed for g, _ in data]) < 0
    chain = np.concatenate([g.chain + o for (g, _), o in zip(data, offset)])
    skip = np.concatenate([g.skip + o for (g, _), o in zip(data, offset)])
    kind = np.concatenate([g.kind for g, _ in data]).astype(int)
    left, right = np.zeros((len(y), k)), np.zeros((len(y), k))
    left[chain[:, 1], y[chain[:, 0]]] = 1
    right[chain[:, 0], y[chain[:, 1]]] = 1
    support = np.zeros((len(y), len(SKIPS), k))
    for a, b in (skip.T, skip.T[::-1]):
        np.add.at(support, (a, kind, y[b]), 1)
    field = Field(np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((len(SKIPS), k)))
    target = np.eye(k)[y]
    rows = np.flatnonzero(loose)
    moments = [[np.zeros_like(v) for v in (field.node, field.chain, field.skip)] for _ in range(2)]
    for step in range(1, steps + 1):
        s = x @ field.node + left @ field.chain + right @ field.chain.T + np.einsum("nsk,sk->nk", support, field.skip)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = np.zeros_like(p)
        d[rows] = (p - target)[rows] / max(1, len(rows))
        grads = (x.T @ d + 1e-4 * field.node, left.T @ d + d.T @ right + 1e-4 * field.chain, np.einsum("nsk,nk->sk", support, d) + 1e-4 * field.skip)
        for i, (name, g) in enumerate(zip(("node", "chain", "skip"), grads)):
            moments[0][i] = 0.9 * moments[0][i] + 0.1 * g
            moments[1][i] = 0.999 * moments[1][i] + 0.001 * g * g
            setattr(field, name, getattr(field, name) - 0.1 * (moments[0][i] / (1 - 0.9**step)) / (np.sqrt(moments[1][i] / (1 - 0.999**step)) + 1e-8))
    return field


def learning_sample(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> list[str]:
    rows = docs.where("doc_id is not null and text is not null").where(F.col("text").rlike("@|[0-9]")).select("doc_id", F.col("text").cast("string").alias("text"))
    return [r.text for r in sample_rows(rows, "text", max_documents, max_bytes, "pii")]


def label(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base_spans(t) for t in texts]
    at, graphs = [], []
    for i, (text, base) in enumerate(zip(texts, bases)):
        graph = graph_of(text, base, field) if "@" in text or DIGIT.search(text) else None
        if graph:
            at.append(i)
            graphs.append(graph)
    added: dict[int, list[Span]] = {}
    for i, g, p in zip(at, graphs, marginals(field, graphs) if graphs else ()):
        best = p.argmax(1)
        keep = np.flatnonzero((g.observed < 0) & (best > 0) & (p[np.arange(len(p)), best] >= MIN_MARGINAL))
        if len(keep):
            added[i] = [(*g.spans[k], int(best[k]) - 1) for k in keep]
    return [(base, sorted(base + added[i], key=lambda s: (s[0], s[2])) if i in added else base) for i, base in enumerate(bases)]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (of all kinds),
    n_added (by the field).

    Null texts are empty: no spans, the digest of an empty list. Every text is read whole and on
    its own, so repeated rows agree; null identifiers pass through; no row gives no row. Only doc_id
    and text are read, so other columns may have any names.
    """
    field = train(learning_sample(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = label(field, [t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0)]
            for k in range(len(KINDS)):
                columns.append(pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()))
            columns.append(pa.array([hashlib.sha256(write_spans(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([write_spans(spans) for _, spans in found], pa.string()))
            columns.append(pa.array([len(spans) for _, spans in found], pa.int64()))
            columns.append(pa.array([len(spans) - len(base) for base, spans in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, n_added bigint")
