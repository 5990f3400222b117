"""Personal data: patterns, and a skip-chain conditional random field for what they miss.

Base spans come from four fixed patterns with checks. On top, a conditional random field labels the
candidates of a document (base spans, and other tokens with a digit or "@", numeric neighbours taken
together) as one of the kinds or as none. Neighbouring candidates are linked in a chain. Skip links
go over any distance: candidates with equal text share one variable, hence their potentials (the mean
of their occurrences') and their label; variables that are similar (equal digits, the same last seven
digits, the same name before "@") are each linked to a variable of what they have in common, so a
label is two links from any other of its kind however many repeats there are. A common variable is
observed if base spans that have it agree. Loopy sum-product messages go over all links until they
stand still; base spans are observed. So a number that a pattern shows as a phone once is one
wherever the document repeats it in another form. Added spans never overlap base ones.

The weights are learned on the driver, by pseudo-likelihood on documents that this module makes up
with a fixed seed: they don't depend on the corpus. Whole documents are labelled at once; features
and messages are worked out in blocks, so a document needs a few hundred bytes for each candidate.

Defined cases: a null or empty text has no spans; a null doc_id and repeated rows stay as they are;
digits are ASCII digits, other Unicode digits are letters of a token like any others.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

KINDS = ("email", "ip", "card", "phone")
NONE, LABELS = 0, len(KINDS) + 1
#: Messages go round until they stand still, for at most so many rounds and one more for each variable.
ROUNDS, DAMPING, CHAIN_GAP = 200, 0.5, 60
#: Candidates whose features, and links whose messages, are worked out together.
BLOCK = 1 << 14

_ANY = re.compile(r"[0-9@]")
# one "@" lies in each address, so the search starts there; digits that a run has before a match's
# start can't be skipped over, so a look-behind keeps long runs linear
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TOKEN = re.compile(r"\S+")
_NUMERIC = re.compile(r"[0-9()+./,-]+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def _octet(part: str) -> bool:
    """Whether ASCII digits, zeros in front included, are at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out, last = [], 0
    for m in _AFTER_AT.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- candidates, features and edges -------------------------------------------------------------------

_CUES = (
    frozenset("email e-mail mail contact write".split()),
    frozenset("ip host server address ping".split()),
    frozenset("card visa credit account pay".split()),
    frozenset("phone tel call mobile fax".split()),
)
_SIZES = (0, 3, 6, 9, 11, 13, 19)
FEATURES = 1 + len(_SIZES) + 1 + 10 + len(_CUES)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,;:!?\"'>]}":
        end -= 1
    while end > start and text[start] in "\"'<[{.,;:":
        start += 1
    inner = text[start:end]
    if inner.endswith(")") and "(" not in inner:
        end -= 1
    if inner.startswith("(") and ")" not in inner:
        start += 1
    return start, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, observed label or NONE) by start: base spans, and tokens clear of them."""
    out = [(s, e, k + 1) for s, k, e in base]
    spans = sorted((s, e) for s, _, e in base)
    at, run = 0, None
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while at < len(spans) and spans[at][1] <= s:
            at += 1
        clear = at >= len(spans) or spans[at][0] >= e
        if not clear or not _ANY.search(m.group()):
            run = None
            continue
        numeric = _NUMERIC.fullmatch(m.group()) is not None
        if numeric and run is not None and out[run][1] >= s - 2 and text[out[run][1]:s] == " " and e - out[run][0] <= 40:
            out[run] = (out[run][0], e, NONE)
        else:
            out.append((s, e, NONE))
            run = len(out) - 1 if numeric else None
        if text[e - 1] in ",;":
            run = None
    out = [(*_trimmed(text, s, e), k) if k == NONE else (s, e, k) for s, e, k in out]
    return sorted(x for x in set(out) if x[1] > x[0])


def features(text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    x = np.zeros((len(nodes), FEATURES))
    for row, (s, e, _) in zip(x, nodes):
        body = text[s:e]
        digits = _NOT_DIGIT.sub("", body)
        row[0] = 1
        row[1 + sum(len(digits) > b for b in _SIZES)] = 1
        k = 2 + len(_SIZES)
        row[k:k + 10] = (
            "@" in body, any(c.isalpha() for c in body), body.count(".") == 3, body.startswith("+"), "(" in body, "-" in body,
            body.isdigit(), 14 <= len(digits) <= 19 and luhn(digits),
            _QUAD.fullmatch(body) is not None and all(_octet(p) for p in body.split(".")), "/" in body or ":" in body)
        before = text[max(0, s - 24):s].lower().split()
        for c, cue in enumerate(_CUES):
            row[k + 10 + c] = any(w.strip(".,:;()") in cue for w in before[-2:])
    return x


def keys(body: str) -> list[str]:
    """What repeats are known by."""
    out = []
    if "@" in body:
        out.append("@" + body.split("@")[0].lower())
    digits = _NOT_DIGIT.sub("", body)
    if len(digits) >= 7:
        out.append(digits)
        out.append("~" + digits[-7:])
    return out


class Graph:
    """The field of a document. variable: of each candidate. observed: of each variable, NONE if hidden;
    the first `shown` variables are of candidates, the others of what similar ones have in common.
    chain and skip: links as pairs of variables, with the chain's weights: a link of occurrences counts
    as one part of the more frequent side's, as a variable's potentials are the mean of its occurrences'."""

    def __init__(self, text: str, nodes: list[tuple[int, int, int]]):
        known: dict[tuple[str, int], int] = {}
        common: dict[str, list[int]] = {}
        self.variable = np.empty(len(nodes), np.int64)
        observed: list[int] = []
        for k, (s, e, label) in enumerate(nodes):
            body = text[s:e]
            v = known.setdefault((body, label), len(known))
            self.variable[k] = v
            if v == len(observed):
                observed.append(label)
                for key in keys(body):
                    common.setdefault(key, []).append(v)
        self.shown, skip = len(observed), []
        for members in common.values():
            if len(members) > 1:
                seen = {observed[v] for v in members} - {NONE}
                skip += [(v, len(observed)) for v in members]
                observed.append(seen.pop() if len(seen) == 1 else NONE)
        self.observed = np.array(observed, np.int64)
        self.count = np.bincount(self.variable, minlength=self.shown)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        begin, end = (np.array([n[k] for n in nodes]) for k in (0, 1))
        near = np.flatnonzero(begin[1:] - end[:-1] <= CHAIN_GAP) if len(nodes) else np.zeros(0, int)
        pairs = np.stack([self.variable[near], self.variable[near + 1]], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        self.chain, times = np.unique(pairs, axis=0, return_counts=True)
        self.weight = times / self.count[self.chain].max(1) if len(self.chain) else np.zeros(0)


# --- the field ----------------------------------------------------------------------------------------

class Weights:
    def __init__(self):
        self.unary = np.zeros((FEATURES, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = np.zeros((LABELS, LABELS))


def marginals(score: np.ndarray, observed: np.ndarray, chain: np.ndarray, weight: np.ndarray, skip: np.ndarray, w: Weights) -> np.ndarray:
    """Label probabilities of each variable by loopy sum-product message passing."""
    score = score.copy()
    seen = np.flatnonzero(observed != NONE)
    score[seen] = -1e6  # more than the messages of any number of repeats
    score[seen, observed[seen]] = 0.0
    pairs = np.concatenate([chain, skip]).astype(np.int64)
    if len(pairs):
        n = len(pairs)
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        share = np.concatenate([weight, np.ones(len(skip))])
        tables = np.stack([w.chain, w.skip, w.chain.T, w.skip.T])
        which = np.repeat([0, 1, 2, 3], [len(chain), len(skip)] * 2)
        message = np.zeros((2 * n, LABELS))
        for _ in range(ROUNDS + len(score)):
            belief = score.copy()
            np.add.at(belief, dst, message)
            change, new = 0.0, np.empty_like(message)
            for lo in range(0, 2 * n, BLOCK):
                at = np.arange(lo, min(lo + BLOCK, 2 * n))
                into = (belief[src[at]] - message[(at + n) % (2 * n)])[:, :, None] + tables[which[at]] * share[at % n][:, None, None]
                top = into.max(1)
                out = top + np.log(np.exp(into - top[:, None, :]).sum(1))
                out -= out.max(1, keepdims=True)
                change = max(change, float(np.abs(out - message[at]).max()))
                new[at] = DAMPING * message[at] + (1 - DAMPING) * out
            message = new
            if change < 1e-3:
                break
        np.add.at(score, dst, message)
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _scores(text: str, nodes: list[tuple[int, int, int]], graph: Graph, w: Weights) -> np.ndarray:
    """The unary potentials of each variable: the mean of its occurrences', none for common variables."""
    out = np.zeros((len(graph.observed), LABELS))
    for lo in range(0, len(nodes), BLOCK):
        np.add.at(out, graph.variable[lo: lo + BLOCK], features(text, nodes[lo: lo + BLOCK]) @ w.unary)
    out[: graph.shown] /= graph.count[:, None]
    return out


def find(text: str | None, w: Weights | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text, each (start, kind, end), sorted."""
    if not text or not _ANY.search(text):
        return [], []
    w = w or weights()
    base = base_spans(text)
    nodes = candidates(text, base)
    if all(k != NONE for _, _, k in nodes):
        return base, base
    graph = Graph(text, nodes)
    best = marginals(_scores(text, nodes, graph, w), graph.observed, graph.chain, graph.weight, graph.skip, w).argmax(1)[graph.variable]
    more = [(s, int(best[k]) - 1, e) for k, (s, e, o) in enumerate(nodes) if o == NONE and best[k] != NONE]
    return base, sorted(base + more)


# --- learning -----------------------------------------------------------------------------------------

def _made_up(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its true spans (start, end, label), repeats in other forms included."""
    parts: list[tuple[str, int]] = []

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def words(n: int) -> None:
        for _ in range(n):
            parts.append(("".join(rng.choice("aeionrstlhd") for _ in range(rng.randrange(2, 9))), NONE))

    def card() -> str:
        head = "4" + digits(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(4)
        if kind == 0:
            name, host = "".join(rng.choice("abcdefgh") for _ in range(5)) + "." + digits(2), f"mail{digits(1)}.example.com"
            forms = [f"{name}@{host}", f"{name}@mail", f"<{name}@{host}>", f"{name}@localhost"]
        elif kind == 1:
            p = [str(rng.randrange(1, 256)) for _ in range(4)]
            forms = [".".join(p), ".".join(p), "-".join(p)]
            if len("".join(p)) < 8:
                forms.pop()
        elif kind == 2:
            c = card()
            forms = [c, f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}"]
        else:
            a, b, c = digits(3), digits(3), digits(4)
            forms = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{b}-{c}"]
        words(rng.randrange(2, 8))
        if rng.random() < 0.3:
            parts.append((rng.choice(sorted(_CUES[kind])), NONE))
        parts.append((forms[0], kind + 1))
        for _ in range(rng.randrange(0, 4)):
            words(rng.randrange(2, 10))
            parts.append((rng.choice(forms), kind + 1))
    decoys = [
        lambda: str(rng.randrange(1900, 2030)), lambda: digits(rng.randrange(1, 8)), lambda: f"{rng.randrange(1, 99)},{digits(3)}", lambda: f"{digits(1)}.{digits(2)}",
        lambda: f"20{digits(2)}-0{rng.randrange(1, 9)}-1{digits(1)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{rng.randrange(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}",
        lambda: "id" + digits(6), lambda: digits(rng.randrange(8, 24)), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: "@" + "".join(rng.choice("abcdefgh") for _ in range(6)),
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(12, 41))), lambda: f"key=\"{''.join(rng.choice('0123456789abcdef') for _ in range(20))}\"",
    ]
    for _ in range(rng.randrange(0, 8)):
        words(rng.randrange(1, 6))
        made = rng.choice(decoys)()
        for _ in range(rng.choice((1, 1, 2, 3))):  # what isn't personal is repeated too
            parts.append((made, NONE))
            words(rng.randrange(1, 6))
    text, spans = "", []
    for body, label in parts:
        if text:
            text += " "
        if label:
            spans.append((len(text), len(text) + len(body), label))
        text += body
    return text, spans


@lru_cache(maxsize=1)
def weights(texts: int = 600, steps: int = 250) -> Weights:
    """Weights by gradient ascent on the pseudo-likelihood: each label given its neighbours' true ones."""
    rng, xs, ys, chains, shares, skips, n = random.Random(7), [], [], [], [], [], 0
    for _ in range(texts):
        text, spans = _made_up(rng)
        nodes = candidates(text, base_spans(text))
        if not nodes:
            continue
        graph = Graph(text, nodes)
        x = np.zeros((len(graph.observed), FEATURES))
        np.add.at(x, graph.variable, features(text, nodes))
        x[: graph.shown] /= graph.count[:, None]
        truth = np.zeros(len(x), np.int64)
        for v, (s, e, _) in zip(graph.variable, nodes):
            truth[v] = max(truth[v], next((k for a, b, k in spans if s < b and e > a), NONE))
        for v, c in graph.skip:  # what similar ones have in common is of their kind
            truth[c] = max(truth[c], truth[v])
        xs.append(x), ys.append(truth), chains.append(graph.chain + n), shares.append(graph.weight), skips.append(graph.skip + n)
        n += len(x)
    x, y, chain, share, skip = (np.concatenate(parts) for parts in (xs, ys, chains, shares, skips))
    share = share[:, None]
    w, truth = Weights(), np.eye(LABELS)[y]
    moments = [np.zeros_like(p) for p in (w.unary, w.chain, w.skip)]
    for step in range(steps):
        score = x @ w.unary
        np.add.at(score, chain[:, 1], share * w.chain[y[chain[:, 0]]])
        np.add.at(score, chain[:, 0], share * w.chain.T[y[chain[:, 1]]])
        np.add.at(score, skip[:, 1], w.skip[y[skip[:, 0]]])
        np.add.at(score, skip[:, 0], w.skip.T[y[skip[:, 1]]])
        p = np.exp(score - score.max(1, keepdims=True))
        gap = truth - p / p.sum(1, keepdims=True)
        grads = [x.T @ gap - 0.2 * w.unary]
        for pairs, part, table in ((chain, share, w.chain), (skip, 1.0, w.skip)):
            g = -0.2 * table
            np.add.at(g, y[pairs[:, 0]], part * gap[pairs[:, 1]])
            np.add.at(g.T, y[pairs[:, 1]], part * gap[pairs[:, 0]])
            grads.append(g)
        for table, g, m in zip((w.unary, w.chain, w.skip), grads, moments):
            m += g * g
            table += 0.3 * g / np.sqrt(m + 1e-9)
    return w


# --- tables -------------------------------------------------------------------------------------------

def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of all spans by kind, base_sha256, spans, and counts of base spans by kind of each row."""
    prepare(docs.sparkSession)
    w = weights()

    def apply(batches):
        for b in batches:
            counts, base_counts, base_sha, spans = [[] for _ in KINDS], [[] for _ in KINDS], [], []
            for t in b.column("text").to_pylist():
                base, every = find(t, w)
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in every))
                    base_counts[k].append(sum(x[1] == k for x in base))
                base_sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_sha, pa.string()), pa.array(spans, pa.string()), *(pa.array(c, pa.int64()) for c in base_counts)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"base_{k}" for k in KINDS)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, " + ", ".join(f"base_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(apply, schema)


def masked(text: str | None, w: Weights | None = None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    if text is None:
        return None
    out, at, end = [], 0, 0
    for s, k, e in find(text, w)[1]:
        if s >= end:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        end = max(end, e)
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; n_chars, if there, follows; other columns and rows stay."""
    prepare(docs.sparkSession)
    w = weights()

    def apply(batches):
        for b in batches:
            text = [masked(t, w) for t in b.column("text").to_pylist()]
            k = b.schema.names.index("text")
            b = b.set_column(k, b.schema.field(k), pa.array(text, b.schema.field(k).type))
            if "n_chars" in b.schema.names:
                k = b.schema.names.index("n_chars")
                b = b.set_column(k, b.schema.field(k), pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(b.schema.field(k).type))
            yield b

    return docs.mapInArrow(apply, docs.schema)
