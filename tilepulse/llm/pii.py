"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their
usual forms; what they find stays. The field adds other forms (an address with "at"
spelt out, a phone number without "+", a card number with dots). It scores *whole
candidate spans* by their features, for each kind, and a dynamic program over
the tokens of a window picks the best way to cut it into spans and single other
tokens: boundaries and kinds at once. Spans are bounded (``MOST_TOKENS``), so the
program is linear in the text. Windows surround digits, "@" signs and a spelt "at"
(in brackets, or with a spelt "dot" after the next word); elsewhere no span can be. What lies within a pattern's match is not looked at again.

No table has labelled spans, so the weights are trained on ``WINDOWS`` windows that
a seeded generator writes: forms of each kind, and numbers that are none. Training
maximises the likelihood of the right cut, by the forward-backward recursion.

Defined results for odd inputs: a null text is an empty one (no spans); repeated
rows each get their row; matches of different kinds may overlap and all are listed
(redaction replaces their union once, named after the first); an empty table gives no
rows; there are no ties among spans, as kind and start order them. Columns other than
the named ones are kept by ``redacted`` and never read. Patterns take time linear in
the text, however long; so does the cut, and what it holds is bounded by the blocks it is
scored in and by runs of overlapping spans above 0, not by the text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import HELD_ROWS, per_row

KINDS = ["email", "ip", "card", "phone"]
# Patterns (fixed values), written so that no text makes them slow: the local part of
# an address is found backwards from its "@".
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

ANCHOR = re.compile(
    r"[0-9@]|[(\[]\s?at\s?[)\]]|\bat\b(?=\s?[\w.-]{1,64}+\s?(?:[(\[]\s?dot\s?[)\]]|\bdot\b))",
    re.IGNORECASE,
)
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)
# Characters around an anchor that a window takes in; tokens and characters of a span.
AROUND, MOST_TOKENS, MOST_CHARS = 48, 20, 64
# Tokens whose candidate spans are scored at once.
BLOCK = 512
# Training: windows, passes over them, step size, weight decay, seed.
WINDOWS, PASSES, RATE, DECAY, SEED = 400, 30, 0.5, 1e-3, 5

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


# --- the field ---------------------------------------------------------------------

AT = re.compile(r"@|[(\[]\s?at\s?[)\]]|\bat\b", re.IGNORECASE)
DOT = re.compile(r"[(\[]\s?(?:dot|\.)\s?[)\]]|\bdot\b|\.", re.IGNORECASE)
ADDRESS = re.compile(
    r"[\w.%+-]+\s?(?:@|[(\[]\s?at\s?[)\]]|\bat\b)\s?[\w-]+"
    r"(?:\s?(?:[(\[]\s?(?:dot|\.)\s?[)\]]|\bdot\b|\.)\s?[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
BARE = re.compile(r"\s?\bat\b\s", re.IGNORECASE)
# Usual last parts of addresses that are no words where "at" is one.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co uk de fr es nl ch eu ca au jp cn br ru pl se dk fi cz pt mx".split()
)
GROUPS = re.compile(r"[0-9]+")
DATE = re.compile(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.](?:19|20)?\d\d")


def features(span: str, left: str, right: str) -> list[float]:
    """Whole-span features; ``left`` and ``right`` are the characters around it (two
    before, one after; fewer at the ends of the text)."""
    groups = GROUPS.findall(span)
    sizes = [len(g) for g in groups]
    digits, letters = sum(sizes), sum(c.isalpha() for c in span)
    between = GROUPS.sub("", span)
    plain = not letters
    small = all(n < 4 and int(g) <= 255 for n, g in zip(sizes, groups))
    address = ADDRESS.fullmatch(span) is not None
    bare = address and "@" not in span and BARE.search(span) is not None
    usual = bare and re.split(r"\W", span)[-1].lower() in ENDINGS
    return [
        1.0,
        address,
        address and "@" in span,
        address and span[-1].isalpha(),
        AT.search(span) is not None and not address,
        bool(letters) and not address,
        plain and len(groups) == 4 and small and len(DOT.findall(span)) == 3,
        plain and len(groups) == 4 and not small,
        plain and 16 <= digits <= 19,
        plain and 16 <= digits <= 19 and luhn("".join(groups)),
        plain and sizes == [4, 4, 4, 4],
        plain and len(groups) == 1,
        plain and 9 <= digits <= 12,
        plain and 13 <= digits <= 15,
        digits < 9,
        digits > 19,
        plain and len(groups) >= 3 and sizes[-1] == 4 and 9 <= digits <= 12,
        plain and len(groups) >= 2 and groups[0].startswith("00"),
        span[0] == "(" and ")" in span,
        span[0] == "+",
        DATE.fullmatch(span) is not None,
        any(c in between for c in ",:$%=*#&|<>\"'"),
        span.count("(") != span.count(")") or span.count("[") != span.count("]"),
        not (span[0].isalnum() or span[0] in "+("),
        not (span[-1].isalnum()),
        left[-1:].isalnum() or left[-1:] in tuple("_@+"),
        left[-1:] in tuple(".-/,") and left[:-1].isdigit(),
        right.isalnum() or right in tuple("_@/"),
        "\n" in span or "  " in span,
        len(groups) > 5,
        usual,
        bare and not usual,
    ]


WIDTH = len(features("1", " ", " "))


def candidates(text: str, edges: list[int], starts: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate spans (i, j) between the edges of tokens, of those that start at one of the
    first ``starts`` tokens, by start and then end, and their features."""
    n = len(edges) - 1
    kinds = [text[edges[i]] for i in range(n)]
    anchors = [c.isdigit() or c in "([" or ANCHOR.match(text, a) for c, a in zip(kinds, edges)]
    rows, spans = [], []
    for i in range(starts):
        if not (kinds[i].isalnum() or kinds[i] in "+(["):
            continue
        anchored = False
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if edges[j] - edges[i] > MOST_CHARS:
                break
            first = kinds[j - 1]
            anchored = anchored or anchors[j - 1]
            if anchored and (first.isalnum() or first in ")]"):
                x, y = edges[i], edges[j]
                rows.append(features(text[x:y], text[max(0, x - 2) : x], text[y : y + 1]))
                spans.append((i, j))
    return spans, np.array(rows, float).reshape(-1, WIDTH)


def best_cut(text: str, start: int, end: int, weights: np.ndarray) -> list[Span]:
    """The best cut of a stretch: its spans as (kind, start, end) in characters. A token on
    its own scores 0; equal scores prefer it, then the longer span.

    So only spans that score above 0 can be in it, and a place that none of them crosses
    parts the stretch. Tokens are scored ``BLOCK`` at a time, and what is kept of them is
    a run of overlapping spans above 0, so memory does not grow with the stretch otherwise."""
    tokens, edges = TOKEN.finditer(text, start, end), [start]
    out, run, reach, whole = [], [], start, False
    while not whole:
        more = [m.end() for m in itertools.islice(tokens, BLOCK)]
        whole = len(more) < BLOCK
        edges += more
        # Starts whose spans all end within the edges in view.
        starts = len(edges) - 1 if whole else max(0, len(edges) - 1 - MOST_TOKENS)
        spans, rows = candidates(text, edges, starts)
        if spans:
            scores = rows @ weights
            top, kind = scores.max(axis=1), scores.argmax(axis=1)
            for s in np.flatnonzero(top > 0):
                a, b = (edges[k] for k in spans[s])
                if a >= reach:
                    out += best_of(run)
                    run = []
                run.append((a, b, int(kind[s]), float(top[s])))
                reach = max(reach, b)
        edges = edges[starts:]
    return out + best_of(run)


def best_of(run: list[tuple[int, int, int, float]]) -> list[Span]:
    """The best choice among spans (start, end, kind, score above 0): a dynamic program over
    the places where one starts or ends."""
    places = sorted({p for a, b, _, _ in run for p in (a, b)})
    at, by_end = {p: i for i, p in enumerate(places)}, {}
    for span in run:
        by_end.setdefault(span[1], []).append(span)
    value, back = [0.0] * len(places), [None] * len(places)
    for i in range(1, len(places)):
        value[i] = value[i - 1]
        for span in by_end.get(places[i], ()):
            score = value[at[span[0]]] + span[3]
            if score > value[i]:
                value[i], back[i] = score, span
    out, i = [], len(places) - 1
    while i > 0:
        if back[i] is None:
            i -= 1
        else:
            a, b, kind, _ = back[i]
            out.append((kind, a, b))
            i = at[a]
    return out[::-1]


class Window:
    """Tokens of a window to train on, and its candidate spans with their features."""

    def __init__(self, text: str, start: int, end: int):
        self.edges = [start, *(m.end() for m in TOKEN.finditer(text, start, end))]
        self.n = len(self.edges) - 1
        self.spans, self.rows = candidates(text, self.edges, self.n)
        self.by_end: list[list[int]] = [[] for _ in range(self.n + 1)]
        for s, (_, j) in enumerate(self.spans):
            self.by_end[j].append(s)

    def gradient(self, weights: np.ndarray, gold: list[Span]) -> np.ndarray:
        """Of the log-likelihood of the gold cut: features seen less those expected."""
        scores = self.rows @ weights
        whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else scores
        alpha, beta = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        alpha[0] = beta[self.n] = 0.0
        for j in range(1, self.n + 1):
            terms = [alpha[j - 1], *(alpha[self.spans[s][0]] + whole[s] for s in self.by_end[j])]
            alpha[j] = np.logaddexp.reduce(terms)
        for j in range(self.n, 0, -1):
            beta[j - 1] = np.logaddexp(beta[j - 1], beta[j])
            for s in self.by_end[j]:
                i = self.spans[s][0]
                beta[i] = np.logaddexp(beta[i], beta[j] + whole[s])
        if not self.spans:
            return np.zeros_like(weights)
        i, j = np.array(self.spans).T
        chance = np.exp(scores + (alpha[i] + beta[j] - alpha[self.n])[:, None])
        at = {(self.edges[a], self.edges[b]): s for s, (a, b) in enumerate(self.spans)}
        for kind, start, end in gold:
            if (start, end) in at:
                chance[at[start, end], kind] -= 1.0
        return -self.rows.T @ chance


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A window of text with the spans in it: a form of some kind, or a number that
    is none, among words."""
    word = lambda: "".join(rng.choices("aeioudlmnrst", k=rng.randint(2, 8)))
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    kind = rng.choice([0, 1, 2, 3, None, None, None, None])
    if kind == 0:
        at = rng.choice([" (at) ", " [at] ", " @ ", "@", "(at)", " at "])
        dot = rng.choice([".", ".", " dot ", " [dot] "][2 * (at == " at ") :])
        name = rng.choice([word(), f"{word()}.{number(2)}", f"{word()}_{word()}"])
        form = f"{name}{at}{word()}{rng.choice(['', number(1)])}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
        form = form.upper() if rng.random() < 0.25 else form
    elif kind == 1:
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        form = rng.choice([".", "[.]", " . ", "(.)"]).join(parts)
    elif kind == 2:
        body = number(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        form = rng.choice([" ", "-", ".", "/", "", " - "]).join(
            body[i : i + 4] for i in range(0, 16, 4)
        )
    elif kind == 3:
        area, local = number(3), (number(3), number(4))
        form = rng.choice(
            [
                f"({area}) {local[0]}-{local[1]}",
                f"{area}-{local[0]}-{local[1]}",
                f"{area}.{local[0]}.{local[1]}",
                f"00{number(2)} {area} {number(7)}",
                f"+{number(1)} ({area}) {local[0]}-{local[1]}",
                f"({area}) {local[0]} {local[1]}",
            ]
        )
    else:
        form = rng.choice(
            [
                f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}",
                f"{number(2)}/{number(2)}/{rng.randint(1900, 2030)}",
                f"{number(2)}:{number(2)}:{number(2)}",
                f"${number(1)},{number(3)}.{number(2)}",
                f"v{number(1)}.{number(1)}.{number(2)}",
                f"{number(1)}.{number(1)}",
                f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}",
                f"{number(2)},{number(3)},{number(3)}",
                number(rng.randint(1, 15)),
                number(16),
                number(rng.randint(20, 30)),
                f'"{"".join(rng.choices("0123456789abcdef", k=40))}"',
                f"{number(3)}-{number(3)}",
                f"{number(4)} {number(4)}",
                f"{number(2)} + {number(1)} = {number(2)}",
                f"{number(3)}.{number(3)}.{number(3)}.{number(4)}",
                f"@{word()}",
                f"{word()} at {word()} {number(2)}",
                f"{word()} at {word()} dot {word()}",
                f"{number(3)} {number(3)} {number(3)} {number(3)} {number(3)} {number(3)}",
                f"{number(1)}.{number(1)}.{number(1)}",
            ]
        )
        if sum(c.isdigit() for c in form) == 16 and luhn(re.sub(r"\D", "", form)):
            form = "0" + form[2:]
    lead = " ".join(word() for _ in range(rng.randint(0, 3)))
    lead += rng.choice([" ", ", ", ": ", "\n", " | "]) if lead else ""
    tail = rng.choice([" ", ". ", ", ", "\n", " | "]) + " ".join(word() for _ in range(rng.randint(0, 3)))
    gold = [] if kind is None else [(kind, len(lead), len(lead) + len(form))]
    return lead + form + tail, gold


@functools.cache
def trained(windows: int = WINDOWS, seed: int = SEED) -> np.ndarray:
    """Weights (feature, kind), by gradient steps scaled per weight."""
    rng = random.Random(seed)
    examples = []
    for _ in range(windows):
        text, gold = example(rng)
        examples.append((Window(text, 0, len(text)), gold))
    weights, seen = np.zeros((WIDTH, len(KINDS))), np.full((WIDTH, len(KINDS)), 1e-6)
    weights[0] = -2.0
    for _ in range(PASSES):
        for first in range(0, len(examples), 20):
            part = examples[first : first + 20]
            slope = sum(w.gradient(weights, gold) for w, gold in part) / len(part)
            slope -= DECAY * weights
            seen += slope**2
            weights += RATE * slope / np.sqrt(seen)
    return weights


def stretches(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Windows around digits and "@", without what the patterns found."""
    fixed = sorted((a, b) for _, a, b in taken)
    fixed.append((len(text), len(text)))
    open_, last, k = None, 0, 0

    def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
        nonlocal k
        while k and fixed[k - 1][1] > start:
            k -= 1
        while k < len(fixed) and fixed[k][0] < end:
            a, b = fixed[k]
            if start < a:
                yield start, a
            start = max(start, b)
            k += 1
        if start < end:
            yield start, end

    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if open_ is None:
            open_, last = a, b
        elif a <= last:
            last = b
        else:
            yield from pieces(open_, last)
            open_, last = a, b
    if open_ is not None:
        yield from pieces(open_, last)


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """What the field finds outside the patterns' matches."""
    out = []
    for start, end in stretches(text, base):
        if ANCHOR.search(text, start, end):
            out += best_cut(text, start, end, weights)
    return out


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and start."""
    if not ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted({*base, *added_spans(text, base, weights)})


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind."""
    parts, last = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= last:
            parts += [text[last:start], f"<{KINDS[kind].upper()}>"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, how many base spans of each kind, the SHA-256 of the list of
    base spans, all spans (kind:start:end in code points), and how many were added."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value

        def make(ident, words):
            base, spans = find(words or "", weights)
            counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            return ident, *counts, digest, listed(spans), len(spans) - len(set(base))

        for batch in batches:
            counts = [(f"n_{k}", pa.int64()) for k in KINDS]
            rest = [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
            yield from per_row([batch], pa.schema([batch.schema.field(0), *counts, *rest]), make)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(
        run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long"
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by its kind, all other columns as
    they are."""
    at, schema = docs.columns.index(text), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, HELD_ROWS):
                batch = whole.slice(first, HELD_ROWS)
                texts = [
                    None if t is None else redact(t, find(t, weights)[1])
                    for t in batch.column(at).to_pylist()
                ]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
