"""Personal data: pattern spans, and more spans from a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) give spans that always stay. Around digits and at
signs the field then scores whole candidate segments of up to MAX_TOKENS white-space tokens by
features of the entire span (digits and their grouping, check sum, octets, brackets, context
words); a bounded-length dynamic programme picks boundaries and kinds of a stretch jointly. Its
segments are added where they touch no base span, for instance phone numbers without a country
code. An entity is bounded by MAX_TOKENS tokens and MAX_CHARS characters, and its tokens stand no
more than MAX_GAP characters of blanks, brackets and dashes apart; base spans have no such bound. The field is trained by gradient ascent on the conditional likelihood of made-up lines
(seeded, no corpus rows), once per process.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAX_TOKENS = 5
#: Characters of an entity of the field: the longest address that mail allows.
MAX_CHARS = 320
MAX_GAP = 4
_SLICE = 256
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'*$#%&|<>[]{}"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of EMAIL from the at signs out: a match takes the whole run of local
    characters before its sign, so each character is looked at a bounded number of times."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[Span]:
    """Leftmost matches of four dotted numbers: each chain of dotted numbers is taken by fours."""
    for chain in _CHAIN.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield "ip", start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if _TRIGGER.search(text) is None:
        return out
    if "." in text:
        out += _addresses(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _shape(s: str) -> str:
    out: list[str] = []
    for c in s:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not (out and out[-1] == k and k == "a"):
            out.append(k)
    return "".join(out)


_CALL = re.compile(r"(phone|tel|call|fax|mobile|contact)", re.I)


@functools.lru_cache(maxsize=65536)
def span_features(span: str, kind: str, left: str) -> tuple[str, ...]:
    """Features of one candidate segment as a whole, for a kind."""
    d = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    shape = _shape(span)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    facts = [
        "bias",
        f"digits={min(len(d), 20)}",
        f"groups={'-'.join(str(min(len(g), 9)) for g in groups[:6])}",
        f"marks={marks[:8]}",
        f"letters={min(letters, 3)}",
        f"luhn={not letters and 13 <= len(d) <= 19 and luhn(d)}",
        f"octets={len(groups) == 4 and all(map(_octet, groups)) and span.count('.') == 3}",
        f"at={span.count('@')}:{bool(EMAIL.fullmatch(span))}",
        f"paren={bool(re.match(r'^[(][0-9]{2,4}[)]', span))}",
        f"plus={span.startswith('+')}",
        f"ends={shape[:1]}{shape[-1:]}",
        f"call={bool(_CALL.search(left))}",
    ]
    return tuple(f"{kind}|{f}" for f in facts)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    return start, end


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of white-space tokens that hold a digit or an at sign, as places in the text; a token
    of brackets or dashes alone does not break a run."""
    run: list[tuple[int, int]] = []
    for found in _active(text):
        if run and not _joins(text[run[-1][1] : found[0]]):
            yield run
            run = []
        run.append(found)
    if run:
        yield run


def _active(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        hit = _TRIGGER.search(text, at)
        if hit is None:
            return
        start = hit.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(text, start).end()
        yield start, end
        at = end


def _joins(between: str) -> bool:
    return len(between) <= MAX_GAP and all(c in " ()-" for c in between)


def _segments(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, tuple[int, int]]]:
    """(first token, token after, trimmed place) of the candidates of a run."""
    out = []
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + MAX_TOKENS) + 1):
            s, e = _trimmed(text, run[i][0], run[j - 1][1])
            if e > s and e - s <= MAX_CHARS:
                out.append((i, j, (s, e)))
    return out


class Field:
    """Log-linear weights of (kind, feature) over segments; a token outside any has the weight
    of its `none` features."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros(0)

    def _ids(self, feats: tuple[str, ...], grow: bool) -> list[int]:
        if grow:
            return [self.index.setdefault(f, len(self.index)) for f in feats]
        return [self.index[f] for f in feats if f in self.index]

    def lattice(self, text: str, run: list[tuple[int, int]], grow: bool = False) -> list[tuple[int, int, str, tuple[int, int], list[int]]]:
        left = text[max(0, run[0][0] - 24) : run[0][0]]
        arcs = []
        for k, (s, e) in enumerate(run):
            place = _trimmed(text, s, e)
            # A token too long for an entity has no rival, so its weight does not matter.
            shown = text[place[0] : place[1]] if place[1] - place[0] <= MAX_CHARS else ""
            arcs.append((k, k + 1, "none", place, self._ids(span_features(shown, "none", left), grow)))
        for i, j, place in _segments(text, run):
            span = text[place[0] : place[1]]
            arcs += [(i, j, kind, place, self._ids(span_features(span, kind, left), grow)) for kind in KINDS]
        return arcs

    def best(self, text: str, run: list[tuple[int, int]]) -> list[Span]:
        """The segments of the best segmentation; ties prefer no segment, then the shorter."""
        arcs = self.lattice(text, run)
        by_end: dict[int, list] = {}
        for arc in arcs:
            by_end.setdefault(arc[1], []).append(arc)
        top: list[tuple[float, tuple | None]] = [(0.0, None)] + [(-np.inf, None)] * len(run)
        for j in range(1, len(run) + 1):
            for arc in by_end[j]:
                value = top[arc[0]][0] + float(self.w[arc[4]].sum())
                if value > top[j][0] + 1e-12:
                    top[j] = (value, arc)
        out, j = [], len(run)
        while j:
            arc = top[j][1]
            if arc[2] != "none":
                out.append((arc[2], *arc[3]))
            j = arc[0]
        return out[::-1]

    def learn(self, lines: list[tuple[str, list[Span]]], rounds: int = 30, rate: float = 0.5, decay: float = 2e-3) -> None:
        examples = []
        for text, gold in lines:
            for run in stretches(text):
                arcs = self.lattice(text, run, grow=True)
                wanted = {(k, s, e) for k, s, e in gold}
                path = [a for a in arcs if a[2] != "none" and (a[2], *a[3]) in wanted]
                covered = {t for a in path for t in range(a[0], a[1])}
                path += [a for a in arcs if a[2] == "none" and a[0] not in covered]
                examples.append((arcs, path, len(run)))
        self.w = np.zeros(len(self.index))
        squares = np.full(len(self.index), 1e-6)
        for _ in range(rounds):
            slope = -decay * self.w * len(examples)
            for arcs, path, n in examples:
                for a in path:
                    slope[a[4]] += 1
                for a, p in zip(arcs, self._marginals(arcs, n), strict=True):
                    if p > 1e-6:
                        slope[a[4]] -= p
            squares += slope * slope
            self.w += rate * slope / np.sqrt(squares)

    def _marginals(self, arcs: list, n: int) -> list[float]:
        value = [float(self.w[a[4]].sum()) for a in arcs]
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        order = sorted(range(len(arcs)), key=lambda k: arcs[k][0])
        for k in order:
            a = arcs[k]
            ahead[a[1]] = np.logaddexp(ahead[a[1]], ahead[a[0]] + value[k])
        for k in sorted(range(len(arcs)), key=lambda k: -arcs[k][1]):
            a = arcs[k]
            back[a[0]] = np.logaddexp(back[a[0]], back[a[1]] + value[k])
        return [float(np.exp(ahead[a[0]] + value[k] + back[a[1]] - ahead[n])) for k, a in enumerate(arcs)]


def _with_check(rnd: random.Random, n: int) -> str:
    head = str(rnd.randint(3, 6)) + "".join(str(rnd.randint(0, 9)) for _ in range(n - 2))
    return next(head + str(k) for k in range(10) if luhn(head + str(k)))


def training_lines(seed: int = 20, n: int = 420) -> list[tuple[str, list[Span]]]:
    """Made-up lines with marked spans, and lines of numbers that are not personal."""
    rnd = random.Random(seed)
    num = lambda k: str(rnd.randint(1, 9)) + "".join(str(rnd.randint(0, 9)) for _ in range(k - 1))
    word = lambda: "".join(rnd.choice("aeioutnrsld") for _ in range(rnd.randint(2, 7)))
    card = lambda: _with_check(rnd, rnd.choice((13, 15, 16, 16, 16, 19)))

    def phone() -> str:
        a, b, c, d = num(3), num(3), num(4), rnd.choice(("1", "44", "49", "33", "7"))
        return rnd.choice((f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d} ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"+{d}-{a}-{b}-{c}"))

    def spaced() -> str:
        c = _with_check(rnd, 16)
        s = rnd.choice(("", " ", "-"))
        return s.join(c[k : k + 4] for k in range(0, 16, 4))

    makers = {
        "email": lambda: f"{word()}{rnd.choice(('', '.', '_'))}{rnd.randint(0, 99)}@{word()}{rnd.randint(0, 9)}.{word()}.com",
        "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        "card": lambda: rnd.choice((card, spaced))(),
        "phone": phone,
    }
    plain = (
        lambda: f"{num(1)}.{num(1)}",
        lambda: num(rnd.randint(1, 8)),
        lambda: num(4) + "-" + num(2) + "-" + num(2),
        lambda: num(rnd.choice((9, 11, 12, 20, 24))),
        lambda: "%032x" % rnd.getrandbits(128),
        lambda: "%040x" % rnd.getrandbits(160),
        lambda: '"%040x"' % rnd.getrandbits(160),
        lambda: "".join(rnd.choice("ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(rnd.randint(6, 24))),
        lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(4, 24))),
        lambda: f"{word()}{num(rnd.randint(1, 4))}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: f"{num(1)},{num(3)}",
        lambda: f"{num(3)}%",
        lambda: "v" + num(1),
        lambda: f"{rnd.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}",
        lambda: f"@{word()}",
        lambda: f"{num(1)} {num(3)} {num(2)}",
        lambda: f"({num(1)})",
        lambda: f"{num(4)} {num(4)}",
        lambda: f"{num(2)}.{num(1)}.{num(2)}",
    )
    lines = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(rnd.randint(1, 3)):
            text += rnd.choice((" ", " ", f" {word()} ", f". {word()} "))
            if rnd.random() < 0.5:
                kind = rnd.choice(KINDS)
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
            else:
                made = rnd.choice(plain)()
            text += made + rnd.choice(("", "", ".", ",", "***", " " + word()))
        lines.append((text, spans))
    return lines


@functools.cache
def trained() -> Field:
    field = Field()
    field.learn(training_lines())
    return field


def all_spans(text: str, field: Field | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by kind as listed, then start."""
    base = base_spans(text)
    if _TRIGGER.search(text) is None:
        return base, base
    field = field or trained()
    taken = sorted((s, e) for _, s, e in base)
    out, k = list(base), 0
    for run in stretches(text):
        while k < len(taken) and taken[k][1] <= run[0][0]:
            k += 1
        for span in field.best(text, run):
            if not any(s < span[2] and span[1] < e for s, e in _around(taken, k, span[2])):
                out.append(span)
    return base, sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _around(taken: list[tuple[int, int]], k: int, end: int) -> Iterator[tuple[int, int]]:
    for s, e in taken[k:]:
        if s >= end:
            return
        yield s, e


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).
    Null text counts as empty; each row is answered by itself, repeated or not, a null id too; an
    empty table gives no rows. The bounds of added spans are those of the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                numbers: list[list[int]] = [[] for _ in KINDS]
                digest, spans = [], []
                for text in part.column(1).to_pylist():
                    base, every = all_spans(text or "", field)
                    for k, kind in enumerate(KINDS):
                        numbers[k].append(sum(s[0] == kind for s in base))
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
                yield pa.record_batch(
                    [part.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
