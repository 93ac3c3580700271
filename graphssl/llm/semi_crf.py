"""Personal data: a semi-Markov conditional random field over segments of text.

Email addresses, IP addresses, card and phone numbers of plain form are found by rule
(``base_spans``) and always stay.  The field adds spans of other form.  A segmentation of a
stretch of text cuts it into single tokens outside and entities of at most ``MOST_TOKENS`` tokens and
``MOST_CHARS`` characters; an entity is scored as a whole, by features of the complete span
(counts of its characters, digit groups, separators, checksum, octets, what stands around it).
Dynamic programming over (end, length, kind) finds the best segmentation, so boundaries and kinds are chosen
jointly; the same recursion with sums gives the likelihood's gradient and each span's probability.
Base spans are fixed segments of the lattice; an added span needs a probability of ``SURE``.

An entity has to contain a trigger (a digit, ``@`` or a bracketed ``at``) and no line break.  So
text further than an entity's length from every trigger is outside in every segmentation, and
cutting the text into islands around the triggers loses nothing: whole texts are decided, at a cost that
follows the triggers.

Training (``train``) sees at most ``SAMPLE`` different islands of each kind and of none, those with the
smallest hash, from all rows.  What the rules find is the truth there; every such span is also shown
in written-out forms that the rules miss (other separators, no leading ``+``, ``(at)``).  The
weights are a few thousand numbers.

Defined results: null texts are empty and have no spans; spans are code points, end exclusive; a
table without any personal data trains a field that adds nothing; repeated rows and repeated or null doc_ids
are rows of their own; other columns never matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphssl.llm.common import id_text, release

#: The kinds in their order, and the forms that are always found.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

#: The longest entity, in tokens and in characters.
MOST_TOKENS, MOST_CHARS = 16, 64
#: Tokens of a long stretch that are scored at once.
STEP_TOKENS = 2048
#: Probability that an added span must have.
SURE = 0.9
#: Training islands per kind (and of none), their longest text, passes, weight of the prior.
SAMPLE, LONGEST, PASSES, PRIOR = 60, 200, 30, 0.05

_TRIGGER = re.compile(r"[0-9]+|@|[(\[{][aA][tT][)\]}]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_DIGITS = re.compile(r"[0-9]")
#: Character classes of a span's inside and edges.
_CLASS = {"@": 1, ".": 2, " ": 3, "-": 4, "(": 5, ")": 5, "[": 5, "]": 5, "{": 5, "}": 5, "+": 6}
_LETTER, _DIGIT, _OTHER, _NONE, _POINT = 7, 8, 9, 0, 10
#: Bins of every feature, in the order of :func:`_bins`.
_BINS = (1, 21, MOST_TOKENS + 1, 9, 3, 7, 7, 5, 3, 3, 4, 11, 11, 11, 11, 7, 3, 3, 64, 36)
_FIRST = np.concatenate([[0], np.cumsum(_BINS)])


# -- rules ------------------------------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start.  Time follows the length of the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(_DIGITS.findall(m.group())) <= PHONE_DIGITS[1]:
            out.append(("phone", *m.span()))
    return out


# -- the lattice of an island --------------------------------------------------------------------------------------

def islands(text: str, covered: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Stretches that hold every entity with a trigger outside ``covered`` (disjoint, in order)."""
    out, k = [], 0
    for m in _TRIGGER.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start() and m.end() <= covered[k][1]:
            continue
        a, b = max(0, m.end() - MOST_CHARS), min(len(text), m.start() + MOST_CHARS)
        a = max(a, text.rfind("\n", a, m.start()) + 1, text.rfind("\r", a, m.start()) + 1)
        b = min([b, *(x for x in (text.find("\n", m.end(), b), text.find("\r", m.end(), b)) if x >= 0)])
        a, b = min(a, m.start()), max(b, m.end())
        while 0 < a and _joined(text[a - 1], text[a]):       # whole tokens
            a -= 1
        while b < len(text) and _joined(text[b - 1], text[b]):
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined(x: str, y: str) -> bool:
    return x.isascii() and y.isascii() and (x.isalpha() and y.isalpha() or x.isdigit() and y.isdigit())


def _class(ch: str) -> int:
    if ch.isascii() and ch.isdigit():
        return _DIGIT
    return _CLASS.get(ch) or (_LETTER if ch.isalpha() else _OTHER)


def _around(text: str, at: int) -> int:
    """Class of the character at ``at``; a point is told from one that something follows at once."""
    if not 0 <= at < len(text) or text[at] in "\r\n":
        return _NONE
    if text[at] == "." and at + 1 < len(text) and text[at + 1].isalnum():
        return _POINT
    return _class(text[at])


class Lattice:
    """The candidate entities of ``text[a:b]``: token bounds ``edge``, and per candidate its first token, its
    length and its feature bins.  ``taken`` are spans that no entity may touch."""

    def __init__(self, text: str, a: int, b: int, taken: list[tuple[int, int]] = ()):
        self.edge = np.array([a, *(m.end() for m in _TOKEN.finditer(text, a, b))])
        n = self.n = len(self.edge) - 1
        bounds = list(zip(self.edge[:-1].tolist(), self.edge[1:].tolist()))
        kind = np.array([_class(text[s]) for s, _ in bounds], np.int64)
        blocked = np.array([text[s] in "\r\n" for s, _ in bounds], bool)
        for s, e in taken:
            if s < b and a < e:
                blocked[max(0, np.searchsorted(self.edge, s, "right") - 1):np.searchsorted(self.edge, e, "left")] = True
        hit = np.zeros(n, bool)
        for m in _TRIGGER.finditer(text, a, b):
            hit[np.searchsorted(self.edge, m.start(), "right") - 1:np.searchsorted(self.edge, m.end(), "left")] = True
        first, length = np.meshgrid(np.arange(n), np.arange(1, MOST_TOKENS + 1), indexing="ij")
        first, length = first.ravel(), length.ravel()
        inside = first + length <= n
        first, length = first[inside], length[inside]
        end = first + length

        def count(flags):
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[end] - total[first]

        size = self.edge[1:] - self.edge[:-1]
        ok = (self.edge[end] - self.edge[first] <= MOST_CHARS) & (count(blocked) == 0) & (count(hit) > 0)
        ok &= (kind[first] != 3) & (kind[end - 1] != 3)      # no space at an edge
        self.first, self.length = first[ok], length[ok]
        first, end = self.first, (first + length)[ok]
        if not len(first):
            self.bins = np.zeros((0, len(_BINS)), np.int64)
            return
        digit = kind == _DIGIT
        groups, digits = count(digit), count(np.where(digit, size, 0))
        large = count(np.array([bool(d) and not _octet(text[s:e]) for d, (s, e) in zip(digit, bounds)], bool))
        per = {c: count(kind == c) for c in (1, 2, 3, 4, 5, 6, _LETTER, _OTHER)}
        before = np.array([_around(text, int(p) - 1) for p in self.edge])
        after = np.array([_around(text, int(p)) for p in self.edge])
        mask = sum((per[c] > 0).astype(np.int64) << k for k, c in enumerate((1, 2, 3, 4, 5, 6)))
        # Sizes of the last two digit groups.
        at = np.flatnonzero(digit)
        last = np.searchsorted(at, end) - 1
        sizes = np.minimum(np.append(size[at], [0, 0]), 5)
        tail = np.where(groups > 0, sizes[last], 0) + 6 * np.where(groups > 1, sizes[last - 1], 0)
        self.bins = np.stack([
            np.zeros_like(first), np.minimum(digits, 20), end - first, np.minimum(per[_LETTER], 8), np.minimum(per[1], 2),
            np.minimum(per[2], 6), np.minimum(per[3], 6), np.minimum(per[4], 4), np.minimum(per[5], 2), np.minimum(per[6], 2),
            np.minimum(per[_OTHER], 3), kind[first], kind[end - 1], before[first], after[end], np.minimum(groups, 6),
            np.where(groups == 4, 1 + (large == 0), 0), self._luhn(text, bounds, digit, first, end, digits), mask, tail], 1)

    @staticmethod
    def _luhn(text, bounds, digit, first, end, digits):
        """0: not 12 to 19 digits, 1: the checksum fails, 2: it holds.  Running sums for both parities."""
        size = np.where(digit, [e - s for s, e in bounds], 0)
        starts = np.concatenate([[0], np.cumsum(size)])
        d = np.frombuffer("".join(text[s:e] for (s, e), x in zip(bounds, digit) if x).encode(), np.uint8).astype(np.int64) - 48
        double = np.where(d > 4, 2 * d - 9, 2 * d)
        even = np.arange(len(d)) % 2 == 0
        sums = [np.concatenate([[0], np.cumsum(np.where(even == (q == 0), d, double))]) for q in (0, 1)]
        u, v = starts[first], starts[end]
        odd = (v - 1) % 2
        total = np.where(odd == 0, sums[0][v] - sums[0][u], sums[1][v] - sums[1][u])
        return np.where((digits < 12) | (digits > 19), 0, 1 + (total % 10 == 0))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Per candidate and kind; ``weights``: (all bins, kinds)."""
        return weights[self.bins + _FIRST[:-1]].sum(1) if len(self.bins) else np.zeros((0, len(KINDS)))

    def table(self, scores: np.ndarray) -> np.ndarray:
        """(end token, length, kind), minus infinity where there is no candidate."""
        out = np.full((self.n + 1, MOST_TOKENS + 1, len(KINDS)), -np.inf)
        out[self.first + self.length, self.length] = scores
        return out


def best(table: np.ndarray) -> list[tuple[int, int, int]]:
    """``(first, end, kind)`` of the entities of the best segmentation (ties: outside, shorter, earlier kind)."""
    n = len(table) - 1
    value, back = np.zeros(n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        most = min(j, MOST_TOKENS)
        got = value[j - most:j][::-1, None] + table[j, 1:most + 1]
        k = int(np.argmax(got))
        if got.flat[k] > value[j]:
            value[j], back[j] = got.flat[k], (j - 1 - k // got.shape[1], j, k % got.shape[1])
    out, j = [], n
    while j:
        out += [back[j]] if back[j] else []
        j = back[j][0] if back[j] else j - 1
    return out[::-1]


def _sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def marginals(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For many lattices at once (a shorter one is filled up with tokens outside): the log
    partition sums and, shaped as ``tables``, the probability of every entity."""
    many, n = len(tables), tables.shape[1] - 1
    ahead, behind = np.zeros((many, n + 1)), np.zeros((many, n + 1))
    for j in range(1, n + 1):
        most = min(j, MOST_TOKENS)
        paths = ahead[:, j - most:j][:, ::-1, None] + tables[:, j, 1:most + 1]
        ahead[:, j] = _sum_exp(np.concatenate([paths.reshape(many, -1), ahead[:, j - 1:j]], 1))
    for i in range(n - 1, -1, -1):
        most = min(n - i, MOST_TOKENS)
        ends = np.arange(i + 1, i + most + 1)
        paths = behind[:, ends, None] + tables[:, ends, np.arange(1, most + 1)]
        behind[:, i] = _sum_exp(np.concatenate([paths.reshape(many, -1), behind[:, i + 1:i + 2]], 1))
    first = np.arange(n + 1)[:, None] - np.arange(MOST_TOKENS + 1)
    start = np.where(first >= 0, ahead[:, np.maximum(first, 0)], -np.inf)
    return ahead[:, n], np.exp(start[..., None] + tables + (behind - ahead[:, n:])[:, :, None, None])


def decode(text: str, a: int, b: int, taken: list[tuple[int, int]], weights: np.ndarray,
           step: int = STEP_TOKENS) -> list[tuple[int, int, int, float]]:
    """``(start, end, kind, probability)`` of the entities of the best segmentation of ``text[a:b]``.

    The recursions of :func:`best` and :func:`marginals` over pieces of ``step`` tokens, whose candidates
    are made when they are needed: what stays is a few numbers per token."""
    edge = np.array([a, *(m.end() for m in _TOKEN.finditer(text, a, b))])
    n = len(edge) - 1

    def tables(order):
        """Per piece its first end and the candidates by end."""
        for begin in order:
            low, high = max(0, begin - MOST_TOKENS), min(n, begin + step)
            lattice = Lattice(text, int(edge[low]), int(edge[high]), taken)
            if len(lattice.first):
                yield begin + 1, lattice.table(lattice.scores(weights))[begin + 1 - low:]
            else:
                yield begin + 1, np.full((high - begin, MOST_TOKENS + 1, len(KINDS)), -np.inf)

    value, ahead, back = np.zeros(n + 1), np.zeros(n + 1), np.zeros((n + 1, 3))      # length, kind, score
    for begin, table in tables(range(0, n, step)):
        for j, row in enumerate(table, begin):
            most = min(j, MOST_TOKENS)
            cut = row[1:most + 1]
            value[j], ahead[j] = value[j - 1], ahead[j - 1]
            if np.isfinite(cut).any():
                got = value[j - most:j][::-1, None] + cut
                k = int(np.argmax(got))
                if got.flat[k] > value[j]:
                    value[j], back[j] = got.flat[k], (k // len(KINDS) + 1, k % len(KINDS), cut.flat[k])
                paths = ahead[j - most:j][::-1, None] + cut
                ahead[j] = _sum_exp(np.append(paths.ravel(), ahead[j - 1])[None])[0]
    if not back[:, 0].any():
        return []
    behind = np.full(n + 1, -np.inf)
    behind[n] = 0.0
    for begin, table in tables(reversed(range(0, n, step))):
        for j in range(begin + len(table) - 1, begin - 1, -1):
            most = min(j, MOST_TOKENS)
            cut = table[j - begin, 1:most + 1]
            behind[j - 1] = np.logaddexp(behind[j - 1], behind[j])
            if np.isfinite(cut).any():
                into = behind[j - most:j][::-1]
                np.logaddexp(into, np.logaddexp.reduce(cut, axis=1) + behind[j], out=into)
    out, j = [], n
    while j:
        length, kind = int(back[j][0]), int(back[j][1])
        if length:
            i = j - length
            out.append((int(edge[i]), int(edge[j]), kind, float(np.exp(ahead[i] + back[j][2] + behind[j] - ahead[n]))))
            j = i
        else:
            j -= 1
    return out[::-1]


# -- training ------------------------------------------------------------------------------------------------------

def variants(kind: str, text: str) -> list[str]:
    """Other ways of writing an entity."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        local, domain = text.rsplit("@", 1)
        return [f"{local}(at){domain}", f"{local}[at]{domain}", f"{local} @ {domain}", f"{local} (at) {domain}"]
    if kind == "ip":
        return [text.replace(".", "[.]"), text.replace(".", " . ")]
    if kind == "card":
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), " - ".join(fours), "  ".join(fours)]
    end = digits[-10:]
    return [f"({end[:3]}) {end[3:6]}-{end[6:]}", f"{end[:3]}-{end[3:6]}-{end[6:]}", f"{end[:3]}.{end[3:6]}.{end[6:]}"] \
        if len(end) == 10 else []


def disjoint(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of spans that overlap the first in the order of kinds stays; by start."""
    out = []
    for s in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])):
        if all(s[2] <= o[1] or o[2] <= s[1] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s[1])


def _examples(snippet: str) -> list[tuple[Lattice, np.ndarray]]:
    """An island with its true spans, and once more per other way to write its first one: lattice and truth (as
    positions in the lattice's candidates, kinds)."""
    base = disjoint(base_spans(snippet))
    shown = [(snippet, base)]
    if base:
        kind, s, e = base[0]
        for other in variants(kind, snippet[s:e]):
            by = len(other) - (e - s)
            shown.append((snippet[:s] + other + snippet[e:], [(kind, s, s + len(other))] + [(k, x + by, y + by) for k, x, y in base[1:]]))
    out = []
    for text, spans in shown:
        lattice = Lattice(text, 0, len(text))
        at = {(int(lattice.edge[f]), int(lattice.edge[f + n])): i
              for i, (f, n) in enumerate(zip(lattice.first.tolist(), lattice.length.tolist()))}
        if all((s, e) in at for _, s, e in spans) and len(lattice.first):
            out.append((lattice, [(at[s, e], KINDS.index(k)) for k, s, e in spans]))
    return out


class Batch:
    """Examples side by side: the candidates of all lattices in one list."""

    def __init__(self, examples):
        self.many, self.most = len(examples), max(x.n for x, _ in examples)
        self.bins = np.concatenate([x.bins for x, _ in examples]) + _FIRST[:-1]
        self.row = np.repeat(np.arange(self.many), [len(x.first) for x, _ in examples])
        self.end = np.concatenate([x.first + x.length for x, _ in examples])
        self.length = np.concatenate([x.length for x, _ in examples])
        at = np.cumsum([0, *(len(x.first) for x, _ in examples)])
        true = [(at[r] + i, k) for r, (_, truth) in enumerate(examples) for i, k in truth]
        self.true = tuple(np.array(true, np.int64).reshape(-1, 2).T)

    def loss(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log likelihood, and its gradient."""
        scores = np.stack([w[self.bins].sum(1) for w in np.ascontiguousarray(weights.T)], 1)
        tables = np.full((self.many, self.most + 1, MOST_TOKENS + 1, len(KINDS)), -np.inf)
        tables[self.row, self.end, self.length] = scores
        total, p = marginals(tables)
        left = p[self.row, self.end, self.length]
        left[self.true] -= 1
        grad, flat = np.zeros_like(weights), self.bins.ravel()
        for k in range(len(KINDS)):
            grad[:, k] += np.bincount(flat, np.repeat(left[:, k], len(_BINS)), _FIRST[-1])
        return float(total.sum() - scores[self.true].sum()), grad


def fit(snippets: list[str], passes: int = PASSES) -> np.ndarray:
    """Weights by gradient steps on the likelihood and a Gaussian prior, with a step size per weight; the start is
    against every entity."""
    weights = np.zeros((_FIRST[-1], len(KINDS)))
    weights[0] = -4.0
    examples = [x for s in snippets for x in _examples(s)]
    if not any(truth for _, truth in examples):
        return weights
    examples.sort(key=lambda x: x[0].n)                  # lattices of like size share a batch
    quarter = -(-len(examples) // 4)
    batches = [Batch(examples[i:i + quarter]) for i in range(0, len(examples), quarter)]
    seen = np.zeros_like(weights)
    for _ in range(passes):
        grad = PRIOR * weights + sum(batch.loss(weights)[1] for batch in batches)
        seen += grad ** 2
        weights = weights - 0.5 * grad / np.sqrt(seen + 1e-8)
    return weights


def _candidates(sample: int, longest: int):
    """A task's training islands: per kind the ``sample`` different ones with the smallest hash."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept: dict[str, dict[str, int]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for a, b in islands(text):
                    snippet = text[a:b]
                    if len(snippet) > longest:
                        continue
                    here = next((k for k, s, e in spans if a <= s and e <= b), "none")
                    mine = kept.setdefault(here, {})
                    mine[snippet] = int.from_bytes(blake2b(snippet.encode(), digest_size=7).digest(), "big")
                    if len(mine) > 4 * sample:
                        kept[here] = dict(sorted(mine.items(), key=lambda x: x[1])[:sample])
        out = [(k, s, h) for k, mine in kept.items() for s, h in sorted(mine.items(), key=lambda x: x[1])[:sample]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["kind", "snippet", "hash"])
    return kernel


def train(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, passes: int = PASSES) -> np.ndarray:
    """The field's weights, from at most ``sample`` islands of each kind and of none."""
    found = (id_text(docs).select("text").where(F.col("text").rlike("[0-9@]"))
             .mapInArrow(_candidates(sample, longest), "kind string, snippet string, hash long").distinct())
    place = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "snippet"))
    rows = found.withColumn("place", place).where(F.col("place") <= sample).collect()   # 5 * sample short texts
    return fit([r["snippet"] for r in sorted(rows, key=lambda r: (r["kind"], r["hash"], r["snippet"]))], passes)


# -- scoring -------------------------------------------------------------------------------------------------------

def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray, sure: float = SURE) -> list[tuple[str, int, int]]:
    """What the field finds beside the base spans."""
    taken = sorted((s, e) for _, s, e in base)
    covered = []
    for s, e in taken:
        if covered and s <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    out = []
    for a, b in islands(text, covered):
        near = [c for c in covered if c[0] < b and a < c[1]]
        out += [(KINDS[k], s, e) for s, e, k, p in decode(text, a, b, near, weights) if p >= sure]
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _find(weights: np.ndarray, count_added: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                every = base + added_spans(text, base, weights)
                kinds = [k for k, _, _ in (every if count_added else base)]
                rows.append((*(kinds.count(k) for k in KINDS), sha256(_listed(base).encode()).hexdigest(), _listed(every)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return kernel


def personal_data(docs: DataFrame, weights: np.ndarray, count_added: bool = True) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (all spans, or the base spans), ``base_sha256, spans`` (all) of every row."""
    return id_text(docs).mapInArrow(
        _find(weights, count_added), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
