"""BPE encoding and decoding with a deterministic tokenization automaton.

The automaton reads tokens: its paths are exactly the token sequences that BPE
produces, so a text has one path, and the path's arc labels are its encoding.
It is compiled by one *merge gadget* per merge rule, in rule order.  Before the
first rule one state has an arc for every byte.  The gadget of ``(a, b) -> c``

* gives the target of the ``a`` arcs a copy that has lost its ``b`` arc (after
  ``a`` comes no ``b`` any more), and
* gives every state that has an ``a`` arc whose target had a ``b`` arc an arc
  ``c``, which leads to where that ``b`` arc led.

Copies share all arcs that a gadget left alone, so a compiled automaton is four
integers per token: a state is named by the label of its incoming arcs, and
``arc(state, label)`` looks for a gadget that took the label from the state or
from the state that it was copied from.  Looked-up arcs are kept in a transition
table.

Encoding a pre-split word walks its bytes once: for each end position it takes
the label whose arc leaves the state reached where the label begins (exactly one
exists), then reads the path back.  Words repeat, so a worker keeps the ids of
the first words it has met, at most ``CACHE_WORDS`` of them (``LEAN_WORDS`` in :func:`encode`).  Decoding
emits the arc labels' bytes.

Defined results: null and empty texts have no ids and decode to ""; special
tokens in a text become their ids, as in the library's default; repeated rows
and doc_ids give a row each; an empty table gives an empty table; other columns
never matter.  A row is encoded whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphssl.llm.common import held, id_text, trim

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and strings between spaces, whose ids a worker keeps; the first ones it
#: meets are the frequent ones.
CACHE_WORDS, CACHE_PIECES = 350_000, 250_000
#: The same where other stages have filled the executor before.
LEAN_WORDS, LEAN_PIECES = 60_000, 120_000
#: Marks a string that begins a label but is none.
PREFIX = -1
#: Arcs in the transition table before it starts anew.
CACHE_ARCS = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class MergeAutomaton:
    """Tokens are ids; ``labels[id]`` are their bytes."""

    def __init__(self, byte_ids: list[int], labels: dict[int, bytes]):
        self.byte_ids = byte_ids
        self.labels = dict(labels)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}          # the gadget that made the label
        self.lost: dict[tuple[int, int], int] = {}   # (state, label) -> the gadget that took the arc away
        self.alive = {labels[i]: i for i in byte_ids}
        self.table: dict[int, bool] = {}         # state * 2^32 + label

    def gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if c in self.born or (a, b) in self.lost:
            raise ValueError(f"token {c} or its pair has two merge rules")
        reachable = self.alive.get(self.labels[a]) == a and self.alive.get(self.labels[b]) == b \
            and self._arc(a, b)
        self.left[c], self.right[c], self.born[c] = a, b, rank
        self.lost[a, b] = rank
        if reachable:           # else no path has an a arc followed by a b arc
            self.alive[self.labels[c]] = c

    def _arc(self, state: int, label: int) -> bool:
        """Is there an arc ``label`` out of ``state``?  A gadget has taken it away if it
        took a label, at the left edge of ``label``, from a state at the right edge of
        ``state``, before these were merged on."""
        lost, left, right, born = self.lost, self.left, self.right, self.born
        copied = None                       # the state was copied before this gadget
        while True:
            x, made = label, None
            while True:
                taken = lost.get((state, x))
                # Of a run of equal tokens the leftmost pair merges, so at equal
                # ranks the state has lost the arc and the label has not been made.
                if taken is not None and (copied is None or taken < copied) and (made is None or taken <= made):
                    return False
                if x not in left:
                    break
                made, x = born[x], left[x]
            if state not in right:
                return True
            copied, state = born[state], right[state]

    def arc(self, state: int, label: int) -> bool:
        key = (state << 32) | label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CACHE_ARCS:
                self.table.clear()
            known = self.table[key] = self._arc(state, label)
        return known

    def finish(self) -> None:
        """Marks the proper prefixes of labels, so that a walk knows where to stop."""
        for label in list(self.alive):
            for end in range(1, len(label)):
                self.alive.setdefault(label[:end], PREFIX)

    def path(self, word: bytes) -> list[int]:
        """The labels of the path that spells ``word``."""
        alive, known, arc, n = self.alive.get, self.table.get, self.arc, len(word)
        reached = [PREFIX] * (n + 1)            # the state (its label) at each position
        for begin in range(n):
            state = reached[begin]
            if begin and state == PREFIX:
                continue
            for end in range(begin + 1, n + 1):
                label = alive(word[begin:end])
                if label is None:
                    break
                if label != PREFIX and (not begin or known((state << 32) | label) or arc(state, label)):
                    reached[end] = label
        out = []
        while n:
            out.append(reached[n])
            n -= len(self.labels[reached[n]])
        return out[::-1]


class Tokenizer:
    """A byte-level BPE file of the tokenizers library (no normalizer, no dropout)."""

    def __init__(self, text: str, most_words: int = CACHE_WORDS, most_pieces: int = CACHE_PIECES):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] \
                or not pre["use_regex"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings are not supported")
        labels = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        self.automaton = MergeAutomaton([vocab[c] for c in letters], labels)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.automaton.gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.automaton.finish()
        emitted = labels | {i: t.encode() for t, i in self.specials.items()}
        self._bytes = _Emitter(emitted)
        self._decimal = _Emitter({i: b"%d," % i for i in emitted})
        self._words = regex.compile(PATTERN)
        longest_first = sorted(self.specials, key=lambda t: (-len(t), t))
        self._special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        # A space between two other characters always begins a word of the pattern;
        # so does the last one of a run of white space.  No other space is cut at.
        self._inner_space = regex.compile(r"\s (?:\s|\Z)")
        self._word_ids = _Known(self._word, most_words)
        self._spaced_ids = _Known(self._spaced, most_pieces)

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.path(word.encode("utf-8")), np.int32).tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._word_ids.__getitem__, self._words.findall(piece)))

    def _spaced(self, piece: str) -> bytes:
        """The ids of a string after a space; a single word is kept as that string only."""
        found = self._words.findall(" " + piece)
        if len(found) == 1 and len(self._spaced_ids) < self._spaced_ids.most:
            return self._word(found[0])
        return b"".join(map(self._word_ids.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        parts = self._special.split(text) if self._special else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.specials[part]], np.int32).tobytes())
            elif self._inner_space.search(part):
                out.append(self._piece(part))
            else:
                pieces = part.split(" ")
                out.append(self._piece(pieces[0]))
                out.extend(map(self._spaced_ids.__getitem__, pieces[1:]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text whose bytes the arcs ``ids`` spell."""
        return self._bytes.emit(ids).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._decimal.emit(ids)[:-1]


class _Emitter:
    """Writes what stands for each id of a list, one after the other."""

    def __init__(self, of: dict[int, bytes]):
        top = max(of) + 1
        self.length = np.array([len(of.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.data = np.frombuffer(b"".join(of.get(i, b"") for i in range(top)), np.uint8)

    def emit(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        at = np.repeat(self.start[ids] - (end - length), length)
        at += np.arange(len(at))
        return self.data[at].tobytes()


class _Known(dict):
    """Ids of the first ``most`` strings met, as int32 bytes; later ones are encoded
    whenever they come."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(self) < self.most:
            self[key] = out
        return out


def _tokenizer(text: str, *most: int) -> Tokenizer:
    """One compiled tokenizer per worker process, until it turns to another operator."""
    def make() -> Tokenizer:
        tok = Tokenizer(text, *most)
        trim()              # the parsed file has gone
        return tok
    return held(f"tokenizer {hashlib.sha256(text.encode()).hexdigest()} {most}", make)


def _over_texts(docs: DataFrame, path: str, schema: str, row, *most: int) -> DataFrame:
    """Applies ``row(tokenizer, text) -> dict`` to every text; ``path`` is read by the
    driver, and its content (one vocabulary) is broadcast.  ``most``: strings that a worker keeps."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(spec.value, *most)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = [row(tok, t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([o[k] for o in out], kind) for k, kind in KINDS[schema])],
                    names=["doc_id", *(k for k, _ in KINDS[schema])])

    return id_text(docs).mapInArrow(run, schema)


ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KINDS = {ENCODED: [("ids", pa.list_(pa.int32()))],
         DIGESTS: [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]}


def _ids(tok: Tokenizer, text: str) -> dict:
    return {"ids": tok.encode(text)}


def _digests(tok: Tokenizer, text: str) -> dict:
    ids = tok.encode(text)
    return {"n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(tok.decimal(ids)).hexdigest(),
            "decoded_sha256": hashlib.sha256(tok.decode(ids).encode()).hexdigest()}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row."""
    return _over_texts(docs, path, ENCODED, _ids, LEAN_WORDS, LEAN_PIECES)


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Every text encoded, and its ids decoded again, as digests."""
    return _over_texts(docs, path, DIGESTS, _digests)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)`` rows (null ids: empty)."""
    with open(path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tok = _tokenizer(spec.value)
        for b in batches:
            texts = [tok.decode(np.array(ids or [], np.int64)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
