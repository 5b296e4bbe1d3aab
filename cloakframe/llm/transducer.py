"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model compiles to machines.  The normaliser rewrites characters by the model's character map, longest match first,
and writes the space mark for spaces and in front of the text.  The lexicon reads characters and writes pieces; beside
it the byte fallback reads a character that no piece holds and writes its bytes, or the unknown piece, at a weight above any path
of pieces.  The last machine says what neighbours weigh in the tropical semiring (smallest sum wins): for a unigram
model each piece weighs minus its score; for a BPE model a pair of neighbouring pieces weighs nothing if merging their joint
text gives just these two, and infinitely much if not.  A segmentation is what the merges produce exactly if all its
neighbours are such pairs, so one path has finite weight, and it is the BPE encoding.

Encoding composes the machines with an input, state by state as the input is read, and takes the shortest path; the
work is in proportion to the input times the longest piece.  Where no piece holds the space mark after another character, an
input falls into independent parts at spaces (and before stops that no piece joins to a letter); parts met before come
from a bounded memory."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Fixed by the model format: the space mark, kinds of models and of pieces.
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 120_000
PAIRS = 300_000
LONGEST = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def _character_map(blob: bytes) -> tuple[tuple[str, str], ...]:
    """(what is read, what is written) of a model's packed character map: a double array over UTF-8 bytes, whose leaves
    are places in the text behind it."""
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    bytes_, offset = np.arange(1, 256), ((units >> 10) << ((units & 512) >> 6))
    rules, waiting = [], [(int(offset[0]), b"")]
    while waiting:
        base, read = waiting.pop()
        places = base ^ bytes_
        inside = places[places < len(units)]
        for at in inside[units[inside] & 0x800000FF == base ^ inside].tolist():
            key, below = read + bytes([base ^ at]), at ^ int(offset[at])
            if units[at] >> 8 & 1:
                begin = int(units[below] & 0x7FFFFFFF)
                rules.append((key.decode(), texts[begin : texts.index(b"\0", begin)].decode()))
            waiting.append((below, key))
    return tuple(sorted(rules))


class Machine:
    """A transducer with one initial and final state: from it a trie of readings, each with what it writes.  Of the
    readings that fit an input at a place the longest is taken; a character that none begins with is written as it is."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.single = {ord(read): write for read, write in rules if len(read) == 1}
        self.trie: dict = {}
        for read, write in rules:
            node = self.trie
            for c in read:
                node = node.setdefault(c, {})
            node[""] = write
        first = {read[0] for read, _ in rules if len(read) > 1}
        # only where a longer reading may begin does an input leave the one-character arcs
        self.branching = re.compile(f"[{re.escape(''.join(sorted(first)))}]") if first else None

    def _longest(self, text: str, at: int) -> tuple[int, str]:
        """(end, what is written) of the longest reading at a place."""
        node, end, write, place = self.trie, at + 1, text[at], at
        while place < len(text) and (node := node.get(text[place])) is not None:
            place += 1
            if "" in node:
                end, write = place, node[""]
        return end, write

    def write(self, text: str) -> str:
        """The output of the composition with ``text``."""
        if self.branching is None:
            if len(self.single) == 1:  # a machine of one arc
                ((read, write),) = self.single.items()
                return text.replace(chr(read), write)
            return text.translate(self.single) if self.single else text
        out, at = [], 0
        while found := self.branching.search(text, at):
            out.append(text[at : found.start()].translate(self.single))
            at, write = self._longest(text, found.start())
            out.append(write)
        return "".join([*out, text[at:].translate(self.single)])


@dataclass(frozen=True)
class Vocabulary:
    """What the machines are compiled from; small (a row a piece), so it is sent to every worker as it is."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    kind: int
    dummy_prefix: bool
    squeeze: bool
    characters: tuple[tuple[str, str], ...] = ()

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as file:
            data = file.read()
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one.get(1, b"").decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(
            tuple(pieces), tuple(scores), tuple(kinds), trainer.get(3, UNIGRAM), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)),
            _character_map(normalizer[2]) if normalizer.get(2) else (),
        )


@dataclass
class Transducer:
    vocabulary: Vocabulary
    remembered: int = REMEMBERED
    _memory: dict[str, bytes] = field(default_factory=dict)
    _older: dict[str, bytes] = field(default_factory=dict)
    _pairs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        v = self.vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.normaliser, self.marks = Machine(v.characters), Machine([(" ", MARK)])
        self.longest = max(map(len, self.ids), default=1)
        self.lexicon: dict = {}
        for piece, i in self.ids.items():
            node = self.lexicon
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.characters = {c for p in self.ids for c in p}
        scores = [v.scores[i] for i in self.ids.values()]
        self.unknown_weight = 10.0 - min(scores, default=0.0)  # heavier than any path of pieces over one character
        marked_inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        feed = "\n" if "\n" not in self.characters else ""
        # Letters that no piece has before a full stop or comma end a part there too.
        glued = {p[i] for p in self.ids for i in range(len(p) - 1) if p[i + 1] in ".,"}
        letters = re.escape("".join(c for c in map(chr, range(65, 384)) if c.isalpha() and c not in glued))
        stopped = f"{MARK}*[^{MARK}{feed}.,]*[{letters}](?=[.,])|" if letters else ""
        rest = f"{MARK}*[^{MARK}{feed}]+|{MARK}+" + ("|\n" if feed else "")
        self.parts = None if marked_inside else re.compile(stopped + rest)
        self.texts = [
            bytes([int(p[3:5], 16)]) if v.kinds[i] == BYTE else b"" if v.kinds[i] == CONTROL else p.replace(MARK, " ").encode()
            for i, p in enumerate(v.pieces)
        ]

    def normalise(self, text: str) -> str:
        """What the lexicon reads: the text through the character map, spaces as marks, squeezed if the model says so."""
        if not text:
            return ""
        text = self.normaliser.write(text)
        if self.vocabulary.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
            if not text:
                return ""
        marked = (MARK if self.vocabulary.dummy_prefix else "") + self.marks.write(text)
        return marked.rstrip(MARK) if self.vocabulary.squeeze else marked

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: of all neighbours whose join is a piece the best scored, leftmost first."""
        symbols, never = list(text), float("-inf")
        ids, scores = self.ids, self.vocabulary.scores

        def worth(i: int) -> float:
            joined = ids.get(symbols[i] + symbols[i + 1])
            return never if joined is None else scores[joined]

        joins = [worth(i) for i in range(len(symbols) - 1)]
        while joins:
            best = max(joins)
            if best == never:
                break
            at = joins.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = worth(at - 1)
            if at < len(joins):
                joins[at] = worth(at)
        return [ids.get(s, -1) for s in symbols]

    def may_follow(self, piece: int, after: int) -> bool:
        """Pair weight is zero rather than infinite; -1 stands for a character of the byte fallback or the start."""
        key = (after << 32) + piece
        known = self._pairs.get(key)
        if known is None:
            own = self.vocabulary.pieces[piece]
            if after < 0:
                known = self.merged(own) == [piece]
            else:
                known = self.may_follow(piece, -1) and self.merged(self.vocabulary.pieces[after] + own) == [after, piece]
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _only_path(self, part: str) -> tuple[list, list[int]]:
        """Last piece and its begin on the one path of weight zero to each place (BPE)."""
        size, pairs, longest = len(part), self._pairs, self.longest
        last: list = [None] * (size + 1)
        last[0] = -1
        begin = [0] * (size + 1)
        for i in range(size):
            after, node, j = last[i], self.lexicon, i
            key = after << 32
            for c in part[i : i + longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                if last[j] is None:
                    piece = node.get("")
                    if piece is not None:
                        fits = pairs.get(key + piece)
                        if fits or (fits is None and self.may_follow(piece, after)):
                            last[j], begin[j] = piece, i
            if last[i + 1] is None:  # no piece holds the character
                last[i + 1], begin[i + 1] = -1, i
        return last, begin

    def _lightest_path(self, part: str) -> tuple[list, list[int]]:
        """Last piece and its begin on the lightest path to each place (unigram)."""
        size, scores = len(part), self.vocabulary.scores
        weight = [0.0] + [float("inf")] * size
        last, begin = [-1] * (size + 1), [0] * (size + 1)
        for i in range(size):
            node = self.lexicon
            for j in range(i + 1, size + 1):
                node = node.get(part[j - 1])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None and weight[i] - scores[piece] < weight[j]:
                    weight[j], last[j], begin[j] = weight[i] - scores[piece], piece, i
            if part[i] not in self.ids and weight[i] + self.unknown_weight < weight[i + 1]:
                weight[i + 1], last[i + 1], begin[i + 1] = weight[i] + self.unknown_weight, -1, i
        return last, begin

    def shortest_path(self, part: str) -> list[int]:
        """Ids along the shortest path through the composition of ``part`` with the machines."""
        last, begin = (self._only_path if self.vocabulary.kind == BPE else self._lightest_path)(part)
        ids: list[int] = []
        at = len(part)
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids += self.fallback(part[begin[at] : at])[::-1]
            at = begin[at]
        ids.reverse()
        return ids

    def fallback(self, character: str) -> list[int]:
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode()]

    def _part(self, part: str) -> bytes:
        """Ids of a part; the parts last met stay in two generations of bounded size."""
        found = self._older.get(part)
        if found is None:
            found = np.array(self.shortest_path(part), np.int32).tobytes()
        if len(part) <= LONGEST:
            if len(self._memory) >= self.remembered:
                self._older, self._memory = self._memory, {}
            self._memory[part] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null and empty texts."""
        text = self.normalise(text or "")
        parts: Iterable[str] = self.parts.findall(text) if self.parts else [text] if text else []
        # the young memory may be replaced on the way; what the old one still finds is right all the same
        known = self._memory.get
        return np.frombuffer(b"".join([known(p) or self._part(p) for p in parts]), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        texts = self.texts
        text = b"".join([texts[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


class _Workers:
    """One transducer in a worker, whose memory outlives a task."""

    held: tuple[Vocabulary, Transducer] | None = None

    @classmethod
    def transducer(cls, vocabulary: Vocabulary) -> Transducer:
        if cls.held is None or cls.held[0] != vocabulary:
            cls.held = vocabulary, Transducer(vocabulary)
        return cls.held[1]


PIECE_TEXTS = 256


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digest: bool = False) -> DataFrame:
    """Columns ``keep`` of every document with n_tokens and, as asked for, the token ids (array<int>) or their
    digest: ids_md5 (over little-endian 32-bit ids), n_chars and ``exact`` (decoding gives the text back, which only a
    text with the space mark itself, or one whose spaces the model squeezes, does not).  Null text counts as empty:
    no tokens.  Repeated rows agree, no rows give none; columns not in ``keep`` are left behind.  One pass, no shuffle."""
    added = [("n_tokens", "long")] + [("ids", "array<int>")] * ids + [("n_chars", "long"), ("ids_md5", "string"), ("exact", "boolean")] * digest
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {t}" for n, t in added])

    def encoded(batches):
        machine = _Workers.transducer(vocabulary)
        for whole in batches:
            for begin in range(0, whole.num_rows, PIECE_TEXTS):
                batch = whole.slice(begin, PIECE_TEXTS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = [machine.encode(t) for t in texts]
                sizes = np.array([len(f) for f in found], np.int64)
                columns = [*(batch.column(c) for c in keep), pa.array(sizes)]
                if ids:
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))))
                if digest:
                    columns += [
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([md5(f.tobytes()).hexdigest() for f in found]),
                        pa.array([machine.decode(f.tolist()) == t for f, t in zip(found, texts)]),
                    ]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *(n for n, _ in added)])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The rows with ``text`` instead of the ids; null ids give null, none the empty text.  Other columns stay, but for one
    named text.  Repeated rows agree, no rows give none."""
    kept = [c for c in encoded.columns if c not in (ids, "text")]
    schema = ", ".join([f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept] + ["text string"])

    def decoded(batches):
        machine = _Workers.transducer(vocabulary)
        for batch in (whole.slice(begin, PIECE_TEXTS) for whole in batches for begin in range(0, whole.num_rows, PIECE_TEXTS)):
            texts = [None if x is None else machine.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return encoded.select(*kept, ids).mapInArrow(decoded, schema)
