"""Encoding and decoding with merge-type (BPE) sentencepiece vocabularies.

An agenda holds the adjacent pairs of symbols that join to a piece of the vocabulary; the pair of the highest
score (of equals the leftmost) is merged first, and its new neighbours join the agenda, until none is left.
In every batch the sentencepiece library encodes and decodes the rows too, all unless told otherwise; if it differs in one of
them, the whole batch is the library's and its rows that differ are marked.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import expand, release, slices

SPACE = "▁"
#: Words that a worker remembers the ids of before it starts anew; characters of words that are merged many at a time.
WORDS_KEPT = 600_000
MERGED_TOGETHER = 48
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: One in so many rows is checked against the library, by the checksum of its text; 1 checks all.
CHECK_EVERY = 1
_NEVER = 1 << 62
_LOW = (1 << 20) - 1


class Vocabulary:
    """The pieces of one model file, and the two directions."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, kind = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a merge-type model without normalisation rules is needed")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: -p.score for p in proto.pieces if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("user-defined and unused pieces, or blanks within pieces, are not handled")
        self.unknown = self.library.unk_id()
        # Pairs of ids that join to a piece, sorted; for each where the piece stands in the order of scores, and its id.
        order = {s: k for k, s in enumerate(sorted({*self.scores.values()}))}
        pairs = {}
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = order[self.scores[piece]] << 20 | k
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.char_ids = np.full(0x110000, -1, np.int64)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = k
        self.end = self.library.eos_id()
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == kind.BYTE} if proto.trainer_spec.byte_fallback else {}
        self.words = _words(self.ids)
        self.text = [" " + proto.trainer_spec.unk_surface.strip() + " " if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ") if p.type == kind.NORMAL else "" for p in proto.pieces]
        for b, k in self.bytes.items():
            self.text[k] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.forget()

    def forget(self) -> None:
        """The words known so far, each with its number, and the ids of word number k: flat[starts[k]:starts[k + 1]]."""
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.decoded: list[str] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, each with the end id last, and where each begins (one more for the end)."""
        return self.both(texts)[:2]

    def both(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids and where each text's begin, and the texts that the ids decode to: no word's ids share a character with another's."""
        words = [self.words.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        every = list(itertools.chain.from_iterable(words))
        if len(self.known) > WORDS_KEPT:
            self.forget()
        self._learn(list({*every}.difference(self.known)))
        number = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        size = self.starts[number + 1] - self.starts[number]
        _, at = expand(self.starts[number], size)
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(size)])[last] + np.arange(1, len(words) + 1)])
        out = np.full(offsets[-1], self.end, np.int32)
        own = np.ones(len(out), np.bool_)
        own[offsets[1:] - 1] = False
        out[own] = self.flat[at]
        read = list(map(self.decoded.__getitem__, number.tolist()))
        whole = ["".join(read[a:b]) for a, b in itertools.pairwise([0, *last.tolist()])]
        return out, offsets, [t[1:] if self.prefix and t.startswith(" ") else t for t in whole]

    def _learn(self, words: list[str]) -> None:
        """Merges new words and adds them to those known."""
        if not words:
            return
        size = np.fromiter(map(len, words), np.int64, len(words))
        blanks = SPACE + SPACE
        runs = np.fromiter((blanks in w for w in words), np.bool_, len(words)) if blanks in "".join(words) else np.zeros(len(words), np.bool_)
        done, counts, flat = self._merge_short(words, np.flatnonzero((size <= MERGED_TOGETHER) & ~runs), size)
        rest = np.setdiff1d(np.arange(len(words)), done)
        long = [self.merge(words[k]) for k in rest]
        counts = np.concatenate([counts, np.array([len(x) for x in long], np.int64)])
        flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(long), np.int32)])
        order = np.argsort(np.concatenate([done, rest]), kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        flat = flat[expand(begin, counts)[1]]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        ends = np.cumsum(counts)
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        # Words merged in the table consist of ordinary pieces, whose texts joined are the word; others are read from their ids.
        read = [w.replace(SPACE, " ") for w in words]
        for k, ids in zip(rest.tolist(), long, strict=True):
            read[k] = self._text(ids)
        self.decoded += read

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], _NEVER)

    def _merge_short(self, words: list[str], chosen: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen words which are done, how many ids each has, and the ids: each word has its agenda in a row of a table.

        Words of one length merge the least entry of their rows together, so all rows stay equally long; a row
        without an entry is done. Words with a character that is no piece are left to the heap.
        """
        none = np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none.astype(np.int32))]
        size = size[chosen]
        for n in np.unique(size).tolist():
            names = chosen[size == n]
            symbols = self.char_ids[np.frombuffer("".join([words[k] for k in names]).encode("utf-32-le"), np.uint32)].reshape(len(names), n)
            whole = (symbols >= 0).all(axis=1)
            names, symbols = names[whole], symbols[whole]
            agenda = self._find(symbols[:, :-1], symbols[:, 1:])
            while len(names):
                m = symbols.shape[1]
                row = np.arange(len(names))
                least = agenda.argmin(axis=1) if m > 1 else np.zeros(len(names), np.int64)
                best = agenda[row, least] if m > 1 else np.full(len(names), _NEVER)
                done = best == _NEVER
                if done.any():
                    parts.append((names[done], np.full(np.count_nonzero(done), m), symbols[done].astype(np.int32).ravel()))
                    names, symbols, agenda, least, best = (x[~done] for x in (names, symbols, agenda, least, best))
                    row = np.arange(len(names))
                if not len(names):
                    break
                k = least[:, None]
                symbols = np.take_along_axis(symbols, np.arange(m - 1) + (np.arange(m - 1) > k), axis=1)
                agenda = np.take_along_axis(agenda, np.arange(m - 2) + (np.arange(m - 2) >= k), axis=1)
                symbols[row, least] = best & _LOW
                for side in (0, -1):  # the pairs that the new symbol makes with its neighbours
                    fits = (least + side >= 0) & (least + side < m - 2)
                    r, c = row[fits], least[fits] + side
                    agenda[r, c] = self._find(symbols[r, c], symbols[r, c + 1])
        done, counts, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        return done, counts, flat

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word of any length: the agenda is a heap."""
        symbols: list[str] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores = self.scores
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (score := scores.get(pair)) is not None:
                agenda.append((score, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                joined = pair + symbols[k]
                if (score := scores.get(joined)) is not None:
                    heapq.heappush(agenda, (score, i, k, joined))
            h = before[i]
            if h >= 0:
                joined = symbols[h] + pair
                if (score := scores.get(joined)) is not None:
                    heapq.heappush(agenda, (score, h, i, joined))
        out: list[int] = []
        for s in symbols:
            if s:
                k = self.ids.get(s)
                if k is not None:
                    out.append(k)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(self.unknown)
        return tuple(out)

    def _text(self, ids) -> str:
        """Pieces joined, bytes put together, control ids left out."""
        out = "".join([self.text[k] for k in ids])
        if not out.isascii():
            try:
                out.encode()
            except UnicodeEncodeError:
                out = out.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank before its first word."""
        out = self._text(ids)
        return out[1:] if self.prefix and out.startswith(" ") else out


def _words(pieces: dict[str, int]) -> re.Pattern:
    """Cuts a text where no piece can join: after a blank's run has ended, and between characters of kinds that no piece has side by side.

    Kinds are the components of the graph that links two characters if some piece has one after the other:
    those without a letter or digit are marks; line breaks and digits stand alone if nothing joins them.
    """
    kind: dict[str, str] = {}

    def find(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for piece in pieces:
        for x, y in zip(piece, piece[1:], strict=False):
            if x != SPACE and x != y:
                kind[find(x)] = find(y)
        if len(piece) > 1 and piece[-1] == piece[-2] != SPACE:
            find(piece[-1])
    joined = {c for p in pieces if len(p.lstrip(SPACE)) > 1 for c in p if c != SPACE}
    members: dict[str, list[str]] = {}
    for c in joined:
        members.setdefault(find(c), []).append(c)
    marks = "".join(re.escape(c) for own in members.values() if not any(c.isalnum() for c in own) for c in own)
    alone = "".join(re.escape(c) for c in "\n0123456789" if c not in joined)
    parts = [f"{SPACE}*[{alone}]"] * bool(alone) + [f"{SPACE}*[{marks}]+"] * bool(marks)
    return re.compile("|".join([*parts, f"{SPACE}*[^{SPACE}{alone}{marks}]+", f"{SPACE}+"]))


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One for each worker process, so that what it has learned about words is used again."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(model)
    return _loaded[key]


def checked(vocabulary: Vocabulary, texts: list[str], check_every: int) -> tuple[np.ndarray, np.ndarray, list[str], list[bool | None]]:
    """What Vocabulary.both returns, held against the library in one of so many texts, or in all if one differs."""
    flat, offsets, decoded = vocabulary.both(texts)
    agrees: list[bool | None] = [None] * len(texts)
    for every in (check_every, 1):
        rows = [k for k, t in enumerate(texts) if every == 1 or zlib.crc32(t.encode()) % every == 0]
        right = vocabulary.library.encode([texts[k] for k in rows], out_type="numpy", add_eos=True, num_threads=1) if rows else []
        read = vocabulary.library.decode(right, num_threads=1) if rows else []
        for k, ids, text in zip(rows, right, read, strict=True):
            agrees[k] = decoded[k] == text and np.array_equal(flat[offsets[k] : offsets[k + 1]], ids)
        if False not in agrees:
            return flat, offsets, decoded, agrees
    offsets = np.cumsum([0, *map(len, right)])
    return np.concatenate(right).astype(np.int32), offsets, read, agrees


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", check_every: int = CHECK_EVERY) -> DataFrame:
    """One row for each row of docs: its id, ids (array of int, end id last), decoded (string) and agrees.

    agrees tells whether the library gives the same ids and the same decoded text, null where it was not asked;
    where it differs, the library's are returned for the batch. Null counts as an empty text, whose only id is the end id. Repeated rows get equal
    results; other columns are not read. The model file is read by the driver and sent to the executors.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model.value)
        for batch in slices(batches, "text", SLICE):
            texts = [t or "" for t in batch["text"].to_pylist()]
            flat, offsets, decoded, agrees = checked(vocabulary, texts, check_every)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["id", "ids", "decoded", "agrees"])
        vocabulary.forget()
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string, agrees boolean").withColumnRenamed("id", id_col)


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, from encode_texts."""
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
