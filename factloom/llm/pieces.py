"""SentencePiece encoding with source spans, and decoding.

Text is normalised by the longest prefix that the model's compiled character
map holds at each place; every normalised byte remembers the source byte its
rule began at. Byte-pair merges then run on the normalised text, and each piece
takes the source span between the places of its first byte and of the byte
after it, as the sentencepiece library reports them.

A merge needs a piece that reads across the two symbols, so a text may be cut
wherever no piece of the vocabulary reads on: before a word mark, and around
characters that only stand alone. Words are merged once and remembered, in a
table of bounded size. Only models of the BPE
type whose pieces carry the word mark in front are taken; others raise an error.

Rows: null text is empty text and has no ids. Any length of text is one row; only
one batch is in memory. Repeated rows are each encoded. All other columns pass
through; a column named like a result is replaced by it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words of a generation whose ids a worker remembers.
REMEMBERED = 1 << 17
#: Bytes of text, or of ids, that are worked on and handed on at once.
SLICE = 2 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path() -> str:
    return public_tokenizers.path(MODEL)


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 and its targets.

    The blob is the trie's size in bytes, its 32-bit units, then targets that
    end in a zero byte. A unit holds a child offset (with a flag that widens
    it), a leaf flag and a label; the unit of a leaf is the target's place.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.targets = blob[4 + size :]
        self.first = {b for b in range(1, 256) if self._child(self._root(), b) is not None} if self.units else set()

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _child(self, at: int, byte: int) -> int | None:
        """Place of the child's unit, if the label agrees."""
        place = at ^ byte
        if place >= len(self.units) or self.units[place] & 0x800000FF != byte:
            return None
        return place

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix with a rule, and its target."""
        found = None
        at = self._root()
        for i in range(start, len(data)):
            place = self._child(at, data[i])
            if place is None:
                break
            unit = self.units[place]
            at = place ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[at] & 0x7FFFFFFF
                found = i + 1 - start, self.targets[value : self.targets.index(b"\0", value)]
        return found


class Decoder:
    """Texts of the ids of one model file."""

    def __init__(self, blob: bytes):
        model = model_pb.ModelProto()
        model.ParseFromString(blob)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        shown = {NORMAL: lambda p: p.piece.replace(MARK, " "), CONTROL: lambda p: "", UNKNOWN: lambda p: trainer.unk_surface or " ⁇ "}
        self.shown = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else shown.get(p.type, shown[NORMAL])(p).encode() for p in model.pieces]
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.is_control = np.array([p.type == CONTROL for p in model.pieces])

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: marks are spaces, the one in front goes, byte pieces that make no UTF-8 become U+FFFD each."""
        shown = self.shown
        listed = ids.tolist()
        parts = [shown[i] for i in listed]
        if self.dummy or self.squeeze:
            # The mark in front is the dummy prefix. With space squeezed out, pieces that are only a mark go too.
            for k, i in enumerate(listed):
                if self.is_control[i]:
                    continue
                if not self.is_byte[i] and i != self.unknown:
                    parts[k] = parts[k].removeprefix(b" ")
                if not self.squeeze or parts[k]:
                    break
        out = b"".join(parts)
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._mended(listed, parts)

    def _mended(self, ids: list[int], parts: list[bytes]) -> str:
        """Runs of byte pieces on their own, as bytes of other pieces never complete them."""
        out, run = [], bytearray()
        for i, part in zip(ids, parts, strict=True):
            if self.is_byte[i]:
                run += part
                continue
            out.append(_utf8(bytes(run)))
            run.clear()
            out.append(part.decode("utf-8", "replace"))
        return "".join(out) + _utf8(bytes(run))


class Encoder:
    """Pieces of texts under one model file, with the source bytes of each."""

    def __init__(self, blob: bytes):
        model = model_pb.ModelProto()
        model.ParseFromString(blob)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != model_pb.TrainerSpec.BPE or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only BPE models with the word mark in front")
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces) or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("only models whose pieces keep within a word, without user-defined or unused pieces")
        self.chars = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.fallback = trainer.byte_fallback
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.sizes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        # Characters of no longer piece never merge: words end before and after them.
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        inner = "".join(map(re.escape, sorted(joined))) or MARK
        self.words = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|[^{inner}{MARK}]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._rank_pieces()

    # --- normalisation ---

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the source byte."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.chars.first and not self.squeeze:
            return self._plain(text, data)
        parts, where, at, spaced = [], [], 0, False
        end = len(data)
        if self.squeeze:
            while at < end:  # leading space, also such as a rule makes
                n, target = self._step(data, at)
                if target != b" ":
                    break
                at += n
        if at == end:
            return "", np.array([at])
        mark = MARK.encode()
        if self.dummy:
            parts.append(mark)
            where += [at] * len(mark)
        spaced = self.squeeze
        while at < end:
            n, target = self._step(data, at)
            while spaced and target.startswith(b" "):
                target = target[1:]
            if target:
                spaced = self.squeeze and target.endswith(b" ")
                target = target.replace(b" ", mark)
                parts.append(target)
                where += [at] * len(target)
            at += n
        out = b"".join(parts)
        if self.squeeze:
            while out.endswith(mark):
                out = out[: -len(mark)]
                at = where[len(out)]
                del where[len(out) :]
        return out.decode("utf-8", "surrogatepass"), np.array([*where, at])

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes taken by the next rule, or by one character, and what they become."""
        if data[at] in self.chars.first and (rule := self.chars.longest(data, at)):
            return rule
        lead = data[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """The same without rules: only spaces change, from one byte to three."""
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        place = np.arange(len(raw))
        starts = np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, place)) if raw.max() >= 0x80 else place
        where = np.repeat(starts, np.where(raw == 32, 3, 1))
        front = [0] * 3 if self.dummy else []
        return (MARK if self.dummy else "") + text.replace(" ", MARK), np.concatenate([np.array(front, dtype=np.int64), where, [len(raw)]])

    # --- merges ---

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the best adjacent merge first, the leftmost of equals."""
        symbols: list[str | None] = list(word)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        queue: list[tuple[float, int, str]] = []
        ids = self.ids

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (found := ids.get(symbols[left] + symbols[right])):
                heapq.heappush(queue, (-found[1], left, symbols[left] + symbols[right]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, left, piece = heapq.heappop(queue)
            right = after[left] if symbols[left] is not None else -1
            if right < 0 or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if found := ids.get(s):
                out.append(found[0])
            elif self.fallback:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def _rank_pieces(self) -> None:
        """The same merges by a compiled library for words of one-byte (Latin-1) characters.

        Pieces are ranked by score and the mark is a space, one byte per
        character, so merging the lowest rank first, leftmost of equals, is the
        same rule. The library takes a word that is a piece as a whole; pieces
        whose own merges end elsewhere are listed.
        """
        single = sorted((p for p in self.ids if all(c == MARK or c != " " and ord(c) < 256 for c in p) and p.count(MARK) < 2), key=lambda p: (-self.ids[p][1], self.ids[p][0]))
        ranks = {p.replace(MARK, " ").encode("latin-1"): n for n, p in enumerate(single)}
        shown = [np.array([self.ids[p][0]], dtype="<i4").tobytes() for p in single]
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = len(ranks)
                shown.append(np.array(self.merge(chr(b)), dtype="<i4").tobytes())
        self._fast = tiktoken.Encoding("own", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._shown = shown
        self._elsewhere = {p for p in single if self.merge(p) != [self.ids[p][0]]}

    def _merged(self, word: str) -> bytes:
        if word not in self._elsewhere and MARK not in word[1:]:
            try:
                return b"".join([self._shown[r] for r in self._fast(word.replace(MARK, " ").encode("latin-1"))])
            except UnicodeEncodeError:
                pass
        return np.array(self.merge(word), dtype="<i4").tobytes()

    def _ids_of(self, word: str) -> bytes:
        """Ids as bytes; the table has two generations, and words in use move on to the next."""
        got = self.older.get(word)
        if got is None:
            got = self._merged(word)
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source bytes where each piece begins and ends."""
        normal, where = self.normalise(text)
        none = np.zeros(0, dtype=np.int32)
        if not normal:
            return none, none, none
        words = self.words.findall(normal)
        get = self.known.get
        found = [get(w) or self._ids_of(w) for w in words]
        ids = np.frombuffer(b"".join(found), dtype="<i4")
        if self.fallback:
            ends = np.cumsum(self.sizes[ids])
        else:
            ids, ends = self._joined_unknowns(ids, normal)
        begins = np.concatenate([[0], ends[:-1]])
        return ids, where[begins].astype(np.int32), where[ends].astype(np.int32)

    def _joined_unknowns(self, ids: np.ndarray, normal: str) -> tuple[np.ndarray, np.ndarray]:
        """Without byte pieces, neighbouring unknown characters are one piece."""
        out, ends, at, pos = [], [], 0, 0
        text = normal
        for i in ids.tolist():
            if i == self.unknown:
                size = len(text[pos].encode("utf-8", "surrogatepass"))
                pos += 1
            else:
                size = int(self.sizes[i])
                pos += len(text.encode("utf-8", "surrogatepass")[at : at + size].decode("utf-8", "surrogatepass"))
            at += size
            if i == self.unknown and out and out[-1] == i:
                ends[-1] = at
            else:
                out.append(i)
                ends.append(at)
        return np.array(out, dtype=np.int32), np.array(ends, dtype=np.int64)


def _utf8(run: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that starts no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    with open(path, "rb") as f:
        return Decoder(f.read())


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``SLICE`` bytes of one column; a longer value comes alone."""
    sizes = np.cumsum([0, *(x.as_buffer().size if isinstance(x, pa.StringScalar) and x.is_valid else 4 * len(x) if x.is_valid else 0 for x in batch.column(at))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _with_columns(df: DataFrame, at: int, added: dict[str, DataType], fn, left_out: tuple[str, ...] = ()) -> DataFrame:
    """The rows with columns that ``fn`` gives for a batch, in place of any of that name."""
    places = [i for i, c in enumerate(df.columns) if c.lower() not in added and c not in left_out]
    source = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    names = [f"c{i}" for i in places] + [f"r{k}" for k in range(len(added))]
    schema = StructType([source.schema[i] for i in places] + [StructField(f"r{k}", kind) for k, kind in enumerate(added.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                yield pa.record_batch([part.column(i) for i in places] + fn(part), names=names)

    return source.mapInArrow(run, schema).toDF(*[df.columns[i] for i in places], *added)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).astype(np.int32, copy=False) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """Columns ids, begins and ends: the pieces of each text and their source bytes [begin, end)."""
    path = path or model_path()
    at = df.columns.index(text)

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = encoder(path)
        found = [coder.encode(t or "") for t in batch.column(at).to_pylist()]
        return [_lists([f[k] for f in found]) for k in range(3)]

    return _with_columns(df, at, dict.fromkeys(("ids", "begins", "ends"), ArrayType(IntegerType())), encode, () if keep_text else (text,))


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Column decoded: the text of each row's ids; null ids are no ids."""
    path = path or model_path()
    at = df.columns.index(ids)

    def decode(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = decoder(path)
        return [pa.array([coder.decode(np.asarray(x.values)) if x.is_valid else "" for x in batch.column(at)], type=pa.string())]

    return _with_columns(df, at, {"decoded": StringType()}, decode)
