"""Operator 12: SentencePiece ids of whole texts by backtracking over longest matches, and the texts decoded from them.

The model merges, again and again, the adjacent pair whose joined piece has the best score. A sequence of pieces is its
result if and only if each adjacent pair is: merging starts alike on both sides of a place where nothing merges across.
So pieces are taken from the left, the longest match first (found for all places by an Aho-Corasick automaton); a piece
stays if merging it together with the one before gives just these two, else its next shorter prefix is tried. Where no
prefix fits, the place is marked in a bitfield of failed positions and the piece before is shortened; a marked place is
never reached again, so each is left once.

Texts are cut where no piece of the model holds the two characters side by side (before most blanks, around line ends,
between most letters and marks); each different part of a group of texts is encoded once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped
from .tokens import _gather

#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 16 << 20
#: The model's sign for a blank; inside this module a blank stands for itself.
_BLANK = "▁"


class Pieces:
    """encode(texts) -> ids equal to the library's, for BPE models with byte fallback and unchanged (identity) texts.

    From one call to the next at most `limit` words and as many checked pairs are kept."""

    def __init__(self, path: str, limit: int = 300_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.lib, self.limit = SentencePieceProcessor(model_file=path), limit
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        kind, norm = model.trainer_spec, model.normalizer_spec
        types = {p.type for p in model.pieces}
        if kind.model_type != kind.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not types <= {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback, without text changes and without own symbols")
        self.prefix = " " if norm.add_dummy_prefix else ""
        normal = [(p.piece.replace(_BLANK, " "), i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self.ids, self.score = {t: i for t, i, _ in normal}, {t: s for t, _, s in normal}
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joined = self._joined()
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, int] = {}

    def _joined(self) -> np.ndarray:
        """Whether some piece may hold two bytes side by side: where none does, nothing is ever merged across.

        Characters beyond ASCII are not told apart; inside a character bytes stay together."""
        inside = {(min(ord(a), 128), min(ord(b), 128)) for t in self.ids for a, b in zip(t, t[1:])}
        out = np.zeros((256, 256), bool)
        for a, b in inside:
            out[a if a < 128 else slice(128, 256), b if b < 128 else slice(192, 256)] = True
        out[:, 128:192] = True  # bytes that go on with a character
        return out

    def merged(self, text: str) -> list[str]:
        """A short text by the model's own rule: the pair of the best score, the leftmost of equals, until there is none."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            at, best = -1, 0.0
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (at < 0 or s > best):
                    at, best = k, s
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: str, piece: str) -> bool:
        """Whether merging both together gives just these; without a last one, whether merging gives the piece."""
        ok = self.pairs.get((last, piece))
        if ok is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            ok = self.pairs[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return ok

    def next_size(self, piece: str) -> int:
        """The length of its longest proper prefix that is a piece, or one character; 0 of a single character."""
        size = self.shorter.get(piece)
        if size is None:
            size = len(piece) - 1
            while size > 1 and piece[:size] not in self.ids:
                size -= 1
            if piece in self.ids:
                self.shorter[piece] = size
        return size

    def split(self, word: str) -> list[str]:
        """The pieces of a word; characters that no piece holds come alone."""
        n = len(word)
        longest = [1] * (n + 1)
        for end, size in self.automaton.iter(word):
            longest[end - size + 1] = size  # ends ascend: the last is the longest
        failed, pieces, at, size = bytearray(n // 8 + 1), [], 0, longest[0]
        while at < n:
            last = pieces[-1] if pieces else ""
            while size:
                end = at + size
                piece = word[at:end]
                if not failed[end >> 3] >> (end & 7) & 1 and self.fits(last, piece):
                    pieces.append(piece)
                    at, size = end, longest[end]
                    break
                size = self.next_size(piece)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                pieces.pop()
                at, size = at - len(last), len(last)  # its end has failed: its next prefix follows
        return pieces

    def word_ids(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = []
            for piece in self.split(word):
                own = self.ids.get(piece)
                ids += [own] if own is not None else [self.bytes[b] for b in piece.encode()]
            if len(word) <= 64:
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (null and empty texts have none), and where each one's begin, and the end."""
        texts = pc.replace_substring(texts.fill_null("").cast(pa.string()), _BLANK, " ")
        prefixed = pc.binary_join_element_wise(pa.scalar(self.prefix), texts, "")
        texts = pa.concat_arrays([pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, prefixed)])
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        lo, hi = int(ends[0]), int(ends[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        begins = np.zeros(len(data), bool)
        begins[(ends[:-1] - lo)[np.diff(ends) > 0]] = True
        begins[1:] |= ~self.joined[data[:-1], data[1:]]
        places = np.r_[np.flatnonzero(begins), len(data)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        lists = list(map(self.word_ids, words.dictionary.to_pylist()))
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, at = np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), words.indices.to_numpy()
        first = np.searchsorted(places[:-1], ends - lo)  # the parts of a text begin at or after its own begin
        return _gather(flat, np.cumsum(lengths) - lengths, lengths, at), np.r_[0, np.cumsum(lengths[at])][first]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model a Python worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int, the model's end id last) and decoded (the text that the library decodes from them) of
    each row of docs (doc_id, text), whole texts, one row for each row.

    Null and empty texts have the end id alone and decode to an empty text; rows of equal or null doc_id stay apart;
    other columns are ignored; no documents give no rows. A very long text that is one part (letters without blanks) takes time in
    proportion to its length. Models other than BPE with byte fallback and identity normalisation are a ValueError."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        end = model.lib.eos_id()
        for b in grouped(batches, 1, GROUP_BYTES):
            ids, places = model.encode(b.column(1))
            ids, places = np.insert(ids, places[1:], end).astype(np.int32), places + np.arange(len(places))
            decoded = [model.lib.decode(ids[lo:hi].tolist()) for lo, hi in zip(places.tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, and SHA-256 of the decimal ids joined by a blank and of the decoded text, of rows of `encode`."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
