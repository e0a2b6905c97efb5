"""Exact token ids of whole texts by the tokenizers library, each different word of a group of texts encoded once."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import grouped

#: Characters of texts that are taken apart: no combining marks, no rare spaces, no letters of changing length.
_PLAIN = "[!-~¡-¬®-įĲ-ž]"
#: Letters, perhaps after a blank or line end, and the marks after them. No apostrophe, which may join letters.
_LETTERS_MARKS = r"^(?P<w>[ \n]?\pL+)(?P<t>[!-&(-/:-@\[-`{-~]*)$"
#: Words in one call of the library: long calls take it more time a word.
_TOGETHER = 64
#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 20 << 20


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The segments (starts, lengths) of flat, in the order of at, one after another."""
    own = lengths[at]
    ends = np.cumsum(own)
    kind = np.int32 if max(len(flat), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    place = np.repeat((starts[at] - (ends - own)).astype(kind), own)
    place += np.arange(len(place), dtype=kind)
    return flat[place]


class Encoder:
    """encode(texts) -> ids equal to the library's ids of each whole text.

    Both vocabularies split a text before each space that follows a non-space, so a text's ids are those of its
    blank-separated words one after another; a word of letters and marks after them splits once more. So the different
    words of many texts are found by Arrow, encoded by the library, many in one call, and put together by numpy. A text
    with other characters, with the string of an added token or, where spaces count, with white space at its ends or
    next to white space goes to the library whole. From one call to the next at most `limit` words and their ids are kept,
    as flat arrays of some 10 MB."""

    def __init__(self, path: str, keeps_space: bool, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.lib, self.keeps_space, self.limit = Tokenizer.from_file(path), keeps_space, limit
        self.known = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.lowers = "Lowercase" in repr(self.lib.normalizer)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.plain = f"^[ \n]?{_PLAIN}+$" if keeps_space else f"^{_PLAIN}*$"
        # tokens that only the first place of a word can have (space kept), or only the last
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t[:1] in ("Ġ", "Ċ") if keeps_space else t[-4:] == "</w>")]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (a null text has none), and where each one's begin, and the end."""
        texts = texts.fill_null("")
        if self.keeps_space:  # each word but a text's first has the white space before it
            words = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n"), "\x00")
        else:
            words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first = np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())]
        found = words.flatten().dictionary_encode()
        plain, at = pc.match_substring_regex(found.dictionary, self.plain).to_numpy(zero_copy_only=False), found.indices.to_numpy()
        whole = np.add.reduceat(~plain[at], first[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(whole & (pc.binary_length(texts).to_numpy() > 0))
        flat, starts, lengths = self._learn(found.dictionary, plain)
        ids, ends = _gather(flat, starts, lengths, at), np.r_[0, np.cumsum(lengths[at])][first]
        if not len(odd):
            return ids, ends
        parts = [ids[lo:hi] for lo, hi in zip(ends.tolist(), ends[1:].tolist())]
        for k, own in zip(odd.tolist(), self.whole(texts.take(pa.array(odd)).to_pylist())):
            parts[k] = own
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def _learn(self, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words: flat, starts, lengths. Words that aren't plain get none: their texts go whole."""
        words = pc.if_else(pa.array(plain), words, "")
        split = pc.extract_regex(words, _LETTERS_MARKS)
        matched = split.is_valid()
        letters, tails = pc.struct_field(split, "w"), pc.struct_field(split, "t")
        letters = pc.if_else(matched, pc.utf8_lower(letters) if self.lowers else letters, words).dictionary_encode()
        tails = pc.fill_null(tails, "").dictionary_encode()
        together = pc.match_substring_regex(letters.dictionary, "^[ \n]" if self.keeps_space else r"^\pL+$").to_numpy(zero_copy_only=False)
        joined = self._joined(letters.dictionary.filter(pa.array(together)))
        single = self.whole(letters.dictionary.filter(pa.array(~together)).to_pylist()) + self.whole(tails.dictionary.to_pylist())
        n_joined, n_alone = int(together.sum()), int((~together).sum())
        flat = np.concatenate([joined[0], *single, np.zeros(0, "<u4")])
        lengths = np.r_[joined[1], [len(x) for x in single]].astype(np.int64)
        place = np.empty(len(together), np.int64)
        place[together], place[~together] = np.arange(n_joined), n_joined + np.arange(n_alone)
        starts = np.cumsum(lengths) - lengths
        both = np.stack([place[letters.indices.to_numpy()], n_joined + n_alone + tails.indices.to_numpy()], 1)
        own = lengths[both].sum(1)
        return _gather(flat, starts, lengths, both.ravel()), np.cumsum(own) - own, own

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words of one kind, those that earlier calls had from memory."""
        at = pc.index_in(words, value_set=self.known[0]) if len(self.known[0]) else pa.nulls(len(words), pa.int32())
        fresh = words.filter(at.is_null())
        ids, lengths = self._encoded(fresh)
        had, flat, own = self.known
        flat, own = np.concatenate([flat, ids]), np.r_[own, lengths]
        at = at.to_numpy(zero_copy_only=False).astype(np.float64)
        at[np.isnan(at)] = len(had) + np.arange(len(fresh))
        at = at.astype(np.int64)
        starts = np.cumsum(own) - own
        self.known = pa.concat_arrays([had, fresh]), flat, own
        if len(own) > self.limit:  # the half that was learnt last stays
            old = len(own) - self.limit // 2
            self.known = pa.concat_arrays([self.known[0].slice(old)]), flat[starts[old] :].copy(), own[old:].copy()
        return _gather(flat, starts, own, at), own[at]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words that begin (space kept) or end with one token of `edge` each and hold no other."""
        n = len(words)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(0, n, _TOGETHER), n].astype(np.int32)), words)
        ids = np.concatenate([np.zeros(0, "<u4"), *self.whole(pc.binary_join(lists, "" if self.keeps_space else " ").to_pylist())])
        at = np.flatnonzero(self.edge[ids])
        if len(at) != n:
            alone = self.whole(words.to_pylist())
            return np.concatenate([np.zeros(0, "<u4"), *alone]), np.array([len(x) for x in alone], np.int64)
        return ids, np.diff(np.append(at, len(ids)) if self.keeps_space else np.append(-1, at))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder a Python worker."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = Encoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]


def encoded(batches: Iterator[pa.RecordBatch], path: str, keeps_space: bool, end_id: int) -> Iterator[tuple[list, list[bytes]]]:
    """Per group of rows (key, text, ...): the keys, and each text's ids and end_id as little-endian uint32 bytes."""
    enc, end = encoder(path, keeps_space), np.array([end_id], "<u4").tobytes()
    for rows in grouped(batches, 1, GROUP_BYTES):
        ids, ends = enc.encode(rows.column(1))
        yield rows.column(0).to_pylist(), [ids[lo:hi].tobytes() + end for lo, hi in zip(ends.tolist(), ends[1:].tolist())]


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
