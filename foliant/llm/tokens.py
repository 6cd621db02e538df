"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut before a blank or a line feed that follows a character which no definition counts as white space. Both
vocabularies split there anyway before their merges, so the ids of the pieces in a row are the ids of the text. The strings of
special tokens hold no blanks, so they stay whole in their piece and get their own ids, as in the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliant.llm.arrow import flatten

#: A worker forgets its pieces beyond so many.
MAX_PIECES = 500_000
#: Where a text may be cut.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Texts with other white space than single blanks and line feeds between words.
ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
#: 1 for a blank and a line feed, 2 for bytes with which the other white space begins.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x0A]] = 1
KIND[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = 2
#: A key after these is the piece as it stands; other keys stand for a line's first word with its line feed, or a word with a blank before it.
RAW = "  "
#: How vocabularies write the end of a word, or a blank at its beginning.
WORD_END, BLANK = "</w>", "\u0120"
#: Pieces that may be encoded in a row: letters, then punctuation (where tokens end words), or no white space but the first blank.
UNITS = r"^[ \n](?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<mark>[#$%&*|.,;:!?()-]*)$"
STRETCH = r"^ [!-;=-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def odd_texts(texts: pa.Array) -> np.ndarray:
    """Which texts are empty or match ODD; the expression is tried on those alone that hold a byte of it or two blanks in a row."""
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    odd, full = size == 0, np.flatnonzero(size)
    if len(full):
        flat = np.frombuffer(b"".join(texts.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8)
        ends = np.cumsum(size)[full]
        begin, kind = ends - size[full], KIND[flat]
        blank = kind == 1
        twice = np.append(blank[1:] & blank[:-1], False)
        twice[ends - 1] = False
        odd[full] = np.logical_or.reduceat((kind == 2) | twice, begin) | blank[begin] | blank[ends - 1]
    look = np.flatnonzero(odd & (size > 0))
    odd[look] = pc.match_substring_regex(texts.take(pa.array(look)), ODD).to_numpy(zero_copy_only=False)
    return odd


class Encoder(dict):
    """piece -> number of the piece; the ids of all pieces stand in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge_ends = any(t.endswith(WORD_END) for t in tokens)
        self.edge = np.zeros(max(tokens.values()) + 1, bool)
        self.edge[[k for t, k in tokens.items() if (t.endswith(WORD_END) if self.edge_ends else t.startswith(BLANK))]] = True
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A\u00c0") == "a\u00e0"
        self.reset()

    def reset(self):
        self.clear()
        self.fresh: list[str] = []
        self.offset, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(" " + piece if piece[:1] > " " else piece[len(RAW) :] if piece[:2] == RAW else piece if piece[:1] == "\n" else " " + piece)
        return n

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pieces in a row, and each text's number of pieces.

        Plain texts are split and their distinct words found by Arrow, so that Python sees each word of a batch once.
        """
        plain = ~odd_texts(texts)
        split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        n = split.value_lengths().to_numpy().astype(np.int64)
        index, first = coded.indices.to_numpy(), np.cumsum(n) - n
        inner = np.ones(len(index), bool)
        inner[first] = False
        met = np.flatnonzero(np.bincount(index[inner], minlength=len(coded.dictionary)))
        known = np.full(len(coded.dictionary), -1, np.int64)
        known[met] = list(map(self.__getitem__, strings(coded.dictionary.take(pa.array(met)))))
        own = known[index]
        own[first] = [self[RAW + w] for w in strings(coded.take(pa.array(first)).cast(pa.string()))]
        if plain.all():
            return own, n
        odd = [[self[RAW + p] for p in CUT.split(t)] if t else [] for t in texts.filter(pa.array(~plain)).to_pylist()]
        n_pieces = np.empty(len(plain), np.int64)
        n_pieces[plain], n_pieces[~plain] = n, list(map(len, odd))
        number, of_plain = np.empty(n_pieces.sum(), np.int64), np.repeat(plain, n_pieces)
        number[of_plain], number[~of_plain] = own, [k for ks in odd for k in ks]
        return number, n_pieces

    def alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and the number of each piece's, every piece encoded by itself."""
        rows = [e.ids for k in range(0, len(pieces), 20_000) for e in self.tokenizer.encode_batch_fast(pieces[k : k + 20_000], add_special_tokens=False)]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(n.sum())), n

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for strings whose ids end in one that ends a word, or begin with one that begins a word, after a blank, with no other such id.

        They are encoded in rows of 500, and those ids say where each string's ids are. In a row with another number of such ids each is encoded by itself.
        """
        rows = [[" " + u for u in units[k : k + 500]] for k in range(0, len(units), 500)]
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            edge = np.flatnonzero(self.edge[ids])
            n = np.diff(edge, prepend=-1) if self.edge_ends else np.diff(edge, append=len(ids))
            if len(edge) != len(row):
                ids, n = self.alone(row)
            found.append(ids)
            sizes.append(n)
        return np.concatenate(found), np.concatenate(sizes)

    def learn(self) -> None:
        """Encode the pieces met for the first time.

        Where tokens end words, white space has no ids, and letters and the punctuation after them are units of their own: each distinct unit is
        encoded once, in lower case if the vocabulary has no other. Where blanks begin tokens, a piece without other white space is one unit.
        """
        fresh = pa.array(self.fresh, pa.string())
        if self.edge_ends:
            split = pc.extract_regex(fresh, UNITS)
            fits = split.is_valid().to_numpy(zero_copy_only=False)
            split = split.filter(pa.array(fits))
            halves = pa.concat_arrays([pc.struct_field(split, "word"), pc.struct_field(split, "mark")])
            coded = (pc.utf8_lower(halves) if self.lowers else halves).dictionary_encode()
            units, of_piece = strings(coded.dictionary), coded.indices.to_numpy().reshape(2, -1)
            solid = np.array([bool(u) for u in units], bool)
            ids, sizes = self.together([u for u in units if u])
            n = np.zeros(len(units), np.int64)
            n[solid] = sizes
            ids, n = ids[flatten(of_piece.T.ravel(), np.cumsum(n) - n, n)], n[of_piece].sum(axis=0)
        else:
            fits = pc.match_substring_regex(fresh, STRETCH).to_numpy(zero_copy_only=False)
            ids, n = self.together([p[1:] for p in strings(fresh.filter(pa.array(fits)))])
        others, n_others = self.alone(strings(fresh.filter(pa.array(~fits))))
        lengths, offset = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        lengths[fits], lengths[~fits] = n, n_others
        offset[fits], offset[~fits] = np.cumsum(n) - n, len(ids) + np.cumsum(n_others) - n_others
        self.offset, self.length = np.concatenate((self.offset, len(self.flat) + offset)), np.concatenate((self.length, lengths))
        self.flat = np.concatenate((self.flat, ids, others))
        self.fresh = []

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), and each text's number of ids."""
        if len(self) > MAX_PIECES:
            self.reset()
        number, n_pieces = self.numbers(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        if self.fresh:
            self.learn()
        ends = np.concatenate(([0], np.cumsum(self.length[number])))
        at = np.concatenate(([0], np.cumsum(n_pieces))).astype(np.int64)
        return self.flat[flatten(number, self.offset, self.length)], np.diff(ends[at])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Give back what the worker's encoders hold; those that are needed again load their vocabulary anew."""
    _ENCODERS.clear()
