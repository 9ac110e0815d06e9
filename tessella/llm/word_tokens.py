"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once a task.

The vocabularies meant here (``word_bpe``) drop white space, lower-case, and split text at it before
anything else, and neither Unicode composition nor lower-casing reaches across an ASCII blank; so
the ids of a text are the ids of its lower-cased, blank-separated words in a row. Arrow splits a block
of texts and finds its distinct words; a task keeps the ids of the words it has met (bounded) and sends
only new words to the library, many in one call with a separator whose single id stands for nothing
else. A text that holds a special string (``<|endoftext|>``) goes to the library as a whole, and so does
every text if the file's settings are others than :data:`SETTINGS`.
"""

from __future__ import annotations

import collections
import functools
import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task remembers; beyond this it forgets those met once, or all if too many are left.
MAX_WORDS = 300_000
#: Words in one call's text.
JOINED = 256
#: A control character that forms a word and a token by itself.
SEPARATOR = "\x01"
# The settings of a tokenizer file under which words may be encoded apart.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: ASCII marks that form one token piece of their own behind a letter or digit, so the word before them
#: is shared. The apostrophe is left out: it starts contractions.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: :func:`cut_marks` where it takes the marks off and no letter beyond ASCII is before them.
MARKED = r"[a-z0-9][!-&(-/:-@\[-`{-~]+$"


def cut_marks(word: bytes) -> tuple[bytes, bytes | None]:
    """A word without its trailing marks, and the marks; None where the two may not be encoded apart."""
    stem = word.rstrip(MARKS)
    if not stem or len(stem) == len(word):
        return word, None
    last = stem[-1]
    if 97 <= last <= 122 or 48 <= last <= 57 or last > 127 and (end := stem.decode()[-1]).isalpha() and end.lower().isalpha():
        return stem, word[len(stem) :]
    return word, None


def split_marks(words: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Every word without the marks that :func:`cut_marks` takes off, and the places of those that had any."""
    texts = pa.array(words, pa.binary()).cast(pa.string())
    marked = pc.match_substring_regex(texts, MARKED)
    stems = pc.if_else(marked, pc.ascii_rtrim(texts, MARKS.decode()), texts).cast(pa.binary()).to_pylist()
    cut = np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist()
    for i in np.flatnonzero(pc.match_substring_regex(texts, r"[^\x00-\x7F][!-&(-/:-@\[-`{-~]+$").to_numpy(zero_copy_only=False)).tolist():
        stems[i], marks = cut_marks(words[i])
        if marks is not None:
            cut.append(i)
    return stems, cut


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level model knows each byte: itself where visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Index(collections.defaultdict):
    """Numbers its keys from 0 in the order in which they are met."""

    def __init__(self, known=()):
        super().__init__(None, known)
        self.default_factory = itertools.count(len(self)).__next__


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        added = settings.get("added_tokens") or []
        self.by_words = all(settings.get(k) == v for k, v in SETTINGS.items()) and settings["model"]["type"] == "BPE" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.special = [t["content"] for t in added]
        ids = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = ids[0] if len(ids) == 1 else None
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.index, self.pieces = _Index(), _Index()
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: For each word the numbers of its one or two pieces; -1: no second piece.
        self.first, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The ids of each word, and how often it was met.
        self.word_starts, self.word_lengths, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.uses = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keeps what was met at least twice."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > MAX_WORDS // 2:
            return self._forget()
        words = list(self.index)
        self.index = _Index(zip([words[i] for i in keep.tolist()], range(len(keep))))
        used = np.unique(np.concatenate([self.first[keep], self.second[keep][self.second[keep] >= 0]]))
        pieces = list(self.pieces)
        self.pieces = _Index(zip([pieces[i] for i in used.tolist()], range(len(used))))
        self.first = np.searchsorted(used, self.first[keep])
        self.second = np.where(self.second[keep] < 0, -1, np.searchsorted(used, self.second[keep]))
        self.ids, ends = ragged_take(self.ids, self.starts, self.lengths, used)
        self.lengths = self.lengths[used]
        self.starts = ends - self.lengths
        self.word_ids, ends = ragged_take(self.word_ids, self.word_starts, self.word_lengths, keep)
        self.word_lengths = self.word_lengths[keep]
        self.word_starts = ends - self.word_lengths
        self.uses = self.uses[keep] // 2

    def _learn(self, words: list[bytes]) -> None:
        """Splits new words into pieces and encodes those that are new too."""
        known = len(self.pieces)
        stems, cut = split_marks(words)
        number = self.pieces.__getitem__
        first, second = np.fromiter(map(number, stems), np.int64, len(words)), np.full(len(words), -1)
        second[cut] = np.fromiter((number(words[i][len(stems[i]) :]) for i in cut), np.int64, len(cut))
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])
        self._encode_new(list(itertools.islice(self.pieces, known, None)))
        both = np.column_stack([first, second]).ravel()
        ids, ends = ragged_take(self.ids, self.starts, self.lengths, both[both >= 0])
        ends = ends[np.cumsum(1 + (second >= 0)) - 1]
        lengths = np.diff(ends, prepend=0)
        self.word_starts = np.concatenate([self.word_starts, ends - lengths + len(self.word_ids)])
        self.word_lengths = np.concatenate([self.word_lengths, lengths])
        self.word_ids = np.concatenate([self.word_ids, ids.astype(self.dtype)])

    def _as_letters(self, word: bytes) -> str | None:
        """What the model gets for a word of lower-case letters, not all ASCII, that the normaliser leaves as it is."""
        text = word.decode()
        if text.isalpha() and max(text) < "\u0530" and text.lower() == text and unicodedata.is_normalized("NFC", text):
            return word.decode("latin-1").translate(self.letters)
        return None

    def _encode_new(self, words: list[bytes]) -> None:
        """Appends the ids of the pieces ``words`` to what is known.

        Words of plain letters are one piece for the library's splitter and unchanged by its
        normaliser, so they go to its model at once; the rest goes through the whole tokenizer.
        """
        tokenize, known_ids, counts = self.model.tokenize, [], []
        texts = pa.array(words, pa.binary()).cast(pa.string())
        ascii_letters = pc.match_substring_regex(texts, "^[a-z]+$").to_numpy(zero_copy_only=False)
        plain, letters = np.flatnonzero(ascii_letters).tolist(), texts.filter(pa.array(ascii_letters)).to_pylist()
        joined, alone = [], []
        for i in np.flatnonzero(~ascii_letters).tolist():
            word = words[i]
            if word[0] > 57 and (text := self._as_letters(word)) is not None:
                plain.append(i)
                letters.append(text)
            elif self.separator is None or SEPARATOR.encode() in word:
                alone.append(i)
            else:
                joined.append(i)
        for text in letters:
            ids = [t.id for t in tokenize(text)]
            counts.append(len(ids))
            known_ids += ids
        lengths = np.zeros(len(words), np.int64)
        batches = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        texts = [f" {SEPARATOR} ".join([words[i].decode() for i in b]) + f" {SEPARATOR}" for b in batches]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in found)])
        cut = np.flatnonzero(flat == self.separator)  # one behind each word
        lengths[joined] = np.diff(cut, prepend=-1) - 1
        lengths[plain] = counts
        parts, order = [np.array(known_ids, np.uint32), np.delete(flat, cut)], plain + joined
        for i in alone:
            ids = np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32)
            lengths[i] = len(ids)
            parts.append(ids)
            order.append(i)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (of ``dtype``) and the ends of the texts' ids; null counts as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        whole = np.full(len(texts), not self.by_words)
        for content in self.special if self.by_words else []:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_words(texts)
        ids, ends = self._encode_words(pc.if_else(pa.array(whole), "", texts))
        alone = np.flatnonzero(whole)
        found = self.whole.encode_batch_fast(texts.take(pa.array(alone)).to_pylist(), add_special_tokens=False)
        parts = np.split(ids, ends[:-1])
        for i, x in zip(alone.tolist(), found):
            parts[i] = np.array(x.ids, self.dtype)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > MAX_WORDS:
            self._forget_rare()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
        filled = pc.not_equal(pc.binary_length(flat), 0)  # a blank at either end gives an empty word
        upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[np.cumsum(sizes)]
        coded = flat.filter(filled).dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        known = len(self.index)
        number = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > known:
            self._learn(list(itertools.islice(self.index, known, None)))
        used = coded.indices.to_numpy()
        counted = np.zeros(len(self.index), np.int64)
        counted[: len(self.uses)] = self.uses
        counted[number] += np.bincount(used, minlength=len(words))
        self.uses = counted
        ids, ends = ragged_take(self.word_ids, self.word_starts, self.word_lengths, number[used])
        return ids, np.concatenate([[0], ends])[upto]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[starts[i] : starts[i] + lengths[i]]`` for ``i`` in ``at`` in a row, and their ends."""
    size = lengths[at]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    places = np.repeat((starts[at] - (ends - size)).astype(kind), size)
    places += np.arange(total, dtype=kind)
    return flat[places], ends


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    return WordEncoder(path)
