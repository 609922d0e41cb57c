"""Sub-word encoding of whole texts with a per-worker table of word encodings.

A byte-level BPE splits a text before merging, and always where a visible character meets a space and where a letter
or digit meets a mark. So a text without runs of white space is the concatenation of such pieces, and each distinct
piece is encoded by the library once for a worker. Any other text is given to the library whole. Ids are the library's.
"""

from __future__ import annotations

import contextlib
from array import array
from itertools import repeat

#: Two characters of Unicode white space in a row: the words of such a text are not encoded apart.
_RUN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Marks that end a word: after a letter or digit they always begin a piece of their own.
_MARKS = r"([\pL\pN])([.,;:!?#$%&*|\"]+)(\x02|$)"
#: Stands between pieces. Texts that hold it are encoded whole.
_CUT = "\x02"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``path``: a tokenizers-library file. ``table_words``: most words that the table keeps; it starts anew beyond.
    """

    def __init__(self, path: str, table_words: int = 600_000):
        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        pre = self._tokenizer.pre_tokenizer
        self._by_word = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self._tokenizer.normalizer is None
        self._bare = Tokenizer(self._tokenizer.model)
        self._letters = byte_letters()
        self._limit = table_words
        self._none = (np.zeros(1, np.int64), np.zeros(0, np.uint16 if self._tokenizer.get_vocab_size() <= 1 << 16 else np.uint32))
        self._at: dict[str, int] = {}
        self._ends, self._ids = self._none

    def _library(self, texts: list[str], bare: bool = False) -> list[bytes]:
        found = (self._bare if bare else self._tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        kind = self._ids.dtype.char
        return [array(kind, e.ids).tobytes() for e in found]

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array (or list) of strings; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "")
        if not self._by_word:
            return self._whole(texts.to_pylist())
        odd = pc.or_(pc.match_substring_regex(texts, _RUN), pc.match_substring(texts, _CUT))
        for s in self._special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not pc.any(odd).as_py():
            return self._parted(texts)
        plain = iter(self._parted(texts.filter(pc.invert(odd))))
        whole = iter(self._whole(texts.filter(odd).to_pylist()))
        return [next(whole if x else plain) for x in odd.to_pylist()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.frombuffer(ids, self._ids.dtype).astype("<u4").tobytes() for at in range(0, len(texts), 64) for ids in self._library(texts[at : at + 64])]

    def _parted(self, texts) -> list[bytes]:
        import numpy as np
        import pyarrow.compute as pc

        marked = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, _MARKS, rf"\1{_CUT}\2\3"), _CUT)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        words = words.to_pylist()
        at = np.fromiter(map(self._at.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            at[unknown] = np.arange(len(self._at), len(self._at) + len(unknown))
            self._learn([words[i] for i in unknown.tolist()])
        starts, sizes = self._ends[at], (self._ends[1:] - self._ends[:-1])[at]
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        first = np.repeat((starts[codes] - (ends - lengths)), lengths)
        first += np.arange(len(first))
        ids = self._ids[first].astype("<u4")
        cuts = np.concatenate([[0], ends])[bounds - bounds[0]]
        out = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        if len(self._at) > self._limit:
            self._at, self._ends, self._ids = {}, *self._none
        return out

    def _learn(self, missing: list[str]) -> None:
        """Add pieces to the table; those of one space and letters need no split before merging."""
        import numpy as np

        table = self._letters
        plain = [w[:1] == " " and w[1:].isalpha() for w in missing]
        found: dict[str, bytes] = {}
        for bare in (True, False):
            some = [w for w, p in zip(missing, plain) if p is bare]
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                given = [table[0x20] + w[1:] if w.isascii() else w.encode().decode("latin-1").translate(table) for w in part] if bare else part
                found.update(zip(part, self._library(given, bare)))
        ids = [found[w] for w in missing]
        self._at.update(zip(missing, range(len(self._at), len(self._at) + len(missing))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self._ids.itemsize
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(ids), self._ids.dtype)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks that one worker runs."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Free the worker's encoders, which operators that do not encode have no use for, and what is unused of its memory."""
    _ENCODERS.clear()
    trim()


def trim() -> None:
    """Give memory that is not in use back to the system; a worker would keep it for its later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # where the C library has it


def slices(batch, most_bytes: int = 8 << 20):
    """Parts of an Arrow batch of about so many bytes, so that long texts do not pile up."""
    step = max(1, min(batch.num_rows or 1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
