"""Encoding words with a public tokenizer file, each distinct word once per process.

The tokenizer's pattern never joins across white space, and its normalizers
work on a run of other characters alike wherever it stands, so a text's ids
are its words' ids end to end. ``tests/llm`` hold this against whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, normalizers, pre_tokenizers

DEFAULT = "word_bpe_49k.json"
#: Distinct words whose ids a process keeps.
KEEP = 400_000
_MARKS = ".,"
#: What the last token of a word ends with.
END = "</w>"
#: Words of letters up to U+012F: in lower case they are letters of that range again, and composed already.
LATIN = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+"
#: Words a line each: letters and marks, or anything else.
_LINE = re.compile(f"({LATIN})([{re.escape(_MARKS)}]*)\n|([^\n]*)\n")


def load(name: str = DEFAULT) -> Tokenizer:
    """The tokenizer of a file in the public folder (or of a path), without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def split_words(text: bytes) -> list[bytes]:
    """The runs of anything but the six ASCII white-space bytes."""
    return text.split()


class WordIds:
    """Ids of words as little-endian 16- or 32-bit bytes, kept by word.

    A word of Latin letters is looked up in lower case and without its last
    dots and commas, as the tokenizer lower-cases and cuts before such marks;
    the ids of the marks follow. Many such words are encoded in one call: each
    is one piece to the tokenizer, and its last token ends with the mark of a
    word's end. Anything else is encoded as it stands.
    """

    def __init__(self, name: str = DEFAULT):
        self.tokenizer = load(name)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(END) for i in range(self.size)])
        self.fast = load(name) if self.ends.any() else None
        if self.fast is not None:
            self.fast.normalizer = normalizers.Sequence([])
            self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def _encode_lower(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin letters."""
        out: list[bytes] = []
        lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        for k, e in enumerate(self.fast.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) != len(words[k * 64 : k * 64 + 64]):
                raise ValueError("a word of Latin letters made more or less than one piece")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def learn(self, words: set[bytes]) -> None:
        """Make the ids of ``words``, those that are not kept yet."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > KEEP:
            self.known, self.cores = {}, {}
            new = list(words)
        parts, cores, other = [], {}, []
        read = _LINE.findall(b"\n".join(new).decode("utf-8", "replace") + "\n") if self.fast is not None else [("", "", "")] * len(new)
        for w, (s, marks_of, _) in zip(new, read, strict=True):
            if s:
                s = s.lower()
                if s not in self.cores:
                    cores[s] = None
                parts.append((w, s, marks_of))
            else:
                other.append(w)
        marks = {m for _, _, m in parts if m and m not in self.cores}
        self.cores.update(zip(cores, self._encode_lower(list(cores)), strict=True))
        self.cores.update(zip(marks, self._encode(list(marks)), strict=True))
        self.cores[""] = b""
        for w, s, m in parts:
            self.known[w] = self.cores[s] + self.cores[m]
        self.known.update(zip(other, self._encode([w.decode("utf-8", "replace") for w in other]), strict=True))

    def forget(self) -> None:
        self.known, self.cores = {}, {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [split_words(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.dtype) for words in split]


_loaded: dict[str, WordIds] = {}


def word_ids(name: str = DEFAULT) -> WordIds:
    """The process's table for a tokenizer file; later tasks of a reused worker find it filled."""
    if name not in _loaded:
        _loaded[name] = WordIds(name)
    return _loaded[name]
