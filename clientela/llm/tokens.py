"""Token ids of whole texts, a word at a time with a bounded memory of words."""

from __future__ import annotations

import os
import re

import numpy as np

# A run of letters that normalisation leaves one run, and ASCII punctuation other
# than the apostrophe after it.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_REMEMBERED = 120_000
_AT_ONCE = 2000


class WordTokenizer:
    """Ids of a text by a tokenizer that drops white space and ends words.

    White space separates the pieces that such a tokenizer encodes, so a text's
    ids are those of its words one after another, and those of a word those of
    its letters and of the punctuation after them. Each is encoded once; two
    generations of ``_REMEMBERED`` words bound what is remembered. New runs of
    letters are encoded together and cut at the tokens that end a run.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4") for one in found]

    def _missing(self, words: set[bytes]) -> list[bytes]:
        """Words not remembered; those of the older generation are young again."""
        missing = []
        for word in words.difference(self._young):
            known = self._old.get(word)
            if known is None:
                missing.append(word)
            else:
                self._young[word] = known
        return missing

    def _learn(self, words: list[bytes]) -> None:
        letters, others, joined = set(), set(), []
        for word in words:
            match = _PLAIN.fullmatch(word)
            if match is None:
                others.add(word)
            elif match[2]:
                joined.append((word, *match.groups()))
                letters.add(match[1])
                others.add(match[2])
            else:
                letters.add(word)
        new = self._missing(letters)
        for start in range(0, len(new), _AT_ONCE):
            part = new[start : start + _AT_ONCE]
            (ids,) = self._ids([b" ".join(part).decode()])
            whole, begin = ids.tobytes(), 0
            for word, end in zip(part, ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist(), strict=True):
                self._young[word] = whole[begin:end]
                begin = end
        new = self._missing(others)
        for word, ids in zip(new, self._ids([w.decode(errors="replace") for w in new]), strict=True):
            self._young[word] = ids.tobytes()
        for word, letters_, tail in joined:
            self._young[word] = self._young[letters_] + self._young[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        # Ids do not depend on case, but for special tokens written out.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        if len(self._young) > _REMEMBERED:
            self._old, self._young = self._young, {}
        self._learn(self._missing(set().union(*split)))
        return [b"".join(map(self._young.__getitem__, words)) for words in split]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
