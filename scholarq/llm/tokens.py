"""Exact tokens of a public BPE vocabulary whose words are independent.

The vocabulary's pre-tokenizer never joins characters across white space, and its
normalizer works character by character, so the tokens of a text are the tokens of
its ASCII-white-space-separated chunks in order. Each Python worker keeps the
tokens of the chunks it has met; only new chunks go to the library, many at a
time. The caches have a fixed bound and start again when full.

Texts with one of the vocabulary's special strings go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Entries per cache and worker (two caches, about 100 bytes an entry).
CACHE_ENTRIES = 1_200_000
#: A chunk that is one run of Latin-1 letters and a tail of ASCII punctuation without apostrophe:
#: two pre-tokens whose letters lower-case one by one.
PLAIN = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
TEXTS_PER_CALL = 2000


def shown_bytes() -> dict[int, str]:
    """Byte-level BPE's rule: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


SHOWN = shown_bytes()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ChunkCache:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer, self.entries = tokenizer(path), entries
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for chunk in new:
            m = PLAIN.fullmatch(chunk.decode())
            if m:
                plain.append((chunk, m[1].lower(), m[2]))
            else:
                other.append(chunk)
        words = list({w for _, a, b in plain for w in (a, b) if w not in self.words})
        if len(self.words) + len(words) > self.entries:
            self.words = {"": b""}
            words = list({w for _, a, b in plain for w in (a, b) if w})
        self.words.update((w, self._word(w)) for w in words)
        for chunk, a, b in plain:
            self.chunks[chunk] = self.words[a] + self.words[b]
        for at in range(0, len(other), TEXTS_PER_CALL):
            part = other[at:at + TEXTS_PER_CALL]
            self.chunks.update(zip(part, self._library([c.decode() for c in part]), strict=True))

    def _word(self, word: str) -> bytes:
        """Tokens of one pre-token of letters or of punctuation, by the library's model alone:
        the model sees bytes, each as a printable character."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8 in, little-endian unsigned 32-bit ids out)."""
        marks = [s.encode() for s in self.special]
        out: list[bytes | None] = []
        waiting: list[tuple[int, list[bytes]]] = []
        for k, text in enumerate(texts):
            if any(m in text for m in marks):
                out.append(self._library([text.decode()])[0])
                continue
            chunks = text.split()
            try:
                out.append(b"".join(map(self.chunks.__getitem__, chunks)))
            except KeyError:
                out.append(None)
                waiting.append((k, chunks))
        if waiting:
            met = set().union(*(chunks for _, chunks in waiting))
            if len(self.chunks) + len(met - self.chunks.keys()) > self.entries:
                self.chunks = {}
            self._learn([c for c in met if c not in self.chunks])
            for k, chunks in waiting:
                out[k] = b"".join(map(self.chunks.__getitem__, chunks))
        return out


@lru_cache(maxsize=2)
def chunk_cache(path: str) -> ChunkCache:
    return ChunkCache(path)
