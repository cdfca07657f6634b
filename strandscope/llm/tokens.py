"""Token ids of whole texts by a byte-level BPE vocabulary file, with a per-worker cache of space-separated words."""

from __future__ import annotations

import json
import os

import numpy as np

# Fixed value: how byte-level BPE of this kind cuts texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a worker keeps; beyond it the cache starts anew, so memory is bounded on any text.
CACHE_WORDS = 500_000
#: Words that are looked up together.
SLICE_WORDS = 150_000
#: Marks that end words.
MARKS = ".,;:!?"


def merge_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file, if its merges are in the order of the ids they make, so that ids rank them."""
    with open(vocabulary, encoding="utf-8") as stream:
        model = json.load(stream)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        return None
    plain = {t: i for t, i in model["vocab"].items() if all(c in byte for c in t) and i <= made[-1]}
    return {bytes(byte[c] for c in t): i for t, i in plain.items()}


def is_clean(word: str) -> bool:
    """Whether what stands between two spaces is a word without white space, but for one newline in front of it.

    An empty word is a space next to a space or at an end, a bare newline one
    next to a space or newline or at an end.
    """
    core = word[1:] if word[:1] == "\n" else word
    return core.split() == [core]


class ByteLevelEncoder:
    """Encodes as ``tokenizers`` does with this vocabulary, which gives the file's added strings their own ids.

    Byte-level BPE never merges across the space in front of a word or around
    a single newline, so a text whose white space is single spaces and newlines
    is the concatenation of its words' ids. Any other text, and a text that has
    an added string in it, is encoded whole.
    A word that begins a line is kept with the newline in front of it.

    Words that are new come from ``tiktoken`` with the file's own ranks, which
    gives the same ids several times faster; a file whose merges don't allow
    that, and texts encoded whole, go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(vocabulary)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.newline = self._ids(["\n"])[0]
        self.break_id = int(np.frombuffer(self.newline, "<u4")[0])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Add ``words``. Letters and the marks after them are separate pieces, so ``word,`` is looked up as two."""
        cores = {w: core for w in words if (core := w.rstrip(MARKS)) != w and core.lstrip("\n").isalpha()}
        self._encode_words((words - cores.keys()) | (set(cores.values()) - self.known.keys()))
        for mark in {w[len(core) :] for w, core in cores.items()} - self.marks.keys():
            self.marks[mark] = self._ids([mark])[0]
        for w, core in cores.items():
            self.known[w] = self.known[core] + self.marks[w[len(core) :]]

    def _encode_words(self, words: set[str]) -> None:
        new = list(words)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            # A newline ends each word here, so its id ends each word's ids in the text of all of them.
            text = "\n".join([w[1:] if w[0] == "\n" else " " + w for w in part]) + "\n"
            raw = np.array(self.fast.encode_ordinary(text), "<u4").tobytes() if self.fast else self._ids([text])[0]
            ends = np.flatnonzero(np.frombuffer(raw, "<u4") == self.break_id).tolist()
            start = 0
            for w, end in zip(part, ends, strict=True):
                ids = raw[4 * start : 4 * end]
                self.known[w] = self.newline + ids if w[0] == "\n" else ids
                start = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        odd: list[int] = []
        at = 0
        while at < len(texts):
            # a slice of texts at a time: the lists of its words are all that memory holds beside the cache
            cut: list[tuple[int, list[str]]] = []
            count, seen = 0, set()
            while at < len(texts) and count < SLICE_WORDS:
                if any(a in texts[at] for a in self.added):
                    odd.append(at)
                    at += 1
                    continue
                words = ("\n" + texts[at]).replace("\n", " \n").split(" ")
                del words[0]
                cut.append((at, words))
                seen.update(words)
                count += len(words)
                at += 1
            new = seen - self.known.keys()
            # Known words are clean, so other white space can only stand in a new one.
            if unclean := {w for w in new if not is_clean(w)}:
                odd += [i for i, words in cut if not unclean.isdisjoint(words)]
                cut = [(i, words) for i, words in cut if unclean.isdisjoint(words)]
                seen = set().union(*(words for _, words in cut))
                new = seen - self.known.keys()
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = seen
            if new:
                self._learn(new)
            get = self.known.__getitem__
            for i, words in cut:
                out[i] = b"".join(map(get, words))[len(self.newline) :]
        for at in range(0, len(odd), 64):
            for i, ids in zip(odd[at : at + 64], self._ids([texts[i] for i in odd[at : at + 64]]), strict=True):
                out[i] = ids
        return out
