"""Encoding whole texts with a tokenizer file, inside tasks.

The vocabularies used here never let a token cross a single space between two other
characters, so a text is cut there and pieces seen before in this worker are looked
up.  New words go through the tokenizers library, many in one text: every word has one id
that only begins (or only ends) words, so the ids are cut there.  Other new pieces of
plain Latin-1 characters are first split by the tokenizer's own pattern, so that words
with marks around them reuse what is known.  Where a space is kept with the word after
it, a text in which a space meets other white space goes through the library whole.
The memory of pieces is bounded and lasts in a Python worker for one run of an
operator, so that no run gains from an earlier one; it changes speed, never ids.
"""

from __future__ import annotations

import gc
import os
from array import array
from dataclasses import dataclass

import numpy as np

PIECES, PARTS = 600_000, 200_000  # entries kept in a worker
JOINED = 256  # words in one text for the library
BATCH = 1 << 18  # characters in one call of it, about
MARKS = ",."
PLAIN = r"[\n\r\t!-;=-~¡-ÿ]+"  # no "<", which may begin a special token


@dataclass(frozen=True)
class Vocabulary:
    """How a tokenizer file splits text: ``glue`` keeps a space with the word after it, else white space goes."""

    path: str
    pattern: str
    glue: bool
    lower: bool


def byte_bpe(path: str) -> Vocabulary:
    return Vocabulary(path, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", True, False)


def word_bpe(path: str) -> Vocabulary:
    return Vocabulary(path, r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", False, True)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary.path)
        self.split = regex.compile(vocabulary.pattern).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.glue, self.lower = " " * vocabulary.glue, vocabulary.lower
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        names = map(self.full.id_to_token, range(self.full.get_vocab_size()))
        self.edge = np.array([(n or "").startswith("\u0120") if vocabulary.glue else (n or "").endswith("</w>") for n in names])
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _run(self, texts: list[str]) -> list[bytes]:
        code, out = self.code, []
        for batch in groups_of(texts, BATCH):  # its results are large, so few are held at a time
            out += [array(code, e.ids).tobytes() for e in self.full.encode_batch_fast(batch, add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each with its ``glue``."""
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        size, out = self.dtype.itemsize, []
        for group, ids in zip(groups, self._run([self.glue + " ".join(g) for g in groups])):
            edges = np.flatnonzero(self.edge[np.frombuffer(ids, self.dtype)])
            if len(edges) != len(group):
                out += self._run([self.glue + w for w in group])
                continue
            cuts = [*(edges * size).tolist(), len(ids)] if self.glue else [0, *((edges + 1) * size).tolist()]
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def _parts(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of texts that are given as lists of parts no token crosses."""
        unseen = list(set().union(*cut).difference(self.parts))
        self.parts.update(zip(unseen, self._run(unseen)))
        out = [b"".join(map(self.parts.__getitem__, c)) for c in cut]
        if len(self.parts) > PARTS:
            for x in unseen:
                del self.parts[x]
        return out

    def _cut(self, text: str) -> list[str]:
        if not self.plain(text.lstrip(" ")):
            return [text]
        return self.split(text.lower() if self.lower else text)

    def _learn(self, new: set[str]) -> list[str]:
        """Put the pieces of ``new`` into the memory; the names put there."""
        words, marked, rest, cuts, skip = set(), [], [], [], len(self.glue)
        for w in new:
            if w.isalpha():
                words.add(w)
            elif w[-1:] in MARKS and w[:-1].isalpha() and (w.isascii() or max(w) < "\u0250"):
                marked.append(w)
                if w[:-1] not in self.pieces:
                    words.add(w[:-1])
            else:
                cut = self._cut(self.glue + w)
                base = cut[0][skip:] if cut else ""
                if base.isalpha():
                    if base not in self.pieces:
                        words.add(base)
                    cut = cut[1:]
                else:
                    base = ""
                rest.append((w, base))
                cuts.append(cut)
        words = list(words)
        added = [*words, *marked, *(w for w, _ in rest)]
        self.pieces.update(zip(words, self._words(words)))
        ends = dict(zip(MARKS, self._parts([[m] for m in MARKS])))
        self.pieces.update((w, self.pieces[w[:-1]] + ends[w[-1]]) for w in marked)
        self.pieces.update((w, self.pieces[base] + ids if base else ids) for (w, base), ids in zip(rest, self._parts(cuts)))
        return added

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text (null: none) and ``end``, as little-endian integers of ``dtype``."""
        # Lists of pieces hold no cycles; looking for some among them costs a tenth of the time.
        gc.disable()
        try:
            return self._encode(texts, end)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None], end: int) -> list[bytes]:
        heads, tails, found, gaps = [], [], [], []
        new, seen, known = set(), 0, self.pieces.get
        for t in texts:
            head, gap, rest = (t or "").partition(" ")
            tail = rest.split(" ") if gap else []
            ids = list(map(known, tail))
            gap = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            new.update([tail[i] for i in gap])
            seen += len(tail)
            heads.append(head)
            tails.append(tail)
            found.append(ids)
            gaps.append(gap)
        odd = []
        if self.glue:
            bad = {w for w in new if not w or w.strip() != w}
            new -= bad
            for i, (head, tail, gap) in enumerate(zip(heads, tails, gaps)):
                if tail and (head[-1:].isspace() or bad and any(tail[j] in bad for j in gap)):
                    odd.append(i)
                    heads[i], found[i], gaps[i] = "", [], []
        added = self._learn(new)
        learnt = self.pieces
        mark = np.array([end], self.dtype).tobytes()
        out = []
        for head, tail, ids, gap in zip(self._parts([self._cut(h) for h in heads]), tails, found, gaps):
            for i in gap:
                ids[i] = learnt[tail[i]]
            out.append(b"".join([head, *ids, mark]))
        for i, ids in zip(odd, self._run([texts[i] for i in odd])):
            out[i] = ids + mark
        if len(self.pieces) > PIECES:
            if len(added) * 4 > seen:  # other texts than before: begin anew
                self.pieces.clear()
            for w in added:
                self.pieces.pop(w, None)
        return out


KEPT: dict[Vocabulary, tuple[str, Encoder]] = {}


def worker_encoder(vocabulary: Vocabulary, run: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task; another ``run`` begins with an empty memory."""
    last, encoder = KEPT.get(vocabulary) or ("", Encoder(vocabulary))
    if last != run:
        encoder.pieces.clear()
        encoder.parts.clear()
        KEPT[vocabulary] = run, encoder
    return encoder


def groups_of(texts, limit: int = 4 << 20):
    """Runs of texts of about ``limit`` characters, at least one text each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
