"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary's strings form a trie with two roots: one for pieces that begin a word and one for
pieces that continue it. Each state has a failure link and the number of pieces that are popped when
the link is taken, so that one pass over a word's characters gives the number of pieces of greedy
longest-match tokenisation; no piece is built and no character is looked at again.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import Carried, kept_arrays

#: Distinct words whose counts a Python worker keeps; the memory is emptied beyond it, results stay the same.
MEMORY_WORDS = 200_000


class Automaton:
    """Greedy longest-match piece counts of words.

    initial: pieces that may begin a word; inner: pieces that may follow. An empty initial piece stands before a word that
    begins with no other one. A word that cannot be split wholly counts as one unknown token.
    """

    def __init__(self, initial, inner):
        #: transitions[state << 21 | code point] = state; states 0 and 1 are the two roots
        self.next: dict[int, int] = {}
        final = [False, False]
        order: list[tuple[int, int, int]] = []
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                state = root
                for c in piece:
                    key = state << 21 | ord(c)
                    to = self.next.get(key)
                    if to is None:
                        to = self.next[key] = len(final)
                        order.append((state, ord(c), to))
                        final.append(False)
                    state = to
                if piece:
                    final[state] = True
        depth = [0] * len(final)
        for parent, _, to in order:
            depth[to] = depth[parent] + 1
        order.sort(key=lambda x: depth[x[2]])
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        if "" in initial:
            self.fail[0], self.pops[0] = 1, 1
        for parent, c, to in order:
            if final[to]:
                self.fail[to], self.pops[to] = 1, 1
                continue
            state, pops = self.fail[parent], self.pops[parent]
            while state >= 0 and (state << 21 | c) not in self.next:
                pops += self.pops[state]
                state = self.fail[state]
            if state >= 0:
                self.fail[to], self.pops[to] = self.next[state << 21 | c], pops

    def count(self, word: str) -> int:
        """The number of pieces, or -1 if the word is unknown."""
        get, fail, pops = self.next.get, self.fail, self.pops
        state = total = 0
        for c in word:
            c = ord(c)
            to = get(state << 21 | c)
            while to is None:
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return -1
                to = get(state << 21 | c)
            state = to
        while state != 1:
            total += pops[state]
            state = fail[state]
            if state < 0:
                return -1
        return total


def pieces_of(model_file: str) -> tuple[list[str], list[str]]:
    """(initial, inner) pieces of a SentencePiece model: those with its word mark, which is taken off once, begin a word; the mark alone is an empty piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    initial, inner = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            (initial if piece.startswith("▁") else inner).append(piece.removeprefix("▁"))
    return initial, inner


def _count(batches, text: str, automaton):
    known: dict[str, int] = {}
    machine = automaton.value
    for batch in batches:
        out = np.zeros((batch.num_rows, 3), np.int64)
        for row, value in enumerate(batch.column(batch.schema.get_field_index(text))):
            value = value.as_py()
            if value:
                for word, n in Counter(value.split()).items():
                    got = known.get(word)
                    if got is None:
                        if len(known) >= MEMORY_WORDS:
                            known.clear()
                        got = machine.count(word)
                        if len(word) <= 64:
                            known[word] = got
                    out[row] += (n, n * abs(got), n * (got < 0))
        names, arrays = kept_arrays(batch)
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(out[:, i]) for i in range(3))], [*names, "n_words", "n_tokens", "n_unknown"])


def token_counts(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word-piece counts of every whole text: keep columns, n_words, n_tokens, n_unknown.

    Words are what str.split() gives, of any length; an unknown word is one token. A null or empty text has zero
    of each. Repeated rows each give their row, an empty table none; other columns of docs may have any names, and
    a kept one with the name of a count is left out. model_file is read on the driver; the automaton, whose size is that of
    the vocabulary, is broadcast.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(*pieces_of(model_file)))
    made = ("n_words", "n_tokens", "n_unknown")
    carried = Carried(docs, keep, text, made)
    out = carried.run(partial(_count, text=carried.text, automaton=automaton), ", ".join(f"{m} long" for m in made))
    return carried.restore(out, {m: m for m in made})
