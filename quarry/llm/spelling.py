"""Spelling variants: forward and backward minimal acyclic automata with word numbers find words one letter apart.

Two words that differ by one letter agree exactly in the half before or in the half after it. Words are dealt by such halves;
a task builds an automaton of the words it has (of the words read backwards for the halves behind), walks a word's exact half and completes the other one with one error.
"""

from __future__ import annotations

from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, sized_join

#: Words that one automaton holds, about; a group of words with the same half that is larger is dealt anew by halves of what is left.
GROUP_WORDS = 20_000


class Automaton:
    """The minimal acyclic automaton of words given in ascending order; numbers count the words before one in that order.

    arcs[state] has letter: (state, words passed by); final states are those where a word ends.
    """

    def __init__(self, words):
        self.arcs: list[dict] = [{}]
        self.final = [False]
        known: dict = {}
        path, last = [0], ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, last, same, known)
            for c in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0, known)
        self._number()

    def _close(self, path: list[int], last: str, depth: int, known: dict) -> None:
        """States of the last word below depth change no more: those that an equal one is known for are replaced by it."""
        while len(path) - 1 > depth:
            state = path.pop()
            shape = (self.final[state], tuple(self.arcs[state].items()))
            other = known.setdefault(shape, state)
            if other != state:
                self.arcs[path[-1]][last[len(path) - 1]] = other
                if state == len(self.arcs) - 1:
                    self.arcs.pop()
                    self.final.pop()

    def _number(self) -> None:
        """Turns arcs into (state, words passed by): what a word's arcs pass by adds up to its number."""
        total: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            missing = [to for to in self.arcs[state].values() if to not in total]
            if missing:
                stack += missing
                continue
            total[stack.pop()] = self.final[state] + sum(total[to] for to in self.arcs[state].values())
        for state in total:
            passed, numbered = int(self.final[state]), {}
            for c, to in self.arcs[state].items():
                numbered[c] = to, passed
                passed += total[to]
            self.arcs[state] = numbered

    def walk(self, state: int, number: int, letters: str):
        """(state, number) after letters, or None."""
        arcs = self.arcs
        for c in letters:
            arc = arcs[state].get(c)
            if arc is None:
                return None
            state, number = arc[0], number + arc[1]
        return state, number

    def near(self, word: str, exact: int, same: bool, longer: bool, shorter: bool) -> list[int]:
        """Numbers of words with the first exact letters of word and one error behind them: one letter replaced (same), inserted (longer) or deleted (shorter)."""
        at = self.walk(0, 0, word[:exact])
        found: list[int] = []
        if at is None:
            return found
        state, number = at
        arcs, size = self.arcs, len(word)
        for i in range(exact, size + 1):
            c = word[i] if i < size else ""
            own = arcs[state]
            if (same and c) or longer:
                for letter, (to, passed) in own.items():
                    # a letter that is inserted before its like gives the same word as behind it
                    if letter != c:
                        if same and c:
                            self._end(to, number + passed, word, i + 1, found)
                        if longer:
                            self._end(to, number + passed, word, i, found)
            if shorter and c and c != word[i + 1 : i + 2]:
                self._end(state, number, word, i + 1, found)
            if not c or c not in own:
                break
            to, passed = own[c]
            state, number = to, number + passed
        return found

    def _end(self, state: int, number: int, word: str, at: int, found: list[int]) -> None:
        arcs = self.arcs
        for i in range(at, len(word)):
            arc = arcs[state].get(word[i])
            if arc is None:
                return
            state, number = arc[0], number + arc[1]
        if self.final[state]:
            found.append(number)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", least: int = 7, times: int = 2, every: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, at least `least` code points and `times` occurrences.

    Of a run whose h = crc32 of "<doc_id>:<run>" is divisible by `every`, the code point h % length is left out, so that true words have known misspellings.
    """
    lower = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{letters}]{{{least},}}"), F.lit(0))).alias("w"))
    h, size = F.crc32(F.concat("d", F.lit(":"), "w")), F.length("w")
    at = (h % size).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, size))
    words = runs.select(F.when(h % every == 0, less).otherwise(F.col("w")).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


KEY = ("size", "lo", "hi", "head", "tail")


def _window(word: Column, size: Column, lo: Column, hi: Column) -> Column:
    """The key of words of size letters, or one more, that may differ in the places lo to hi alone: what stands before and behind."""
    behind = size - hi
    tail = F.substring(word, F.length(word) - behind + 1, behind)
    return F.struct(size.alias("size"), lo.alias("lo"), hi.alias("hi"), F.substring(word, F.lit(1), lo).alias("head"), tail.alias("tail"))


def halves(words: DataFrame, group_words: int, least: int) -> DataFrame:
    """(word, n, size, lo, hi, head, tail): each word once for each half that a near word may share with it exactly.

    Size is the length of the shorter of two near words, which is at least `least`. Groups of more than group_words words are dealt by halves of the window that is left,
    again and again, until they are smaller or the window is one letter, where a group has no more words than there are letters and pairs of them.
    """
    length = F.length("word")
    shorter = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s")).filter(F.col("s") >= max(1, least))
    middle = F.floor(F.col("s") / 2).cast("int")
    both = F.array(_window(F.col("word"), F.col("s"), middle, F.col("s")), _window(F.col("word"), F.col("s"), F.lit(0), middle))
    rows = shorter.select("word", "n", F.explode(both).alias("k")).select("word", "n", "k.*")
    done = None
    while True:
        large = cut(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("words")).filter((F.col("words") > group_words) & (F.col("hi") - F.col("lo") > 1)).drop("words"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = sized_join(rows, large, list(KEY), "left_anti", 128)
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        again = F.array(_window(F.col("word"), F.col("size"), middle, F.col("hi")), _window(F.col("word"), F.col("size"), F.col("lo"), middle))
        rows = cut(sized_join(rows, large, list(KEY), "left_semi", 128).select("word", "n", F.explode(again).alias("k")).select("word", "n", "k.*"))


def _search(rows: list[tuple], backward: bool):
    """(word, near words, n of the most frequent, that word) for the rows of whole groups, all read forward or all backward."""
    read = (lambda w: w[::-1]) if backward else (lambda w: w)
    counts = {read(r[0]): r[1] for r in rows}
    words = sorted(counts)
    automaton = Automaton(words)
    for word, _, size, lo, hi, _, _ in rows:
        own = len(word) == size
        exact = size - hi if backward else lo
        best, n_near = None, 0
        for number in automaton.near(read(word), exact, own, own, not own):
            other = words[number]
            n = counts[other]
            other = read(other)
            # a pair that agrees up to hi is found by the group of the half before
            if hi < size and (other[:hi] == word[:hi] or other[:lo] != word[:lo] or other[len(other) - size + hi :] != word[len(word) - size + hi :]):
                continue
            n_near += 1
            if best is None or (-n, other) < best:
                best = -n, other
        if n_near:
            yield word, n_near, -best[0], best[1]


def _near(batches, group_words: int):
    """Near words of the sorted groups of a task; whole groups are gathered until there are group_words words."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def answers(held, backward):
        found = list(_search(held, backward))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["word", "n_near", "best_n", "best"])

    held, kind = [], None
    for key, group in groupby(rows(), key=lambda r: r[2:]):
        # what has nothing behind the window is read forward, what has nothing before it backward
        backward = key[1] == 0
        if held and (len(held) >= group_words or backward != kind):
            yield from answers(held, kind)
            held = []
        held += group
        kind = backward
    if held:
        yield from answers(held, kind)


def near_words(words: DataFrame, group_words: int = GROUP_WORDS, least: int = 1) -> DataFrame:
    """(word, n_near, best_n, best) of distinct words (word, n) of at least `least` letters that have words one inserted, deleted or replaced code point away: how many, and the most frequent (ties: least)."""
    rows = halves(words, group_words, least).select("word", "n", *KEY)
    dealt = rows.repartition(*KEY).sortWithinPartitions(F.col("lo") > 0, *KEY)
    found = dealt.mapInArrow(partial(_near, group_words=group_words), "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: where following forms ends, by doubling of steps."""
    roots = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not roots.filter("moved").isEmpty():
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(sized_join(roots.drop("moved"), step, "root", "left", 64).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return roots.select("word", "root")


def variants(docs: DataFrame, times_more: int = 10, doc_id: str = "doc_id", text: str = "text", least: int = 7, group_words: int = GROUP_WORDS, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts (see word_counts, which takes the other parameters).

    Near words differ by exactly one inserted, deleted or replaced code point. form: the near word of largest n (ties: least in code-point order) if that n is at least times_more times the word's, else null.
    root: where following forms ends; the word itself if it has none. n_near: how many near words there are; form_n: the form's n or null.
    Null texts have no words, a null id counts as empty, rows that repeat an id count each. Words of any length are matched whole; each pair of words is found in one group
    by one direction, so that nothing is counted twice. An empty table gives no rows; other columns may have any names.
    """
    counted = cut(word_counts(docs, doc_id, text, least=least, **counting))
    near = cut(near_words(counted, group_words, least))
    joined = cut(counted.join(near, "word", "left"))
    fine = F.col("best_n") >= times_more * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fine, F.col("best")).alias("form"), F.when(fine, F.col("best_n")).alias("form_n"))
    roots = follow(formed.filter("form is not null").select("word", "form"))
    return sized_join(formed, roots, "word", "left", 64).select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
