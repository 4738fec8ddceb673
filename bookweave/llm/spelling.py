"""Spelling variants: words one insertion, deletion or replacement apart, found with search schemes over a
bidirectional FM-index, and grouped by following each word to its far more frequent form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import starts_of, stored, table

#: What a word is made of, as the contract spells it; code points of a word at least, and occurrences.
LETTERS, LENGTH, OCCURRENCES = "A-Za-zÀ-ÿ", 7, 2
#: One run in so many loses a code point (noise of the query op12).
NOISE = 31
#: A form is at least so many times as frequent as its variant.
FACTOR = 10
#: Code points of one index, about, and words of one block of a half that very many words share.
INDEX_CHARS, BLOCK_WORDS = 1 << 20, 50_000
#: An interval of more suffixes than this tries all letters instead of looking at each suffix.
WIDE = 96


class HalfIndex:
    """FM-index of one direction over ``$w1$w2$...$``: suffix-rank intervals that grow by one letter to the left."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        self.n, self.sigma = n, sigma
        rank = text.astype(np.int64)
        step = 1
        while True:  # prefix doubling; the text ends in its only smallest letter, so suffixes differ
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.suffixes = order
        self.before = text[order - 1].astype(np.int64)  # the letter in front of each suffix
        # occurrences of a letter in front of suffixes, as sorted letter * n + rank
        self.occurrences = np.sort(self.before * n + np.arange(n))
        self.first = np.searchsorted(self.occurrences, np.arange(sigma + 1) * n)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the letter and then with those of the given interval."""
        ends = np.searchsorted(self.occurrences, np.concatenate((letter * self.n + low, letter * self.n + high)))
        ends += np.tile(self.begin[letter] - self.first[letter], 2)
        return ends[: len(letter)], ends[len(letter) :]

    def letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the interval, letter): the letters in front of each interval's suffixes, once each."""
        width = high - low
        wide = width > WIDE
        narrow = np.where(wide, 0, width)
        owner = np.repeat(np.arange(len(low)), narrow)
        at = np.repeat(low, narrow) + np.arange(narrow.sum()) - np.repeat(starts_of(narrow), narrow)
        pairs = np.unique(owner * self.sigma + self.before[at])
        every = (np.flatnonzero(wide)[:, None] * self.sigma + np.arange(self.sigma)[None, :]).ravel()
        pairs = np.concatenate((pairs, every))
        return pairs // self.sigma, pairs % self.sigma


class Vocabulary:
    """A bidirectional FM-index over delimited words: extends a match to the left with the index of the text, to
    the right with that of the reversed text."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.codes = codes.astype(np.int64) + 2
        self.at = starts_of(self.sizes)
        self.sigma = len(self.alphabet) + 2
        self._sides: dict[bool, tuple[HalfIndex, np.ndarray]] = {}

    def side(self, right: bool) -> tuple[HalfIndex, np.ndarray]:
        """The index that extends to this side, and the word of each suffix that starts with a delimiter."""
        if right not in self._sides:
            m = len(self.words)
            text = np.ones(self.sizes.sum() + m + 2, np.int64)  # 1 is the delimiter, 0 ends the text
            text[-1] = 0
            owner = np.repeat(np.arange(m), self.sizes)
            inside = np.arange(len(self.codes)) + owner + 1
            text[inside] = self.codes
            if right:
                text[:-1] = text[-2::-1].copy()
            index = HalfIndex(text, self.sigma)
            places = np.concatenate(([0], np.cumsum(self.sizes + 1)))
            word = np.full(len(text), -1)
            word[places[:-1]] = np.arange(m)  # the delimiter in front of a word
            if right:
                word = np.full(len(text), -1)
                word[places[-1] - places[1:]] = np.arange(m)
            self._sides[right] = index, word[index.suffixes]
        return self._sides[right]

    def near(self, queries: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs of words exactly one edit apart whose halves on one side are equal.

        ``right``: the left half of the query is matched exactly from the delimiter on, then extended to the
        right, across the other half, with one error. Else the right half, extended to the left."""
        index, word_at = self.side(right)
        size = self.sizes[queries]
        half = size // 2 if right else size - size // 2

        def letter(query: np.ndarray, k: np.ndarray) -> np.ndarray:
            """The k-th letter of queries from the exact end on; the delimiter behind the last."""
            inside = np.minimum(k, size[query] - 1)
            place = self.at[queries[query]] + (inside if right else size[query] - 1 - inside)
            return np.where(k < size[query], self.codes[place], 1)

        query = np.arange(len(queries))
        low, high = np.full(len(query), index.begin[1]), np.full(len(query), index.begin[2])
        k = 0
        exact: list[tuple[np.ndarray, ...]] = []
        while len(query):
            done = half[query] == k
            if done.any():
                exact.append((query[done], low[done], high[done]))
            query, low, high = query[~done], low[~done], high[~done]
            if len(query):
                low, high = index.extend(letter(query, np.full(len(query), k)), low, high)
                some = high > low
                query, low, high = query[some], low[some], high[some]
            k += 1
        if not exact:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, low, high = (np.concatenate(x) for x in zip(*exact))
        at = half[query]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        late = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, next letter, interval: one error spent
        while len(query) or len(late[0]):
            if len(query):
                parent, other = index.letters(low, high)
                inner = other > 1  # an error never adds or replaces by a delimiter
                parent, other = parent[inner], other[inner]
                wrong_low, wrong_high = index.extend(other, low[parent], high[parent])
                some = wrong_high > wrong_low
                parent, other, wrong_low, wrong_high = parent[some], other[some], wrong_low[some], wrong_high[some]
                owner, place = query[parent], at[parent]
                replaced = (place < size[owner]) & (other != letter(owner, place))
                missing = at < size[query]
                late = tuple(
                    np.concatenate(x)
                    for x in zip(
                        late,
                        (owner, place, wrong_low, wrong_high),  # the word has one letter more
                        (owner[replaced], place[replaced] + 1, wrong_low[replaced], wrong_high[replaced]),
                        (query[missing], at[missing] + 1, low[missing], high[missing]),  # and one less
                    )
                )
                on = at < size[query]
                query, at, low, high = query[on], at[on], low[on], high[on]
                low, high = index.extend(letter(query, at), low, high)
                some = high > low
                query, at, low, high = query[some], at[some] + 1, low[some], high[some]
            owner, place, left, right_end = late
            step = letter(owner, place)
            left, right_end = index.extend(step, left, right_end)
            some = right_end > left
            owner, place, left, right_end, step = owner[some], place[some], left[some], right_end[some], step[some]
            over = step == 1
            if over.any():
                # words differ, so an interval with both delimiters is one suffix
                found.append((owner[over], word_at[left[over]]))
            late = owner[~over], place[~over] + 1, left[~over], right_end[~over]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], 1), axis=0)
        return queries[pairs[:, 0]], pairs[:, 1]


def vocabulary(docs: DataFrame, noise: int = 0, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words of whole texts, lower-cased (A-Z only), of at least ``length`` code points and at least
    ``occurrences`` occurrences. With ``noise``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses its code
    point crc32 % length; a null id counts as empty text there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")))
    if noise:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
        less = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
        runs = runs.select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("run"))
    words = runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return words.where((F.length("word") >= length) & (F.col("n") >= occurrences))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) both ways: the pairs of words exactly one inserted, deleted or replaced code point apart.

    A word and a near one share the word's left half as a prefix or its right half as a suffix. Words are dealt
    out by these halves: each word as a query under its own two, and as an entry under those that near words
    can have. Each task fills indexes of bounded size with the entries of the halves it gets, and searches their
    queries there. Of a half that very many words share, entries and queries are split and each part of the one
    meets each part of the other."""
    size = F.length("word")
    halves = []
    for right in (True, False):
        for change in (-1, 0, 1):
            own = F.floor((size + change) / 2) if right else size + change - F.floor((size + change) / 2)
            half = F.substr("word", F.lit(1), own) if right else F.substr("word", size - own + 1, own)
            halves.append(F.struct(F.lit(right).alias("right"), half.alias("half"), F.lit(change == 0).alias("query"), (own <= size).alias("fits")))
    placed = words.select("word", F.explode(F.array(*halves)).alias("at")).select("word", "at.*").where("fits")
    # the halves for two of the changes are the same; a row is an entry always, and a query if one of them is
    placed = placed.groupBy("word", "right", "half").agg(F.max("query").alias("query"))
    placed = stored(placed, "spelling-halves")
    parts = F.ceil(F.count("*") / BLOCK_WORDS).cast("int")
    shared = placed.groupBy("right", "half").agg(F.count("*").alias("many"), parts.alias("parts")).where("many > 1").drop("many")
    rows = placed.join(shared, ["right", "half"])
    part, every = F.pmod(F.xxhash64("word"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    entries = rows.select("right", "half", part.alias("part"), every.alias("block"), "word", F.lit(True).alias("entry"))
    queries = rows.where("query").select("right", "half", every.alias("part"), part.alias("block"), "word", F.lit(False).alias("entry"))
    place = ["right", "half", "part", "block"]
    dealt = entries.unionByName(queries).repartition(*place).sortWithinPartitions(*place).select(*place, "word", "entry")

    def search(batches) -> Iterator[pa.RecordBatch]:
        def solved() -> pa.RecordBatch:
            index = Vocabulary(list(entered | asked))
            number = {w: k for k, w in enumerate(index.words)}
            hit, near = index.near(np.array([number[w] for w in asked], np.int64), side)
            hit, near = hit[near < len(entered)], near[near < len(entered)]
            return pa.RecordBatch.from_arrays([pa.array([index.words[k] for k in x], pa.string()) for x in (hit, near)], names=["word", "near"])

        entered: dict[str, None] = {}
        asked: dict[str, None] = {}
        side, group, chars = None, None, 0
        for batch in batches:
            for right, *rest, word, entry in zip(*(c.to_pylist() for c in batch.columns)):
                if group is not None and (right != side or (rest != group and chars > INDEX_CHARS)):
                    yield solved()
                    entered, asked, chars = {}, {}, 0
                side, group = right, rest
                (entered if entry else asked)[word] = None
                chars += len(word) + 1
        if group is not None:
            yield solved()

    return dealt.mapInArrow(search, "word string, near string").distinct()


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, root, form, n, n_near, form_n for each row of (word, n).

    n_near counts the near words. form is the near word of largest n (of equal ones the smallest in code-point
    order), if that n is at least ``factor`` times the word's; form_n is its n. root follows forms to the last: n
    grows by the factor with each step, so the steps are few. An empty table gives an empty result."""
    words = stored(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words.select("word"))
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    enough = F.col("form_n") >= F.col("n") * factor
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the number of forms followed
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = steps.agg(F.max("moved")).first()[0]
        steps = steps.select("word", "root")
        if not moved:
            break
    return rows.join(steps, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = variants(vocabulary(table(spark, folder, "documents"), NOISE))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
