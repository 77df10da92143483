"""Phrase collocation mining by suffix sorting, in the manner of Suffix-sigma.

Each word begins a suffix of its piece, truncated to ``longest`` words. A task sends the suffixes that share a language
and first word in one row. Rows are dealt by language and first word and sorted in reverse; one stack over the sorted
suffixes counts every prefix, since all suffixes that begin with it lie together. Prefixes that reach the bound go on.

A first pass finds the prefixes that are too frequent for one part. Each chunk of a task names those that begin more
than a share of its suffixes; a prefix over twice that share in all must be over it in chunks that together hold the
share. Suffixes with such a prefix are dealt by one word more, so their parts hold it in pieces; what the parts count of
it is sent whole and added up afterwards. All other counts are complete in their part. Equal suffixes of a chunk are one
entry, so the most frequent of full length takes no more room than there are chunks.

The cuts of a candidate are joined with the counts of their halves. A candidate lies inside a longer one only if it also
lies inside one that is a word longer and at least as frequent, so that the two direct sub-phrases of each candidate are
all that need to be compared.

Defined cases: null texts are empty; a null language is ``und``, together with rows whose language says so; a text of
delimiters alone has no words; a piece shorter than two words has no phrase; repeated rows count as often as they occur;
an empty table gives no rows; a language without a candidate gives no rows. Columns other than text and language are not
read. Texts are read whole; the rows of a task fall into chunks of about ``CHUNK`` characters, a longer text in one of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch

CHUNK = 6 << 20
#: What ends a piece, as bytes, here marked with a byte that UTF-8 never has; blanks and tabs between words
#: are left to bytes.split.
ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"
TABLE = bytes(MARK[0] if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
RANKED = 16  # parts that rank their best before a language's best are ranked


class Words:
    """The words of some texts: codes into ``found``, and for each the place behind the last word of its piece."""

    def __init__(self, texts: list[str]):
        raw = "\n".join(texts).encode().translate(TABLE).replace(MARK, b" \xff ").split()
        raw.append(MARK)
        codes, found = pd.factorize(np.array(raw, object))
        mark = codes[-1]
        word = codes != mark
        piece = np.cumsum(~word)[word]
        self.codes, self.found = codes[word], found
        self.ends = np.searchsorted(piece, piece, side="right")

    def follows(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which of these places have k more words in their piece."""
        return at + k < self.ends[at]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Words]]:
    """Words by language, of about CHUNK characters at a time."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if x := text.as_py():
                held[lang.as_py()].append(x)
                size += len(x)
            if size >= CHUNK:
                yield {lang: Words(texts) for lang, texts in held.items()}
                held, size = defaultdict(list), 0
    if size:
        yield {lang: Words(texts) for lang, texts in held.items()}


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def frequent_prefixes(texts: DataFrame, share: float, longest: int) -> DataFrame:
    """(lang, prefix, n): each chunk's prefixes, below full length, over a share of its suffixes, and its words under a null prefix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            rows, least = [], share * sum(len(w.codes) for w in chunk.values())
            for lang, w in chunk.items():
                rows.append((lang, None, len(w.codes)))
                # Places where a frequent prefix begins, and its number; only what extends one can be frequent.
                at, own = np.arange(len(w.codes)), w.codes
                for k in range(1, longest):
                    times = np.bincount(own) if len(own) else np.zeros(0, int)
                    over = times > least
                    first = dict(zip(own[::-1].tolist(), at[::-1].tolist(), strict=True)) if k > 1 else {}
                    for x in np.flatnonzero(over).tolist():
                        words = [w.found[x]] if k == 1 else [w.found[c] for c in w.codes[first[x] : first[x] + k]]
                        rows.append((lang, b" ".join(words).decode(), int(times[x])))
                    kept = over[own] & w.follows(at, k)
                    at = at[kept]
                    if k + 1 == longest or not len(at):
                        break
                    own = np.unique(own[kept] * len(w.found) + w.codes[at + k], return_inverse=True)[1]
            yield _batch(rows, ["lang", "prefix", "n"], [pa.string(), pa.string(), pa.int64()])

    return texts.mapInArrow(each, "lang string, prefix string, n long")


def _key(suffix: tuple[bytes, ...], split: set[bytes]) -> tuple[bytes, bytes]:
    """The words by which a suffix is dealt, as many as it takes to leave the split prefixes, and the rest."""
    k = 1
    while k < len(suffix) and b" ".join(suffix[:k]) in split:
        k += 1
    return b" ".join(suffix[:k]), b" ".join(suffix[k:])


def _tails(w: Words, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A chunk's distinct suffixes in reverse order: the words in order of their bytes, ranks of each suffix's words in
    rows (their number where there is none), and how often each suffix occurs."""
    words = pa.array(w.found.tolist(), pa.large_binary())
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
    at = np.arange(len(w.codes))
    # A suffix that ends sorts before those that go on: 0 stands for no word.
    grid = [np.where(at + i < w.ends, rank[w.codes[np.minimum(at + i, len(at) - 1)]], np.uint64(0)) for i in range(longest)]
    two = [(grid[i] << np.uint64(32)) | (grid[i + 1] if i + 1 < longest else np.uint64(0)) for i in range(0, longest, 2)]
    down = np.lexsort(two[::-1])[::-1]
    two = [x[down] for x in two]
    starts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in two], axis=0)))
    kept = np.stack([grid[i][down[starts]].astype(np.int64) for i in range(longest)])
    return pa.concat_arrays([words.take(pa.array(order)), pa.array([b""], pa.large_binary())]), np.where(kept > 0, kept - 1, len(order)), np.diff(np.append(starts, len(at)))


def suffixes(texts: DataFrame, split: dict[str, set[bytes]], longest: int) -> DataFrame:
    """(lang, key, tails): the suffixes of a chunk that share a language and key. tails: one a line, with their number where it is not one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for lang, w in chunk.items():
                if not len(w.codes):
                    continue
                words, grid, times = _tails(w, longest)
                none = len(words) - 1
                cut = split.get(lang, set())
                # What follows the key, joined by blanks, and the number of occurrences behind a tab where it is not one.
                lines = words.take(pa.array(grid[1]))
                for row in grid[2:]:
                    lines = pc.binary_join_element_wise(lines, words.take(pa.array(row)), pa.array(np.where(row < none, b" ", b""), pa.large_binary()))
                often = np.flatnonzero(times > 1)
                mark = np.full(len(times), b"", object)
                mark[often] = [b"\t%d" % n for n in times[often].tolist()]
                lines = pc.binary_join_element_wise(lines, pa.array(mark, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                first = grid[0]
                starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
                ends = np.append(starts[1:], len(first))
                keys = words.take(pa.array(first[starts]))
                whole = np.array([k not in cut for k in keys.to_pylist()], bool) if cut else np.ones(len(starts), bool)
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(first))), lines), pa.scalar(b"\n", pa.large_binary()))
                kept = pa.array(whole)
                keys, joined = keys.filter(kept).cast(pa.large_string()).cast(pa.string()), joined.filter(kept).cast(pa.large_string()).cast(pa.string())
                for at in range(0, len(keys), 20_000):
                    part = keys[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, joined[at : at + 20_000]], ["lang", "key", "tails"])
                # Suffixes with a split prefix are dealt by more of their words.
                longer: dict[bytes, list[bytes]] = defaultdict(list)
                for i in chain.from_iterable(range(a, b) for a, b in zip(starts[~whole].tolist(), ends[~whole].tolist(), strict=True)):
                    key, rest = _key(tuple(words[w].as_py() for w in grid[:, i].tolist() if w < none), cut)
                    longer[key].append(rest if times[i] == 1 else b"%s\t%d" % (rest, times[i]))
                if longer:
                    yield _batch([(lang, k, b"\n".join(v)) for k, v in longer.items()], ["lang", "key", "tails"], [pa.string()] * 3)

    return texts.mapInArrow(each, "lang string, key string, tails string")


class Stack:
    """Counts prefixes of suffixes that come in reverse order. Each level holds a word and what its prefix has so far."""

    def __init__(self, done):
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.done = done

    def push(self, suffix: list[bytes], n: int) -> None:
        same, words = 0, self.words
        for a, b in zip(words, suffix, strict=False):
            if a != b:
                break
            same += 1
        self.pop(same)
        words += suffix[same:]
        self.counts += [0] * (len(suffix) - same)
        self.counts[-1] += n

    def pop(self, to: int) -> None:
        """Prefixes longer than ``to`` words are complete; each adds to the one that it extends."""
        while len(self.words) > to:
            n = self.counts.pop()
            self.done(self.words, n)
            self.words.pop()
            if self.counts:
                self.counts[-1] += n


def _frequent(group: np.ndarray, words: list[np.ndarray], times: np.ndarray, least: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes cut behind their last prefix that can reach the bound, equal ones summed: (rows of group and words, -1 for none; times).

    group: of each suffix; words: codes of those behind the key, -1 for none; whole: groups whose suffixes aren't cut.
    """
    own, cut, kinds = group.astype(np.int64), group.astype(np.int64), [group]
    for w in words:
        wide = int(w.max(initial=0)) + 2
        own = pd.factorize(own * wide + w + 1)[0]
        often = np.bincount(own, times)[own] >= least
        stay = (w >= 0) & (often | whole[group])
        if len(kinds) > 1:
            stay &= kinds[-1] >= 0
        kinds.append(np.where(stay, w, -1))
        cut = pd.factorize(cut * wide + kinds[-1] + 1)[0]
    first = np.empty(int(cut.max(initial=-1)) + 1, np.int64)
    first[cut] = np.arange(len(cut))
    first = first[np.argsort(group[first], kind="stable")]
    return np.stack([k[first] for k in kinds]), np.bincount(cut, times)[cut[first]].astype(np.int64)


def prefix_counts(dealt: DataFrame, split: dict[str, set[bytes]], least: int) -> DataFrame:
    """(lang, phrase, words, n, whole) from sorted rows of suffixes: complete counts of at least ``least``, and pieces of split ones."""

    def counted(langs: list[str], keys: list[str], tails: pa.Array) -> Iterator[tuple]:
        """The prefixes of whole groups, rows that share a language and key being next to each other."""
        new = [i == 0 or keys[i] != keys[i - 1] or langs[i] != langs[i - 1] for i in range(len(keys))]
        heads = [(langs[i], keys[i].encode().split(b" ")) for i in range(len(keys)) if new[i]]
        parted = pc.split_pattern(tails.cast(pa.large_binary()), b"\n")
        group = np.repeat(np.cumsum(new) - 1, pc.list_value_length(parted).to_numpy())
        pair = pc.split_pattern(parted.flatten(), b"\t")
        size = pc.list_value_length(pair).to_numpy()
        at, flat = np.cumsum(size) - size, pair.flatten()
        times = np.ones(len(size), np.int64)
        times[size > 1] = [int(x) for x in flat.take(pa.array(at[size > 1] + 1)).to_pylist()]
        held = [split.get(lang, set()) for lang, _ in heads]
        odd = np.array([bool(cut) and any(b" ".join(key[:k]) in cut for k in range(1, len(key) + 1)) for (_, key), cut in zip(heads, held, strict=True)], bool)
        # Groups of fewer suffixes than the bound have no prefix that can reach it.
        live = ((np.bincount(group, times, len(heads)) >= least) | odd)[group]
        group, times, rest = group[live], times[live], pc.split_pattern(flat.take(pa.array(at[live])), b" ")
        if not len(group):
            return
        size = pc.list_value_length(rest).to_numpy()
        codes = rest.flatten().dictionary_encode()
        names, numbers, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(), np.cumsum(size) - size
        empty = names.index(b"") if b"" in names else -1
        words = []
        for k in range(int(size.max())):
            w = np.where(k < size, numbers[np.minimum(at + k, len(numbers) - 1)], -1)
            words.append(np.where(w == empty, -1, w))
        kinds, sums = _frequent(group, words, times, least, odd)
        listed = zip(*kinds.tolist(), sums.tolist(), strict=True)
        for g, own in groupby(listed, key=lambda r: r[0]):
            (lang, head), cut, out = heads[g], held[g], []
            stack = Stack(lambda w, n, out=out: out.append((b" ".join(w), len(w), n)))
            for suffix, n in sorted(((head + [names[c] for c in r[1:-1] if c >= 0], r[-1]) for r in own), reverse=True):
                stack.push(suffix, n)
            stack.pop(0)
            yield from ((lang, p.decode(), k, n, p not in cut) for p, k, n in out if n >= least or p in cut)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
            langs, keys = table.column(0).to_pylist(), table.column(1).to_pylist()
            # The last group may go on in the next batch.
            end = len(keys) - 1
            while end and keys[end - 1] == keys[-1] and langs[end - 1] == langs[-1]:
                end -= 1
            left = table.slice(end)
            if end and (rows := list(counted(langs[:end], keys[:end], table.column(2).slice(0, end).combine_chunks()))):
                yield _batch(rows, names, kinds)
        if left is not None and (rows := list(counted(left.column(0).to_pylist(), left.column(1).to_pylist(), left.column(2).combine_chunks()))):
            yield _batch(rows, names, kinds)

    names, kinds = ["lang", "phrase", "words", "n", "whole"], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
    return dealt.mapInArrow(each, "lang string, phrase string, words int, n long, whole boolean")


def phrase_counts(docs: DataFrame, least: int, longest: int, scratch: Scratch, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) for every phrase of one to ``longest`` words that occurs ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / (4 * parts)
    met = scratch.cut(frequent_prefixes(texts, share, longest), "phrases-prefixes")
    words = met.where("prefix is null").groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most (longest - 1) / share rows, a dozen a part.
    over = met.where("prefix is not null").groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total)
    split: dict[str, set[bytes]] = defaultdict(set)
    for r in over.toLocalIterator():
        split[r.lang].add(r.prefix.encode())
    split = dict(split)

    dealt = suffixes(texts, split, longest).repartition(parts, "lang", "key").sortWithinPartitions("lang", F.desc("key"))
    counted = scratch.cut(prefix_counts(dealt, split, least), "phrases-counts")
    added = counted.where("not whole").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return counted.where("whole").select("lang", "phrase", "words", F.col("n").alias("f")).unionByName(added), words


def _part(phrase: Column, first: Column | int, n: Column | int) -> Column:
    """n words of a phrase from the first-th on, counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words that occur ``least`` times.

    score: floor(2000000 * a / (l + r)) for the cut where it is least. Phrases inside a longer one that has ``inside``
    per cent of their occurrences are left out. Ties: by a, then by the phrase's bytes.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be 1 or more, longest 2 or more")
    scratch = Scratch()
    known, words = phrase_counts(docs, least, longest, scratch, text_col, lang_col)
    known = scratch.cut(known, "phrases-known")
    found = known.where("words >= 2")

    longer = known.where("words >= 3")
    subs = F.explode(F.array(_part(F.col("phrase"), 1, F.col("words") - 1), _part(F.col("phrase"), 2, F.col("words") - 1)))
    covered = longer.select("lang", subs.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = found.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * exact("most") < inside * exact("f"), F.lit(True)))

    cut = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.col("phrase"), 1, F.col("k")).alias("first"), _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left, right = (known.select("lang", F.col("phrase").alias(c), F.col("f").alias(f)) for c, f in (("first", "l"), ("rest", "r")))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = both.withColumn("score", F.expr("cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as bigint)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    some = lowest.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return scratch.last(out, "phrases-out")
