"""Best-fit packing of token sequences, with exact complements first.

Texts are encoded where they lie and cut into pieces of the limit; only the last
piece of a document is shorter. Packing works on counts by length, of which there
are at most as many as the limit, so the driver's part is bounded: an index of
the lengths, of the sums of two and (through those) of three, each under what is
still available, gives for the longest length the one, two or three others that
fill its gap exactly, taken as often as the counts allow. What has no exact
complement goes best fit, longest first, into the smallest gap that holds it. The
plan is made under two orders of choice and without exact complements, and the one
of fewest sequences is taken. It is a table of ranges: ranks of a length, their
sequences and offsets. A piece's rank among its length is its place within its
part of the written table plus the counts of earlier parts, so no piece is moved
to be ranked, and a length that a third of all pieces have is no hot key.

Nulls: a null text is an empty one and has only the end id. Null and repeated ids
are kept as rows of their own, copies too. Very long texts become many pieces. An
empty table gives no rows. Only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import halved, table, written
from .pieces import Memo, packed

VOCABULARY = "word_bpe_49k.json"
LIMIT = 4096
END_ID = 1
#: Words that a worker remembers, with and without marks, and as many older ones: about 200 MB at most.
MEMO_WORDS = 700_000
#: Marks that a word is remembered without. No apostrophe: the pattern joins it to letters.
MARKS = '.,;:!?"()[]{}|-_/<>*#=+&%'
#: A mark next to another, and letters that change otherwise when lowered first: such texts are split as they are.
_MARK_RUN = re.compile(r"[,.;:!?](?=\s)(?<=[^\w\s].|_.)", re.DOTALL)
_CASE_ODD = re.compile("[\u0300-\u036f\u03a3\u0130]")
#: The pre-tokenizing pattern under which white space only divides (a fixed value of the vocabulary file).
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _of_letters(word: str) -> bool:
    """Whether a word is letters alone, and stays so when it is normalised and lowered."""
    return word.isalpha() and (word.isascii() or "\u0130" not in word and unicodedata.normalize("NFC", word).isalpha())


class TextEncoder:
    """texts -> their ids as little-endian integers of 32 bits (narrow: 16), as the tokenizers library gives them.

    Where the vocabulary drops white space and no rule looks across it, the words
    between white space that are not remembered are encoded together, once each:
    each word of letters alone ends in one token that can only end a word, by
    which the ids are told apart. Marks round a word are tokens of their own, so
    words are remembered without them. Texts with an added token or with control
    characters that only Python takes for white space, and texts under any other
    vocabulary, go through the library whole.
    """

    def __init__(self, path: str, narrow: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.narrow = Tokenizer.from_file(path), narrow
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())}
        end = spec["model"].get("end_of_word_suffix")
        self.divides = bool(end) and steps[0].get("pattern") == {"Regex": WORDWISE} and steps[0].get("behavior") == "Removed" and kinds <= {"NFC", "Replace", "Lowercase"}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if end and t.endswith(end)]] = True
        self.whole_only = [t["content"] for t in spec.get("added_tokens", ())] + ["\x1c", "\x1d", "\x1e", "\x1f"]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = Memo(self.whole, 10_000)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids, self.narrow)

    def split(self, text: str) -> list[str]:
        """The words of a text; single marks before white space stand alone, and A-Z are lowered, where this changes no id."""
        if not _MARK_RUN.search(text) and (text.isascii() or not _CASE_ODD.search(text) and unicodedata.is_normalized("NFC", text)):
            text = text.lower()
            for mark in ",.;:!?":
                text = text.replace(mark + " ", f" {mark} ").replace(mark + "\n", f" {mark} ")
        return text.split()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t and self.divides and not any(x in t for x in self.whole_only) else None for t in texts]
        fresh = set(chain.from_iterable(w for w in split if w)).difference(self.words)
        if len(self.words) + len(fresh) > MEMO_WORDS:
            self.older, self.words = self.words, {}
            fresh = set(chain.from_iterable(w for w in split if w))
        self.learn(fresh)
        known = self.words.__getitem__
        return [b"" if not t else self.whole(t) if w is None else b"".join(map(known, w)) for t, w in zip(texts, split)]

    def learn(self, fresh: set[str]) -> None:
        words, older = self.words, self.older
        for word in fresh.intersection(older):
            words[word] = older[word]
        rest = [w for w in fresh if w not in words] if older else fresh
        new = {w for w in rest if w.isalpha() and (w.isascii() or _of_letters(w))}
        marked = [(w, core if _of_letters(core := w.strip(MARKS)) else "") for w in rest if w not in new]
        new.update(core for _, core in marked if core and core not in words)
        plain = list(new)
        for at in range(0, len(plain), 2_000):
            some = plain[at : at + 2_000]
            words.update(zip(some, self.together(some)))
        for word, core in marked:
            if core:
                first = word.index(core)
                before, after = word[:first], word[first + len(core) :]
                words[word] = (self.marks[before] if before else b"") + words[core] + (self.marks[after] if after else b"")
            else:
                words[word] = self.marks[word]

    def together(self, some: list[str]) -> list[bytes]:
        """The ids of words of letters alone, from one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(some):  # a letter that lower-cases to more than letters
            return [self.whole(w) for w in some]
        width = 2 if self.narrow else 4
        data, at = ids.astype("<u2" if self.narrow else "<u4").tobytes(), [0, *(ends * width).tolist()]
        return [data[i:j] for i, j in zip(at, at[1:])]


@functools.lru_cache(maxsize=2)
def encoder(path: str, narrow: bool) -> TextEncoder:
    """One for each worker: what it remembers stays there over tasks."""
    return TextEncoder(path, narrow)


def pieces(df: DataFrame, vocabulary: str, limit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row a piece: id, piece, start, length, ids, ids_crc32, and its part of the table and place in it among its length."""
    from tokenizers import Tokenizer

    narrow = max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()) < 1 << 16
    kind, width = ("<u2", 2) if narrow else ("<u4", 4)
    fields = [
        df.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.LongType()), T.StructField("place", T.LongType()),
    ]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, places, task = encoder(vocabulary, narrow), packed([end_id], narrow), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for part in halved(batch):
                rows, number, ids, crcs, place = [], [], [], [], []
                for i, found in enumerate(encode(part.column(1).to_pylist())):
                    data = found + end
                    for k, at in enumerate(range(0, len(data), limit * width)):
                        ids.append(data[at : at + limit * width])
                        rows.append(i)
                        number.append(k)
                        crcs.append(zlib.crc32(np.frombuffer(ids[-1], kind).astype("<u4").tobytes()))
                        place.append(places[len(ids[-1])])
                        places[len(ids[-1])] += 1
                number = np.array(number, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(number * limit),
                    pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64()),
                    pa.array(np.full(len(ids), task, np.int64)), pa.array(place, pa.int64()),
                ], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


class Sums:
    """Which lengths, and which sums of two lengths, are still available, under their counts."""

    def __init__(self, left: np.ndarray):
        self.left, self.limit = left, len(left) - 1
        self.once, self.twice = left > 0, left > 1
        self.pairs = np.zeros(len(left), np.int64)
        for a in np.flatnonzero(self.once).tolist():
            self.pairs[a:] += self.once[: len(left) - a]
        # Each pair of different lengths was met twice, each length with itself once.
        doubles = 2 * np.flatnonzero(self.once)
        self.pairs[doubles[doubles <= self.limit]] -= 1
        self.pairs //= 2
        doubles = 2 * np.flatnonzero(self.twice)
        self.pairs[doubles[doubles <= self.limit]] += 1

    def take(self, lengths: Counter, times: int) -> None:
        for a, n in lengths.items():
            self.left[a] -= n * times
            if self.twice[a] and self.left[a] < 2:
                self.twice[a] = False
                if 2 * a <= self.limit:
                    self.pairs[2 * a] -= 1
            if self.once[a] and not self.left[a]:
                self.once[a] = False
                self.pairs[a:] -= self.once[: self.limit + 1 - a]

    def times(self, lengths: Counter) -> int:
        return min(int(self.left[a]) // n for a, n in lengths.items())

    def two(self, total: int, balanced: bool) -> Iterator[tuple[int, int]]:
        """Available pairs of this sum, the larger first: the most alike or the least alike before others."""
        first = (total + 1) // 2
        found = first + np.flatnonzero(self.once[first:total] & self.once[total - first : 0 : -1][: total - first])
        for a in (found if balanced else found[::-1]).tolist():
            yield a, total - a

    def filling(self, length: int, balanced: bool) -> Counter | None:
        """length with the one, two or three others that fill its gap exactly, if there are such."""
        gap = self.limit - length
        if gap > 0 and self.once[gap] and self.times(found := Counter((length, gap))):
            return found
        if self.pairs[gap]:
            for two in self.two(gap, balanced):
                if self.times(found := Counter((length, *two))):
                    return found
        thirds = np.flatnonzero(self.once[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0)) + 1
        for a in (thirds if balanced else thirds[::-1]).tolist():
            for two in self.two(gap - a, balanced):
                if self.times(found := Counter((length, a, *two))):
                    return found
        return None


Pattern = tuple[tuple[tuple[int, int], ...], int]


def _exact(left: np.ndarray, balanced: bool) -> list[Pattern]:
    """Sequences that are filled exactly, as ((length, how many), ...) and times; left loses what they hold."""
    sums, made = Sums(left), []
    for length in range(len(left) - 2, 0, -1):
        while left[length] and (found := sums.filling(length, balanced)):
            times = sums.times(found)
            sums.take(found, times)
            made.append((tuple(sorted(found.items(), reverse=True)), times))
    return made


def _best_fit(left: np.ndarray) -> list[Pattern]:
    """All that is left, longest first, each into the smallest gap that holds it."""
    limit = len(left) - 1
    gaps: list[list[Pattern]] = [[] for _ in range(limit + 1)]
    open_ = np.zeros(limit + 1, bool)

    def put(gap: int, pattern: tuple, times: int) -> None:
        if times:
            gaps[gap].append((pattern, times))
            open_[gap] = True

    for length in range(limit, 0, -1):
        while n := int(left[length]):
            gap = length + int(np.argmax(open_[length:]))
            if open_[gap]:
                pattern, times = gaps[gap].pop()
                open_[gap] = bool(gaps[gap])
            else:
                pattern, times, gap = (), -(-n // (limit // length)), limit
            each = gap // length
            full = min(times, n // each)
            put(gap - each * length, (*pattern, (length, each)), full)
            rest = n - full * each if full < times else 0
            if rest:
                put(gap - rest * length, (*pattern, (length, rest)), 1)
            put(gap, pattern, times - full - bool(rest))
            left[length] -= full * each + rest
    return [x for held in gaps for x in held]


def plan(counts: dict[int, int], limit: int) -> list[Pattern]:
    """Sequences for so many pieces of each length: ((length, how many), ...) and how often. Bounded by the limit, not the counts."""
    start = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        start[length] = n
    best = None
    for balanced in (False, True, None):
        left = start.copy()
        found = [(((limit, 1),), int(left[limit]))] if left[limit] else []
        left[limit] = 0
        found += _exact(left, balanced) if balanced is not None else []
        found += _best_fit(left)
        if best is None or sum(t for _, t in found) < sum(t for _, t in best):
            best = found
    return best


def ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, how many in a sequence) of each place in the plan."""
    rank, base, out = Counter(), 0, []
    for lengths, times in patterns:
        offset = 0
        for length, each in lengths:
            out.append((length, rank[length], rank[length] + times * each, base, offset, each))
            rank[length] += times * each
            offset += length * each
        base += times
    return out


def pack(df: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: id, piece, start, length, ids (little-endian, 16 bits where the vocabulary allows), ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    held = written(pieces(df, vocabulary, limit, end_id, id_col, text_col), "pieces")
    counts = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    schema = "length long, low long, high long, base long, at long, each long"
    places = spark.createDataFrame(ranges(plan(totals, limit)), schema)  # a few rows a length at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("earlier"))
    ranked = held.join(earlier, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("place"))
    found = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    return found.select(
        id_col, "piece", "start", ranked["length"], "ids", "ids_crc32",
        (F.col("base") + F.expr("(rank - low) div each")).alias("sequence_id"), (F.col("at") + within % F.col("each") * ranked["length"]).alias("offset"),
    )


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, and all ids in order of their offsets; a group holds the limit at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def op11_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).drop("ids")
