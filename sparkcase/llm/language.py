"""Language identification by cross-parsing entropy.

Texts are lower-cased, and runs of anything but letters are one blank; symbols
are the UTF-8 bytes of what is left, so letters of any script have their own. For
each language a suffix automaton of labelled text is built. A text is parsed,
from left to right, into the longest phrases that occur in a language's labelled
text; a language in which it takes few phrases is near. Phrase counts are
normalised as entropies, phrases * log2(labelled symbols) / symbols, and the
language needing fewest wins (ties: the smaller name).

The automata become one transition table, so that many stretches of text are
parsed in all languages at once. Whole texts are parsed: each stretch first as
if it began a phrase, then on from where the one before it ended, until both
parses are in one state; what differs up to there is put right.

Fitting takes a bounded sample of labelled rows: of each language the SAMPLE_ROWS
rows of least hash, SAMPLE_CHARS code points of each, and SAMPLE_SYMBOLS in all
(fewer where there are so many languages that TOTAL_SYMBOLS would be passed, so
the table that is broadcast is bounded).

Nulls: rows with null text or label teach nothing. A text that is null or has
no letter is `und` with score 0, as is every text when nothing was learned. An
empty table gives no rows; repeated rows are predicted alike. Extra columns are
kept, columns with the outputs' names are replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import append_columns, table
from .pieces import letters

UNKNOWN = "und"
SAMPLE_ROWS = 40
SAMPLE_CHARS = 4_000
SAMPLE_SYMBOLS = 30_000
TOTAL_SYMBOLS = 240_000
STRETCH = 512
BATCH_SYMBOLS = 1_000_000
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


class CrossParser:
    """The phrase counters of some languages, as one transition table."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        most = min(SAMPLE_SYMBOLS, TOTAL_SYMBOLS // max(len(samples), 1))
        learned: dict[str, list[bytes]] = {}
        for name in self.languages:
            learned[name], left = [], most
            for text in samples[name]:
                symbols = _plain(text)[:left]
                left -= len(symbols)
                learned[name].append(symbols)
        used = sorted({b for parts in learned.values() for part in parts for b in part})
        self.symbol = np.zeros(256, np.uint8)  # 0: a byte that no language knows
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 2
        self.pad = self.width - 1
        tables, self.bases, self.sizes, base = [], [], [], 0
        for name in self.languages:
            sam = SuffixAutomaton(s for part in learned[name] for s in [*self.symbol[list(part)].tolist(), -1])
            self.sizes.append(sum(map(len, learned[name])))
            self.bases.append(base)
            tables.append(self._table(sam, base))
            base += len(tables[-1])
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def _table(self, sam: SuffixAutomaton, base: int) -> np.ndarray:
        """(next state's row * 2 + 1 if a phrase begins) for each state and symbol."""
        width = self.width
        root = np.full(width, base * 2 + 1, np.int32)
        for s, to in sam.next[0].items():
            if s > 0:
                root[s] = (base + to * width) * 2 + 1
        root[self.pad] = base * 2
        out = np.tile(root, (len(sam.next), 1))
        for state in range(1, len(sam.next)):
            for s, to in sam.next[state].items():
                if s > 0:
                    out[state, s] = (base + to * width) * 2
        return out.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (languages x texts) and lengths of texts in symbols, runs of other than letters as one blank."""
        symbols, sizes = _symbols(texts)
        pieces = -(-sizes // STRETCH)
        n = int(pieces.sum())
        grid = np.full(n * STRETCH, self.pad, np.uint8)
        skipped = np.concatenate(([0], np.cumsum(pieces * STRETCH - sizes)))[:-1]
        grid[np.arange(len(symbols)) + np.repeat(skipped, sizes)] = self.symbol[symbols]
        steps = np.ascontiguousarray(grid.reshape(n, STRETCH).T).astype(np.int32)
        n_languages = len(self.bases)
        state = np.repeat(np.array(self.bases, np.int32)[:, None], n, axis=1)
        entries = np.empty((STRETCH, n_languages, n), np.int32)
        begun = np.zeros(state.shape, np.int32)
        for row, kept in zip(steps, entries):
            state += row
            self.table.take(state, out=kept, mode="clip")
            begun += kept & 1
            np.right_shift(kept, 1, out=state)
        begun += self._corrections(steps, entries.reshape(STRETCH, -1), state, pieces)
        of_text = np.repeat(np.arange(len(texts)), pieces)
        return np.array([np.bincount(of_text, row, len(texts)) for row in begun]), sizes

    def _corrections(self, steps: np.ndarray, entries: np.ndarray, last: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """What the phrase counts of stretches change by when each goes on from the end of the one before it.

        entries and last: the parse of stretches that each begin a phrase, and its last states.
        """
        n = steps.shape[1]
        goes_on = np.ones(n, bool)
        goes_on[(np.cumsum(pieces) - pieces)[pieces > 0]] = False
        change = np.zeros(last.size, np.int32)
        own, true = last.ravel(), last.ravel().copy()
        cells = np.flatnonzero(np.tile(goes_on, len(last)))  # cell: language * n + stretch
        while len(cells):
            here, state = cells, true[cells - 1].copy()
            ended = own[cells].copy()
            change[cells] = 0
            left = np.arange(len(cells))
            for row, kept in zip(steps, entries):
                entry = self.table.take(state + row[here % n])
                before = kept[here]
                change[here] += (entry & 1) - (before & 1)
                state = entry >> 1
                apart = state != before >> 1
                if not apart.all():
                    here, state, left = here[apart], state[apart], left[apart]
                    if not len(here):
                        break
            ended[left] = state
            moved = ended != true[cells]
            true[cells] = ended
            after = cells[moved] + 1
            cells = after[(after % n != 0)]
            cells = cells[goes_on[cells % n]]
        return change.reshape(last.shape)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        counts, sizes = self.phrases(texts)
        entropy = counts * np.log2(np.array(self.sizes)[:, None] + 2.0) / np.maximum(sizes, 1)
        order = np.argsort(entropy, axis=0, kind="stable")
        best = np.take_along_axis(entropy, order[:1], 0)[0]
        second = np.take_along_axis(entropy, order[1:2], 0)[0] if len(order) > 1 else np.full_like(best, np.inf)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(second + best, 1e-12))
        return [(self.languages[i], float(s)) for i, s in zip(order[0], score)]


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts, one after another, runs of other than letters as one blank; and each text's number of bytes."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = ~letters()[points]
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    kept[:1] = True
    kept[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    points = np.where(blank, np.uint32(32), points)[kept]
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    of_text = np.repeat(np.arange(len(texts)), sizes)[kept]
    plain = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return np.frombuffer(plain, np.uint8), np.bincount(of_text, width, len(texts)).astype(np.int64)


def _plain(text: str) -> bytes:
    return _symbols([text])[0].tobytes()


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> bytes:
    """A pickled CrossParser of the labelled rows' bounded sample."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & has_letter(F.col(text_col)))
    least = Window.partitionBy("label").orderBy("order", "id")
    sample = (
        rows.select(
            F.col(label_col).cast("string").alias("label"), F.col(id_col).alias("id"),
            F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("order"),
            F.substring(text_col, 1, SAMPLE_CHARS).alias("text"),
        )
        .withColumn("n", F.row_number().over(least)).filter(F.col("n") <= SAMPLE_ROWS)
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["label"], r["n"])):  # SAMPLE_ROWS a language at most
        samples.setdefault(row["label"], []).append(row["text"])
    return pickle.dumps(CrossParser(samples))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        parser: CrossParser = pickle.loads(shared.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text_col).to_pylist()
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            lettered = [i for i, ok in enumerate(batch.column("__lettered").to_pylist()) if ok and parser.languages]
            group, held = [], 0
            for i in [*lettered, None]:
                if i is not None:
                    group.append(i)
                    held += len(texts[i])
                if group and (i is None or held > BATCH_SYMBOLS):
                    for j, found in zip(group, parser.predict([texts[j] for j in group])):
                        out[j] = found
                    group, held = [], 0
            return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

        return compute

    return append_columns(df.withColumn("__lettered", has_letter(F.col(text_col))), FIELDS, make).drop("__lettered")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.filter(~held_out()))
    return predict(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
