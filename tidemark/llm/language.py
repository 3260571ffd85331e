"""Language identification of mixed texts.

Letters' script ranges narrow each word's candidate languages; a word scores its character trigrams (and itself, if
common) under each candidate; a Viterbi pass over the words, with a penalty for every switch, labels spans. A text's
language is the one whose spans hold most words.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch, slices

UNKNOWN = "und"
#: Labelled texts read for each language at most.
TEXTS_PER_LANGUAGE = 1000
#: What a switch costs, in natural-log units of the word scores.
SWITCH = 8.0
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01
# First code points of letter ranges and the script from there on ("" where letters of many scripts stand).
SCRIPTS = [
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x750, "arabic"), (0x780, ""),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""),
    (0x1780, "khmer"), (0x1800, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""),
    (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, ""), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]


def words_of(text: str) -> list[str]:
    """The runs of letters and combining marks, in lower case; learning and prediction cut texts alike."""
    import regex

    return regex.findall(r"[\p{L}\p{M}]+", text.lower())


def script_of(word: str) -> str:
    """The script of a word's first letter that has one."""
    for c in word:
        i = bisect_right(_STARTS, ord(c)) - 1
        if i >= 0 and SCRIPTS[i][1] and c.isalpha():
            return SCRIPTS[i][1]
    return ""


def features_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(word))] + ["=" + word]


class Model:
    """languages in order; feature -> log probability in each language; script -> which languages use it."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        total = {k: sum(n.values()) for k, n in counts.items()}
        known = {f for n in counts.values() for f in n}
        self.scores = {f: tuple(math.log((counts[k].get(f, 0) + 0.5) / (total[k] + 0.5 * len(known) + 1)) for k in self.languages) for f in known}
        self.rare = tuple(math.log(0.5 / (total[k] + 0.5 * len(known) + 1)) for k in self.languages)
        letters: dict[str, dict[str, int]] = {k: {} for k in self.languages}
        for k, n in counts.items():
            for f, c in n.items():
                if f[0] != "=" and (s := script_of(f)):
                    letters[k][s] = letters[k].get(s, 0) + c
        self.uses: dict[str, tuple] = {}
        for s in {s for n in letters.values() for s in n}:
            self.uses[s] = tuple(letters[k].get(s, 0) >= SCRIPT_SHARE * sum(letters[k].values()) and s in letters[k] for k in self.languages)

        self.grams = np.array(sorted(self._packed(f) for f in known if len(f) == 3 and f[0] != "="), np.uint64)
        by_key = {self._packed(f): f for f in known if len(f) == 3 and f[0] != "="}
        self.gram_scores = np.array([*(self.scores[by_key[k]] for k in self.grams.tolist()), self.rare], np.float64).reshape(len(self.grams) + 1, len(self.languages))
        self.scores = {f: row for f, row in self.scores.items() if f[0] == "="}

    @staticmethod
    def _packed(gram: str) -> int:
        return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])

    def candidates(self, word: str) -> tuple | None:
        """Which languages use the word's script; None without a letter, () if none does."""
        if not (word[0].isalpha() or any(map(str.isalpha, word))):
            return None
        uses = self.uses.get("latin" if "a" <= word[0] <= "z" else script_of(word))
        return uses if uses is not None and any(uses) else ()

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's score in each language: its trigrams', and its own if it is common."""
        text = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = np.flatnonzero(text != 32)
        keys = text[at - 1] << np.uint64(42) | text[at] << np.uint64(21) | text[at + 1]
        row = np.minimum(np.searchsorted(self.grams, keys), max(0, len(self.grams) - 1))
        row = np.where(self.grams[row] == keys, row, len(self.grams)) if len(self.grams) else np.zeros(len(keys), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sums = np.add.reduceat(self.gram_scores[row], np.cumsum(sizes) - sizes, axis=0)
        for i, w in enumerate(words):
            if (own := self.scores.get("=" + w)) is not None:
                sums[i] += own
        return sums


class WordScores:
    """Words' scores as rows of one table, the best candidate of each at 0. Row 0 is for words without a letter, row 1 for
    words without a candidate."""

    def __init__(self, model: Model, size: int = 120_000):
        self.model, self.size, self.row = model, size, {}
        self.table, self.used = np.zeros((2, len(model.languages)), np.float32), 2

    def learn(self, words: set[str]) -> None:
        """Scores the words that aren't known yet, all at once; before that, forgets all if there are more than `size`."""
        if self.used > self.size:
            self.row, self.used = {}, 2
        new, uses = [], []
        for w in words - self.row.keys():
            found = self.model.candidates(w)
            if found:
                self.row[w] = self.used + len(new)
                new.append(w)
                uses.append(found)
            else:
                self.row[w] = 0 if found is None else 1
        if not new:
            return
        scores, uses = self.model.words(new), np.array(uses, bool)
        scores -= np.where(uses, scores, -np.inf).max(1, keepdims=True)
        need = self.used + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
        self.table[self.used : need] = np.where(uses, scores, -2 * SWITCH)
        self.used = need

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))


def spans_of(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int]]:
    """label_spans of a table of scores.

    Let no run of words gain more than a switch by any language over the one that is best over all words, and no first
    and last run together: then each run of other languages costs at least as many switches as it can gain, and the pass
    over the words is left out.
    """
    best = int(scores.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    before = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]])), 0)
    last = gain[-1] - before[-1]
    if (gain - before).max() <= switch and max(0.0, gain.max()) + max(0.0, last.max()) <= switch:
        return [(0, best)]
    return label_spans(scores.tolist(), switch)


def label_spans(scores: list, switch: float = SWITCH) -> list[tuple[int, int]]:
    """(first word, language) of each span of the best labelling. Ties keep the language that sorts first."""
    if not scores:
        return []
    n = len(scores[0])
    each, reach, start, back = range(n), [0.0] * n, [0] * n, [None] * n
    for t, s in enumerate(scores):
        top = max(reach)
        floor = top - switch
        if min(reach) < floor:
            b = reach.index(top)
            node = (start[b], b, back[b])
            for k in each:
                if reach[k] < floor:
                    reach[k], start[k], back[k] = floor, t, node
        reach = list(map(add, reach, s))
    b = reach.index(max(reach))
    node, spans = (start[b], b, back[b]), []
    while node is not None:
        spans.append(node[:2])
        node = node[2]
    return spans[::-1]


def _by_language(values: dict[str, float]) -> Column:
    """The value of the row's `lang`; null without one."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None).cast("double")


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """From at most per_language texts of each language, those whose ids hash lowest: all their trigrams, and their words
    that occur more than once, are counted by Spark and go to the driver. Null texts and labels don't count."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("t is not null and lang is not null")
    place = F.shiftrightunsigned(F.xxhash64("i"), 1) / F.lit(float(1 << 63))
    # twice the share that a language needs, so that few rows of a common language are ranked; then the highest place
    # that is chosen: both are one number a language, and no text is shuffled
    counts = rows.groupBy("lang").count().collect()
    low = rows.select("lang", place.alias("place")).where(F.col("place") < _by_language({r["lang"]: 2.0 * per_language / r["count"] for r in counts}))
    ranked = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("n") <= per_language)
    chosen = rows.where(place <= _by_language({r["lang"]: r["last"] for r in ranked.groupBy("lang").agg(F.max("place").alias("last")).collect()}))
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        for batch in slices(batches):
            found = Counter((lang, w) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words_of(text))
            yield record_batch(schema, [[k[0] for k in found], [k[1] for k in found], list(found.values())])

    words = chosen.select("lang", "t").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: padded.substr(i, F.lit(3)))).alias("f"))
    grams = grams.groupBy("lang", "f").agg(F.sum("n").alias("n"))
    whole = words.where("n > 1").select("lang", F.concat(F.lit("="), "word").alias("f"), "n")
    found: dict[str, dict[str, int]] = {}
    for r in grams.unionByName(whole).collect():
        found.setdefault(r["lang"], {})[r["f"]] = r["n"]
    return Model(found)


def identify_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (array of first word, words, lang) for every row of docs.

    lang_pred is UNKNOWN with score 0 for a null text, one without a letter, or a model of no language; a text whose
    letters are all of scripts that no learned language uses gets the first learned language with score 0. score is
    the share of words in spans of lang_pred. Very long texts are labelled whole, in memory in proportion to the text.
    Repeated rows and null ids stay; other columns are left out; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it learned from
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))])

    def run(batches):
        model = shared.value
        languages, words = model.languages, WordScores(model)
        for batch in slices(batches):
            found = [words_of(text or "") for text in batch.column(1).to_pylist()]
            if languages:
                words.learn(set().union(*found))
            rows = []
            for each in found:
                ids = words.ids(each) if languages else np.zeros(0, np.int64)
                known = ids[ids > 1]
                if not len(known) or not languages:
                    rows.append((languages[0] if languages and len(ids) and ids.max() else UNKNOWN, 0.0, []))
                    continue
                spans = spans_of(words.table[known])
                ends = [a for a, _ in spans[1:]] + [len(known)]
                share = [0] * len(languages)
                for (a, k), b in zip(spans, ends):
                    share[k] += b - a
                top = share.index(max(share))
                rows.append((languages[top], share[top] / len(known), [{"start": a, "words": b - a, "lang": languages[k]} for (a, k), b in zip(spans, ends)]))
            yield record_batch(schema, [batch.column(0), *map(list, zip(*rows))])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, words: long, lang: string>>")
