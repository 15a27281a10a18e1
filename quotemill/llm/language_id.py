"""Language identification: scripts narrow the candidates, Viterbi over word scores labels the spans.

A model holds log probabilities of letter trigrams per language and the languages seen in each script. A text is
cut into words; each word gets a normalised log score per language, with languages foreign to its script at the
floor; Viterbi with a fixed penalty per change of language labels the words, and runs of one label are spans.

These scores only choose among the known languages and sum to one over them, so they can't tell that a text is in none.
For that a word counts as known if its script was seen and its trigrams are, on average, more likely in some language
than half-way (in logarithms) from text of that language to its letters in random order. The share of the letters in
known words doesn't depend on how many languages share the text.

Defined cases: a null or letterless text gives language ``und``, score 0 and no span; a word in an unseen script
scores all languages alike; equal texts give equal rows; an empty table gives an empty table; without any labelled
row every text is ``und``. Columns of the input other than key and text are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carrying, lean, small_batches

#: Combining marks, which belong to the word of the letter before them.
MARKS = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")))
WORD = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")
UNDETERMINED = "und"

# First code points of blocks and the script that starts there (Unicode block chart).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Other"), (0x20000, "Han"),
]
_STARTS = [start for start, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _codes(text: str) -> np.ndarray:
    """One number for each three neighbouring letters of ``text``."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]


@dataclass
class LanguageModel:
    """Plain arrays, so that it is cheap to send; at most ``max_grams`` trigrams."""

    languages: list[str]
    grams: dict[str, int] = field(default_factory=dict)
    log_p: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    scripts: dict[str, list[int]] = field(default_factory=dict)
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor: float = 5.0
    penalty: float = 16.0

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams' numbers in order, and the row of each."""
        own = _codes("".join(self.grams))[::3] if self.grams else np.zeros(0, np.uint64)
        rows = np.argsort(own).astype(np.int32)
        return own[rows], rows

    def scores(self, words: list[str], slots: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A row of normalised log scores, between -floor and 0, for each word; whether it is like words of any language."""
        found = _codes("^" + "$^".join(words) + "$")
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 2)
        real = np.ones(len(found), bool)  # no trigram spans two words
        for back in (1, 2):
            real[ends[:-1] - back] = False
        found = found[real]
        rows = np.full(len(found), len(self.grams), np.int32)  # the last row is for trigrams that aren't there
        if self.grams:
            at = np.minimum(np.searchsorted(slots[0], found), len(slots[0]) - 1)
            rows = np.where(slots[0][at] == found, slots[1][at], rows)
        table = np.vstack([self.log_p, self.unseen[None, :]])
        total = np.add.reduceat(table[rows].astype(np.float64), np.append(0, np.cumsum(size)[:-1]), axis=0)
        own = [script_of(w) in self.scripts for w in words]
        if any(len(c) < len(self.languages) for c in self.scripts.values()):
            for i, allowed in enumerate(self.scripts.get(script_of(w)) for w in words):
                if allowed is not None and len(allowed) < total.shape[1]:
                    total[i, np.setdiff1d(np.arange(total.shape[1]), allowed)] = -np.inf
        known = np.array(own) & (total > size[:, None] * self.limits).any(1)  # a word has as many trigrams as letters
        total[~np.array(own)] = 0.0
        total -= total.max(1, keepdims=True)
        total -= np.log(np.exp(total).sum(1, keepdims=True))
        return np.maximum(total, -self.floor), known


def likely_limits(grams: list[str], table: np.ndarray, log_p: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Per language the mean log probability of a trigram half-way between its text and its letters in random order.

    ``table`` has the counts. The share of trigrams that new text has and these don't is taken from those seen once.
    """
    at = {c: i for i, c in enumerate(sorted(set("".join(grams))))}
    place = np.array([[at[c] for c in g] for g in grams], np.int64).reshape(-1, 3)
    out = np.zeros(table.shape[1])
    for k in range(table.shape[1]):
        n, total = table[:, k], max(table[:, k].sum(), 1)
        new = (n == 1).sum() / total
        text = (1 - new) * (n * log_p[:, k]).sum() / total + new * unseen[k]
        letters = np.bincount(place[:, 1], n, len(at)) / total  # the middle ones: each letter of a word is it once
        edges = np.bincount(place[:, 0], n, len(at)) / total, np.bincount(place[:, 2], n, len(at)) / total
        random = edges[0][place[:, 0]] * letters[place[:, 1]] * edges[1][place[:, 2]]
        out[k] = (text + (random * log_p[:, k]).sum() + (1 - random.sum()) * unseen[k]) / 2
    return out


def train(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang",
    rows_per_language: int = 2_000, max_grams: int = 100_000, max_languages: int = 500, penalty: float = 16.0,
) -> LanguageModel:
    """Fit on about ``rows_per_language`` labelled whole texts of each language (all of a rarer one).

    Trigram counts are summed on the executors; the driver gets the ``max_grams`` most frequent ones.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("label").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels in {label}")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([])
    slots = 1 << 40
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, int(slots * min(1.0, rows_per_language / sizes[k])))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("language"), "key"), F.lit(slots)) < limit[F.col("label")])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for value, name in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words.update((name, w) for w in WORD.findall(value.lower()))
            grams: Counter = Counter()
            for (name, word), n in words.items():
                grams[name, "s", script_of(word)] += n
                for gram in trigrams(word):
                    grams[name, "g", gram] += n
            names, kinds, values = zip(*grams, strict=True) if grams else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((names, pa.string()), (kinds, pa.string()), (values, pa.string()), (list(grams.values()), pa.int64()))], ["label", "kind", "value", "n"])

    counts = sample.select("text", "label").mapInArrow(count, "label string, kind string, value string, n long")
    counts = counts.groupBy("kind", "value", "label").agg(F.sum("n").alias("n"))
    each = counts.groupBy("kind", "value").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"))
    found = each.orderBy(F.col("kind").desc(), F.col("total").desc(), "value").limit(max_grams).collect()
    place = {name: i for i, name in enumerate(languages)}
    grams = [r for r in found if r["kind"] == "g"]
    table = np.zeros((len(grams), len(languages)))
    for i, r in enumerate(grams):
        for name, n in r["by"].items():
            table[i, place[name]] = n
    smooth = 0.5
    total = table.sum(0) + smooth * (len(grams) + 1)
    seen = {r["value"]: r["by"] for r in found if r["kind"] == "s"}
    letters = Counter()
    for by in seen.values():
        letters.update(by)
    scripts = {s: sorted(place[k] for k, n in by.items() if n >= 0.01 * letters[k]) for s, by in seen.items()}
    log_p, unseen = np.log((table + smooth) / total).astype(np.float32), np.log(smooth / total).astype(np.float32)
    return LanguageModel(
        languages, {r["value"]: i for i, r in enumerate(grams)}, log_p, unseen, {s: c for s, c in scripts.items() if c},
        likely_limits([r["value"] for r in grams], table, log_p, unseen), penalty=penalty,
    )


class _Words(dict):
    """Row number of a word's scores; -1 if it has no letter. Emptied between steps when it has grown large."""

    def __init__(self, model: LanguageModel, most: int = 150_000):
        super().__init__()
        self.model, self.most, self.fresh, self.slots = model, most, [], model.slots()
        self.table, self.known = np.zeros((0, len(model.languages))), np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        at = -1
        if word.isalpha() or any(map(str.isalpha, word)):
            at = len(self.table) + len(self.fresh)
            self.fresh.append(word)
        self[word] = at
        return at

    def scores(self) -> np.ndarray:
        if self.fresh:
            table, known = self.model.scores(self.fresh, self.slots)
            self.table, self.known = np.vstack([self.table, table]), np.append(self.known, known)
            self.fresh = []
        return self.table

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.table, self.known = self.table[:0], self.known[:0]


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word; document d has rows starts[d] .. starts[d] + lengths[d].

    A document keeps its best single label if no stretch of words gains more than half the penalty by another one:
    then no path with a change can be better. The others go through Viterbi, all of them step by step together.
    """
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    full = np.flatnonzero(lengths)
    first, size = starts[full], lengths[full]
    owner = np.repeat(np.arange(len(full)), size)
    best = np.add.reduceat(scores, first, axis=0).argmax(1)
    labels[:] = best[owner]
    gain = scores - scores[np.arange(len(scores)), labels][:, None]
    apart = (1.0 + np.abs(gain).sum()) * owner[:, None]  # so that each document starts below all before it
    run = np.cumsum(gain, axis=0)
    run -= (run[first] - gain[first])[owner]
    low = np.minimum.accumulate(run - gain - apart, axis=0) + apart
    most = np.maximum.reduceat(run - low, first, axis=0).max(1)
    mixed = np.flatnonzero(most > penalty / 2)
    if len(mixed):
        _viterbi(scores, first[mixed], size[mixed], penalty, labels)
    return labels


def _viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float, labels: np.ndarray) -> None:
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t
    value = np.zeros((len(starts), scores.shape[1]))
    kept = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int16)
    for t, n in enumerate(active):
        at, now = starts[:n] + t, value[:n]
        if t:
            best = now.argmax(1)
            change = now[np.arange(n), best] - penalty
            kept[at] = now >= change[:, None]
            came[at] = best
            np.maximum(now, change[:, None], out=now)
        now += scores[at]
    last = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = last[:n]
        leave = ~kept[at, last[:n]]
        last[:n][leave] = came[at][leave]


def identify(
    docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text", spans: bool = True, carry: bool = False, known_share: bool = False,
) -> DataFrame:
    """Per row: key (``carry``: all columns, of which the result's replace those with its names), ``lang_pred``, ``score``
    (share of the letters in spans of that language), ``n_spans`` and, if asked for, ``known_share`` (share of the letters
    in words like those of any known language) and ``spans`` (start and end as code points of the text, language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = "lang_pred string, score double, n_spans int" + ", known_share double" * known_share + ", spans array<struct<start: int, end: int, lang: string>>" * spans
    source, schema, at_text, first = carrying(docs, key, text, added, carry)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    @lean
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        words, count = _Words(known), len(known.languages)
        for batch in small_batches(batches, at_text):
            texts = batch.column(at_text).to_pylist()
            found, ids, letters, lengths = [], [], [], []
            for value in texts:
                own = WORD.findall(value.lower()) if value and count else []
                row = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
                size = np.fromiter(map(len, own), np.int64, len(own))
                keep = row >= 0
                if not keep.all():
                    row, size = row[keep], size[keep]
                ids.append(row)
                letters.append(size)
                lengths.append(len(row))
            flat, lengths = np.concatenate([np.zeros(0, np.int64), *ids]), np.array(lengths, np.int64)
            scores = words.scores()[flat]
            starts = np.cumsum(lengths) - lengths
            labels = viterbi(scores, starts, lengths, known.penalty)
            size = np.concatenate([np.zeros(0, np.int64), *letters])
            owner = np.repeat(np.arange(len(texts)), lengths)
            wide = max(count, 1)
            share = np.bincount(owner * wide + labels, size, len(texts) * wide).reshape(len(texts), wide)
            fresh = np.ones(len(labels), bool)
            fresh[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
            runs = np.bincount(owner[fresh], minlength=len(texts))
            best, sums = share.argmax(1), share.sum(1)
            names = [known.languages[b] if s else UNDETERMINED for b, s in zip(best, sums, strict=True)]
            score = share[np.arange(len(texts)), best] / np.maximum(sums, 1)
            columns = [*batch.columns[first:], pa.array(names, pa.string()), pa.array(score), pa.array(runs, pa.int32())]
            if known_share:
                known_letters = np.bincount(owner, size * words.known[flat], len(texts))
                columns.append(pa.array(known_letters / np.maximum(sums, 1)))
            if spans:
                for d, value in enumerate(texts):
                    at, own = [], labels[starts[d] : starts[d] + lengths[d]]
                    places = [m.span() for m in WORD.finditer(value) if any(map(str.isalpha, m.group()))] if len(own) else []
                    for (start, end), name in zip(places, own, strict=False):
                        if at and at[-1]["lang"] == known.languages[name]:
                            at[-1]["end"] = end
                        else:
                            at.append({"start": start, "end": end, "lang": known.languages[name]})
                    found.append(at)
                columns.append(pa.array(found, kind))
            words.trim()
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(label, schema)
