"""Repeated passages of WINDOW words removed, with Aho-Corasick automata.

A window is WINDOW consecutive words of one text. A word goes if a window over it has the word sequence of a window that
starts anywhere else. Every window names one phrase in it: the PHRASE words of smallest hash, the first of equals. Equal
windows name equal phrases at the same place, so:

1. the phrases that windows name (about one in fifteen positions) are counted over all texts;
2. texts meet the phrases that occur twice or more; texts without any are done, and of the others just the windows that
   name such a phrase are counted. Those found twice are confirmed;
3. the phrases of confirmed windows are compiled into automata, a few thousand phrases each, for every part of the
   texts; each automaton holds phrases that its part has, and all undecided texts of the part stream through it. An
   occurrence of a phrase settles the confirmed windows around it, and their words go.

Texts are dealt out into parts of bounded size by a hash of id and text; every record returns to the part it came from.
Nothing is capped: a phrase in a third of all texts is one record for each part and count.

Windows are told apart by 64-bit hashes, phrases by their bytes. Null and empty texts have no words; fewer words than a
window are kept as they are; equal rows repeat each other. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.packing import PACKED, flushed, packed, regrouped, unpacked
from ruleloom.llm.storage import part_count, written
from ruleloom.llm.text import column_bytes, gram_hashes, inner_grams, mixed, ranges, word_hashes

WINDOW = 35
PHRASE = 8
PART_BYTES = 8 << 20
AUTOMATON_PHRASES = 20_000

SEEN = np.dtype([("hash", "<u8"), ("part", "<i4")])
FOUND = np.dtype([("hash", "<u8")])
FIRST = "doc_id long, n_words long, n_removed long, kept_sha256 string, text binary, part int, bucket int, records binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def named_phrases(words: np.ndarray, at: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and first words of all windows, the words where the phrases they name begin, and all phrase hashes."""
    windows, starts, _ = inner_grams(words, at, window)
    grams = gram_hashes(words, phrase)
    if not len(starts):
        return windows, starts, starts, grams
    width, best, reach = window - phrase + 1, np.arange(len(grams)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        reach += step
    return windows, starts, best[starts], grams


def _twice(values: np.ndarray) -> np.ndarray:
    """Every value once, and those that come again a second time."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return np.r_[values[first], values[first[np.diff(np.r_[first, len(values)]) > 1]]]


def _seen(hashes: np.ndarray, part, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(hashes), SEEN)
    out["hash"], out["part"] = hashes, part
    return out, (mixed(hashes) % np.uint64(buckets)).astype(np.int32)


def _phrases(window: int, phrase: int, buckets: int):
    """Records of the phrases that each text's windows name."""

    def pieces(batches):
        for batch in batches:
            data, bounds = column_bytes(batch.column("text"))
            part = batch.column("part").to_numpy()
            for a, b in ranges(bounds):
                words, at = word_hashes(data, bounds[a : b + 1], lower=False)
                _, starts, named, grams = named_phrases(words, at, window, phrase)
                new = np.flatnonzero(np.r_[True, named[1:] != named[:-1]]) if len(named) else np.zeros(0, np.int64)
                text = np.searchsorted(at, starts[new], "right") - 1
                yield _seen(grams[named[new]], part[a:b][text], buckets)

    return lambda batches: flushed(pieces(batches))


def _repeated(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes recorded twice or more, once for each part that has them."""
    records = records[np.lexsort((records["part"], records["hash"]))]
    h, p = records["hash"], records["part"]
    again = np.zeros(len(h), bool)
    again[1:] |= h[1:] == h[:-1]
    again[:-1] |= h[1:] == h[:-1]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    out = np.zeros((again & new).sum(), FOUND)
    out["hash"] = h[again & new]
    return out, p[again & new]


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``found``."""
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found, values)
    at[at == len(found)] = 0
    return found[at] == values


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _candidates(window: int, phrase: int, buckets: int):
    """Texts without a repeated phrase are done; of the others, the windows that name one are recorded."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        repeated = np.sort(unpacked(found.column("records"), FOUND)["hash"])
        data, bounds = column_bytes(docs.column("text"))
        part = docs.column("part")[0].as_py() if docs.num_rows else 0
        ids = docs.column("doc_id").to_pylist()
        rows, held = [], []
        for a, b in ranges(bounds):
            words, at = word_hashes(data, bounds[a : b + 1], lower=False)
            windows, starts, named, grams = named_phrases(words, at, window, phrase)
            open_ = np.flatnonzero(_among(grams[named], repeated)) if len(named) else np.zeros(0, np.int64)
            held.append(windows[open_])
            undecided = np.zeros(b - a, bool)
            undecided[np.searchsorted(at, starts[open_], "right") - 1] = True
            for i in range(a, b):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                n = int(at[i - a + 1] - at[i - a])
                rows.append((ids[i], n, None, None, text) if undecided[i - a] else (ids[i], n, 0, _digest(text.split()), None))
        sent = packed(*_seen(_twice(np.concatenate(held)), part, buckets)) if held else packed(*_seen(np.zeros(0, np.uint64), part, buckets))
        m, k = len(rows), sent.num_rows
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        values = [pa.concat_arrays([pa.array(c, t), pa.nulls(k, t)]) for c, t in zip(columns, kinds)]
        values.append(pa.array([part] * m + [None] * k, pa.int32()))
        values += [pa.concat_arrays([pa.nulls(m, c.type), c]) for c in sent.columns]
        return pa.table(values, names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "part", "bucket", "records"])

    return run


def _automata(phrases: dict[str, list[tuple[int, int]]], most: int):
    keys = list(phrases)
    for k in range(0, len(keys), most):
        automaton = ahocorasick.Automaton()
        for key in keys[k : k + most]:
            automaton.add_word(key, (len(key), phrases[key]))
        automaton.make_automaton()
        yield automaton


def _removal(window: int, phrase: int, most: int):
    """Confirmed windows located by automata over a part's undecided texts, and their words removed."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        confirmed = np.sort(unpacked(found.column("records"), FOUND)["hash"])
        data, bounds = column_bytes(docs.column("text"))
        phrases: dict[str, set[tuple[int, int]]] = {}
        spots, hashes = [], []
        for a, b in ranges(bounds):
            words, at = word_hashes(data, bounds[a : b + 1], lower=False)
            windows, starts, named, _ = named_phrases(words, at, window, phrase)
            ok = np.flatnonzero(_among(windows, confirmed))
            text = np.searchsorted(at, starts[ok], "right") - 1
            own = np.full(len(words), 0, np.uint64)
            own[starts] = windows
            split = {}
            for t, first, at_word, h in zip(text.tolist(), starts[ok].tolist(), named[ok].tolist(), windows[ok].tolist()):
                if t not in split:
                    split = {t: data[bounds[a + t] : bounds[a + t + 1]].tobytes().split()}
                k = at_word - int(at[t])
                key = " " + b" ".join(split[t][k : k + phrase]).decode("latin-1") + " "
                phrases.setdefault(key, set()).add((at_word - first, h))
            hashes += [own[at[t] : at[t + 1]] for t in range(b - a)]
        automata = list(_automata({k: sorted(v) for k, v in phrases.items()}, most))
        removed, kept = [], []
        for i in range(docs.num_rows):
            words = data[bounds[i] : bounds[i + 1]].tobytes().split()
            stream = " " + b" ".join(words).decode("latin-1") + " "
            begins = np.cumsum([0] + [len(w) + 1 for w in words])
            cover, own = np.zeros(len(words) + 1, np.int64), hashes[i]
            for automaton in automata:
                for end, (size, windows) in automaton.iter(stream):
                    spots = int(np.searchsorted(begins, end - size + 1))
                    for before, h in windows:
                        first = spots - before
                        if 0 <= first <= len(words) - window and own[first] == h:
                            cover[first] += 1
                            cover[first + window] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(_digest([w for w, g in zip(words, gone.tolist()) if not g]))
        return pa.table([docs.column("doc_id"), docs.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, part_bytes: int = PART_BYTES, automaton_phrases: int = AUTOMATON_PHRASES
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    parts = part_count(docs, part_bytes)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), part)
    seen = rows.select("text", "part").mapInArrow(_phrases(window, phrase, parts), PACKED)
    repeated = regrouped(seen, SEEN, _repeated)
    first = rows.groupBy("part").cogroup(repeated.groupBy("bucket")).applyInArrow(_candidates(window, phrase, parts), FIRST)
    first = written(first, "phrases")
    done = first.filter(F.col("kept_sha256").isNotNull()).select("doc_id", "n_words", "n_removed", "kept_sha256")
    undecided = first.filter(F.col("text").isNotNull()).select("doc_id", "n_words", "text", "part")
    confirmed = regrouped(first.filter(F.col("records").isNotNull()).select("bucket", "records"), SEEN, _repeated)
    rest = undecided.groupBy("part").cogroup(confirmed.groupBy("bucket")).applyInArrow(_removal(window, phrase, automaton_phrases), RESULT)
    return done.union(rest)


def op6(spark, sf_dir) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
