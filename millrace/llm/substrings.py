"""Substring dedup: removes every word of a run of `window` words that also occurs elsewhere, by recompression.

Rounds name runs and pairs of symbols. A symbol's name is a hash of what it stands for, so equal content gets one name on
every executor and no table of names is passed around; whether two neighbours merge depends on at most three symbols on each
side, so equal passages have equal symbols but for a bounded margin. Long phrases of the last round's symbols are compared
over the corpus; where the phrase of a window is shared, the window itself is verified with 128 bits over the corpus.

Why nothing is missed: a round blurs at most three symbols at each end of a window, of at most 2^r words in round r, so at
`lost` words inside each end all symbol boundaries of equal windows agree. The first boundary at or after that point begins a
phrase of at least `least` words that ends before the far margin: equal windows share it.

Defined results: null and empty texts have no words; texts of under `window` words lose nothing; repeated rows, repeated and
null ids are rows as any other (a repeated row's words all occur elsewhere, so it loses them if it has a window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.shared import ODD, ODD2, attached, doc_columns, hashed, mapped, mixed, spans_of, texts_of, windows
from millrace.llm.sharing import Keys, answer_size, answered, packed, shared_flags, shards_for, unpacked

#: The inverse of ODD among the odd numbers modulo 2^64.
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def plan_of(window: int, most_rounds: int = 2) -> tuple[int, int, int]:
    """(rounds, words lost at each end, least words of a phrase): as many rounds as leave a phrase of at least a fifth of the window."""
    best = (0, 0, window)
    for rounds in range(1, most_rounds + 1):
        lost = sum(3 << r for r in range(rounds))
        least = window - 2 * lost - 2 * ((1 << rounds) - 1)
        if least >= max(2, window // 5):
            best = (rounds, lost, least)
    return best


def recompressed(h: np.ndarray, ends: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of the symbols after some rounds over joined documents; starts has the total as its last entry."""
    names, starts = h, np.arange(len(h), dtype=np.int64)
    edge = np.zeros(len(h) + 1, bool)
    edge[ends] = True
    with np.errstate(over="ignore"):
        for r in range(rounds):
            n = len(names)
            if n < 2:
                break
            inner = ~edge[starts[1:]]  # between i and i + 1
            same = (names[1:] == names[:-1]) & inner
            twice = same.copy()  # runs of exactly two
            twice[1:] &= ~same[:-1]
            twice[:-1] &= ~same[1:]
            in_run = np.zeros(n, bool)
            in_run[:-1] |= twice
            in_run[1:] |= twice
            left = (mixed(names + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
            pair = left[:-1] & ~left[1:] & inner & ~in_run[:-1] & ~in_run[1:]
            merge = np.nonzero(twice | pair)[0]
            new = names.copy()
            new[merge] = mixed(names[merge] * ODD + names[merge + 1] * ODD2 + np.uint64(r + 1))
            keep = np.ones(n, bool)
            keep[merge + 1] = False
            names, starts = new[keep], starts[keep]
    return names, np.append(starts, len(h))


class Parsed:
    """The joined words of a batch's documents, the windows of each and their phrases."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        self.words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.begins, self.ends = spans_of(self.counts)
        self.h = hashed([w for ws in self.words for w in ws])
        rounds, self.lost, least = plan_of(window)
        names, self.starts = recompressed(self.h, self.ends, rounds)
        # a phrase runs from a boundary to the first boundary at least `least` words on, within the document
        until = np.repeat(self.ends, self.counts)
        at = self.starts[:-1]
        fits = at + least <= until[at] if len(at) else np.zeros(0, bool)
        self.phrase_at = np.nonzero(fits)[0]
        last = np.searchsorted(self.starts, at[self.phrase_at] + least)
        with np.errstate(over="ignore"):
            powers = np.ones(len(names) + 1, np.uint64)
            powers[1:] = ODD
            powers = np.cumprod(powers, dtype=np.uint64)
            back = np.ones(len(names) + 1, np.uint64)
            back[1:] = INVERSE
            back = np.cumprod(back, dtype=np.uint64)
            sums = np.zeros(len(names) + 1, np.uint64)
            np.cumsum(names * powers[:-1], dtype=np.uint64, out=sums[1:])
            self.phrases = mixed((sums[last] - sums[self.phrase_at]) * back[self.phrase_at])

    def window_starts(self) -> np.ndarray:
        n = np.maximum(self.counts - self.window + 1, 0)
        total = int(n.sum())
        return np.repeat(self.begins - (np.cumsum(n) - n), n) + np.arange(total)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows whose phrase is shared."""
        flag = np.zeros(len(self.starts), bool)
        flag[self.phrase_at[shared]] = True
        s = self.window_starts()
        return s[flag[np.searchsorted(self.starts, s + self.lost)]]

    def window_keys(self, starts: np.ndarray) -> Keys:
        return Keys(mixed(windows(self.h, self.window, ODD)[starts]), mixed(windows(self.h, self.window, ODD2)[starts]))


def drop_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, on demand, kept (the words left, joined by one space)."""
    if window < 1:
        raise ValueError("window must be positive")
    batches = packed(doc_columns(docs, id_col, text_col), "text", "texts")
    n_shards = shards_for(batches, 0.6)

    def parsed(row: dict) -> tuple[pa.Table, Parsed]:
        t = unpacked(row["payload"])
        return t, Parsed(texts_of(t.column("text").combine_chunks()), window)

    phrases = answered(batches, lambda row: Keys(parsed(row)[1].phrases), False, n_shards, "phrases")

    def candidates_of(row: dict, p: Parsed) -> np.ndarray:
        keys = Keys(p.phrases)
        return p.candidates(shared_flags(keys, row["phrases"] or [], n_shards)) if len(p.phrases) else np.zeros(0, np.int64)

    def window_keys(row: dict) -> Keys | None:
        _, p = parsed(row)
        starts = candidates_of(row, p)
        return p.window_keys(starts) if len(starts) else None

    with_phrases = attached(batches, phrases, "batch_id", answer_size("phrases"), "left")
    verified = answered(with_phrases, window_keys, True, n_shards, "windows")

    def finish(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            t, p = parsed(row)
            starts = candidates_of(row, p)
            if len(starts):
                starts = starts[shared_flags(p.window_keys(starts), row["windows"] or [], n_shards)]
            step = np.zeros(len(p.h) + 1, np.int64)
            step[starts] += 1  # the starts are distinct
            step[starts + window] -= 1
            covered = np.cumsum(step[:-1]) > 0
            removed = np.add.reduceat(np.append(covered, False).astype(np.int64), p.begins) if len(p.begins) else np.zeros(0, np.int64)
            removed = np.where(p.counts > 0, removed, 0)
            kept = []
            for ws, lo, hi, gone in zip(p.words, p.begins.tolist(), p.ends.tolist(), removed.tolist(), strict=True):
                kept.append(b" ".join(ws) if not gone else b" ".join([w for w, c in zip(ws, covered[lo:hi].tolist(), strict=True) if not c]))
            out = {"doc_id": t.column("doc_id").combine_chunks(), "n_words": pa.array(p.counts), "n_removed": pa.array(removed), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            if keep_text:
                out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    final = attached(with_phrases, verified, "batch_id", answer_size("windows"), "left")
    return final.mapInArrow(mapped(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
