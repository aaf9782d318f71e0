"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece (what the pre-split pattern yields) is a row of symbols. The leaves of its tree hold, for each adjacent pair,
its merge rank with its position below it, so the root is the leftmost pair of lowest rank. A merge changes three leaves,
and each change climbs one path: logarithmic point updates, until the root says that nothing can be merged. The trees of
all unseen pieces of one size class lie side by side in one array, so that one numpy call updates all of them.

Defined results: null text is empty and gives no tokens; special tokens that a text spells out become their ids; a piece
of any length is encoded whole; rows are independent, so repeated rows and repeated or null ids are all kept.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from millrace.llm.shared import doc_columns, kept, mapped, slices, tune

#: Bytes of the table of units and ids that a worker keeps, about: a bound on memory.
TABLE_BYTES = 64 << 20
#: Marks that end a chunk and are a piece of their own after a letter.
ENDS = frozenset(".,:;!?|)")
#: Characters of a text that are worked on at once, about; longer texts are cut where no piece is.
SEGMENT = 1 << 20
#: Symbols by class that one block of trees holds, so that a block stays within some tens of MB.
BLOCK = 1 << 18
NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 stays, the rest follows from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = np.array([ids[c] for c in letters], np.int64)
        pairs = np.empty(len(spec["model"]["merges"]), np.int64)
        made = np.empty_like(pairs)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[rank], made[rank] = ids[a] * self.size + ids[b], ids[a + b]
        # open addressing: two or three probes find a pair's rank
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs)))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        mask = (1 << self.bits) - 1
        for rank, key in enumerate(pairs.tolist()):
            at = self.slot(key)
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = at + 1 & mask
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank
        self.probes = self._longest_probe()
        self.made = made
        self.names = [str(i) for i in range(self.size)]

    def slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits

    def _longest_probe(self) -> int:
        full, run, most = self.keys >= 0, 0, 0
        for x in [*full, *full[:64]]:
            run = run + 1 if x else 0
            most = max(most, run)
        return most + 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left * self.size + right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            if not len(todo):
                break
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        return out


def forest(v: Vocabulary, pieces: list[bytes], leaves: int) -> list[bytes]:
    """Ids (16 or 32 bits each, by the vocabulary's size) of pieces of 2 to leaves + 1 bytes; leaves is a power of two."""
    n, depth = len(pieces), leaves.bit_length() - 1
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    width = leaves + 1
    symbols = np.full((n, width), -1, np.int64)
    inside = np.arange(width) < sizes[:, None]
    symbols[inside] = v.first[flat]
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    tree = np.full((2 * leaves, n), NONE, np.int64)
    pair = inside[:, 1:]
    rank = v.rank(symbols[:, :-1][pair], symbols[:, 1:][pair])
    keys = np.full((n, leaves), NONE, np.int64)
    keys[pair] = np.where(rank < 0, NONE, rank * width + np.nonzero(pair)[1])
    tree[leaves:] = keys.T
    for level in range(depth - 1, -1, -1):
        a = 1 << level
        np.minimum(tree[2 * a : 4 * a : 2], tree[2 * a + 1 : 4 * a : 2], out=tree[a : 2 * a])

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """The point update: one leaf of each row, then its path to the root."""
        node = leaf + leaves
        tree[node, rows] = value
        for _ in range(depth):
            node = node >> 1
            tree[node, rows] = np.minimum(tree[2 * node, rows], tree[2 * node + 1, rows])

    rows = np.nonzero(tree[1] < NONE)[0]
    while len(rows):
        root = tree[1, rows]
        at, best = root % width, root // width
        gone = after[rows, at]
        symbols[rows, at], symbols[rows, gone] = v.made[best], -1
        then = after[rows, gone]
        after[rows, at] = then
        here = then < sizes[rows]
        before[rows[here], then[here]] = at[here]
        inner = gone < leaves
        put(rows[inner], gone[inner], np.full(inner.sum(), NONE))
        value = np.full(len(rows), NONE)
        r = v.rank(symbols[rows[here], at[here]], symbols[rows[here], then[here]])
        value[here] = np.where(r < 0, NONE, r * width + at[here])
        inner = at < leaves
        put(rows[inner], at[inner], value[inner])
        prev = before[rows, at]
        there = prev >= 0
        r = v.rank(symbols[rows[there], prev[there]], symbols[rows[there], at[there]])
        put(rows[there], prev[there], np.where(r < 0, NONE, r * width + prev[there]))
        rows = rows[tree[1, rows] < NONE]
    kept = symbols >= 0
    ends = np.cumsum(kept.sum(axis=1)).tolist()
    kind = id_type(v.size)
    ids, wide, begin, out = symbols[kept].astype(kind).tobytes(), kind.itemsize, 0, []
    for end in ends:
        out.append(ids[begin * wide : end * wide])
        begin = end
    return out


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def by_forest(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece; pieces of like length share a block of trees."""
    out: list[bytes] = [b""] * len(pieces)
    kind = id_type(v.size)
    single = [kind.type(x).tobytes() for x in v.first]
    classes: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if len(p) == 1:
            out[i] = single[p[0]]
        elif p:
            classes.setdefault(max(0, (len(p) - 2).bit_length()), []).append(i)
    for c, members in classes.items():
        step = max(1, BLOCK >> c)
        for k in range(0, len(members), step):
            part = members[k : k + step]
            for i, ids in zip(part, forest(v, [pieces[i] for i in part], 1 << c), strict=True):
                out[i] = ids
    return out


class Places(dict):
    """Place of each unit in the table of ids; a unit not met before gets the next place and waits in `fresh` for its ids."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.size = 0

    def __missing__(self, unit) -> int:
        place = self[unit] = len(self)
        self.fresh.append(unit)
        return place


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first[0], ..., first[0] + count[0] - 1, first[1], ..."""
    ends = np.cumsum(count)
    where = np.repeat(first - ends + count, count)
    where += np.arange(len(where))
    return where


class Encoder:
    """Whole texts to packed ids. Texts are cut into units where a blank stands before a non-blank, which no pre-split piece crosses. A unit
    is a string (a chunk that a blank precedes), a tuple of one string (a chunk that none does) or the id of a special token. The ids of
    units met are kept in a table of TABLE_BYTES at most, where only those met in several batches stay when it is full; encode(pieces), which gives the ids of all pieces
    joined and the number for each, encodes what it lacks."""

    def __init__(self, pattern: str, special: dict[str, int], size: int, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.find = regex.compile(pattern).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.encode, self.kind = encode, id_type(size)
        self.odd_blank = re.compile(r" (?:\s|$)").search
        self.at_word = re.compile(r" (?=\S)").split
        self.next_word = re.compile(r" (?=\S)").search
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        ids = list(self.special.values())
        for i in ids:
            self.places[i]
        self.places.fresh = []
        self.flat, self.first, self.count = np.array(ids, self.kind), np.arange(len(ids), dtype=np.int64), np.ones(len(ids), np.int64)
        self.seen = np.zeros(len(ids), np.int32)  # how often a batch had the unit

    def shrink(self) -> None:
        """Leaves the units that batches met most often, half of them at most: most units of a text occur nowhere else."""
        keep, least = self.seen >= 2, 2
        while keep.sum() > len(keep) // 2 and least < 64:
            least += 1
            keep = self.seen >= least
        keep[: len(self.special)] = True
        share = keep.sum() / len(keep)
        if share > 0.6:
            return self.clear()
        units, size = list(compress(self.places, keep.tolist())), self.places.size
        count = self.count[keep]
        self.flat = self.flat[ragged(self.first[keep], count)]
        self.first, self.count, self.seen = np.cumsum(count) - count, count, self.seen[keep] // 2
        self.places = Places()
        self.places.update(zip(units, range(len(units)), strict=True))
        self.places.size = int(size * share)

    def units(self, text: str) -> Iterator[list]:
        """Lists of units, in order; long texts give several."""
        parts = self.cut(text) if self.cut and any(s in text for s in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.special[part]]
                continue
            begin, first = 0, True
            while begin < len(part):
                end = len(part)
                if end - begin > SEGMENT and (m := self.next_word(part, begin + SEGMENT)):
                    end = m.start()
                piece = part[begin:end]
                found = self.at_word(piece) if self.odd_blank(piece) else piece.split(" ")
                if first:
                    found[0] = (found[0],)
                yield found
                begin, first = end + 1, False

    def learn(self) -> None:
        """Ids of the fresh units: words by encode(), the others by the pieces that they consist of, some of which are known or words."""
        places, fresh, known = self.places, self.places.fresh, len(self.first)
        is_word = [type(c) is str and c.isalpha() for c in fresh]
        words = [" " + c for c, w in zip(fresh, is_word, strict=True) if w]
        refs: list[int] = []
        sizes: list[int] = []
        extra: dict[str, int] = {}
        get, at = places.get, known + len(fresh)

        def ref(p: str) -> int:
            if p[0] == " ":
                b = get(p[1:], -1)
                if 0 <= b < known or (b >= known and is_word[b - known]):
                    return b
            return at + extra.setdefault(p, len(extra))

        for c, w in zip(fresh, is_word, strict=True):
            if w:
                continue
            if type(c) is tuple:
                found = self.find(c[0])
            elif c[-1:] in ENDS and (word := c[:-1]).isalpha():
                b = get(word, -1)
                refs.append(b if b >= 0 else at + extra.setdefault(" " + word, len(extra)))
                refs.append(at + extra.setdefault(c[-1], len(extra)))
                sizes.append(2)
                continue
            else:
                found = self.find(" " + c)
            refs.extend(map(ref, found))
            sizes.append(len(found))
        places.fresh = []
        places.size += 130 * len(fresh) + sum(map(len, words))
        ids, n = self.encode([*words, *extra])
        firsts = len(self.flat) + np.cumsum(n) - n
        of_words = int(n[: len(words)].sum())
        is_word = np.array(is_word, bool)
        first, count = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        first[is_word], count[is_word] = firsts[: len(words)], n[: len(words)]
        ref_at = np.array(refs, np.int64)
        ref_count = np.concatenate([self.count, count, n[len(words) :]])[ref_at]
        ref_first = np.concatenate([self.first, first, firsts[len(words) :]])[ref_at]
        joined = np.append(self.flat, ids)[ragged(ref_first, ref_count)]
        sums = np.append(0, np.cumsum(ref_count))
        ends = np.cumsum(np.array(sizes, np.int64))
        rest = np.flatnonzero(~is_word)
        if len(rest):
            begins = np.append(0, ends[:-1])
            first[rest], count[rest] = len(self.flat) + of_words + sums[begins], sums[ends] - sums[begins]
        self.first, self.count = np.append(self.first, first), np.append(self.count, count)
        self.seen = np.append(self.seen, np.zeros(len(fresh), np.int32))
        self.flat = np.concatenate([self.flat, ids[:of_words], joined])

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        plain, rows, lists, size = [], [], [], 0
        for i, t in enumerate(texts):
            if len(t) <= SEGMENT and not self.odd_blank(t) and not any(s in t for s in self.special):
                plain.append(i)
                continue
            for found in self.units(t):
                rows.append(i)
                lists.append(found)
                size += len(found)
                if size > SEGMENT // 4:
                    self.listed(rows, lists, out)
                    rows, lists, size = [], [], 0
        if rows:
            self.listed(rows, lists, out)
        if plain:
            # single blanks only: Arrow splits them and finds the distinct chunks
            split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            begins = split.offsets.to_numpy()
            words = split.flatten().dictionary_encode()
            of = self.distinct(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            at = of[words.indices.to_numpy()]
            heads = [texts[i].split(" ", 1)[0] for i in plain]
            at[begins[:-1]] = self.placed([(h,) for h in heads], len(heads))
            self.flush(plain, np.diff(begins), at, out)
        return [b"".join(x) for x in out]

    def distinct(self, units: list[str]) -> np.ndarray:
        """placed() for units of which none repeats: new ones get their places all at once."""
        at = np.fromiter(map(self.places.get, units, repeat(-1)), np.int64, len(units))
        new = at < 0
        fresh = list(compress(units, new.tolist()))
        at[new] = places = np.arange(len(self.places), len(self.places) + len(fresh))
        self.places.update(zip(fresh, places.tolist(), strict=True))
        self.places.fresh.extend(fresh)
        return at

    def placed(self, units: Iterable, n: int) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, units), np.int64, n)

    def listed(self, rows: list[int], lists: list[list], out: list[list[bytes]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flush(rows, sizes, self.placed(chain.from_iterable(lists), int(sizes.sum())), out)

    def flush(self, rows: list[int], sizes: np.ndarray, at: np.ndarray, out: list[list[bytes]]) -> None:
        """Adds to each row's output the ids of its next so many units, which stand at `at` in the table."""
        if self.places.fresh:
            self.learn()
        count = self.count[at]
        ends = np.cumsum(count)
        data, wide, begin = self.flat[ragged(self.first[at], count)].tobytes(), self.kind.itemsize, 0
        for i, end in zip(rows, ends[np.cumsum(sizes) - 1].tolist(), strict=True):
            out[i].append(data[begin * wide : end * wide])
            begin = end
        here = np.zeros(len(self.seen), bool)
        here[at] = True
        self.seen += here
        if self.places.size > TABLE_BYTES:
            self.shrink()
            if self.places.size > TABLE_BYTES:
                self.clear()


#: What splits a text before the merges (the byte-level pattern that the vocabulary files are made for); a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def joined(parts: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), kind), np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize


def encoder(path: str) -> tuple[Vocabulary, Encoder]:
    """One per worker and file, while the stage lasts."""

    def made() -> tuple[Vocabulary, Encoder]:
        gc.set_threshold(200_000, 50, 100)  # the tables hold no cycles, and walking them is slow
        v = Vocabulary(path)
        return v, Encoder(PATTERN, v.special, v.size, lambda ps: joined(by_forest(v, [p.encode() for p in ps]), id_type(v.size)))

    return kept(f"bpe {path}", made)


def decoded(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: the tokens' bytes, joined; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(v.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand ids (array<int>) and decoded (string). No shuffle.

    tokenizer: a byte-level BPE file of the tokenizers library; it must be at that path on every executor."""
    tune(docs.sparkSession)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, enc = encoder(tokenizer)
        names, kind = v.names, enc.kind
        texts = [t or "" for t in b.column(1).to_pylist()]
        for lo, hi in slices(texts):
            packed = enc(texts[lo:hi])
            hashes, back_hashes, back = [], [], []
            for p in packed:  # one document's ids at a time as Python numbers
                x = np.frombuffer(p, kind).tolist()
                text = decoded(v, x)
                hashes.append(hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest())
                back_hashes.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_text:
                    back.append(text)
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // kind.itemsize
            out = {"doc_id": b.column(0).slice(lo, hi - lo), "n_tokens": pa.array(sizes), "ids_sha256": hashes, "decoded_sha256": back_hashes}
            if keep_ids:
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), kind).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            if keep_text:
                out["decoded"] = pa.array(back, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return doc_columns(docs, id_col, text_col).mapInArrow(mapped(run), schema)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text of the ids; null ids give an empty text. Ids outside the vocabulary are an error."""
    tune(tokens.sparkSession)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, _ = encoder(tokenizer)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": [decoded(v, x or []) for x in b.column(1).to_pylist()]})

    return tokens.select(tokens[f"`{id_col}`"].cast("long").alias("doc_id"), tokens[f"`{ids_col}`"].cast("array<int>").alias("ids")).mapInArrow(mapped(run), "doc_id long, text string")
