"""SentencePiece encoding and decoding with seeded merge-dropout.

A BPE model merges neighbouring symbols in order of score. The agenda holds the candidate merges; each candidate
taken from it is skipped with the dropout rate, by a draw of its own. Other pieces come out than without dropout,
but all of them spell the same text: characters that are no piece become bytes, and so does a literal mark for
spaces, so decoding gives back every text exactly. With rate 0 the result is the model's own segmentation.

Merges do not reach from a word to the space after it, as no piece of the vocabulary does (this is checked), so
each run of spaces with the word after it, a unit, is encoded by itself. A unit's skips come from a hash of the
document and the unit's place in it, so occurrences of a word are drawn apart and every run draws the same: the
hash is read as numbers of candidates that are taken before the next one is skipped, which is the same as a draw
for each. What a worker keeps is no draw but its outcome, a state: the pieces of a unit after given skips, and how
many candidates follow the last of them. A batch looks all its units up at once, and the outcomes it lacks are
merged side by side in arrays, a candidate of each a turn. (The library's own dropout mixes in numbers of its
process, so runs would differ.)
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm.common import fresh, place_of, table, text_of
from quirespark.llm.tokencount import path_of

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
#: States that a worker keeps between batches, how long their units may be, bytes that are encoded at a time, and
#: units whose merges are worked out side by side.
KNOWN, KNOWN_CHARS = 200_000, 48
BATCH = 1 << 20
SIDE_BY_SIDE = 1 << 14

MARK = "▁"
#: Stands for a character that no piece may hold; it is in no text, as it is no character.
ALONE = "\ud800"
_UNIT = re.compile(r" *[^ ]+| +")
#: A place in the order of merges after all, and what a pair's first symbol is multiplied by.
_NONE, _PAIR = 1 << 30, 1 << 24
#: More candidates than a kept unit can have.
_MANY = 1 << 8


def _symbols(unit: str) -> list[str]:
    return list(unit.replace(MARK, ALONE).replace(" ", MARK))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units_of(text: str) -> list[str]:
    """The runs of spaces with the word after each, of a text with a space put before it."""
    return _UNIT.findall(" " + text) if text else []


def unit_hash(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each unit, from its document's and its place."""
    return _mixed(keys + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def gaps(hashes: np.ndarray, turn: int, dropout: float) -> np.ndarray:
    """How many candidates each unit takes after its skip number ``turn`` - 1 and before the next one."""
    draw = _mixed(hashes + np.uint64((turn + 1) * 0xD6E8FEB86659FD93 % 2**64))
    uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    if dropout <= 0:
        return np.full(len(hashes), _MANY - 1, np.int64)
    with np.errstate(divide="ignore"):
        return np.minimum(np.log(uniform) / np.log1p(-min(dropout, 1.0)), 1e15).astype(np.int64)


class Model:
    """The merges of a sentencepiece BPE model, with dropout."""

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.own.get_piece_size()
        plain = [i for i in range(n) if not (self.own.is_control(i) or self.own.is_unknown(i) or self.own.is_byte(i) or self.own.is_unused(i))]
        self.ids = {self.own.id_to_piece(i): i for i in plain}
        self.scores = {self.own.id_to_piece(i): self.own.get_score(i) for i in plain}
        self.bytes = {int(self.own.id_to_piece(i)[3:5], 16): i for i in range(n) if self.own.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no pieces for bytes, so not every text could be decoded")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("the model has pieces that reach over a space")
        letters = [self.own.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        letters = [bytes([int(self.own.id_to_piece(i)[3:5], 16)]) if self.own.is_byte(i) else x for i, x in enumerate(letters)]
        odd = [self.own.is_control(i) or self.own.is_unknown(i) or self.own.is_unused(i) for i in range(n)]
        self.width = np.array([-1 if o else len(x) for x, o in zip(letters, odd, strict=True)])
        self.first = np.cumsum([0, *map(len, letters)])[:-1]
        self.letters = np.frombuffer(b"".join(letters), np.uint8)
        self.spaced = np.array([self.own.id_to_piece(i).startswith(MARK) for i in range(n)])
        self.byte_ids = np.array([self.bytes[x] for x in range(256)], np.int32)
        # Symbols as numbers: a piece is its place in the order of merges, any other character comes after them.
        order = sorted(self.ids, key=lambda p: -self.scores[p])
        number = {p: k for k, p in enumerate(order)}
        self.other, self.spelling = len(order), np.array([self.ids[p] for p in order], np.int32)
        self.symbol = self.other + np.arange(0x110000)
        for p in order:
            if len(p) == 1:
                self.symbol[ord(p)] = number[p]
        self.symbol[ord(MARK)], self.symbol[ord(" ")] = self.other + ord(ALONE), number.get(MARK, self.other + ord(MARK))
        pairs = {
            number[p[:k]] * _PAIR + number[p[k:]]: number[p] for p in order for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        }
        self._hash(pairs)
        # Equal scores need the agenda; as a rule runs of spaces alone have them.
        merged = [self.scores[p] for p in order if p.strip(MARK) and len(p) > 1]
        self.short_chars = KNOWN_CHARS if len(set(merged)) == len(merged) else 0
        self.dropout, self.seed = dropout, seed
        self.forget()

    def forget(self) -> None:
        """Drops all states."""
        self.unit: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.root: dict[str, int] = {}
        self.follow: dict[int, int] = {}
        self.after = self.start = self.size = np.zeros(0, np.int64)
        self.spelt = np.zeros(0, np.int32)

    def _spelled(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for symbol in symbols:
            known = self.ids.get(symbol)
            out += [known] if known is not None else [self.bytes[x] for x in (MARK if symbol == ALONE else symbol).encode()]
        return out

    def _hash(self, pairs: dict[int, int]) -> None:
        """A table of merges: a pair is in the first free slot from its own on, ``probes`` slots on at most."""
        self.slots = 1 << (16 * len(pairs)).bit_length()
        self.pair, self.place, self.probes = np.full(self.slots, -1, np.int64), np.full(self.slots, _NONE, np.int32), 1
        keys, places = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.pair[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.pair[slot[put]], self.place[slot[put]] = keys[put], places[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, places, slot = keys[rest], places[rest], (slot[rest] + 1) & (self.slots - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).view(np.int64) & (self.slots - 1)

    def _places(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where the merges of symbols x and y come in the order; ``_NONE`` where there is none."""
        key = x.astype(np.int64) * _PAIR + y
        slot = self._slot(key)
        there = self.pair.take(slot)
        out = np.where(there == key, self.place.take(slot), _NONE).astype(np.int32)
        at = np.flatnonzero((there != key) & (there >= 0))
        for _ in range(self.probes):
            if not len(at):
                break
            slot[at] = (slot[at] + 1) & (self.slots - 1)
            there = self.pair[slot[at]]
            hit = there == key[at]
            out[at[hit]] = self.place[slot[at[hit]]]
            at = at[~hit & (there >= 0)]
        return out

    def _side_by_side(self, units: list[str], skips: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit how many candidates follow its last skip; all their ids; and how many each has."""
        n, sizes = len(units), np.array([*map(len, units)])
        wide, turns = int(sizes.max()) + 2, max(map(len, skips)) + 1  # with a column on either side that pairs with nothing
        starts = np.cumsum(sizes) - sizes
        cell = np.arange(sizes.sum()) + np.repeat(np.arange(n) * wide + 1 - starts, sizes)
        symbols = np.full(n * wide, -1, np.int32)
        symbols[cell] = self.symbol[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        alive = symbols >= 0
        offers = np.full(n * wide, _NONE, np.int32)
        inner = cell[symbols[cell + 1] >= 0]
        offers[inner] = self._places(symbols[inner], symbols[inner + 1])
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)
        due = np.full(n * turns, _MANY)
        lengths = np.fromiter(map(len, skips), np.int64, n)
        due[np.arange(lengths.sum()) + np.repeat(np.arange(n) * turns - np.cumsum(lengths) + lengths, lengths)] = np.fromiter(chain.from_iterable(skips), np.int64, lengths.sum())
        taken, turn = np.zeros(n, np.int64), np.arange(n) * turns
        live, table = np.arange(n), offers.reshape(n, wide)
        while len(live):
            at = table[live].argmin(axis=1) + live * wide
            best = offers[at]
            there = best < _NONE
            if not there.all():
                live, at, best = live[there], at[there], best[there]
            rows = live
            if turns > 1:
                skip = taken[live] == due[turn[live]]
                rows = live[skip]
                offers[at[skip]] = _NONE
                turn[rows] += 1
                taken[rows] = 0
                at, best, rows = at[~skip], best[~skip], live[~skip]
            taken[rows] += 1
            gone, left = after[at], before[at]
            right = after[gone]
            symbols[at], alive[gone], offers[gone], after[at], before[right] = best, False, _NONE, right, at
            other = symbols[np.concatenate([right, left])]
            found = self._places(np.concatenate([best, other[len(at) :]]), np.concatenate([other[: len(at)], best]))
            offers[at], offers[left] = found[: len(at)], found[len(at) :]
        return taken, *self._bytewise(symbols[alive], alive.reshape(n, wide).sum(axis=1))

    def _bytewise(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols and how many each run of ``sizes`` has; a character that is no piece is its bytes."""
        char = symbols - self.other
        char[char == ord(ALONE)] = ord(MARK)
        width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        of = np.repeat(np.arange(len(char)), width)
        rest = np.cumsum(width)[of] - np.arange(len(of)) - 1  # bytes of the character that are still to come
        low = char[of] >> (6 * rest)
        first = rest == width[of] - 1
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[of]]
        byte = np.where(first, lead | low, 0x80 | (low & 0x3F))
        plain = char[of] < 0
        ids = np.where(plain, self.spelling[np.where(plain, symbols[of], 0)], self.byte_ids[np.where(plain, 0, byte)])
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids.astype(np.int32), np.diff(ends)

    def _learn(self, units: list[str], skips: list[tuple[int, ...]]) -> np.ndarray:
        """Adds a state for each unit and its skips; their numbers."""
        first, order = len(self.unit), np.argsort([*map(len, units)], kind="stable")
        after, size, spelt = [self.after], [self.size], [self.spelt]
        for at in range(0, len(order), SIDE_BY_SIDE):
            some = order[at : at + SIDE_BY_SIDE].tolist()
            self.unit += (own := [units[k] for k in some])
            self.skips += (due := [skips[k] for k in some])
            for grown, part in zip((after, spelt, size), self._side_by_side(own, due), strict=True):
                grown.append(part)
        self.after, self.size, self.spelt = (np.concatenate(x) for x in (after, size, spelt))
        self.start = np.cumsum(self.size) - self.size
        numbers = np.empty(len(units), np.int64)
        numbers[order] = np.arange(first, len(self.unit))
        return numbers

    def long(self, unit: str, own: np.ndarray) -> list[int]:
        """The ids of any unit, with an agenda; ``own`` is an array of its hash."""
        symbols, scores = _symbols(unit), self.scores
        n, turn, left = len(symbols), 0, int(gaps(own, 0, self.dropout)[0]) if self.dropout > 0 else -1
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            if (score := scores.get(piece)) is not None:
                agenda.append((-score, i, j, piece)) if building else heapq.heappush(agenda, (-score, i, j, piece))

        building = True
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(agenda)
        building = False
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if not symbols[i] or after[i] != j or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been merged meanwhile
            if left == 0:
                turn += 1
                left = int(gaps(own, turn, self.dropout)[0])
                continue
            left -= 1
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return self._spelled([x for x in symbols if x])

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has; ``keys`` decide on their skips."""
        if len(self.unit) > KNOWN:
            self.forget()
        units = [*map(units_of, texts)]
        counts = np.array([*map(len, units)], np.int64)
        flat = [u for own in units for u in own]
        first = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(texts)), counts)
        hashes = unit_hash(keys[doc], np.arange(len(flat)) - first[doc])
        root = self.root
        new = [u for u in dict.fromkeys(flat) if u not in root]
        short = [u for u in new if len(u) <= self.short_chars and not u.startswith("  ")]
        if short:
            root.update(zip(short, self._learn(short, [()] * len(short)).tolist(), strict=True))
        state = np.fromiter(map(root.get, flat, repeat(-1)), np.int64, len(flat))
        at = np.flatnonzero(state < 0)
        spelt = [np.array(self.long(flat[k], hashes[k : k + 1]), np.int32) for k in at.tolist()]
        at, turn = np.flatnonzero(state >= 0), 0
        while len(at) and self.dropout > 0:
            gap = gaps(hashes[at], turn, self.dropout)
            more = gap < self.after[state[at]]
            at, turn = at[more], turn + 1
            state[at] = self._followed(state[at] * _MANY + gap[more])
        long = np.flatnonzero(state < 0)
        size, start = self.size[state], self.start[state]
        size[long], start[long] = [*map(len, spelt)], len(self.spelt) + np.cumsum([0, *map(len, spelt)])[:-1]
        pool = np.concatenate([self.spelt, *spelt])
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[edges[1:]] - ends[edges[:-1]]

    def _followed(self, steps: np.ndarray) -> np.ndarray:
        """The states that states lead to by a further skip; a step is a state and the candidates taken before it."""
        distinct, where = np.unique(steps, return_inverse=True)
        known = [self.follow.get(x, -1) for x in distinct.tolist()]
        new = [x for x, k in zip(distinct.tolist(), known, strict=True) if k < 0]
        if new:
            units, skips = [self.unit[x // _MANY] for x in new], [(*self.skips[x // _MANY], x % _MANY) for x in new]
            self.follow.update(zip(new, self._learn(units, skips).tolist(), strict=True))
            known = [self.follow[x] for x in distinct.tolist()]
        return np.array(known, np.int64)[where]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts that runs of ids spell: run k is ids[ends[k] : ends[k + 1]]. Ids of no piece spell nothing."""
        ids, ends = ids[ends[0] : ends[-1]].astype(np.int64), ends.astype(np.int64) - ends[0]
        ids = np.where((ids >= 0) & (ids < len(self.width)), ids, -1)
        width = np.where(ids < 0, 0, self.width[ids])
        cuts = np.concatenate([[0], np.cumsum(np.maximum(width, 0))])
        raw = self.letters[np.repeat(self.first[ids] - cuts[:-1], np.maximum(width, 0)) + np.arange(cuts[-1])]
        begin, end = cuts[ends[:-1]], cuts[ends[1:]]
        # The space that was put before the text goes.
        full = np.flatnonzero(ends[1:] > ends[:-1])
        led = np.zeros(len(begin), bool)
        led[full] = self.spaced[ids[ends[full]]]
        keep = np.ones(len(raw), bool)
        keep[begin[led]] = False
        offsets = np.concatenate([[0], np.cumsum(end - begin - led)]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
        unlike = np.concatenate([[0], np.cumsum(width < 0)])  # controls and the like, which only the library spells
        unlike = unlike[ends[1:]] > unlike[ends[:-1]]
        try:
            spelt = texts.cast(pa.string())
        except pa.ArrowInvalid:
            unlike |= np.array([not _is_utf8(x) for x in texts.to_pylist()])
        if unlike.any():
            other = lambda k: self.own.decode([x for x in ids[ends[k] : ends[k + 1]].tolist() if x >= 0])
            spelt = pa.array([other(k) if unlike[k] else x.decode() for k, x in enumerate(texts.to_pylist())], pa.string())
        return spelt


def _is_utf8(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


@cache
def model(path: str, dropout: float, seed: int) -> Model:
    return Model(path, dropout, seed)


def _pieces(sizes: np.ndarray) -> list[np.ndarray]:
    held = np.cumsum(sizes) // BATCH
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(held)) + 1) if len(sizes) else []


def numbered(docs: DataFrame, into: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a number from 1 on for rows of equal id and text, so that copies can be drawn apart."""
    alike = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(F.lit(0))
    return docs.withColumn(into, F.row_number().over(alike))


def encoded(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", into: str = "pieces", dropout: float = DROPOUT, seed: int = SEED, copy: Column | None = None
) -> DataFrame:
    """``docs`` with the ids of each whole text in ``into``, an array of int; a null or empty text has none.

    ``path`` is that of a file every executor has. Rows of equal id, text and ``copy`` get equal ids, in every run;
    ``copy`` tells rows of one id apart, and rows without an id count as rows of one. A column already called ``into``,
    in any case, is replaced, all others stay. A very long
    text is encoded in one piece, in arrays of a few times its size.
    """
    rows = docs.drop(into)
    at = place_of(rows, text)
    schema = rows.select("*", F.array().cast("array<int>").alias(into)).schema
    keyed = rows.withColumn(fresh(rows.columns, "_key"), F.xxhash64(F.lit(seed), F.col(doc_id), *([] if copy is None else [copy])))

    return keyed.mapInArrow(lambda batches: _encoded(batches, path, at, into, dropout, seed), schema)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text: int, into: str, dropout: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the rows' keys, with the ids of column ``text`` in its place."""
    own = model(path, dropout, seed)
    for b in batches:
        texts = pc.fill_null(b.column(text).cast(pa.string()), "")
        keys = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
        for part in _pieces(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
            at, n = int(part[0]), len(part)
            ids, sizes = own.encode(texts.slice(at, n).to_pylist(), keys[part])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[:-1]), lists], names=[*b.schema.names[:-1], into])


def decoded(docs: DataFrame, path: str, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids in ``pieces`` spell; null ids, and ids of no piece, spell nothing.

    A column already called ``into``, in any case, is replaced, all others stay.
    """
    rows = docs.drop(into)
    at = place_of(rows, pieces)
    schema = rows.select("*", F.lit("").alias(into)).schema
    return rows.mapInArrow(lambda batches: _decoded(batches, path, at, into), schema)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pieces: int, into: str) -> Iterator[pa.RecordBatch]:
    own = model(path, 0.0, 0)
    for b in batches:
        lists = b.column(pieces)
        if lists.null_count:
            lists = pc.if_else(pc.is_valid(lists), lists, pa.scalar([], lists.type))
        ids = pc.fill_null(lists.values, -1).to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        for part in _pieces(np.diff(ends) * 3):
            at, n = int(part[0]), len(part)
            texts = own.decode(ids, ends[at : at + n + 1])
            yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns), texts], names=[*b.schema.names, into])


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", copy: Column | None = None) -> DataFrame:
    """``docs`` with ``pieces`` and the text they ``decoded`` to, encoded and decoded in one pass."""
    rows = docs.drop("pieces", "decoded")
    at, last = place_of(rows, text), len(rows.columns)
    keyed = rows.withColumn(fresh(rows.columns, "_key"), F.xxhash64(F.lit(SEED), F.col(doc_id), *([] if copy is None else [copy])))
    schema = rows.select("*", F.array().cast("array<int>").alias("pieces"), F.lit("").alias("decoded")).schema
    return keyed.mapInArrow(lambda batches: _decoded(_encoded(batches, path, at, "pieces", DROPOUT, SEED), path, last, "decoded"), schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, pieces_hash, decoded_sha256, lossless) of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    return round_trip(docs, path_of(MODEL)).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )
