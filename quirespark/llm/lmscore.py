"""LM scoring: a smoothed n-gram model as a weighted backoff automaton.

Smoothing is by Dirichlet priors, p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu), down to unigrams with
absolute discounting, whose left-over mass is that of the unknown word. As an automaton: each context seen in
training is a state; an arc for each n-gram seen carries log10 p(w | h) and leads to the longest context it
ends in; a failure arc carries log10 mu / (c(h) + mu) and leads to the context without its first word. A text
is read left to right from the start state, which has its own arcs; nothing else is kept but the state and the sum.

No task needs the whole model. Texts are dealt by hash into blocks of ``BLOCK`` bytes; a block sends its distinct
n-grams, as hashes in sorted runs, to buckets by ranges of the hash; a bucket sums the counts of all blocks and
answers each with the totals of the n-grams it sent, in the order sent; then the block builds the automaton of
its own n-grams and reads its texts. A run holds an n-gram once however often the block has it, and a run that would be
empty is not sent. Numbers of blocks and buckets follow the bytes of the corpus, which bounds both kinds of task; the
texts and the runs are shuffled once.

Blocks are the leaves of a tree: a node sums up to ``FAN`` blocks, in buckets of its own, and where there are several
nodes, each of their buckets is a sender to the next node up, as a block is to its node; totals come back the same way.
So a frequent n-gram costs a bucket at most ``FAN`` entries, at any size of the corpus. Hashes have
``SPARE`` bits more than it takes to number the corpus's bytes, those of single words, which are counted exactly,
``SPARE_WORDS`` more, so that two n-grams share one as seldom in any size. What smoothing needs of all words at once,
how many there are and how many come once and twice, is summed before, from runs of single words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import table, text_of

ORDER = 3
MU = 200.0
FOLDS, HELD_OUT = 7, 2
#: Bytes of a block's texts, and of the texts whose n-grams a bucket sums.
BLOCK, BUCKET = 5_000_000, 10_000_000
SPARE, SPARE_WORDS = 14, 27
#: Senders to a node of the tree: up to 328 GB there is one node, up to 21 PB two levels of them. A bucket of ``BUCKET``
#: bytes has over a million entries, beside which the entries of an n-gram that all senders have are few.
FAN = 1 << 16
#: Texts read at a time where words are summed before.
BATCH = 4_000_000
#: Words of a stretch of text; stretches are read side by side.
STRETCH = 512

#: A run goes from a sender, which is a part of a block or node, to a bucket of a node; its answer goes back.
RUN = "node int, bucket int, block int, part int, rank int, keys binary, counts binary"
ANSWER = "block int, part int, bucket int, rank int, totals binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes spread over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(x: np.ndarray) -> bytes:
    """Bytes by significance: those that are zero throughout a run compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unpacked(data: bytes | pa.Buffer, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


@dataclass
class Grams:
    """The n-grams of some texts. Each text is a start, its words and an end; ``doc`` and ``place`` say whose a position
    is and how far into its text, ``first`` where texts begin. ``keys[k - 1]`` has, by position, the hash of the n-gram
    of k words that ends there, if there is one: a start is a context, never a token, and none reaches over a start.
    """

    doc: np.ndarray
    place: np.ndarray
    first: np.ndarray
    keys: list[np.ndarray]

    @classmethod
    def of(cls, texts: pa.Array, order: int, bits: tuple[int, int]) -> Grams:
        # A slice is copied first: the cast to 64-bit offsets misreads one.
        whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        real = pc.not_equal(words, "")
        coded, doc = words.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)]
        n = len(coded.dictionary)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in [*coded.dictionary.to_pylist(), " ", "\n"]], np.uint64)
        sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        before = np.cumsum(sizes) - sizes
        first = before + 2 * np.arange(len(texts))
        tokens = np.full(len(doc) + 2 * len(texts), n + 1, np.int64)
        tokens[first] = n
        if len(doc):
            tokens[first[doc] + 1 + np.arange(len(doc)) - before[doc]] = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), sizes + 2)
        own = _mixed(hashes[tokens])
        gram, keys = own, [own >> np.uint64(64 - bits[0])]
        for _ in range(1, order):
            gram = np.concatenate([gram[:1], _mixed(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])])
            keys.append(gram >> np.uint64(64 - bits[1]))
        return cls(owner, np.arange(len(tokens)) - first[owner], first, keys)

    def there(self, rank: int) -> np.ndarray:
        """The positions where an n-gram of rank + 1 words ends."""
        return np.flatnonzero(self.place >= max(rank, 1))

    def counted(self, rank: int, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and how often each is there in texts that are ``trained`` on."""
        at = self.there(rank)
        marked = np.sort((self.keys[rank][at] << np.uint64(1)) | trained[self.doc[at]].astype(np.uint64))
        keys, taken = marked >> np.uint64(1), (marked & np.uint64(1)).astype(np.int64)
        new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        return keys[new], np.add.reduceat(taken, new).astype(np.uint32) if len(new) else np.zeros(0, np.uint32)

    def spread(self, rank: int, totals: np.ndarray) -> np.ndarray:
        """By position, what ``totals`` has for its n-gram: they go by the sorted distinct hashes. 0 where there is none."""
        at, out = self.there(rank), np.zeros(len(self.place))
        order = np.argsort(self.keys[rank][at])
        keys = self.keys[rank][at][order]
        out[at[order]] = totals[np.cumsum(np.diff(keys, prepend=keys[:1]) > 0)] if len(keys) else 0
        return out


def _cut(keys: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the stretches of sorted hashes that fall into one of equal ranges."""
    high = (keys >> np.uint64(max(bits - 32, 0))).astype(np.float64) * (buckets / 2.0 ** min(bits, 32))
    bucket = np.minimum(high.astype(np.int64), buckets - 1)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
    return zip(bucket[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(c, pa.binary() if kind == "binary" else pa.int32()) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


@dataclass(frozen=True)
class Level:
    """Nodes that take up to ``fan`` senders each, and the number of a node's buckets. ``bits`` are those of the hashes
    of single words and of longer n-grams."""

    fan: int
    buckets: int
    bits: tuple[int, int]

    @classmethod
    def tree(cls, size: int, blocks: int, block: int, bucket: int, fan: int, bits: tuple[int, int]) -> list[Level]:
        """The levels above the blocks, up to a single node."""
        out, nodes, reach = [], blocks, block
        while not out or nodes > 1:
            nodes, reach = math.ceil(nodes / fan), reach * fan
            out.append(cls(fan, max(1, math.ceil((size if nodes == 1 else min(size, reach)) / bucket)), bits))
        return out

    def runs(self, sender: tuple[int, int], rank: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """For each bucket the sorted hashes, as differences, and their counts."""
        cuts = _cut(keys, self.buckets, self.bits[min(rank, 1)])
        return [(sender[0] // self.fan, b, *sender, rank, _packed(np.diff(keys[a:z], prepend=np.uint64(0))), _packed(counts[a:z])) for b, a, z in cuts]


def _runs_of(grams: Grams, trained: np.ndarray, number: int, order: int, level: Level) -> list[tuple]:
    """What a block sends: its n-grams and their counts in training."""
    return [run for rank in range(order) for run in level.runs((number, 0), rank, *grams.counted(rank, trained))]


def _text(block: pa.Table) -> pa.Array:
    return pa.chunked_array(block["text"].chunks, pa.string()).combine_chunks()


def _runs(block: pa.Table, order: int, level: Level) -> pa.Table:
    return _table(_runs_of(Grams.of(_text(block), order, level.bits), ~block["held_out"].to_numpy(), block["block"][0].as_py(), order, level), RUN)


def _word_runs(batches: Iterator[pa.RecordBatch], blocks: int, level: Level) -> Iterator[pa.RecordBatch]:
    """Runs of the single words of texts, all of them trained on. Each batch sends as one of the blocks, dealt in turn
    from a place of the task's own."""
    place = TaskContext.get().partitionId() * 0x9E3779B1
    for b in batches:
        held = np.cumsum(pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False)) // BATCH
        edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            texts = b.column(0).slice(a, z - a)
            place += 1
            yield from _table(_runs_of(Grams.of(texts, 1, level.bits), np.ones(len(texts), bool), place % blocks, 1, level), RUN).to_batches()


@dataclass
class Bucket:
    """The runs of one rank in a bucket: which rows they are, how many hashes each has, the order that sorts all their
    hashes, which of the distinct ones each is in that order, the sums of the counts of the distinct ones and, where they
    are to be sent on, these."""

    rows: list[int]
    sizes: list[int]
    order: np.ndarray
    which: np.ndarray
    totals: np.ndarray
    keys: np.ndarray | None

    @classmethod
    def of(cls, runs: pa.Table, rank: int, sent_on: bool = False) -> Bucket:
        rows = np.flatnonzero(runs["rank"].to_numpy() == rank).tolist()
        own = runs.select(["keys", "counts"]).take(pa.array(rows))
        sizes = (pc.binary_length(own["keys"]).to_numpy() // 8).tolist()
        keys = np.concatenate([np.cumsum(_unpacked(k.as_buffer(), np.uint64), dtype=np.uint64) for k in own["keys"]])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        keys = keys[new] if sent_on else None
        which = np.cumsum(new, dtype=np.int32)
        which -= 1
        # Blocks count in 32 bits, nodes in 64.
        counts = np.concatenate([_unpacked(c.as_buffer(), f"u{c.as_buffer().size // n}") for c, n in zip(own["counts"], sizes, strict=True)])
        del own
        counts = counts[order]
        return cls(rows, sizes, order, which, np.add.reduceat(counts, np.flatnonzero(new), dtype=np.uint64), keys)

    def back(self, runs: pa.Table, rank: int, totals: np.ndarray) -> list[tuple]:
        """For each run what ``totals`` has for its hashes, in the order sent."""
        each = np.empty(len(self.order), np.uint64)
        each[self.order] = totals[self.which]
        block, part, bucket = runs["block"].to_numpy(), runs["part"].to_numpy(), runs["bucket"][0].as_py()
        return [(int(block[i]), int(part[i]), bucket, rank, _packed(x)) for i, x in zip(self.rows, np.split(each, np.cumsum(self.sizes)[:-1]), strict=True)]


def _ranks(runs: pa.Table) -> list[int]:
    return sorted({*runs["rank"].to_pylist()})


def _sends_to(level: Level) -> Callable[[pa.Table], pa.Table]:
    """What makes the sums of a bucket runs for the level above."""

    def sent(runs: pa.Table) -> pa.Table:
        sender, out = (runs["node"][0].as_py(), runs["bucket"][0].as_py()), []
        for rank in _ranks(runs):
            own = Bucket.of(runs, rank, sent_on=True)
            out += level.runs(sender, rank, own.keys, own.totals)
        return _table(out, RUN)

    return sent


def _in_order(answers: pa.Table) -> list[dict]:
    """A sender's answers by buckets, which are ranges of the hashes."""
    return sorted(answers.select(["bucket", "rank", "totals"]).to_pylist(), key=lambda r: (r["rank"], r["bucket"]))


def _totals(rows: list[dict], rank: int) -> np.ndarray:
    """What answers say of the sorted distinct hashes of a rank."""
    return np.concatenate([np.zeros(0, np.uint64), *(_unpacked(r["totals"], np.uint64) for r in rows if r["rank"] == rank)])


def _answers(runs: pa.Table, above: pa.Table | None = None) -> pa.Table:
    """For each run of a bucket the total counts of its n-grams: the bucket's sums, or what the level above answers."""
    out, known = [], None if above is None else _in_order(above)
    for rank in _ranks(runs):
        own = Bucket.of(runs, rank)
        out += own.back(runs, rank, own.totals if known is None else _totals(known, rank))
    return _table(out, ANSWER)


def _climbed(runs: DataFrame, levels: list[Level]) -> list[DataFrame]:
    """The runs that each level gets, from those of the blocks on."""
    out = [runs]
    for level in levels[1:]:
        out.append(out[-1].groupBy("node", "bucket").applyInArrow(_sends_to(level), RUN))
    return out


def _answered(climbed: list[DataFrame]) -> DataFrame:
    """The answers to the runs of the blocks."""
    *lower, top = climbed
    answers = top.groupBy("node", "bucket").applyInArrow(lambda t: _answers(t), ANSWER)
    for runs in reversed(lower):
        answers = runs.groupBy("node", "bucket").cogroup(answers.groupBy("block", "part")).applyInArrow(_answers, ANSWER)
    return answers


@dataclass(frozen=True)
class Words:
    """Of all texts trained on: how many there are, how many tokens, and how many kinds of token, in all, come once and
    come twice. The end of a text is a token, too."""

    texts: int
    tokens: int
    types: int
    once: int
    twice: int

    @classmethod
    def of(cls, texts: DataFrame, blocks: int, levels: list[Level]) -> Words:
        """Of the texts in a table of one column."""

        def summed(runs: pa.Table) -> pa.Table:
            totals = Bucket.of(runs, 0).totals
            sums = [len(totals), int(totals.sum()), int((totals == 1).sum()), int((totals == 2).sum())]
            return pa.table({n: pa.array([x], pa.int64()) for n, x in zip("abcd", sums, strict=True)})

        runs = _climbed(texts.mapInArrow(lambda b: _word_runs(b, blocks, levels[0]), RUN), levels)[-1]
        sums = runs.groupBy("node", "bucket").applyInArrow(summed, "a long, b long, c long, d long")
        types, tokens, once, twice = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "abcd")).first()
        return cls(texts.count(), tokens, types, once, twice)


class Automaton:
    """States, arcs and failure arcs for the n-grams of some texts.

    A state of k words is known by a position where its n-gram ends, and so is the arc that reads the word there: by
    position and k, ``weight`` is the weight of the arc from the state of the k words before (nan: no arc, the n-gram is
    not in training), and ``fail`` that of the failure arc of that state. An arc from k words leads to the state of k + 1,
    as far as there are states. ``totals`` has by rank and position how often the n-gram that ends there was trained on.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], words: Words, mu: float):
        self.order, self.grams = len(totals), grams
        discount = min(max(words.once / (words.once + 2 * words.twice), 0.1), 0.95) if words.once + words.twice else 0.5
        self.unknown = math.log10(discount * words.types / words.tokens) if words.tokens else 0.0
        self.weight, self.fail = [], []
        with np.errstate(divide="ignore"):
            p = np.maximum(totals[0] - discount, 0) / max(words.tokens, 1)
            self.weight.append(np.where(totals[0] > 0, np.log10(p), np.nan))
            self.fail.append(np.zeros(len(p)))
            p = np.where(totals[0] > 0, p, 0.0)
            for k in range(1, self.order):
                context = np.append(0.0, totals[k - 1][:-1])  # of the k words that end one position before
                if k == 1:
                    context[grams.place == 1] = words.texts
                p = (totals[k] + mu * p) / (context + mu)
                self.weight.append(np.where(totals[k] > 0, np.log10(p), np.nan))
                self.fail.append(np.log10(mu / (context + mu)))

    def read(self) -> np.ndarray:
        """The log10 probability of each text, its end among them, in one traversal from left to right.

        Long texts are read in stretches side by side. The state before a stretch is that of the words that precede it,
        of which a state has order - 1 at most, so a traversal that starts that much earlier has come to it.
        """
        doc, place, most = self.grams.doc, self.grams.place, self.order - 1
        begin = np.flatnonzero((place >= 1) & ((place - 1) % STRETCH == 0))
        ends = np.append(self.grams.first[1:], len(place))
        last = np.minimum(begin + STRETCH, ends[doc[begin]])
        starts = begin
        early = np.minimum(most, place[begin] - 1)
        at, sums = begin - early, np.zeros(len(begin))
        # The state: how many words of context it holds. At a text's first word that is the start.
        held = np.where(place[at] == 1, min(1, most), 0)
        order = np.argsort(at - last, kind="stable")  # the longest first, so that those that go on stay in front
        begin, last, at, held = begin[order], last[order], at[order], held[order]
        while len(at):
            live = int(np.searchsorted(-(last - at), 0))  # all that have a word left
            at, last, begin, held = at[:live], last[:live], begin[:live], held[:live]
            if not live:
                break
            added, todo = np.zeros(live), np.arange(live)
            for k in range(most, -1, -1):
                here = todo[held[todo] == k]
                w = self.weight[k][at[here]]
                found = ~np.isnan(w)
                added[here[found]] += w[found]
                held[here[found]] = -min(k + 1, most) - 1  # done; the state it leads to
                rest = here[~found]
                if k:
                    added[rest] += self.fail[k][at[rest]]
                    held[rest] = k - 1
                else:
                    added[rest] += self.unknown
                    held[rest] = -1
            held = -held - 1
            sums[order[:live]] += np.where(at >= begin, added, 0.0)
            at = at + 1
        return np.bincount(doc[starts], weights=sums, minlength=len(self.grams.first))


def _scored(block: pa.Table, answers: pa.Table, order: int, mu: float, bits: tuple[int, int], words: Words) -> pa.Table:
    grams = Grams.of(_text(block), order, bits)
    block = block.select(["doc_id", "held_out"])
    rows = _in_order(answers)
    placed = [grams.spread(k, _totals(rows, k)) for k in range(order)]
    grams.keys.clear()
    there, n = grams.there(0), len(block)
    seen, doc = placed[0][there], grams.doc[there]
    base = np.bincount(doc, weights=np.log10((seen + 1) / (words.tokens + words.types + 1)), minlength=n)
    machine = Automaton(grams, placed, words, mu)
    del placed, rows
    added = {
        "n_tokens": pa.array(np.bincount(doc, minlength=n), pa.int64()),
        "n_known": pa.array(np.bincount(doc, weights=seen > 0, minlength=n).astype(np.int64), pa.int64()),
        "train_tokens": pa.array([words.tokens] * n, pa.int64()),
        "base_score": pa.array(base, pa.float64()),
        "score": pa.array(machine.read(), pa.float64()),
    }
    return pa.table({"doc_id": block["doc_id"], "held_out": block["held_out"], **added})


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU, block: int = BLOCK, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, token counts, the add-one unigram ``base_score`` and ``score``.

    Learns from the rows whose crc32(id as text) mod 7 is not 2; a row without an id has the empty id. A text is
    its words, split at ASCII white space with A-Z lower-cased, and one end; a null or empty one is just the
    end. Very long texts are read whole. Repeated rows count and are scored as often as they come. If nothing is
    trained on, every word is the unknown one, of probability 1. Other columns play no part.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(text)) + 1), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block))
    bits = tuple(min(63, max(40, spare + math.ceil(math.log2(size + 1)))) for spare in (SPARE_WORDS, SPARE))
    levels = Level.tree(size, blocks, block, bucket, fan, bits)
    number = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    held_out = F.crc32(number.cast("binary")) % FOLDS == HELD_OUT
    words = Words.of(docs.filter(~held_out).select(text_of(text).alias("text")), blocks, levels)
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int").alias("block"),
        F.col(doc_id).alias("doc_id"),
        text_of(text).alias("text"),
        held_out.alias("held_out"),
    ).repartition(min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    answers = _answered(_climbed(dealt.groupBy("block").applyInArrow(lambda t: _runs(t, order, levels[0]), RUN), levels))
    out = docs.select(F.col(doc_id).alias("doc_id")).schema
    schema = out.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: _scored(t, a, order, mu, bits, words), schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
