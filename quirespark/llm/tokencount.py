"""Token counts by overlap resynchronisation.

A text of up to ``CHUNK`` characters is one chunk. A longer one is encoded in chunks that overlap, each with the
offsets of its tokens, and two neighbours are spliced at a common boundary: a token of both starts there, the
tokens after it agree as far as the left chunk can tell, and it is proven stable, which means that white space
stands before it and no token of the tokenizer reaches over that (``Encoder.attach`` says whose the white space
is). If the overlap has no such boundary it is widened, by doubling; if the whole left chunk has none (one very
long word), that chunk is. Memory follows the chunk, not the text, but for a text that is one word.

Where a tokenizer's own description shows that white space parts its tokens (``parts_words``), the same proof
makes every word a chunk of its own, so the tokens of a short text are the sum over its words, and the library sees
each distinct word of a batch once.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import place_of, table, text_of

CHUNK = 16_384
OVERLAP = 512
LIMIT = 2048
#: Characters encoded in one call to the library, and words whose counts a worker keeps.
BATCH = 1 << 19
KNOWN_WORDS = 600_000

def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoded:
    """The tokens of a chunk: how many, and where they start. A start is looked up only where it is asked for."""

    def __init__(self, n: int, start: Callable[[int], int]):
        self.n, self.start = n, start

    def first(self, place: int) -> int:
        """The first token that starts at ``place`` or later."""
        return bisect_left(range(self.n), place, key=self.start)

    def starts(self, low: int, high: int) -> list[int]:
        """Where the tokens start that do so in [low, high)."""
        return [self.start(k) for k in range(self.first(low), self.first(high))]


class Encoder:
    """What counting needs of a tokenizer.

    ``attach`` is 0 if it drops white space, so that a word's first token starts at the word, and 1 if a single
    space before a word belongs to the word's first token.
    """

    def __init__(self, counts: Callable[[list[str]], list[int]], encoded: Callable[[str], Encoded], attach: int):
        self.counts, self.encoded, self.attach = counts, encoded, attach
        self.stable = re.compile(r"(?<=\S) (?=\S)" if attach else r"(?<=[ \t\n\x0b\x0c\r])(?=\S)")
        self.known: dict[str, int] = {}

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Where a token may start in text[low:high] whatever stands before and after."""
        return [m.start() for m in self.stable.finditer(text, max(low, 0), high)]


#: Parts of a pattern that match no white space: plain characters, letters or digits, and classes that leave it out.
_NO_SPACE = re.compile(r"[^\s\\\[\](){}.*+?^$|]+|\[?\\p\{[LN]\}\]?\+?|\[\^[^\]]*\\s[^\]]*\]\+?")


def parts_words(spec: dict) -> bool:
    """Whether no token of a tokenizers file reaches over ASCII white space and none stands for it, as far as its added
    tokens, normalisers and first pre-tokenizer prove; then the tokens of a text are those of its words."""
    steps = lambda x, inner: [] if not x else x[inner] if x["type"] == "Sequence" else [x]
    for t in spec.get("added_tokens") or []:
        if re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            return False
    for n in steps(spec.get("normalizer"), "normalizers"):
        blank = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
        if not blank and n["type"] not in ("NFC", "NFD", "Lowercase"):
            return False
    cuts = steps(spec.get("pre_tokenizer"), "pretokenizers")
    if not cuts or any(c.get("add_prefix_space") or c["type"] == "Metaspace" for c in cuts):
        return False
    first = cuts[0]
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]:
        return all(_NO_SPACE.fullmatch(x) for x in first["pattern"].get("Regex", " ").split("|"))
    return first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


@cache
def encoder(path: str) -> Encoder:
    """Of a tokenizers .json file or a sentencepiece .model; nothing is added, cut off or padded."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        encode = lambda texts: own.encode_batch_fast(texts, add_special_tokens=False)
        drops = parts_words(json.loads(own.to_str()))

        def encoded(text: str) -> Encoded:
            found = own.encode(text, add_special_tokens=False)
            return Encoded(len(found), lambda k: found.token_to_chars(k)[0])

        return Encoder(lambda x: [len(e) for e in encode(x)], encoded, 0 if drops else 1)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encoded(text: str) -> Encoded:
        starts = _starts(text, model.encode(text, return_type="proto").pieces)
        return Encoded(len(starts), starts.__getitem__)

    return Encoder(lambda x: [len(e) for e in model.encode(x, num_threads=1)], encoded, 1)


def _starts(text: str, pieces) -> list[int]:
    """Where pieces start, in characters: the library counts bytes."""
    at = np.zeros(len(text.encode()) + 1, np.int64)
    sizes = [len(c.encode()) for c in text]
    at[np.cumsum([0, *sizes])] = np.arange(len(text) + 1)
    return np.maximum.accumulate(at)[[p.begin for p in pieces]].tolist() if len(pieces) else []


def count_chunked(own: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks."""
    total, start, end = 0, 0, chunk
    left, base, done = own.encoded(text[:end]), 0, 0  # a chunk, where it begins, and how many of its tokens are counted
    while end < len(text):
        width = overlap
        while True:
            low = max(end - width, start + 1)
            right = own.encoded(text[low : low + chunk + width])
            splice = _common(own, text, left, base, right, low, end)
            if splice is not None or low == start + 1:
                break
            width *= 2
        if splice is None:
            end = start + 2 * (end - start)
            left, base, done = own.encoded(text[start:end]), start, 0
            continue
        total += left.first(splice - base) - done
        left, base, done, start, end = right, low, right.first(splice - low), splice, low + chunk + width
    return total + left.n - done


def _common(own: Encoder, text: str, left: Encoded, base: int, right: Encoded, low: int, end: int) -> int | None:
    """The first stable boundary in text[low:end] where both chunks start a token and then agree."""
    found = own.boundaries(text, low + 1, end)
    if not found:
        return None
    last = found[-1] + 1
    a, b = ([at + x for x in e.starts(low - at, last + own.attach - at)] for e, at in ((left, base), (right, low)))
    before, after = set(a), set(b)
    for p in found:
        at = {p, p + own.attach}
        if at & before and at & after and [x for x in a if p <= x < found[-1]] == [x for x in b if p <= x < found[-1]]:
            return p
    return None


def _batches(texts: list[str]) -> Iterator[list[int]]:
    batch, held = [], 0
    for i, text in enumerate(texts):
        batch.append(i)
        held += len(text)
        if held >= BATCH:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def _by_words(own: Encoder, texts: pa.Array) -> np.ndarray:
    """Token counts as sums over words, each distinct word counted by the library unless it is known."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    if len(own.known) > KNOWN_WORDS:
        own.known.clear()
    new = [w for w in distinct if w not in own.known]
    own.known.update(zip(new, own.counts(new), strict=True))
    each = np.fromiter((own.known[w] for w in distinct), np.int64, len(distinct))
    sums = np.concatenate([[0], np.cumsum(each[words.indices.to_numpy()])]) if len(words) else np.zeros(1, np.int64)
    return sums[offsets[1:]] - sums[offsets[:-1]]


def counts(texts: pa.Array, own: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Token counts of texts without nulls; those over ``chunk`` characters in chunks."""
    out = np.zeros(len(texts), np.int64)
    long = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(long):
        out[i] = count_chunked(own, texts[int(i)].as_py(), chunk, overlap)
    short = np.flatnonzero(~long)
    held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[short]) // (BATCH * (1 if own.attach else 8))
    for part in np.split(short, np.flatnonzero(np.diff(held)) + 1) if len(short) else []:
        some = texts.take(pa.array(part))
        out[part] = own.counts(some.to_pylist()) if own.attach else _by_words(own, some)
    return out


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with the number of tokens of each whole text; a null text counts as an empty one.

    ``tokenizer`` is the path of a file that every executor has. A very long text is read in chunks. The column ``into``,
    in any case, is replaced if it is there and is not the text itself; all others stay.
    """
    rows = docs.drop(into)
    at = place_of(rows, text)
    schema = rows.select("*", F.lit(0).cast("long").alias(into)).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in batches:
            texts = pc.fill_null(b.column(at), "")
            n = pa.array(counts(texts.cast(pa.string()), own, chunk, overlap), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, into])

    return rows.mapInArrow(counted, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    out = with_token_counts(docs.withColumn("n_bytes", F.octet_length("text").cast("long")), path_of("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
