"""Models behind adapters: embedding, reranking, generation and judging.

An adapter is a function from a DataFrame with a prompt or text column to one with the answer added. The stubs are
deterministic and local; results made with them are stub results. ``called`` wraps any blocking client with retries;
give its rows stable keys and write them before use, as tasks can be retried.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import first_words, strip, tokens
from quirespark.sources import store

#: Accepted names of the columns of a question sheet, without case and punctuation.
ALIASES = {
    "question": ("question", "questions", "prompt", "query"),
    "answer": ("answer", "answers", "goldanswer", "referenceanswer", "groundtruth"),
}


def resolved(df: DataFrame, role: str) -> str:
    """The name of the column that plays ``role``: the first that fits the earliest alias."""
    fits = [(ALIASES[role].index(said), k) for k, c in enumerate(df.columns) if (said := re.sub(r"[\W_]+", "", c).casefold()) in ALIASES[role]]
    if not fits:
        raise ValueError(f"no column for {role} among {df.columns}")
    return df.columns[min(fits)[1]]


Wait = Callable[[int, Exception], float | None]


def backoff(attempt: int, error: Exception) -> float:
    """Seconds before the next attempt: doubling, a minute at most, with some jitter."""
    return min(60, 2**attempt + random.random())


#: Names of errors that another attempt cannot mend, and of those that ask for patience.
HOPELESS = ("AuthenticationError", "PermissionDeniedError", "BadRequestError", "NotFoundError", "UnprocessableEntityError")
LIMITED = ("RateLimitError",)


def by_error_class(attempt: int, error: Exception) -> float | None:
    """Two seconds more each time, or as long as a rate limit says; no further attempt after a hopeless error."""
    kinds = {k.__name__ for k in type(error).__mro__}
    if kinds & {*HOPELESS}:
        return None
    wait = 2.0 * (attempt + 1)
    asked = re.search(r"(?i)wait\s+(\d+)\s*seconds", str(error)) if kinds & {*LIMITED} else None
    return max(wait, float(asked[1])) if asked else wait


def by_status(attempt: int, error: Exception) -> float:
    """For image models: doubling from a second, from 15 after status 429, which may ask for more in ``retry_after``."""
    if getattr(error, "code", None) != 429:
        return 2.0**attempt + random.random()
    return max(15 * 2.0**attempt, float(getattr(error, "retry_after", None) or 0)) + random.random()


class Hopeless(RuntimeError):
    """A model call that no further attempt can mend; it ends the run, as every other call would fail the same way."""


def tried(client: Callable[..., str], tries: int = 5, wait: Wait = backoff, delay: float = 0.0) -> Callable[..., str | None]:
    """``client``, called ``delay`` seconds after the last call and again after ``wait`` if it raises; None after ``tries``.
    If ``wait`` gives None the run fails."""

    def one(*asked: str) -> str | None:
        for attempt in range(tries):
            if delay:
                time.sleep(delay)
            try:
                return client(*asked)
            except Exception as error:
                seconds = wait(attempt, error)
                if seconds is None:
                    raise Hopeless(str(error)) from error
                if attempt + 1 < tries:
                    time.sleep(seconds)
        return None

    return one


def called(client: Callable[[str], str], prompt: str = "prompt", into: str = "output", tries: int = 5, wait: Wait = backoff, delay: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """An adapter that calls ``client`` for each prompt, as ``tried`` does."""
    one = tried(client, tries, wait, delay)

    def adapter(rows: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def ask(prompts: pd.Series) -> pd.Series:
            return prompts.map(one)

        return rows.withColumn(into, ask.asNondeterministic()(F.col(prompt)))

    return adapter


def either(first: Callable[[str], str], second: Callable[[str], str]) -> Callable[[str], str]:
    """A client that asks ``second`` if ``first`` raises."""

    def ask(text: str) -> str:
        try:
            return first(text)
        except Exception:
            return second(text)

    return ask


def rag_prompt(question: Column, context: Column) -> Column:
    """What a generator is asked with a context; without one, the question alone."""
    told = F.concat(F.lit("Answer the question from this context.\n\nContext:\n"), context, F.lit("\n\nQuestion:\n"), question)
    return F.when(F.coalesce(strip(context), F.lit("")) == "", question).otherwise(told)


def base_prompt(question: Column, max_tokens: int) -> Column:
    """What a generator is asked without retrieval, with its cap."""
    return F.concat(question, F.lit(f"\n\nAnswer in {max_tokens} tokens at most."))


def answer_of(response: Column, max_tokens: int) -> Column:
    """(text, count, truncated) of a chat response in JSON, cut to ``max_tokens`` words.

    The answer is the first choice's message. If that is empty though tokens were counted, it is the choice's text,
    else its message as it is, else the response.
    """
    get = lambda path: F.get_json_object(response, path)
    said = strip(F.coalesce(get("$.choices[0].message.content"), F.lit("")))
    filled = lambda c: F.when(strip(c) != "", c)
    other = F.coalesce(filled(get("$.choices[0].text")), filled(get("$.choices[0].message")), response)
    spent = F.coalesce(get("$.usage.completion_tokens").cast("int"), F.lit(0))
    return first_words(F.coalesce(F.when((said == "") & (spent > 0), other).otherwise(said), F.lit("")), max_tokens)


def echo(rows: DataFrame, prompt: str = "prompt", into: str = "output") -> DataFrame:
    """Stub of a generator: what follows the blank line of the prompt."""
    return rows.withColumn(into, F.regexp_replace(F.col(prompt), r"(?s)^.*?\n\n", ""))


def hashed_embedding(c: Column, dims: int = 64) -> Column:
    """Stub of an embedder: signed counts of hashed tokens, of length one."""

    @F.pandas_udf("array<double>")
    def embed(words: pd.Series) -> pd.Series:
        import xxhash

        def one(ws) -> list[float]:
            v = np.zeros(dims)
            for w in ws:
                h = xxhash.xxh64_intdigest(w)
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return words.map(lambda said: one(said.split(" ") if said else []))

    # As one string a text: the words of a batch of texts would take many times its size in Python.
    return embed(F.array_join(tokens(c), " "))


def overlap_score(query: Column, text: Column) -> Column:
    """Stub of a reranker: the share of the query's tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def judged(block: Column) -> Column:
    """The verdict in a judge's answer: what stands before the first comma of the last line that gives one."""
    found = F.regexp_extract_all(block, F.lit(r"(?m)^[^\S\n]*\*\*Result Accuracy\*\*:[^\S\n]*([^,\n]*)"), F.lit(1))
    return F.coalesce(strip(F.try_element_at(found, F.lit(-1))), F.lit(""))


def judge_prompt(question: Column, answer: Column, result: Column) -> Column:
    parts = (("Provided question", question), ("Official standard answer", answer), ("AI-generated answer", result))
    return F.concat_ws("\n", *(F.concat(F.lit(f"**{name}**: "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in parts))


def judge(rows: DataFrame, model: Callable[[DataFrame], DataFrame], start: int = 0, index: str = "row_index") -> DataFrame:
    """(index, question, Answer, Result, Result Accuracy) of the rows from ``start`` on that have anything; a row whose
    call failed or gave no verdict stays, with an empty one."""
    asked = judgeable(rows, "question", "Answer", "Result", start=start, index=index)
    asked = asked.withColumn("prompt", judge_prompt(F.col("question"), F.col("Answer"), F.col("Result")))
    verdict = judged(F.coalesce(F.col("output"), F.lit("")))
    own = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("question", "Answer", "Result"))
    return model(asked).select(index, *own, verdict.alias("Result Accuracy"))


def judgeable(rows: DataFrame, *columns: str, start: int = 0, index: str = "row_index") -> DataFrame:
    """Rows from ``start`` on in which at least one of ``columns`` has something."""
    some = F.lit(False)
    for c in columns:
        some = some | (strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return rows.filter(some & (F.col(index) >= start))


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is still to do: rows whose keys are not in ``done``."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")



def vectors(encode: Callable[[list[str]], list[list[float]]], text: str = "text", into: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """An embedder made of ``encode(texts)``, which is asked an Arrow batch at a time; vectors get length one, a null text
    has a null vector."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        there = np.flatnonzero(texts.notna())
        for i, v in zip(there, encode(texts.iloc[there].tolist()) if len(there) else [], strict=True):
            n = float(np.linalg.norm(v))
            out.iloc[i] = [float(x) / (n or 1.0) for x in v]
        return out

    return lambda rows: rows.withColumn(into, run(F.col(text)))


def scores(score: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", text: str = "text", into: str = "rerank") -> Callable[[DataFrame], DataFrame]:
    """A reranker made of ``score(pairs)``, which is asked an Arrow batch at a time."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(questions.fillna(""), texts.fillna(""), strict=True))), dtype=float)

    return lambda rows: rows.withColumn(into, run(F.col(question), F.col(text)))


def usable_models(wanted: tuple[str, ...], available: list[str]) -> tuple[str, ...]:
    """Those of ``wanted`` that a server offers; an error if it offers none."""
    found = tuple(m for m in wanted if m in available)
    if not found:
        raise ValueError(f"none of {wanted} is among {available}")
    return found


def maintained_embeddings(docs: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, model: str, text: str = "text") -> tuple[DataFrame, int]:
    """``docs`` with ``embedding``, and how many texts were embedded for that.

    Vectors are kept by the digest of their text, in a folder of the model's that only grows: a run embeds the texts
    that no run has embedded before, each once however many rows have it, and adds them in one commit. A text that
    goes and comes again is known. A null text is an empty one; a column ``embedding`` is replaced.
    """
    spark = docs.sparkSession
    folder = f"{path.rstrip('/')}/{hashlib.sha256(model.encode()).hexdigest()[:32]}"
    rows = docs.drop("embedding").withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    parts = [f"{folder}/{n}" for n in store.children(spark, folder) if store.exists(spark, f"{folder}/{n}/_SUCCESS")]
    known = spark.read.parquet(*parts) if parts else None
    new = rows.select("_digest", F.coalesce(F.col(text), F.lit("")).alias(text)).dropDuplicates(["_digest"])
    if known is not None:
        new = new.join(known.select("_digest"), "_digest", "left_anti")
    at = f"{folder}/{len(store.children(spark, folder)):08d}-{uuid.uuid4().hex[:8]}"
    embed(new).select("_digest", "embedding").write.parquet(at)
    made = spark.read.parquet(at)
    n = made.count()
    if not n:
        store.removed(spark, at)
    every = made if known is None else known.unionByName(made) if n else known
    # two runs at a time may both have embedded a text
    return rows.join(every.dropDuplicates(["_digest"]), "_digest", "left").drop("_digest"), n


def cached_embeddings(docs: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, model: str, signature: str) -> tuple[DataFrame, bool]:
    """``docs`` with vectors, and whether they were there already.

    ``embed`` adds ``embedding`` to a table of texts. Vectors are kept as Parquet in a folder for the model and the
    corpus signature, and taken from it if the rows there are those of ``docs``; else they are made and written anew.
    ``maintained_embeddings`` embeds what is new only.
    """
    spark = docs.sparkSession
    folder = f"{path.rstrip('/')}/{hashlib.sha256(f'{model}|{signature}'.encode()).hexdigest()[:32]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        kept = spark.read.parquet(folder)
        dims = kept.agg(F.countDistinct(F.size("embedding"))).first()[0]
        ids = [c for c in docs.columns if c in kept.columns and c != "embedding"]
        same = not docs.select(*ids).exceptAll(kept.select(*ids)).limit(1).count() and not kept.select(*ids).exceptAll(docs.select(*ids)).limit(1).count()
        if same and dims <= 1:
            return kept, True
    embed(docs).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder), False
