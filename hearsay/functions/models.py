"""Where models plug in: deterministic callables over Arrow batches, each with a rule to fall back on."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: calls to a model that a task has waiting at once.
CONCURRENCY = 8


def hash_embedder(size: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """Unit vectors from hashed character triples: a stand-in for an embedding model that gives the same vectors everywhere."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for k in range(max(len(t) - 2, 0)):
                h = int.from_bytes(hashlib.blake2b(t[k : k + 3].encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(text: Column, embed: Callable[[Sequence[str]], np.ndarray], batch: int = 64) -> Column:
    """Vectors of texts, in batches; a null text is empty. A model that returns another number of vectors fails the task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            own, out = part.fillna("").tolist(), []
            for i in range(0, len(own), batch):
                got = embed(own[i : i + batch])
                if len(got) != len(own[i : i + batch]):
                    raise ValueError("the model returned another number of vectors")
                out += [v.astype(np.float32).tolist() for v in np.asarray(got)]
            yield pd.Series(out)

    return run(text)


def classified(text: Column, classify: Callable[[Sequence[str]], Sequence[str | None]], labels: Sequence[str], fallback: Column, batch: int = 20) -> Column:
    """A model's label, or the rule's where the model fails, is silent, or names no label."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            own, out = part.fillna("").tolist(), []
            for i in range(0, len(own), batch):
                try:
                    got = list(classify(own[i : i + batch]))
                except Exception:  # noqa: BLE001  a model's failure is data here: the rule decides
                    got = []
                got += [None] * (min(batch, len(own) - i) - len(got))
                out += [g if g in labels else None for g in got[: len(own[i : i + batch])]]
            yield pd.Series(out, dtype=object)

    return F.coalesce(run(text), fallback)


def at_once(call: Callable[[Any], Any], items: Sequence[Any], concurrency: int = CONCURRENCY) -> list[tuple[Any, str | None]]:
    """(answer, error) of a call for each item, in order, so many at once; a call that raises leaves its message and no answer."""

    def tried(item: Any) -> tuple[Any, str | None]:
        try:
            return call(item), None
        except Exception as e:  # noqa: BLE001  recorded beside the item
            return None, f"{type(e).__name__}: {e}"

    if concurrency <= 1 or len(items) < 2:
        return [tried(item) for item in items]
    with ThreadPoolExecutor(min(concurrency, len(items))) as pool:
        return list(pool.map(tried, items))


def mapped_calls(df: DataFrame, key: str, text: str, call: Callable[[str], str], concurrency: int = CONCURRENCY) -> DataFrame:
    """(key, answer, error) of a call for each row, spread over tasks, of which each waits for so many at once; a call that raises leaves its message and no answer."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            told = at_once(call, list(part[text]), concurrency)
            yield pd.DataFrame({key: part[key], "answer": [a for a, _ in told], "error": [e for _, e in told]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, answer string, error string")


def checked_risk(level: Column, score: Column, reasons: Column, rule_level: Column, rule_score: Column) -> Column:
    """struct(level, score, reasons, source): a model's judgement if its level is known and its score lies in 0..100, else the rule's; six reasons at most."""
    ok = F.coalesce(level.isin("low", "medium", "high") & score.between(0, 100), F.lit(False))
    return F.struct(F.when(ok, level).otherwise(rule_level).alias("level"), F.when(ok, score).otherwise(rule_score).alias("score"), F.when(ok, F.slice(F.coalesce(reasons, F.array().cast("array<string>")), 1, 6)).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(ok, "model").otherwise("rule").alias("source"))


def prescreened(answers: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """Every item with publish, reject or hold: what a model answered, hold where the answer is missing or is none of these."""
    own = answers.where(F.col("answer").isin("publish", "reject", "hold")).groupBy(key).agg(F.min("answer").alias("answer"))
    return items.join(own, key, "left").withColumn("answer", F.coalesce("answer", F.lit("hold")))
