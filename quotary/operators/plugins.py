"""What the caller brings along: lookups of places, clients that answer requests, checks, kinds of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.operators.chunks import request_hash


def placed(views: DataFrame, address: str, lookup: Callable[[list[str]], list[dict | None]] | DataFrame, columns: str = "city string, country string, hosting boolean") -> DataFrame:
    """views with the columns of a place: D1. `lookup` is a table (address, columns) or a function that is given distinct addresses, some hundred at
    a time, inside a task, and returns a place or null for each. Each address is looked up once, however many views it has; views without an
    address or a place have nulls. Columns of views by the places' names are replaced."""
    names = [c.split()[0] for c in columns.split(",")]
    if isinstance(lookup, DataFrame):
        places = lookup.select(F.col(address).alias("_a"), *names).dropDuplicates(["_a"])
    else:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), 500):
                    some = batch["_a"].iloc[lo : lo + 500].tolist()
                    found = lookup(some)
                    yield pd.DataFrame([{"_a": a, **{n: (p or {}).get(n) for n in names}} for a, p in zip(some, found, strict=True)])

        asked = views.where(F.col(address).isNotNull()).select(F.col(address).cast("string").alias("_a")).distinct()
        places = asked.mapInPandas(ask, f"_a string, {columns}")
    return views.drop(*names).join(places, F.col(address).cast("string") == F.col("_a"), "left").drop("_a")


def answered(requests: DataFrame, text: str, model: str, client: Callable[[], Callable[[str], tuple[str, float]]]) -> DataFrame:
    """(hash, state, answer, cost): D2. A ledger of answers: `client` makes, once a task, the function that gives a text's answer and its cost; a text for which it
    raises is `failed` without an answer or cost, so it's planned again (X46). Equal texts are asked once; null ones aren't. Write the
    result before using it: a task that is run again asks again."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            rows = []
            for h, t in zip(batch["hash"], batch["t"], strict=True):
                try:
                    answer, cost = call(t)
                    rows.append((h, "done", answer, float(cost)))
                except Exception:  # noqa: BLE001  whatever a client raises, the ledger has to say so
                    rows.append((h, "failed", None, 0.0))
            yield pd.DataFrame(rows, columns=["hash", "state", "answer", "cost"])

    asked = requests.where(F.col(text).isNotNull()).select(request_hash(F.col(text), model).alias("hash"), F.col(text).alias("t")).dropDuplicates(["hash"])
    return asked.mapInPandas(ask, "hash string, state string, answer string, cost double")


def with_kind(docs: DataFrame, kinds: DataFrame, kind: str, default: str) -> DataFrame:
    """docs with the columns of their kind: D4. kinds(kind, framing, two_parts) is a registry of document types; a kind that it lacks, or null, is read
    as `default`, which it must have."""
    if kinds.where(F.col("kind") == default).isEmpty():
        raise ValueError(f"no kind {default}")
    known = kinds.select(F.col("kind").alias("_k"), *[c for c in kinds.columns if c != "kind"])
    own = docs.join(known.select(F.col("_k").alias("_known")), F.col(kind) == F.col("_known"), "left")
    return own.withColumn("_k", F.coalesce("_known", F.lit(default))).drop("_known").join(known, "_k").drop("_k")
