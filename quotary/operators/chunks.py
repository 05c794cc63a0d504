"""Prose chunks, restarts and request batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotary.functions.text import latin_key, words


def fixed_chunks(docs: DataFrame, doc: str, text: str, size: int = 30) -> DataFrame:
    """(doc, chunk_idx, c_start, c_end): X16's last resort, chunks of so many words."""
    n = docs.select(doc, F.size(words(F.col(text))).cast("long").alias("n")).where("n > 0")
    i = n.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / size) - 1)))
    return i.select(doc, "chunk_idx", (F.col("chunk_idx") * size).alias("c_start"), F.least((F.col("chunk_idx") + 1) * size, F.col("n")).alias("c_end"))


def repeated_runs(keys: list[str], n: int, within: int) -> list[dict]:
    """Runs of n words or more that come again n to n + within words on, {i, j, n}: from each start the nearest repeat, as far
    as the words are equal, up to the repeat; a run that begins inside the one before is left out. Empty keys equal nothing."""
    ids: dict[str, int] = {"": 0}
    return _repeated(np.array([ids.setdefault(k, len(ids)) for k in keys], np.int64), n, within)


def _repeated(w: np.ndarray, n: int, within: int) -> list[dict]:
    """repeated_runs of numbers that stand for the keys, 0 for the empty one. Only places inside long enough runs are looked at one by one."""
    shift, length = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    for k in range(n, min(n + within, len(w) - n) + 1):
        same = (w[:-k] == w[k:]) & (w[:-k] != 0)
        edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, stop = edges[::2], edges[1::2]  # where each run of equal words begins and ends
        some = stop - first >= n
        count = (stop - first - n + 1)[some]
        at = np.repeat(first[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        run, new = np.repeat(stop[some], count) - at, shift[at] == 0
        shift[at[new]], length[at[new]] = k, np.minimum(run[new], k)
    out, reached = [], 0
    for i in np.flatnonzero(shift).tolist():
        if i >= reached:
            out.append({"i": i, "j": i + int(shift[i]), "n": int(length[i])})
            reached = i + int(length[i])
    return out


#: Words that are compared with themselves at a time: some MB.
TOGETHER = 1 << 19


def repeats_of(n: int, within: int) -> Callable[[Column], Column]:
    """repeated_runs over an array column of keys' hashes, 0 for the empty one. Rows are laid out one after another, so far apart
    that none meets the next, and compared together."""
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int32())]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("i", "j", "n")])))
    def runs(keys: pa.Array) -> pa.Array:
        values, edges, out = keys.values.to_numpy(), keys.offsets.to_numpy(), [[] for _ in range(len(keys))]
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + TOGETHER, "right")) - 1)
            begins = edges[at:to] - edges[at] + np.arange(to - at) * (n + within)
            laid = np.zeros(int(edges[to] - edges[at]) + (to - at) * (n + within), np.int64)
            laid[np.arange(edges[to] - edges[at]) + np.repeat(np.arange(to - at) * (n + within), np.diff(edges[at : to + 1]))] = values[edges[at] : edges[to]]
            for r in _repeated(laid, n, within):
                row = int(np.searchsorted(begins, r["i"], "right")) - 1
                out[at + row].append({"i": r["i"] - int(begins[row]), "j": r["j"] - int(begins[row]), "n": r["n"]})
            at = to
        return pa.array(out, kind)

    return runs


def find_repeats(docs: DataFrame, doc: str, text: str, n: int = 5, within: int = 30, whole: int = 8, own: int = 3, formula: tuple[str, ...] = (), deliberate: str = "(?!)") -> DataFrame:
    """(doc, from_pos, again_pos, n_words): X18. Runs of n words or more that the document says again `within` words on.

    From the start, the first place of the next words that says n words again; the run grows while its words are equal and
    it doesn't reach the repeat. Reading goes on past the run. A run counts if it has `whole` words or the repeat follows at
    most one word after it, if `own` of its words are no formula and it isn't said so on purpose. A row is compared with itself,
    shifted by each distance in turn; only runs leave it."""
    w = docs.select(doc, F.explode(F.array(F.transform(words(F.col(text)), latin_key))).alias("w")).where(F.size("w") >= 2 * n)
    taken = w.select(doc, "w", repeats_of(n, within)(F.transform("w", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))).alias("_r")).select(doc, "w", F.explode("_r").alias("r"))
    said = F.slice("w", F.col("r.j") + 1, F.col("r.n"))
    words_of_its_own = F.size(F.filter(said, lambda x: ~x.isin(*formula))) if formula else F.size(said)
    good = ((F.col("r.n") >= whole) | (F.col("r.j") - F.col("r.i") - F.col("r.n") <= 1)) & (words_of_its_own >= own) & ~F.array_join(said, " ").rlike(deliberate)
    return taken.where(good).select(doc, F.col("r.i").cast("long").alias("from_pos"), F.col("r.j").cast("long").alias("again_pos"), F.col("r.n").cast("long").alias("n_words"))


def broken_off(rows: DataFrame, key: str, order: str, text: str, ending: str = r"(\.\.\.|…)$", share: float = 0.6) -> DataFrame:
    """(key, order, n): X18. Rows that break off, by their ending, and whose last sentence the next row says again: of its
    words but the last, two at least, `share` stand among as many words and three more of the next row's beginning."""
    nxt = F.lead(text).over(Window.partitionBy(key).orderBy(order))
    r = rows.withColumn("_next", nxt).where(F.trim(text).rlike(ending) & F.col("_next").isNotNull())
    last = F.regexp_replace(F.element_at(F.split(F.trim(text), r"[.،؟!:؛]\s"), -1), ending, "")
    r = r.select(key, order, "_next", F.explode(F.array(F.transform(words(last), latin_key))).alias("_t"))
    head = F.transform(F.slice(words(F.col("_next")), 1, F.size("_t") + 3), latin_key)
    whole = F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0)))
    n = F.size(F.filter(whole, lambda x: F.array_contains(head, x)))
    return r.where((F.size(whole) >= 2) & (n >= F.greatest(F.lit(2.0), F.size(whole) * share))).select(key, order, n.cast("long").alias("n"))


def pack(sizes: Column, least: int, most: int) -> Column:
    """Array of group numbers for an array of unit sizes: a group is closed at a unit's end once it has `least`, and
    before a unit that would take it over `most`."""
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] >= least) | ((s["n"] > 0) & (s["n"] + x > most))
        g = F.when(full, s["g"] + 1).otherwise(s["g"])
        return F.struct(g.alias("g"), F.when(full, x).otherwise(s["n"] + x).alias("n"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def chunk_prose(docs: DataFrame, doc: str, text: str, least: int = 10, most: int = 45) -> DataFrame:
    """(doc, chunk_idx, w_start, w_end, text): X16. Chunks end at sentence ends, or at line ends where there are enough
    of those; sentences are packed to `least` words or more, up to `most` where sentences allow."""
    n_words, lines = F.size(words(F.col(text))), F.size(F.split(F.col(text), "\n"))
    parts = F.when(lines >= n_words / 30, F.split(F.col(text), "\n")).otherwise(F.split(F.col(text), r"(?<=[.!?])\s+"))
    units = docs.select(doc, F.filter(F.transform(parts, lambda x: F.array_join(words(x), " ")), lambda x: x != "").alias("u"))
    sizes = F.transform("u", lambda x: F.size(F.split(x, " ")))
    rows = units.select(doc, F.explode(F.arrays_zip(F.col("u"), sizes.alias("n"), pack(sizes, least, most).alias("g"), F.sequence(F.lit(0), F.greatest(F.size("u") - 1, F.lit(0))).alias("i"))).alias("r")).where("r.u is not null")
    g = rows.groupBy(doc, F.col("r.g").cast("long").alias("chunk_idx")).agg(F.array_sort(F.collect_list(F.struct("r.i", "r.u"))).alias("p"), F.sum("r.n").cast("long").alias("n"))
    upto = Window.partitionBy(doc).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("w_start", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long")).select(doc, "chunk_idx", "w_start", (F.col("w_start") + F.col("n")).alias("w_end"), F.array_join(F.transform("p", lambda x: x["u"]), " ").alias("text"))


def batches(rows: DataFrame, keys: list[str], number: str, size: int = 12) -> DataFrame:
    """Consecutive numbers in batches of at most `size`; (keys, first, last, n)."""
    order = Window.partitionBy(*keys).orderBy(number)
    isle = rows.withColumn("_isle", F.col(number) - F.row_number().over(order))
    part = isle.withColumn("_b", F.floor((F.row_number().over(Window.partitionBy(*keys, "_isle").orderBy(number)) - 1) / size))
    return part.groupBy(*keys, "_isle", "_b").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_isle", "_b")


def requests(rows: DataFrame, ledger: DataFrame, run: str, number: str, text: str, *, model: str, cap: float, price: tuple[float, float], out: int, size: int = 12) -> DataFrame:
    """(run, first, last, n, worst, allowed): X46. The requests that are still to be sent for rows of (run, number, text), by a
    ledger(hash, state, cost) of earlier ones, whose hashes request_hash gives.

    Rows with a `done` entry ask for nothing, so that planning again after a failure sends nothing twice. Rows with a `failed` one are asked on their own, the others in batches
    of consecutive numbers, `size` at most. `worst` is what a request may cost, at one token a character and `out` tokens back a row, at
    the `price` of both; it's allowed while the run's costs so far and the worst of all requests before and of itself keep to `cap`. Null texts ask for nothing; entries that repeat count
    once by their best state, their costs add up in the run of the first row that has them."""
    hashed = rows.where(F.col(text).isNotNull()).withColumn("_h", request_hash(F.col(text), model))
    known = ledger.groupBy(F.col("hash").alias("_h")).agg(F.bool_or(F.col("state") == "done").alias("_done"), F.bool_or(F.col("state") == "failed").alias("_failed"), F.sum("cost").alias("_cost"))
    told = hashed.join(known, "_h", "left")
    spent = told.groupBy(run, "_h").agg(F.first("_cost").alias("c")).groupBy(run).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("_spent"))
    todo = told.where(~F.coalesce("_done", F.lit(False))).withColumn("_alone", F.coalesce("_failed", F.lit(False)))
    order = Window.partitionBy(run, "_alone").orderBy(number)
    isle = todo.withColumn("_isle", F.when(F.col("_alone"), F.col(number)).otherwise(F.col(number) - F.row_number().over(order)))
    part = isle.withColumn("_b", F.floor((F.row_number().over(Window.partitionBy(run, "_alone", "_isle").orderBy(number)) - 1) / size))
    asked = part.groupBy(run, "_alone", "_isle", "_b").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("_chars"))
    worst = (F.col("_chars") * price[0] + F.col("n") * out * price[1]) / 1e6
    before = Window.partitionBy(run).orderBy("first", "_alone").rowsBetween(Window.unboundedPreceding, 0)
    costed = asked.join(spent, run).withColumn("worst", worst).withColumn("allowed", F.col("_spent") + F.sum("worst").over(before) <= cap)
    return costed.select(run, "first", "last", "n", "worst", "allowed")


def request_hash(text: Column, model: str) -> Column:
    """What names a request: its text and the model that is asked."""
    return F.sha1(F.concat(F.lit(model), F.lit("\n"), text))
